"""Text built from records: prompt context lines, wrappers and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(items: Column, fn, separator: str = "\n") -> Column:
    return F.array_join(F.transform(items, fn), separator)


def _set(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def action_lines(items: Column) -> Column:
    return _lines(
        items,
        lambda a: F.concat(
            F.lit("- "), F.coalesce(a["description"], F.lit("Unknown")), F.lit(" (Owner: "), F.coalesce(a["owner"], F.lit("Unknown")), F.lit(")")
        ),
    )


def metadata_lines(record: Column, names: list[str]) -> Column:
    """``- key: value`` for every field that is not null, in order."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), record[n].cast("string")) for n in names])


def contact_context(name: Column, source: Column, phone: Column) -> Column:
    number = F.coalesce(_set(source), _set(phone))
    return F.concat_ws(
        "\n", F.concat(F.lit("- Customer Name: "), _set(name)), F.concat(F.lit("- Customer Phone: "), number)
    )


def analysis_context(a: Column) -> Column:
    """Lines of a finished analysis that help a later prompt."""
    items = a["extracted_items"]
    names = F.filter(F.transform(items["products"], lambda p: p["name"]), lambda n: n != "")
    todo = F.filter(F.transform(items["action_items"], lambda i: i["description"]), lambda d: d != "")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Call Summary: "), _set(a["summary"])),
        F.concat(
            F.lit("Customer Sentiment: "), a["sentiment"]["category"], F.lit(" (confidence "),
            F.coalesce(a["sentiment"]["confidence"].cast("string"), F.lit("N/A")), F.lit(")"),
        ),
        F.when(F.size(names) > 0, F.concat(F.lit("Products Discussed: "), F.array_join(names, ", "))),
        F.when(F.size(todo) > 0, F.concat(F.lit("Action Items: "), F.array_join(todo, "; "))),
        F.concat(F.lit("Customer Name: "), _set(items["contact_info"]["name"])),
        F.concat(F.lit("Customer Email: "), _set(items["contact_info"]["email"])),
    )


def instruction(system: Column, user: Column) -> Column:
    return F.concat(F.lit("[INST] "), system, F.lit("\n\n"), user, F.lit(" [/INST]"))


def chat(system: Column, user: Column) -> Column:
    def turn(role: str, text: Column) -> Column:
        return F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n"))

    return F.concat(turn("system", system), turn("user", user), F.lit("<|im_start|>assistant\n"))


def checklist(items: Column) -> Column:
    return _lines(
        items,
        lambda i: F.concat(
            F.lit("- [ ] "), i["task"],
            F.coalesce(F.concat(F.lit(" (@"), _set(i["assignee"]), F.lit(")")), F.lit("")),
            F.coalesce(F.concat(F.lit(" - Due: "), _set(i["due_date"])), F.lit("")),
            F.lit(" ["), i["priority"], F.lit("]"),
        ),
    )


def contact_lines(people: Column) -> Column:
    def one(p: Column) -> Column:
        ways = F.concat_ws(", ", _set(p["email"]), _set(p["phone"]))
        return F.concat(
            F.lit("- **"), p["name"], F.lit("**"),
            F.coalesce(F.concat(F.lit(" - "), _set(p["role"])), F.lit("")),
            F.coalesce(F.concat(F.lit(" at "), _set(p["company"])), F.lit("")),
            F.when(ways != "", F.concat(F.lit(" ("), ways, F.lit(")"))).otherwise(""),
        )

    return _lines(people, one)
