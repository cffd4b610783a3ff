"""Column helpers shared by the field normalisers.

Model responses are parsed with every leaf as a string, so that a number, a
quoted number and a null word can all be told apart and cleaned here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a model writes for "nothing".
NULL_WORDS = ["null", "none", "n/a"]
NULL_WORDS_CONTACT = ["null", "none", "n/a", "unknown"]
TRUE_WORDS = ["true", "yes", "y", "1"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used.

    Long rule chains would otherwise repeat their inputs in every branch.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Missing, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def text_or(c: Column, default: str) -> Column:
    return F.when(blank(c), F.lit(default)).otherwise(strip(c))


def optional_text(c: Column, null_words: list[str]) -> Column:
    """Trimmed text, null where blank or a null word."""
    return F.when(blank(c) | F.lower(c).isin(null_words), None).otherwise(strip(c))


def flag(c: Column) -> Column:
    """true / yes / y / 1 in any case; everything else is false."""
    return F.coalesce(F.lower(strip(c)).isin(TRUE_WORDS), F.lit(False))


def json_flag(c: Column) -> Column:
    """A JSON boolean that may be missing."""
    return F.coalesce(F.lower(c).isin("true", "1", "yes", "y", "on", "t"), F.lit(False))


def unit_interval(c: Column, default: float) -> Column:
    """A number clamped to 0…1; anything else becomes ``default``."""
    number = strip(c).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    )


def whole(c: Column) -> Column:
    """Integer literals and the whole part of decimals; null otherwise."""
    return F.when(strip(c).rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_extract(strip(c), r"^[+-]?\d+", 0).try_cast("long"))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Value of the first rule whose pattern occurs in the lower-case text."""
    low = F.lower(text)
    out = None
    for pattern, value in rules:
        hit = low.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.coalesce(out.otherwise(default), F.lit(default))


def text_list(items: Column, lower: bool = False) -> Column:
    """Trimmed non-blank entries, in order; null becomes an empty list."""
    kept = F.filter(items, lambda x: ~blank(x))
    trimmed = F.transform(kept, lambda x: F.lower(strip(x)) if lower else strip(x))
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(text_list(items))


def distinct_sorted(items: Column) -> Column:
    """Lists the service keeps as sets; sorted so that results are stable."""
    return F.array_sort(F.array_distinct(text_list(items)))
