"""Salvage of JSON documents from raw model text.

The candidate search runs in the engine: a fold over the pieces of the text
between braces keeps a stack of open braces and the objects closed so far. An
object is kept only if it may be the document, so the fold holds a few, and a
response with thousands of objects, or a truncated one, costs little more than
its length. ``salvage_text`` states the same rule for one text in plain Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from callflow.functions import records

# Keys that mark a document of each kind, strict and relaxed.
MARKERS = {
    "analysis": (["ai_analysis"], ["ai_analysis"]),
    "scoring": (["agent_scoring"], ["agent_scoring", "overall_score"]),
    "fraud": (["fraud_detection", "fraud_detected"], ["fraud_detection", "fraud_detected"]),
    "tasks": (["tasks"], ["tasks"]),
    "email": (["follow_up_email"], ["follow_up_email"]),
}
WRAPPERS = {"analysis": "ai_analysis", "scoring": "agent_scoring", "fraud": "fraud_detection"}
# Levels of a document, and the fences and comments taken out of a response.
MAX_DEPTH = 4
FENCE = re.compile(r"```(?:json)?\s*")
COMMENT = re.compile(r"//(?<!://)(?!/)[^\n]*")
#: Numbers that JSON does not have become null.
NO_NUMBER = r"(?<=[:\[,\s])(?:NaN|-?Infinity)(?=\s*[,\]}])"
EMPTY = ["", "{}", "[]", "0", "0.0", "false"]

SCHEMAS = {
    "analysis": records.ANALYSIS_SCHEMA,
    "scoring": records.SCORING_SCHEMA,
    "fraud": records.FRAUD_SCHEMA,
    "tasks": records.TASKS_SCHEMA,
    "email": records.EMAIL_SCHEMA,
}


def _objects(text: str) -> list[tuple[int, int, int, bool]]:
    """Matched brace pairs as (start, end, nesting height, is outermost)."""
    opened: list[list[int]] = []  # position, height of what it holds
    found = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            opened.append([m.start(), 0])
        elif opened:
            start, inner = opened.pop()
            if opened:
                opened[-1][1] = max(opened[-1][1], inner + 1)
            found.append((start, m.end(), inner + 1, not opened))
    return sorted(found)


def _load(text: str, keys: list[str]):
    if not any(f'"{k}"' in text for k in keys):
        return None
    try:
        doc = json.loads(text, parse_constant=lambda _: None)
    except ValueError:
        return None
    return doc if isinstance(doc, dict) and any(k in doc for k in keys) else None


def salvage_text(raw: str | None, kind: str) -> str | None:
    """The document inside one raw response as JSON text, or None."""
    if not raw:
        return None
    text = COMMENT.sub("", FENCE.sub("", raw).strip())
    strict, relaxed = MARKERS[kind]
    pairs = _objects(text)

    best, size, reach = None, 0, 0
    for start, end, height, _ in pairs:
        if start < reach or height > MAX_DEPTH:
            continue
        reach = end
        if end - start > size:
            doc = _load(text[start:end], strict)
            if doc is not None:
                best, size = doc, end - start
    if best is None and kind == "analysis" and "{" in text:
        best = _load(text[text.index("{") : text.rfind("}") + 1], strict)
    if best is None:
        for start, end, _, outermost in reversed(pairs):
            if outermost:
                best = _load(text[start:end], relaxed)
                if best is not None:
                    break
    if not best:
        return None
    inner = best.get(WRAPPERS.get(kind, ""), best)
    return json.dumps(inner, ensure_ascii=False) if inner else None


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, computing ``value`` once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _keys(kind: Column, which: int) -> Column:
    return F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, keys[which]))) for k, keys in MARKERS.items()])


def _fields(text: Column) -> Column:
    """Top-level fields of a text that is one JSON object and nothing else; null otherwise."""
    whole = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    return _bound(whole, lambda objects: F.when(F.size(objects) == 1, F.get(objects, F.lit(0))))


def _marked(text: Column, keys: Column) -> Column:
    return F.exists(keys, lambda k: F.contains(text, F.concat(F.lit('"'), k, F.lit('"'))))


def _loads(text: Column, keys: Column) -> Column:
    """Whether ``text`` is an object with one of ``keys``; the words are looked for before it is parsed."""
    fields = _fields(text)
    return _marked(text, keys) & F.coalesce(F.exists(keys, lambda k: F.map_contains_key(fields, k)), F.lit(False))


def _closed(text: Column, keys: Column) -> Column:
    """Matched brace pairs (at, size, height, outer) that may be the document, in the order they close.

    Those no higher than ``MAX_DEPTH`` and not inside another such pair, and
    the outermost ones; both only with one of ``keys`` in their text.
    """
    stack, pair = "array<struct<at:int,peak:int,held:int>>", "array<struct<at:int,size:int,height:int,outer:boolean>>"
    seed = F.struct(F.lit(0).alias("pos"), F.array().cast(stack).alias("open"), F.array().cast(pair).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end, depth = (acc["pos"] + F.length(part)).alias("pos"), F.size(acc["open"])
        opened = F.struct(end, F.array_append(acc["open"], F.struct(end.alias("at"), (depth + 1).alias("peak"), F.size(acc["found"]).alias("held"))).alias("open"), acc["found"].alias("found"))

        def close(top: Column) -> Column:
            height, size = top["peak"] - depth + 1, end - top["at"] + 1
            under = F.get(acc["open"], depth - 2)
            raised = F.struct(under["at"].alias("at"), F.greatest(under["peak"], top["peak"]).alias("peak"), under["held"].alias("held"))
            rest = F.when(depth > 1, F.array_append(F.slice(acc["open"], F.lit(1), depth - 2), raised)).otherwise(F.array().cast(stack))
            low = height <= MAX_DEPTH
            kept = F.when(low, F.slice(acc["found"], F.lit(1), top["held"])).otherwise(acc["found"])
            wanted = (low | (depth == 1)) & _marked(F.substr(text, top["at"], size), keys)
            this = F.struct(top["at"].alias("at"), size.alias("size"), height.alias("height"), (depth == 1).alias("outer"))
            return F.struct(end, rest.alias("open"), F.when(wanted, F.array_append(kept, this)).otherwise(kept).alias("found"))

        closes = (F.right(part, F.lit(1)) == "}") & (depth > 0)
        return (
            F.when(F.right(part, F.lit(1)) == "{", opened)
            .when(closes, _bound(F.get(acc["open"], depth - 1), close))
            .otherwise(F.struct(end, acc["open"].alias("open"), acc["found"].alias("found")))
        )

    return F.aggregate(F.split(text, r"(?<=[{}])"), seed, step, lambda acc: acc["found"])


def _unwrapped(doc: Column, fields: Column, kind: Column) -> Column:
    """The value under the kind's wrapper if the document has one, null if that is empty; else the document."""
    wrapper = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WRAPPERS.items()], F.lit(""))
    inner = F.element_at(fields, wrapper)
    typed = F.element_at(F.from_json(doc, "map<string,variant>"), wrapper)  # a field's text comes without its quotes
    quoted = doc.rlike('"(?:' + "|".join(WRAPPERS.values()) + r')"\s*:\s*"')
    text = F.when(quoted, F.coalesce(F.schema_of_variant(typed) == "STRING", F.lit(False))).otherwise(F.lit(False))
    value = F.when(text, F.when(inner != "", F.to_json(typed))).otherwise(F.when(~inner.isin(EMPTY), inner))
    return F.when(F.map_contains_key(fields, wrapper), value).otherwise(doc)


def _span(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    first = F.instr(text, "{")
    return F.substr(text, first, F.length(text) - F.length(F.substring_index(text, "}", -1)) - first + 1)


def _plain(span: Column) -> Column:
    """Whether the braces of a valid object are its structure, at most ``MAX_DEPTH`` levels of it.

    With strings and all else taken out, the braces left must be all there are,
    and vanish when innermost pairs are struck out once per level.
    """
    gone = lambda text, sign: F.replace(text, F.lit(sign), F.lit(""))

    def fits(braces: Column) -> Column:
        struck = braces
        for _ in range(MAX_DEPTH):
            struck = gone(struck, "{}")
        return (struck == "") & (F.octet_length(braces) == F.octet_length(span) - F.octet_length(gone(gone(span, "{"), "}")))

    few_escapes = F.octet_length(span) - F.octet_length(gone(span, "\\")) < 1000  # the pattern goes a level down for each
    return few_escapes & _bound(F.regexp_replace(span, r'"(?:[^"\\]++|\\.)*+"|[^{}"]++', ""), fits)


def _search(text: Column, kind: Column) -> Column:
    strict, relaxed = _keys(kind, 0), _keys(kind, 1)
    cut = lambda p: F.substr(text, p["at"], p["size"])

    def choose(found: Column) -> Column:
        low = F.filter(found, lambda p: p["height"] <= MAX_DEPTH)
        none = F.struct(F.lit(0).alias("size"), F.lit(None).cast("string").alias("doc"))
        longest = F.aggregate(low, none, lambda acc, p: F.when((p["size"] > acc["size"]) & _loads(cut(p), strict), F.struct(p["size"].alias("size"), cut(p).alias("doc"))).otherwise(acc), lambda acc: acc["doc"])
        span = _span(text)
        whole = F.when((kind == "analysis") & text.contains("{") & _loads(span, strict), span)
        outer = F.filter(found, lambda p: p["outer"])
        last = F.aggregate(outer, F.lit(None).cast("string"), lambda acc, p: F.when(_loads(cut(p), relaxed), cut(p)).otherwise(acc))
        return F.coalesce(longest, whole, last)

    both = F.array_distinct(F.concat(strict, relaxed))
    searched = _bound(_bound(_closed(text, both), choose), lambda doc: _unwrapped(doc, _fields(doc), kind))

    def at_once(span: Column, fields: Column) -> Column:
        """Most responses hold one plain object: then that is the longest one, and no search is needed."""
        there = F.coalesce(F.exists(strict, lambda k: F.map_contains_key(fields, k)), F.lit(False))
        return F.when(there & _plain(span), _unwrapped(span, fields, kind)).otherwise(searched)

    found = _bound(_span(text), lambda span: _bound(_fields(span), lambda fields: at_once(span, fields)))
    return F.when(_marked(text, both), found)


def salvage(raw: Column, kind: str | Column) -> Column:
    """JSON text of the document in ``raw``; ``kind`` is a key of MARKERS.

    The longest object of at most ``MAX_DEPTH`` levels with the key of its
    kind; for an analysis else what lies between the first and the last brace;
    else the last outermost object with a key. The value of the kind's wrapper
    is taken if it is there, and null if that is empty.
    """
    named = F.lit(kind) if isinstance(kind, str) else kind

    def without(text: Column, signs: list[str], pattern: str, instead: str = "") -> Column:
        there = reduce(or_, [text.contains(x) for x in signs])
        return F.when(there, F.regexp_replace(text, pattern, instead)).otherwise(text)

    clean = _bound(without(raw, ["```"], FENCE.pattern), lambda text: without(text, ["//"], COMMENT.pattern))
    numbers = _bound(clean, lambda text: without(text, ["NaN", "Infinity"], NO_NUMBER, "null"))
    return _bound(numbers, lambda text: _search(text, named))


def parse(doc: Column, kind: str) -> Column:
    """Typed struct of a salvaged document with string leaves."""
    return F.from_json(doc, SCHEMAS[kind])


def role_object(raw: Column) -> Column:
    """JSON of a role answer: the fenced block, else the first balanced object."""
    fenced = F.regexp_extract(raw, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    usable = (fenced != "") & F.try_parse_json(fenced).isNotNull()
    return F.when(usable, fenced).otherwise(_first_object(raw))


def _first_object(raw: Column) -> Column:
    """The object that the first opening brace begins, if it closes and is valid JSON."""
    seed = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, part: Column) -> Column:
        end, brace = acc["pos"] + F.length(part), F.right(part, F.lit(1))
        depth = acc["depth"] + F.when(brace == "{", 1).when((brace == "}") & (acc["depth"] > 0), -1).otherwise(0)
        done = acc["end"].isNull() & (acc["depth"] == 1) & (depth == 0)
        return F.struct(end.alias("pos"), depth.alias("depth"), F.when(done, end).otherwise(acc["end"]).alias("end"))

    def cut(text: Column) -> Column:
        first = F.instr(text, "{")
        end = F.aggregate(F.split(text, r"(?<=[{}])"), seed, step, lambda acc: acc["end"])
        piece = F.substr(text, first, end - first + 1)
        return F.when(_fields(piece).isNotNull(), piece)

    return _bound(raw, cut)


def outer_object(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` if that is valid JSON."""
    span = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when((span != "") & F.try_parse_json(span).isNotNull(), span)


def error_envelope(raw: Column, marker: str) -> Column:
    """What is worth keeping of a response that holds no document."""
    return F.struct(
        F.lit("Could not extract valid JSON from output").alias("error"),
        F.length(raw).cast("long").alias("output_length"),
        raw.contains(f'"{marker}"').alias("contains_marker"),
        F.substring(raw, 1, 100).alias("first_100_chars"),
        F.right(raw, F.lit(100)).alias("last_100_chars"),
    )


def unwrap(doc: Column, key: str) -> Column:
    """The nested object under ``key`` if present, else the document itself."""
    return F.coalesce(F.get_json_object(doc, f"$.{key}"), doc)


def candidates(raw: Column) -> Column:
    """Balanced objects without inner braces, longest first."""
    every = F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), 0)
    valid = F.filter(every, lambda t: F.try_parse_json(t).isNotNull())
    return F.array_sort(valid, lambda a, b: F.length(b) - F.length(a))


def by_strategy(df: DataFrame, keys: list[str], strategies: list[DataFrame]) -> DataFrame:
    """First strategy that yields a document wins, per key."""
    union = None
    for rank, found in enumerate(strategies):
        part = found.select(*keys, F.col("doc"), F.lit(rank).alias("rank")).where(F.col("doc").isNotNull())
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(*keys).agg(F.min_by("doc", "rank").alias("doc"), F.min("rank").alias("strategy"))
    return df.select(*keys).join(best, keys, "left")


def sanitize_numbers(value: Column, kind: DataType | None = None) -> Column:
    """NaN and infinities become null, in a number or anywhere inside arrays, maps and structs of type ``kind``."""
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sanitize_numbers(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: sanitize_numbers(x, kind.valueType))
    if isinstance(kind, StructType):
        fields = [sanitize_numbers(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if kind is not None and not isinstance(kind, (FloatType, DoubleType)):
        return value
    bad = [float("inf"), float("-inf")]
    return F.when(F.isnan(value) | value.isin(bad), None).otherwise(value)


def sanitize_frame(df: DataFrame) -> DataFrame:
    """Every column with its NaN and infinite numbers made null."""
    return df.select(*[sanitize_numbers(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
