"""The salvage of the engine against the rule stated in plain Python, on random and on large texts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from callflow.operators import responses


def engine(spark, rows):
    df = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rows)], "i int, kind string, raw string")
    got = df.select("i", responses.salvage(F.col("raw"), F.col("kind")).alias("doc")).collect()
    return [r.doc for r in sorted(got, key=lambda r: r.i)]


def same(a, b):
    return (a is None) == (b is None) and (a is None or json.loads(a) == json.loads(b))


def value(rng, depth):
    kind = rng.random()
    if depth > 0 and kind < 0.35:
        return {rng.choice(["a", "b", "tasks", "ai_analysis", "fraud_detected", "overall_score"]): value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth > 0 and kind < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, "text", "a \" quote", "{", "}", "ü // no", True, None, "", 0])


def response(rng, kind):
    strict, relaxed = responses.MARKERS[kind]
    parts = []
    for _ in range(rng.randint(0, 4)):
        doc = {rng.choice([*strict, *relaxed, "other"]): value(rng, rng.randint(0, 5)) for _ in range(rng.randint(1, 2))}
        text = json.dumps(doc, ensure_ascii=False, indent=rng.choice([None, 2]))
        parts.append(rng.choice([text, f"```json\n{text}\n```", text[: rng.randint(0, len(text))], text + " // end\n", "{" + text + "}"]))
        parts.append(rng.choice(["", "Sure: ", "}", "{", "\n", "see https://x/y "]))
    return "".join(parts)


def test_salvage_in_the_engine_follows_the_rule(spark):
    rng = random.Random(11)
    rows = [(k, response(rng, k)) for k in responses.MARKERS for _ in range(250)]
    rows += [("tasks", None), ("tasks", ""), ("email", "{}"), ("analysis", '{"ai_analysis": {}}'), ("fraud", '{"fraud_detection": null}'), ("analysis", 'x {"ai_analysis": {"s": "a } b"}} y')]
    got = engine(spark, rows)
    wrong = [(k, raw, a, responses.salvage_text(raw, k)) for (k, raw), a in zip(rows, got, strict=True) if not same(a, responses.salvage_text(raw, k))]
    assert not wrong, wrong[:3]
    assert sum(a is not None for a in got) > 300


def test_many_siblings_and_cut_off_texts(spark):
    tasks = '{"tasks": [{"title": "x"}, {"title": "y"}]}'
    many = '{"a": 1} ' * 1000
    rows = [("tasks", many + tasks), ("tasks", "[" + many + "] " + tasks + "{" * 500), ("tasks", '{"tasks": [' + '{"title": "t"},' * 1000 + '{"title": "t"}]}'), ("tasks", '{"tasks": [' + '{"title": "t"},' * 1000), ("tasks", "{" * 3000), ("tasks", "}" * 3000 + tasks), ("tasks", '{"x":' * 300 + "1" + "}" * 300 + tasks)]
    began = time.time()
    got = engine(spark, rows)
    assert time.time() - began < 30
    assert all(same(a, responses.salvage_text(raw, k)) for (k, raw), a in zip(rows, got, strict=True))
    assert [a is not None for a in got] == [True, True, True, False, False, True, True]


@pytest.mark.parametrize("raw, want", [('x {"a": {"b": 1}} {"c": 2}', '{"a": {"b": 1}}'), ('} {"a": 1', None), ('{"a": }', None), ("none", None), (None, None), ('```json\n{"r": 1}\n``` {"z": 2}', '{"r": 1}'), ('{"a": "}"}', None), ("{" * 2000, None)])
def test_first_object(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(responses.role_object(F.col("raw")).alias("o")).first().o == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("tasks", "{}")], "kind string, raw string")
    plan = df.select(responses.salvage(F.col("raw"), F.col("kind")), responses.role_object(F.col("raw")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
