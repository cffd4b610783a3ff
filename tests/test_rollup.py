"""Rollups by differences against full runs."""

import random
from collections import defaultdict
from statistics import mean

import pytest

from callflow.streaming import rollup

SCHEMA = "id long, version int, group string, value double"


def batches(seed=4):
    """Three batches with new rows, changed values and groups, unchanged repeats, late old versions and removals."""
    rng = random.Random(seed)
    state, out = {}, []
    for number in range(3):
        rows = []
        for _ in range(400):
            i = rng.randint(0, 500)
            version = rng.randint(1, 9)
            row = (i, version, rng.choice(["a", "b", "c", None]), rng.choice([None, 0.0, rng.uniform(0, 1), rng.lognormvariate(0, 3)]))
            if i in state and rng.random() < 0.2:
                row = state[i]
            rows.append(row)
        rows = list({(r[0], r[1]): r for r in rows}.values())
        for r in sorted(rows, key=lambda r: r[1]):
            if r[0] not in state or r[1] > state[r[0]][1]:
                state[r[0]] = r
        out.append(rows)
    return out, state


def full(state):
    groups = defaultdict(list)
    for _, _, group, value in state.values():
        if group is not None and value is not None:
            groups[group].append(value)
    return groups


def check(kept, state):
    want = full(state)
    got = {r.group: r for r in kept.read().collect()}
    assert got.keys() == want.keys()
    for group, values in want.items():
        values = sorted(values)
        assert got[group].n == len(values)
        assert got[group].mean == pytest.approx(mean(values), rel=1e-9, abs=1e-11)
        assert got[group]["quantile"] == pytest.approx(values[-(-len(values) // 2) - 1], rel=rollup.ERROR * 1.0001, abs=rollup.LEAST)
        assert got[group].largest == pytest.approx(values[-1], rel=rollup.ERROR * 1.0001)


def test_three_increments_equal_a_full_run(spark, folder):
    parts, state = batches()
    kept = rollup.Rollup(spark, f"{folder}/r", 4)
    for number, rows in enumerate(parts):
        kept.add(spark.createDataFrame(rows, SCHEMA), number)
        kept.add(spark.createDataFrame(rows, SCHEMA), number)  # repeated
    check(kept, state)
    whole = rollup.Rollup(spark, f"{folder}/w", 4)
    whole.add(spark.createDataFrame(list(state.values()), SCHEMA), 0)
    bins = lambda r: {(x.group, x.bin): x.n for x in r.bins.read().where("n > 0").collect()}
    assert bins(kept) == bins(whole)
    assert kept.bins.read().where("n < 0").isEmpty()


def test_a_failure_between_sums_and_rows(spark, folder):
    parts, state = batches(5)
    kept = rollup.Rollup(spark, f"{folder}/r", 2)
    publish = kept.rows._publish
    for number, rows in enumerate(parts):
        kept.rows._publish = lambda version: (_ for _ in ()).throw(OSError("lost"))
        with pytest.raises(OSError):
            kept.add(spark.createDataFrame(rows, SCHEMA), number)
        kept.rows._publish = publish
        kept.add(spark.createDataFrame(rows, SCHEMA), number)
    check(kept, state)


def test_a_rollup_follows_a_stream(spark, folder):
    parts, state = batches(6)
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    kept = rollup.Rollup(spark, f"{folder}/r", 2)
    assert kept.read() is None
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept.follow(stream, f"{folder}/c").awaitTermination(120)
    assert {g: len(v) for g, v in full(state).items()} == {r.group: r.n for r in kept.read().collect()}
