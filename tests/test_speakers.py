"""Speaker vectors stream past the sums and centres of their call; held against all pairs."""

import time
from contextlib import redirect_stdout
from io import StringIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from callflow.operators import speakers, spectral
from callflow.operators.speakers import beside
from tests.test_busy_keys import call_vectors

SCHEMA = "call_id int, vec_id long, embedding array<double>"


@pytest.fixture
def short_batches(spark):
    """Calls and their blocks go on over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan_of(df):
    with redirect_stdout(StringIO()) as out:
        df.explain()
    return out.getvalue()


def plain_quality(vectors, labels):
    u = np.array([v / np.linalg.norm(v) for v in vectors])
    d, names = (1 - u @ u.T) / 2, sorted(set(labels))
    np.fill_diagonal(d, 0)
    labels = np.array(labels)
    fits = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1 or len(names) == 1:
            fits.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, labels == o].mean() for o in names if o != c)
        fits.append((b - a) / max(a, b))
    centres = [u[labels == c].mean(0) for c in names]
    spread = [np.linalg.norm(u[labels == c] - m, axis=1).mean() for c, m in zip(names, centres, strict=True)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(len(names)) if j != i) for i in range(len(names))] if len(names) > 1 else None
    return np.mean(fits), None if worst is None else np.mean(worst), len(names)


def test_quality_equals_all_pairs_and_copies_no_sums_to_vectors(spark, short_batches):
    rng = np.random.default_rng(3)
    calls = {1: [0, 1] * 30, 2: [5] * 8, 3: [-2, *rng.integers(3, 7, 90).tolist()], 4: [0, 0, 9]}
    vectors = {c: call_vectors(c, 3, len(labels), width=5) for c, labels in calls.items()}
    rows = [(c, i, vectors[c][i], label) for c, labels in calls.items() for i, label in enumerate(labels)]
    judged = speakers.quality(spark.createDataFrame(rows, f"{SCHEMA}, cluster int"), ["call_id"])
    got = {r.call_id: (r.silhouette, r.davies_bouldin, r.clusters) for r in judged.collect()}
    for c, labels in calls.items():
        assert got[c] == pytest.approx(plain_quality(vectors[c], labels), abs=1e-9)
    assert "MapInArrow" in plan_of(judged)


def test_vectors_without_a_row_of_their_call_are_left_out(spark, short_batches):
    vectors = spark.range(600).selectExpr("id % 4 AS call_id", "id AS vec_id", "CAST(pmod(hash(id), 16) AS int) AS _block")
    small = spark.createDataFrame([(0, 10), (2, 12), (7, 17)], "call_id long, mark long")

    def work(rows, at, table):
        yield rows.select(["call_id", "vec_id"]).append_column("mark", table["mark"].take(at))

    got = beside(vectors, small, ["call_id"], work, "call_id long, vec_id long, mark long").collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 4, i, 10 + i % 4) for i in range(600) if i % 4 in (0, 2))


def test_speakers_do_not_depend_on_batches_and_keep_the_types_of_ids(spark):
    calls = {1: call_vectors(1, 2, 150), 2: call_vectors(2, 4, 90), 3: call_vectors(3, 1, 1), 4: call_vectors(4, 2, 3), 5: [[1.0, 2.0] * 8] * 20, None: call_vectors(6, 2, 9)}
    df = spark.createDataFrame([(c, i, v) for c, vs in calls.items() for i, v in enumerate(vs)], SCHEMA)
    for cluster in (speakers.cluster_calls, spectral.spectral_speakers):
        named = cluster(df)
        assert [f.dataType.simpleString() for f in named.schema][:3] == ["int", "bigint", "bigint"]
        whole = sorted(tuple(r) for r in named.collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert sorted(tuple(r) for r in cluster(df).collect()) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r[0] for r in whole} == {1, 2, 3, 4, 5} and len(whole) == sum(len(v) for c, v in calls.items() if c)
        assert {r[2] for r in whole if r[0] in (3, 5)} == {0}


def test_a_vector_is_normalised_in_time_proportional_to_its_width(spark):
    """A wide vector took its norm again for every element: 4,000 of them, 160 million products for ten vectors."""
    wide = spark.range(0, 10, 1, 1).selectExpr("transform(sequence(1, 4000), x -> CAST(x + id AS double)) AS v")
    began = time.perf_counter()
    got = wide.select("v", speakers.normalise(F.col("v")).alias("u")).collect()
    assert time.perf_counter() - began < 5
    for r in got:
        assert np.allclose(r.u, np.array(r.v) / np.linalg.norm(r.v), rtol=1e-12)
