"""Sweeps, order numbers, admission, chunk plans and spectral clustering with one key that holds most rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callflow.operators import segments, spectral, usage
from callflow.operators.sequence import dealt, order_numbers, running_max
from callflow.streaming import admission
from test_sequence import plan_model
from test_sources_and_streams import admit_model, frame


def busy_rows(n=3000, seconds=86_000, seed=5, limits=(3, 30, 300)):
    """One key makes two thirds of all requests within one day, some at the same instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.67 else rng.randint(1, 6)
        t = rng.randint(0, seconds) if rng.random() < 0.9 else 40_000 + rng.randint(0, 3)
        rows.append((key, i, 1_700_000_000 + t, *limits))
    return rows


def test_trailing_counts_of_a_busy_day(spark):
    rows = busy_rows()
    got = {r.request_id: (r.last_minute, r.last_hour, r.last_day) for r in usage.trailing_counts(frame(spark, rows)).collect()}
    times = defaultdict(list)
    for key, _, t, *_ in rows:
        times[key].append(t)
    arrays = {k: np.array(v) for k, v in times.items()}
    for key, rid, t, *_ in rows:
        age = t - arrays[key]
        assert got[rid] == tuple(int(((age >= 0) & (age < w)).sum()) for w in (60, 3600, 86400))


def test_a_busy_key_is_dealt_over_all_ranges(spark):
    df = frame(spark, busy_rows(8000)).withColumn("us", F.unix_micros("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would fit one range
    try:
        sizes = Counter(r["_dealt"] for r in dealt(df, ["key_id", "us", "request_id"]).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes.values()) < 0.35 * 8000  # a key with two thirds fills no range alone


def test_order_numbers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None, rng.randint(0, 50)])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(7)
    got = {r.id: r.place for r in order_numbers(df, [F.desc("v"), F.asc("id")], "place").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    assert order_numbers(df.where("id < 0"), [F.asc("id")], "place").collect() == []


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_max(spark, inclusive):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.choice([None, rng.randint(0, 99)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = {(r.k, r.i): r.top for r in running_max(df, ["k"], ["i"], F.floor(F.col("i") / 20), F.col("v"), "top", inclusive).collect()}
    for k, i, _ in rows:
        before = [v for kk, ii, v in rows if kk == k and (ii <= i if inclusive else ii < i) and v is not None]
        assert got[k, i] == max(before, default=None)


@pytest.mark.parametrize("seed,seconds,limits", [(1, 86_000, (3, 30, 300)), (2, 900_000, (2, 20, 60)), (3, 2_000_000, (4, 40, 260)), (4, 30_000_000, (3, 3, 3))])
def test_admission_of_a_busy_key(spark, seed, seconds, limits):
    rows = busy_rows(2500, seconds, seed, limits)
    got = admission.admit_batch(frame(spark, rows)).collect()
    assert {r.request_id: r.allowed for r in got} == admit_model(rows)
    past = defaultdict(list)
    left = {}
    for key, rid, t, *m in sorted(rows, key=lambda r: (r[2], r[1])):
        counts = [sum(t - x < w for x in past[key]) for w in (60, 3600, 86400)]
        if all(c < x for c, x in zip(counts, m, strict=True)):
            past[key].append(t)
            counts = [c + 1 for c in counts]
        left[rid] = tuple(max(0, x - c) for c, x in zip(counts, m, strict=True))
    assert {r.request_id: (r.remaining_minute, r.remaining_hour, r.remaining_day) for r in got} == left


def test_a_busy_key_without_a_pause_is_cut(spark):
    """Bursts a week apart on steady use: only what follows a burst within a day is replayed."""
    rows = [(0, i, 1_700_000_000 + 600 * i, 5, 50, 500) for i in range(4000)]  # 28 days without a pause
    rows += [(0, 10_000 + i, 1_700_000_000 + 604_800 * (i % 4) + 100, 5, 50, 500) for i in range(40)]
    df = frame(spark, rows)
    found = admission.pieces(df.select("key_id", "request_id", "ts", *admission.LIMITS.values())).collect()
    replayed = [r for r in found if not r.known]
    assert len({r.piece for r in replayed}) == 4
    assert 4 * 140 < len(replayed) < 4 * 150  # a day of ten-minute steps after each burst, of 4,040 instants
    assert {r.request_id: r.allowed for r in admission.admit_batch(df).collect()} == admit_model(rows)


def test_chunk_plan_of_five_hours(spark):
    """A call of five hours beside short ones; long talk without any silence; a span over several windows."""
    rng = random.Random(8)
    spans, totals, want = [], [], {}
    for call, hours in enumerate([5, 5, 0.01, 0.2, 1]):
        total = int(hours * 3_600_000)
        silent, t = [], rng.randint(0, 2000)
        while t < total:
            n = rng.randint(1, 60) if call != 4 else 20_000
            if call != 1 or not 2_000_000 < t < 15_000_000:
                spans.append((call, t // 30 * 30, t // 30 * 30 + 30 * (n - 1)))
                silent += range(t // 30 * 30, t // 30 * 30 + 30 * n, 30)
            t += 30 * n + rng.randint(60, 60_000)
        totals.append((call, total))
        want[call] = plan_model(sorted({x for x in silent if x < total + 30 * 20_000}), total, 300_000, 20_000, 200)
    got = defaultdict(list)
    plan = segments.plan_chunks(spark.createDataFrame(spans, "call_id long, start_ms long, last_ms long"), spark.createDataFrame([*totals, (9, 0), (8, 400_000)], "call_id long, total_ms long"))
    for r in plan.orderBy("call_id", "chunk_idx").collect():
        got[r.call_id].append((r.start_ms, r.end_ms))
    assert got.pop(8) == [(0, 300_200), (300_000, 400_000)]
    assert got == want


def plain_spectral(vectors):
    """All pairs of a call, a full eigen-solution, the same seeds and rounds; speaker numbers by count tried."""
    u = np.array([v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v for v in vectors])
    affinity = (1 + u @ u.T) / 2
    degree = affinity.sum(1)
    values, basis = np.linalg.eigh(affinity / np.sqrt(np.outer(degree, degree)))
    basis = basis[:, ::-1][:, :4] / np.sqrt(degree)[:, None]
    basis = basis * (values[::-1][:4] > spectral.RANK * values[-1])
    out = {}
    for k in (2, 3, 4):
        e = basis[:, :k]
        centres = [e[0]]
        while len(centres) < k:
            near = np.min([((e - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(e[int(np.argmax(near))])
        for _ in range(100):
            labels = np.argmin([((e - c) ** 2).sum(1) for c in centres], axis=0)
            moved = [e[labels == i].mean(0) if (labels == i).any() else c for i, c in enumerate(centres)]
            if np.allclose(moved, centres, atol=1e-12):
                break
            centres = moved
        out[k] = labels
    return out


def call_vectors(seed, speakers, n, noise=0.25, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(speakers, width))
    return [(centres[rng.integers(speakers)] + noise * rng.normal(size=width)).tolist() for _ in range(n)]


def test_spectral_labels_follow_the_full_eigen_solution(spark):
    calls = {1: call_vectors(1, 2, 40), 2: call_vectors(2, 3, 60), 3: call_vectors(3, 4, 80, 0.4), 4: call_vectors(4, 2, 3), 5: call_vectors(5, 1, 1), 6: call_vectors(6, 3, 600)}
    rows = [(c, i, v) for c, vs in calls.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "call_id long, vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in spectral.spectral_speakers(df).collect():
        got[r.call_id][r.vec_id] = r.speaker_no
        assert r.settled
    assert set(got[5].values()) == {0} and len(set(got[4].values())) == 2
    for c, speakers in {1: 2, 2: 3, 3: 4, 6: 3}.items():
        mine = [got[c][i] for i in range(len(calls[c]))]
        k = len(set(mine))
        plain = plain_spectral(calls[c])[k]
        assert len(set(zip(mine, plain.tolist(), strict=True))) == k, c  # the same classes, by other names
        assert k == min(speakers, 3) or c == 3


def test_spectral_embedding_is_the_leading_eigenspace(spark):
    vectors = call_vectors(7, 3, 50)
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors)], "call_id long, vec_id long, embedding array<double>")
    place = np.array([r.place for r in spectral.spectral_embedding(df).orderBy("vec_id").collect()])
    u = np.array([v / np.linalg.norm(v) for v in vectors])
    affinity = (1 + u @ u.T) / 2
    degree = affinity.sum(1)
    values, full = np.linalg.eigh(affinity / np.sqrt(np.outer(degree, degree)))
    full = full[:, ::-1][:, :4] / np.sqrt(degree)[:, None]
    signs = np.sign((place * full).sum(0))
    assert np.allclose(place * signs, full, atol=1e-9)


def test_clustering_says_what_has_not_settled(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(call_vectors(9, 4, 200, 2.0))], "call_id long, vec_id long, embedding array<double>")
    assert not all(r.settled for r in spectral.spectral_speakers(df, rounds=1).collect())
