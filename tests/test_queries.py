"""Registered queries against DuckDB, and the shape of their plans.

Every query with SQL runs on the smallest tables.
"""

import os

import duckdb
import pytest

from callflow.catalog import registry
from callflow.catalog.views import BASE
from callflow.operators import align
from callflow.catalog.views import Tables
from callflow.plans import transcripts
from check import canonical

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    cur = duck.execute(registry.oracle_sql()[name])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want


def differences(spark, duck, folder, name):
    """Rows of a query on tables of its own and of its SQL on the same."""
    for f in os.listdir(folder):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = registry.queries()[name](spark, folder)
    cur = duck.execute(registry.oracle_sql()[name])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    return canonical([tuple(r) for r in df.collect()], df.columns), want


@pytest.mark.parametrize("name", ["c2_word_align", "g1_concatenate_words"])
def test_words_of_a_chunk_without_segments(spark, folder, name):
    duck = duckdb.connect()
    # one turn of 202 words, its end at 60.6 s; the segment of call 0 ends 1.2 s earlier, that of call 2 with it
    duck.execute(f"COPY (SELECT unnest([0, 2])::BIGINT AS conv_id, 0 AS turn, 'user' AS role, repeat('w ', 201) || 'w' AS text) TO '{folder}/conversations.parquet'")
    got, want = differences(spark, duck, folder, name)
    assert got == want
    assert len(got[1]) == {"c2_word_align": 401, "g1_concatenate_words": 406}[name]


def test_sizes_past_a_terabyte(spark, folder):
    duck = duckdb.connect()
    # 64 bytes times the square of the key: 1 TB at 131,072
    duck.execute(f"COPY (SELECT * REPLACE (o_orderkey + 131000 AS o_orderkey) FROM '{FOLDER}/orders.parquet') TO '{folder}/orders.parquet'")
    got, want = differences(spark, duck, folder, "h18_formatting")
    assert got == want and {r[-1].split()[-1] for r in got[1]} == {"GB'", "TB'"}


def test_equal_scores_take_the_smallest_count(spark, folder):
    duck = duckdb.connect()
    one = f"SELECT * FROM '{FOLDER}/events.parquet'"  # copies with later keys bring the same best value to other counts
    duck.execute(f"COPY (SELECT e.* REPLACE (event_id + i AS event_id) FROM ({one}) e, unnest([5, 4, 3, 2, 1, 0]) t(i)) TO '{folder}/events.parquet'")
    got, want = differences(spark, duck, folder, "f7_best_cluster_count")
    assert got == want and {r[0] for r in got[1]} == {"2"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["k3_enrich", "h1_salvage_all_kinds", "b24_task_count"])
def test_responses_are_dealt_and_searched_once(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    assert "RoundRobinPartitioning" in plan(df)  # events in one file do not make one task
    searches = df._jdf.queryExecution().optimizedPlan().toString().count("```(?:json)?")
    assert searches <= {"k3_enrich": 5, "h1_salvage_all_kinds": 4, "b24_task_count": 1}[name]  # kinds


def test_alignment_stays_in_the_engine(spark):
    t = Tables(spark, FOLDER)
    text = plan(transcripts.align_corpus(t["chunk_words"], t["segments"], t["chunks"]))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


def test_projection_and_filter_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    text = plan(registry.queries()["b10_pending_async"](spark, FOLDER))
    assert "o_totalprice" not in text and "PushedFilters" in text
    assert align.CHUNK == ["call_id", "chunk_idx"] and t["orders"] is not None


def test_long_calls_stay_dealt_by_block(spark):
    """No window over a block sits on rows that a per-call join has dealt by call alone."""
    import re

    from callflow.operators import frames, smoothing

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        feats = ["energy_std", "dtmf", "flatness", "high_freq", "zcr", "rms", "std"]
        rows = spark.createDataFrame([], "call_id long, frame_idx long, t_ms long, " + ", ".join(f"{f} double" for f in feats))
        words = spark.createDataFrame([], "call_id long, word_idx long, text string, start_ms long, end_ms long, speaker string")
        for df in (frames.flag_frames(rows), frames.rolling_std(rows.withColumn("energy", rows["rms"])), smoothing.number_silence_turns(words)):
            lines = plan(df).split("\n")
            at = [i for i, x in enumerate(lines) if re.search(r"\bWindow \[.*\[call_id#\d+L?, _block#", x)]
            assert at
            for i in at:
                below = next(x for x in lines[i + 1 :] if re.search(r"Exchange|Join", x))
                assert "_block#" in below, below
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
