"""The pass along the runs against the single steps on frames, and the cuts of the transcript plan."""

import random

import pytest
from pyspark.sql import functions as F

from callflow.catalog.views import Tables
from callflow.operators import repair, runs, smoothing
from callflow.plans import transcripts

SCHEMA = "call_id long, run_idx long, speaker string, first_idx long, last_idx long, n_words long, start_ms long, end_ms long, last_text string"


def random_runs(seed, calls=60):
    rng = random.Random(seed)
    rows = []
    for call in range(calls):
        names = rng.choice([["a"], ["b", "a"], ["a", "b", "IVR"], ["c", "a", "b"], ["IVR"], ["IVR", "x"]])
        at, word, speaker = 0, 0, None
        for i in range(rng.choice([1, 2, 2, 3, 12, 40])):
            choice = [n for n in names if n != speaker] or names
            speaker = rng.choice(choice)
            n = rng.choice([1, 1, 2, 2, 3, 5])
            length = rng.choice([100, 149, 150, 300, 399, 400, 499, 500, 2000])
            rows.append((call, i, speaker, word, word + n - 1, n, at, at + length, rng.choice(["so", "end.", "what? ", None, "well"])))
            at, word = at + length + rng.choice([0, 30]), word + n
    return rows


def by_steps(base):
    """What the fold stands for, one frame operation after the other; calls of one speaker keep their runs as stretches."""
    totals = runs.call_totals(base)
    lone = totals.where("call_speakers <= 1").select("call_id")
    stretches = base.join(lone, "call_id", "left_semi")
    span = stretches.groupBy("call_id").agg(F.max("run_idx").alias("_last"), F.sum("n_words").alias("_words"))
    name = F.when((F.col("_words") >= smoothing.MIN_WORDS_SENTENCE) & (F.col("_last") > 0), F.col("speaker")).otherwise(F.lit("speaker_0"))
    split = smoothing.alternate_speakers(stretches).join(span, "call_id").withColumn("speaker", name).drop("_last", "_words")
    named = smoothing.renumber(base.join(lone, "call_id", "left_anti").unionByName(split)).drop("original_speaker").checkpoint()
    few = runs.call_totals(named).where("call_speakers <= 2").select("call_id", F.lit(True).alias("_few"))

    def boundaries(turns):
        fixed = smoothing.fix_boundaries(turns, only_two_speakers=False).select("call_id", "run_idx", F.col("speaker").alias("_to")).join(few, "call_id")
        return turns.join(fixed, ["call_id", "run_idx"], "left").withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to", "_few")

    out = named
    for step in (smoothing.smooth_short_runs, boundaries, smoothing.fix_mid_sentence):
        out = smoothing.apply_to_base(out, step)
    return runs.regroup(smoothing.renumber(out).drop("original_speaker"))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_the_steps(spark, seed):
    base = spark.createDataFrame(random_runs(seed), SCHEMA).checkpoint()
    totals = runs.call_totals(base).select("call_id", "call_words", "call_speakers")
    columns = ["call_id", "run_idx", "speaker", "turn_idx", "first_idx", "n_words", "start_ms", "last_text"]
    got = repair.repair_runs(base.repartition(5), totals).select(columns).collect()
    want = by_steps(base).select(columns).collect()
    assert len(got) == base.count() and sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(map(tuple, want), key=lambda r: r[:2])


def test_a_transcript_takes_three_cuts(spark, monkeypatch):
    t, cuts = Tables(spark, "/root/testdata/sf0.001"), []
    words, segments, chunks = t["chunk_words"], t["segments"], t["chunks"]
    whole = type(words).checkpoint

    def counted(df, *args, **kw):
        cuts.append(df)
        return whole(df, *args, **kw)

    monkeypatch.setattr(type(words), "checkpoint", counted)
    built = transcripts.assemble_transcripts(words, segments, chunks)
    assert len(cuts) == 2
    assert built.documents().count() > 0
    assert len(cuts) == 3


def test_words_travel_as_stretches(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    words, segments, chunks = t["chunk_words"], t["segments"], t["chunks"]
    built = transcripts.assemble_transcripts(words, segments, chunks)
    assert 0 < built.aligned.count() < words.count() / 5  # rows, each a stretch of one speaker
    columns = ["call_id", "word_idx", "text", "start_ms", "end_ms"]
    want = transcripts.align_corpus(words, segments, chunks).select(columns).collect()
    assert sorted(built.words().select(columns).collect()) == sorted(want)
