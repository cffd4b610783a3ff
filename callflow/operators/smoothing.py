"""Repair of speaker turns, expressed on runs.

Every step takes runs (``call_id, run_idx, speaker, first_idx, last_idx,
n_words, start_ms, end_ms, last_text``) and returns them with corrected
``speaker``; decisions always use the runs as they were before the step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.runs import CALL, IVR, RUN_BLOCK, call_totals, merge, regroup, with_adjacent
from callflow.operators.sequence import index_block, neighbours, running_sum
from callflow.session import durable

# Thresholds in milliseconds and words.
STANDARD_MS = 500
CONSERVATIVE_MS = 150
BOUNDARY_MS = 400
BOUNDARY_WORDS = 2
FRAGMENT_WORDS = 4
MIN_WORDS_SMOOTH = 3
MIN_WORDS_SENTENCE = 5
TURN_GAP_MS = 800
TURN_GAP_LOW_MS = 300
TURN_MIN_WORDS = 3
TURN_MIN_POINTS = 3
SENTENCE_END = r"[.?!]\s*$"


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def renumber(runs: DataFrame) -> DataFrame:
    """speaker_0, speaker_1, … by first appearance; IVR keeps its label.

    ``original_speaker`` holds the label that was replaced, else null.
    """
    first = runs.where(F.col("speaker") != IVR).groupBy("call_id", "speaker").agg(F.min("first_idx").alias("_seen"))
    # one row per distinct speaker of a call, not per run
    rank = F.row_number().over(W.partitionBy("call_id").orderBy("_seen")) - 1
    names = first.select("call_id", "speaker", F.concat(F.lit("speaker_"), rank.cast("string")).alias("_name"))
    out = runs.join(names, ["call_id", "speaker"], "left")
    name = F.coalesce("_name", "speaker")
    return (
        out.withColumn("original_speaker", F.when(name != F.col("speaker"), F.col("speaker")))
        .withColumn("speaker", name)
        .drop("_name")
    )


def _interior_same(speaker: str = "speaker") -> Column:
    """Between two runs of one speaker, none of the three being IVR."""
    return (
        F.col("has_prev")
        & F.col("has_next")
        & (F.col(speaker) != IVR)
        & (F.col("prev_speaker") != IVR)
        & (F.col("next_speaker") != IVR)
    )


def smooth_short_runs(runs: DataFrame) -> DataFrame:
    """Short runs between two runs of one speaker take that speaker.

    With at most two speakers a run under 0.5 s qualifies; with more only a
    single word under 0.15 s does. Calls under three words stay as they are.
    """
    near = with_adjacent(runs, "speaker").join(call_totals(runs), "call_id")
    length = F.col("end_ms") - F.col("start_ms")
    short = F.when(F.col("call_speakers") <= 2, length < STANDARD_MS).otherwise(
        (length < CONSERVATIVE_MS) & (F.col("n_words") <= 1)
    )
    fix = (
        _interior_same()
        & short
        & (F.col("prev_speaker") == F.col("next_speaker"))
        & (F.col("call_words") >= MIN_WORDS_SMOOTH)
    )
    return near.withColumn("speaker", F.when(fix, F.col("prev_speaker")).otherwise(F.col("speaker"))).select(*runs.columns)


def fix_boundaries(runs: DataFrame, only_two_speakers: bool = True) -> DataFrame:
    """A stray first or last run (at most 2 words, under 0.4 s) joins its neighbour.

    ``runs`` must be merged, i.e. adjacent runs differ in speaker.
    """
    near = with_adjacent(runs, "speaker").join(call_totals(runs), "call_id")
    stray = (F.col("n_words") <= BOUNDARY_WORDS) & (F.col("end_ms") - F.col("start_ms") < BOUNDARY_MS)
    eligible = (F.col("call_words") >= MIN_WORDS_SMOOTH) & (F.col("call_runs") >= 2)
    if only_two_speakers:
        eligible = eligible & (F.col("call_speakers") <= 2)
    at_start = eligible & stray & ~F.col("has_prev")
    started = near.where(at_start).select("call_id", F.lit(True).alias("_moved"))
    out = near.join(started, "call_id", "left")
    # after the start fix a call of two runs has one speaker left: no end fix
    at_end = (
        eligible
        & stray
        & ~F.col("has_next")
        & ~((F.col("call_runs") == 2) & F.coalesce(F.col("_moved"), F.lit(False)))
    )
    return out.withColumn(
        "speaker",
        F.when(at_start, F.col("next_speaker")).when(at_end, F.col("prev_speaker")).otherwise(F.col("speaker")),
    ).select(*runs.columns)


def fix_mid_sentence(runs: DataFrame) -> DataFrame:
    """A short run inside a sentence of the previous speaker joins that speaker."""
    near = with_adjacent(runs, "speaker", "last_text").join(call_totals(runs), "call_id")
    fix = (
        _interior_same()
        & (F.col("n_words") < FRAGMENT_WORDS)
        & ~ends_sentence(F.col("prev_last_text"))
        & ((F.col("prev_speaker") == F.col("next_speaker")) | (F.col("n_words") <= 2))
        & (F.col("call_words") >= MIN_WORDS_SENTENCE)
    )
    return near.withColumn("speaker", F.when(fix, F.col("prev_speaker")).otherwise(F.col("speaker"))).select(*runs.columns)


def apply_to_base(base: DataFrame, step) -> DataFrame:
    """Run ``step`` on the merged runs of ``base`` and carry its labels back.

    Runs are small; cutting lineage here keeps the plan of each step short.
    """
    grouped = durable(regroup(base))
    turns = durable(merge(grouped))
    fixed = step(turns).select("call_id", F.col("run_idx").alias("turn_idx"), F.col("speaker").alias("_fixed"))
    return (
        grouped.join(fixed, ["call_id", "turn_idx"]).withColumn("speaker", F.col("_fixed")).select(*base.columns)
    )


def gap_thresholds(gaps: DataFrame) -> DataFrame:
    """Turn threshold per call from its silence gaps (``call_id, gap_ms``).

    Order statistics come from the histogram of gap lengths in milliseconds, so
    a call costs as many rows as it has distinct gaps, never its words.
    """
    hist = gaps.where("gap_ms > 0").groupBy("call_id", "gap_ms").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("call_id").orderBy("gap_ms").rowsBetween(W.unboundedPreceding, 0)
    ranked = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("call_id")))

    def at(position: Column) -> Column:
        holds = (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)
        return F.max(F.when(holds, F.col("gap_ms")))

    high = F.greatest(F.lit(TURN_GAP_MS), F.col("median_ms") * 3)
    # enough turn points exist when the third largest gap reaches the high threshold
    return (
        ranked.groupBy("call_id")
        .agg(
            at(F.floor(F.col("total") / 2)).alias("median_ms"),
            at(F.floor(F.col("total") * 0.75)).alias("upper_ms"),
            at(F.col("total") - TURN_MIN_POINTS).alias("third_ms"),
        )
        .select(
            "call_id",
            F.when(F.col("third_ms") >= high, high)
            .otherwise(F.greatest(F.lit(TURN_GAP_LOW_MS), F.col("upper_ms")))
            .alias("threshold_ms"),
        )
    )


def number_silence_turns(words: DataFrame, hold: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Number the stretches between significant gaps on the words of calls.

    Calls without a positive gap keep a single stretch. The words next to their
    gaps are read three times; ``hold`` cuts their lineage.
    """
    near = hold(
        neighbours(words, CALL, ["word_idx"], index_block("word_idx"), ["end_ms"]).withColumn(
            "gap_ms", F.col("start_ms") - F.col("prev_end_ms")
        )
    )
    limits = gap_thresholds(near.select("call_id", "gap_ms"))
    # the few thresholds are repeated for every block of their call, so that words stay dealt by block
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), index_block("_last")))
    ends = near.groupBy("call_id").agg(F.max("word_idx").alias("_last")).join(limits, "call_id", "left")
    spread = ends.select("call_id", "threshold_ms", blocks.alias("_home"))
    flagged = near.withColumn("_home", index_block("word_idx")).join(spread, ["call_id", "_home"]).drop("_home").withColumn(
        "_turn", F.coalesce(F.col("gap_ms") >= F.col("threshold_ms"), F.lit(False)).cast("long")
    )
    numbered = running_sum(flagged, CALL, ["word_idx"], index_block("word_idx"), F.col("_turn"), "run_idx")
    return numbered.drop("prev_end_ms", "has_prev", "gap_ms", "threshold_ms", "_turn")


def alternate_speakers(stretches: DataFrame) -> DataFrame:
    """Label stretches speaker_0 / speaker_1 in turn.

    A stretch under three words continues the one before it, except the first.
    """
    kept = ((F.col("run_idx") > 0) & (F.col("n_words") >= TURN_MIN_WORDS)).cast("long")
    turns = running_sum(stretches, CALL, ["run_idx"], index_block("run_idx", RUN_BLOCK), kept, "_turn")
    return turns.withColumn("speaker", F.concat(F.lit("speaker_"), (F.col("_turn") % 2).cast("string"))).drop("_turn")


def split_by_silence(words: DataFrame) -> DataFrame:
    """Two speakers from silence gaps, on the words of single-speaker calls.

    Calls under five words and calls without a positive gap are returned with
    their labels unchanged.
    """
    from callflow.operators.runs import collapse

    sizes = words.groupBy("call_id").agg(F.count(F.lit(1)).alias("call_words"))
    numbered = durable(number_silence_turns(words))
    runs = durable(collapse(numbered))
    count = runs.groupBy("call_id").agg(F.max("run_idx").alias("last_run")).join(sizes, "call_id")
    labels = (
        alternate_speakers(runs)
        .join(count, "call_id")
        .select(
            "call_id",
            "run_idx",
            F.when((F.col("call_words") >= MIN_WORDS_SENTENCE) & (F.col("last_run") > 0), F.col("speaker")).alias("_name"),
        )
    )
    return (
        numbered.join(labels, ["call_id", "run_idx"])
        .withColumn("speaker", F.coalesce("_name", "speaker"))
        .drop("_name", "run_idx")
    )
