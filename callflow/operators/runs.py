"""Speaker runs: words compressed to one row per uninterrupted speaker.

All turn repair works on runs (tens of words each), not on words; words are
read once to build them and once more to write the text of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.align import CHUNK
from callflow.operators.sequence import index_block, label_runs, neighbours

CALL = ["call_id"]
IVR = "IVR"
RUN_BLOCK = 16384


def word_runs(words: DataFrame, block: Column | None = None) -> DataFrame:
    """Number the speaker runs of each call on its words."""
    return label_runs(words, CALL, ["word_idx"], index_block("word_idx") if block is None else block, "speaker")


def collapse(words: DataFrame, run: str = "run_idx") -> DataFrame:
    """One row per run from numbered words."""
    at = F.col("word_idx")
    return words.groupBy("call_id", F.col(run).alias("run_idx")).agg(
        F.min("speaker").alias("speaker"),
        F.min(at).alias("first_idx"),
        F.max(at).alias("last_idx"),
        F.count(F.lit(1)).alias("n_words"),
        F.min_by("start_ms", at).alias("start_ms"),
        F.max_by("end_ms", at).alias("end_ms"),
        F.max_by("text", at).alias("last_text"),
    )


def speaker_runs(words: DataFrame, block: Column | None = None) -> DataFrame:
    return collapse(word_runs(words, block))


def stretches(words: DataFrame) -> DataFrame:
    """Words of one speaker in a row within a chunk, gathered: ``items`` in order and the number of the ``step``.

    ``words`` are in chunk-local time with a ``pos`` each. A stretch is bounded by its chunk.
    """
    chunk = W.partitionBy(*CHUNK).orderBy("pos")
    same = (F.row_number().over(chunk) == 1) | F.col("speaker").eqNullSafe(F.lag("speaker").over(chunk))
    steps = F.sum(F.when(same, 0).otherwise(1).cast("long")).over(chunk.rowsBetween(W.unboundedPreceding, W.currentRow))
    item = F.struct("pos", "text", "start_ms", "end_ms")
    return (
        words.select(*CHUNK, "pos", "text", "start_ms", "end_ms", "speaker")
        .withColumn("step", steps)
        .groupBy(*CHUNK, "step")
        .agg(F.min("speaker").alias("speaker"), F.array_sort(F.collect_list(item)).alias("items"))
    )


def _bounds(shift: Column, ms: Column) -> list[Column]:
    """Columns of a stretch from its first and last word."""
    first, last = F.get("items", F.lit(0)), F.element_at("items", -1)
    return [
        (first["pos"] + shift).alias("first_idx"),
        (last["pos"] + shift).alias("last_idx"),
        F.size("items").cast("long").alias("n_words"),
        (first["start_ms"] + ms).alias("start_ms"),
        (last["end_ms"] + ms).alias("end_ms"),
        last["text"].alias("last_text"),
    ]


def number_stretches(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stretches with their speaker run, their place in the call and global times.

    Only a row per chunk meets in the windows over a call. ``items`` stay in the
    terms of their chunk; ``shift_idx`` and ``shift_ms`` lead from there to the call.
    """
    sizes = parts.groupBy(*CHUNK).agg(
        (F.max(F.element_at("items", -1)["pos"]) + 1).alias("_n"),
        F.min_by("speaker", "step").alias("_first"),
        F.max_by("speaker", "step").alias("_last"),
        F.max("step").alias("_steps"),
    )
    call = W.partitionBy("call_id").orderBy("chunk_idx")
    before = F.lag("_last").over(call)
    joint = F.when(before.isNull() | (before == F.col("_first")), 0).otherwise(1)
    placed = sizes.join(chunks.select(*CHUNK, F.col("start_ms").alias("shift_ms")), CHUNK).withColumn("_joint", joint)
    upto = call.rowsBetween(W.unboundedPreceding, W.currentRow)
    carry = placed.select(
        *CHUNK,
        "shift_ms",
        (F.sum("_n").over(upto) - F.col("_n")).alias("shift_idx"),
        (F.sum(F.col("_steps") + F.col("_joint")).over(upto) - F.col("_steps")).alias("_base"),
    )
    return parts.join(carry, CHUNK).select(
        *CHUNK, (F.col("step") + F.col("_base")).cast("long").alias("run_idx"), "speaker", "items", "shift_idx", "shift_ms", *_bounds(F.col("shift_idx"), F.col("shift_ms"))
    )


def spread(parts: DataFrame) -> DataFrame:
    """The words of stretches, placed in their call."""
    inside = ["items", "shift_idx", "shift_ms", "first_idx", "last_idx", "n_words", "start_ms", "end_ms", "last_text"]
    kept = [c for c in parts.columns if c not in inside]
    return parts.select(*kept, "shift_idx", "shift_ms", F.explode("items").alias("_w")).select(
        *kept,
        (F.col("_w.pos") + F.col("shift_idx")).alias("word_idx"),
        "_w.text",
        (F.col("_w.start_ms") + F.col("shift_ms")).alias("start_ms"),
        (F.col("_w.end_ms") + F.col("shift_ms")).alias("end_ms"),
    )


def gather(words: DataFrame, size: int = 1024) -> DataFrame:
    """Stretches of numbered words: those of a run in blocks of ``size`` places of the call."""
    item = F.struct(F.col("word_idx").alias("pos"), "text", "start_ms", "end_ms")
    none = F.lit(0).cast("long")
    parts = words.groupBy("call_id", "run_idx", index_block("word_idx", size).alias("_block")).agg(
        F.min("speaker").alias("speaker"), F.array_sort(F.collect_list(item)).alias("items")
    )
    return parts.select("call_id", "run_idx", "speaker", "items", none.alias("shift_idx"), none.alias("shift_ms"), *_bounds(none, none))


def regroup(runs: DataFrame, label: str = "speaker", out: str = "turn_idx") -> DataFrame:
    """Number groups of adjacent runs that now carry the same label."""
    return label_runs(runs, CALL, ["run_idx"], index_block("run_idx", RUN_BLOCK), label, out)


def merge(grouped: DataFrame, group: str = "turn_idx") -> DataFrame:
    """Merge numbered groups of runs into longer runs."""
    at = F.col("first_idx")
    return grouped.groupBy("call_id", F.col(group).alias("run_idx")).agg(
        F.min("speaker").alias("speaker"),
        F.min(at).alias("first_idx"),
        F.max("last_idx").alias("last_idx"),
        F.sum("n_words").alias("n_words"),
        F.min_by("start_ms", at).alias("start_ms"),
        F.max_by("end_ms", at).alias("end_ms"),
        F.max_by("last_text", at).alias("last_text"),
    )


def with_adjacent(runs: DataFrame, *columns: str) -> DataFrame:
    """Add the previous and next run's columns."""
    return neighbours(runs, CALL, ["run_idx"], index_block("run_idx", RUN_BLOCK), columns, columns)


def call_totals(runs: DataFrame) -> DataFrame:
    """Per call: words, runs and distinct speakers that are not IVR."""
    return runs.groupBy("call_id").agg(
        F.sum("n_words").alias("call_words"),
        F.count(F.lit(1)).alias("call_runs"),
        F.count_distinct(F.when(F.col("speaker") != IVR, F.col("speaker"))).alias("call_speakers"),
    )
