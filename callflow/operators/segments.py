"""Speech segments from frames, windows and labels, and their clean-up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.align import interval_join
from callflow.operators.sequence import index_block, label_runs, neighbours, number_rows, running_sum

CALL = ["call_id"]
FRAME_BLOCK = 16384
SEGMENT_BLOCK_MS = 3_600_000

# Frame lengths and thresholds.
SPEECH_FRAME_MS = 20
SPEECH_PROB = 0.5
MIN_SEGMENT_MS = 200
MERGE_GAP_MS = 500
MIN_PIECE_MS = 500
WINDOW_MS, SHIFT_MS, MIN_WINDOW_MS = 1000, 500, 500
IVR_BUFFER_MS, IVR_CUTOFF_MS = 500, 10_000
CHUNK_MS, DRIFT_MS, PADDING_MS, VAD_FRAME_MS = 300_000, 20_000, 200, 30


def frame_runs(frames: DataFrame, label: Column, frame_ms: int) -> DataFrame:
    """Runs of equal label over frames, with start and end time."""
    rows = label_runs(frames.withColumn("label", label), CALL, ["frame_idx"], index_block("frame_idx", FRAME_BLOCK), "label")
    return (
        rows.groupBy("call_id", "run_idx")
        .agg(F.min("label").alias("label"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
        .select("call_id", "run_idx", "label", (F.col("first") * frame_ms).alias("start_ms"), ((F.col("last") + 1) * frame_ms).alias("end_ms"))
    )


def speech_segments(frames: DataFrame) -> DataFrame:
    """Stretches of frames with speech probability above 0.5, at least 0.2 s."""
    runs = frame_runs(frames, (F.col("speech_prob") > SPEECH_PROB).cast("int"), SPEECH_FRAME_MS)
    return runs.where((F.col("label") == 1) & (F.col("end_ms") - F.col("start_ms") >= MIN_SEGMENT_MS)).select(
        "call_id", "start_ms", "end_ms"
    )


def argmax_segments(frames: DataFrame, frame_ms: int) -> DataFrame:
    """Segments of the likeliest speaker per frame (``probs`` array), score ≥ 0.5."""
    best = F.array_max("probs")
    who = F.when(best >= SPEECH_PROB, F.array_position("probs", best) - 1).otherwise(-1)
    runs = frame_runs(frames, who, frame_ms)
    return runs.where((F.col("label") >= 0) & (F.col("end_ms") - F.col("start_ms") >= MIN_SEGMENT_MS)).select(
        "call_id", F.concat(F.lit("speaker_"), F.col("label").cast("string")).alias("speaker"), "start_ms", "end_ms"
    )


def label_segments(windows: DataFrame) -> DataFrame:
    """Segments from labelled windows: first start to last end of each run."""
    rows = label_runs(windows, CALL, ["win_idx"], index_block("win_idx", FRAME_BLOCK), "label")
    at = F.col("win_idx")
    return rows.groupBy("call_id", F.col("run_idx").alias("seg_idx")).agg(
        F.concat(F.lit("speaker_"), F.min("label").cast("string")).alias("speaker"),
        F.min_by("start_ms", at).alias("start_ms"),
        F.max_by("end_ms", at).alias("end_ms"),
    )


def merge_adjacent(segments: DataFrame, gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """Merge neighbours of one speaker at most ``gap_ms`` apart.

    The merged end is the last segment's end.
    """
    block = F.floor(F.col("start_ms") / SEGMENT_BLOCK_MS)
    order = ["start_ms", "seg_idx"]
    near = neighbours(segments, CALL, order, block, ["speaker", "end_ms"])
    joined = (
        F.col("has_prev") & (F.col("prev_speaker") == F.col("speaker")) & (F.col("start_ms") - F.col("prev_end_ms") <= gap_ms)
    )
    groups = running_sum(near, CALL, order, block, (~joined).cast("long"), "group")
    place = F.struct("start_ms", "seg_idx")
    return groups.groupBy("call_id", (F.col("group") - 1).alias("merged_idx")).agg(
        F.min("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", place).alias("end_ms")
    )


def subtract(speech: DataFrame, removed: DataFrame, min_ms: int = MIN_PIECE_MS, bin_ms: int = 60_000) -> DataFrame:
    """Cut ``removed`` intervals out of ``speech`` (call_id, start_ms, end_ms).

    A piece before a removed interval must be longer than ``min_ms``, the rest
    after the last one at least that; untouched segments stay whole.
    """
    keyed = speech.withColumn("speech_id", F.struct("start_ms", "end_ms"))
    cuts = removed.select("call_id", "start_ms", "end_ms")
    hit = interval_join(keyed, cuts, CALL, bin_ms).select(
        "call_id", F.col("l.start_ms").alias("s"), F.col("l.end_ms").alias("e"), F.col("r.start_ms").alias("a"), F.col("r.end_ms").alias("b")
    )
    # cuts of one speech segment, in order: the open position is the furthest end so far
    w = W.partitionBy("call_id", "s", "e").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = hit.withColumn("from", F.greatest(F.col("s"), F.coalesce(reach, F.col("s"))))
    before = opened.where(F.col("a") > F.col("from") + min_ms).select("call_id", F.col("from").alias("start_ms"), F.col("a").alias("end_ms"))
    rest = hit.groupBy("call_id", "s", "e").agg(F.greatest("s", F.max("b")).alias("from"))
    after = rest.where((F.col("from") < F.col("e")) & (F.col("e") - F.col("from") >= min_ms)).select(
        "call_id", F.col("from").alias("start_ms"), F.col("e").alias("end_ms")
    )
    touched = rest.select("call_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    whole = speech.select("call_id", "start_ms", "end_ms").join(touched, ["call_id", "start_ms", "end_ms"], "left_anti")
    return before.unionByName(after).unionByName(whole)


def embedding_windows(segments: DataFrame) -> DataFrame:
    """1 s windows every 0.5 s over each segment, plus a tail of 0.5 s or more.

    Segments under 1 s are kept whole if they last at least 0.5 s.
    """
    length = F.col("end_ms") - F.col("start_ms")
    n = F.when(length >= WINDOW_MS, F.floor((length - WINDOW_MS) / SHIFT_MS) + 1).otherwise(0)
    rows = segments.withColumn("_n", n)
    starts = F.transform(
        F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct((F.col("start_ms") + i * SHIFT_MS).alias("a"), (F.col("start_ms") + i * SHIFT_MS + WINDOW_MS).alias("b")),
    )
    tail_from = F.col("start_ms") + F.col("_n") * SHIFT_MS
    tail = F.when(
        F.col("end_ms") - tail_from >= MIN_WINDOW_MS, F.array(F.struct(tail_from.alias("a"), F.col("end_ms").alias("b")))
    ).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return rows.select("call_id", "seg_idx", F.posexplode(F.concat(starts, tail)).alias("win", "w")).select(
        "call_id", "seg_idx", F.col("win").cast("long").alias("win"), F.col("w.a").alias("start_ms"), F.col("w.b").alias("end_ms")
    )


def remove_leading_ivr(segments: DataFrame, announcements: DataFrame) -> DataFrame:
    """Drop segments before the end of a detected announcement.

    The cutoff is its end plus 0.5 s, at most 10 s; nothing happens where no
    announcement was found or no segment lies beyond the cutoff.
    """
    cut = announcements.groupBy("call_id").agg(F.least(F.max("end_ms") + IVR_BUFFER_MS, F.lit(IVR_CUTOFF_MS)).alias("cutoff"))
    first = (
        segments.join(cut, "call_id").groupBy("call_id", "cutoff")
        .agg(F.min(F.when(F.col("end_ms") > F.col("cutoff"), F.col("seg_idx"))).alias("first"))
        .where(F.col("first") > F.lit(0))
    )
    zero = segments.groupBy("call_id").agg(F.min("seg_idx").alias("_zero"))
    moved = first.join(zero, "call_id").where("first > _zero").select("call_id", "cutoff", "first")
    kept = segments.join(moved, "call_id", "left").where(F.col("first").isNull() | (F.col("seg_idx") >= F.col("first")))
    names = kept.where("first IS NOT NULL").select("call_id", "speaker").distinct()
    # one row per distinct speaker; names sort as text
    rank = F.row_number().over(W.partitionBy("call_id").orderBy("speaker")) - 1
    names = names.withColumn("_name", F.concat(F.lit("speaker_"), rank.cast("string")))
    clipped = F.when((F.col("seg_idx") == F.col("first")) & (F.col("start_ms") < F.col("cutoff")), F.col("cutoff")).otherwise(F.col("start_ms"))
    return kept.join(names, ["call_id", "speaker"], "left").select(
        "call_id", "seg_idx", F.coalesce("_name", "speaker").alias("speaker"), clipped.alias("start_ms"), "end_ms"
    )


def silence_spans(frames: DataFrame) -> DataFrame:
    """Silent frames compressed to spans of frame times (first and last)."""
    runs = frame_runs(frames, (F.col("speech_prob") <= SPEECH_PROB).cast("int"), VAD_FRAME_MS)
    return runs.where("label = 1").select("call_id", "start_ms", (F.col("end_ms") - VAD_FRAME_MS).alias("last_ms"))


def plan_chunks(
    silences: DataFrame, calls: DataFrame, target_ms: int = CHUNK_MS, drift_ms: int = DRIFT_MS, pad_ms: int = PADDING_MS, frame_ms: int = VAD_FRAME_MS
) -> DataFrame:
    """Chunks of about ``target_ms`` cut at the silent frame nearest to it.

    The next cut depends on the last one alone, so one pass over the spans of a
    call in time order plans it: a task streams them with one open chunk in
    memory, and those spans that the next chunk may still need. Spans are runs
    of silent frames; no call is gathered and nothing is repeated per chunk.
    """
    if target_ms <= drift_ms:
        raise ValueError("a chunk must be longer than its drift")

    def nearest(spans: Sequence[tuple[int, int]], goal: int, low: int, high: int) -> int:
        """Silent frame closest to ``goal`` within the window, the earlier of two; ``goal`` if there is none."""
        best = None
        for a, b in spans:
            first = a + -(-max(0, low - a) // frame_ms) * frame_ms
            last = a + (min(b, high) - a) // frame_ms * frame_ms
            if first <= last:
                below = min(max(a + (goal - a) // frame_ms * frame_ms, first), last)
                for t in (below, min(below + frame_ms, last)):
                    if best is None or (abs(t - goal), t) < best:
                        best = (abs(t - goal), t)
        return goal if best is None else best[1]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, total, start, chunk, kept = None, 0, 0, 0, []
        rows: list[tuple] = []

        def advance(until: float) -> None:
            """Write the chunks whose window ends before ``until``, from where spans are still to come."""
            nonlocal start, chunk, kept
            while start < total:
                goal = start + target_ms
                if goal >= total:
                    rows.append((call, chunk, start, total))
                    start = total
                    return
                low, high = max(0, goal - drift_ms), min(total, goal + drift_ms)
                if high >= until:
                    return
                cut = nearest(kept, goal, low, high)
                rows.append((call, chunk, start, min(cut + pad_ms, total)))
                start, chunk = cut, chunk + 1
                kept = [x for x in kept if x[1] >= start + target_ms - drift_ms]

        for batch in batches:
            for key, a, b in zip(batch["call_id"].to_pylist(), batch["start_ms"].to_pylist(), batch["last_ms"].to_pylist(), strict=True):
                if a < 0:  # a new call, with its length
                    advance(float("inf"))
                    call, total, start, chunk, kept = key, b, 0, 0, []
                elif key == call:
                    advance(a)
                    if b >= start + target_ms - drift_ms:
                        kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["call_id", "chunk_idx", "start_ms", "end_ms"])
            rows.clear()
        advance(float("inf"))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["call_id", "chunk_idx", "start_ms", "end_ms"])

    long = [F.col(c).cast("long").alias(c) for c in ("call_id", "start_ms", "last_ms")]
    heads = calls.where("total_ms > 0").select("call_id", F.lit(-1).alias("start_ms"), F.col("total_ms").alias("last_ms")).select(*long)
    ordered = silences.select(*long).unionByName(heads).repartition("call_id").sortWithinPartitions("call_id", "start_ms", "last_ms")
    return ordered.mapInArrow(walk, "call_id long, chunk_idx long, start_ms long, end_ms long")
