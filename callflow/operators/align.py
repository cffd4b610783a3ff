"""Words, speaker segments and chunks: overlap joins and default timing.

Times are integer milliseconds. Groups are ``(call_id, chunk_idx)``: a chunk is
at most the planner's five minutes plus drift, so what one group holds is
bounded by its length however large a call is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = ["call_id", "chunk_idx"]
FALLBACK_WORD_MS = 300  # slot per word where a chunk has no usable length


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_ms: int) -> DataFrame:
    """Pairs of overlapping intervals per key: ``l`` and ``r`` structs.

    Both sides carry ``start_ms`` and ``end_ms``; they overlap when each starts
    before the other ends. Rows meet in time bins, so one busy key spreads over
    many tasks; a pair is kept only in the bin of its later start.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start_ms") / bin_ms), F.floor(F.col("end_ms") / bin_ms))
        return df.select(
            *keys,
            F.struct(*[F.col(c) for c in df.columns if c not in keys]).alias(name),
            F.explode(bins).alias("_bin"),
        )

    both = binned(left, "l").join(binned(right, "r"), [*keys, "_bin"])
    later = F.greatest(F.col("l.start_ms"), F.col("r.start_ms"))
    return both.where(
        (F.col("l.end_ms") > F.col("r.start_ms"))
        & (F.col("l.start_ms") < F.col("r.end_ms"))
        & (F.col("_bin") == F.floor(later / bin_ms))
    ).drop("_bin")


def clip_segments(segments: DataFrame, chunks: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Segments cut to the chunks they touch, in chunk-local time."""
    segs = segments.select("call_id", "seg_idx", "speaker", "start_ms", "end_ms")
    spans = chunks.select("call_id", "chunk_idx", "start_ms", "end_ms")
    zero = F.lit(0).cast("long")
    pairs = interval_join(segs, spans, ["call_id"], bin_ms)
    return pairs.select(
        "call_id",
        F.col("r.chunk_idx").alias("chunk_idx"),
        F.col("l.seg_idx").alias("seg_idx"),
        F.col("l.speaker").alias("speaker"),
        F.greatest(zero, F.col("l.start_ms") - F.col("r.start_ms")).alias("start_ms"),
        F.least(F.col("r.end_ms") - F.col("r.start_ms"), F.col("l.end_ms") - F.col("r.start_ms")).alias("end_ms"),
    ).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def segments_per_chunk(chunk_segments: DataFrame) -> DataFrame:
    """One row per chunk with its segments in diarisation order."""
    one = F.struct("seg_idx", "speaker", "start_ms", "end_ms")
    return chunk_segments.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(one)).alias("segs"))


def _first_best(segs: Column, measure) -> Column:
    """The segment with the largest ``measure``; the earlier one wins ties."""
    seed = F.struct(
        F.lit(None).cast("string").alias("speaker"),
        F.lit(None).cast("long").alias("seg_idx"),
        F.lit(None).cast("long").alias("score"),
    )

    def step(best, seg):
        score = measure(seg)
        better = score.isNotNull() & (best["score"].isNull() | (score > best["score"]))
        return F.when(
            better, F.struct(seg["speaker"].alias("speaker"), seg["seg_idx"].alias("seg_idx"), score.alias("score"))
        ).otherwise(best)

    return F.aggregate(segs, seed, step)


def align_words(words: DataFrame, chunk_segments: DataFrame) -> DataFrame:
    """Give every word a speaker in one join with its chunk's segments.

    Largest overlap wins, then the segment nearest to the word's middle, then
    ``speaker_0`` where the chunk has no segment. ``how`` tells which applied.
    """
    start, end = F.col("start_ms"), F.col("end_ms")

    def overlap(seg):
        ms = F.least(end, seg["end_ms"]) - F.greatest(start, seg["start_ms"])
        return F.when((ms > 0) & (end > start), ms)

    def nearness(seg):  # doubled, so that the middle stays an integer
        mid = start + end
        return (
            F.when(mid < seg["start_ms"] * 2, mid - seg["start_ms"] * 2)
            .when(mid > seg["end_ms"] * 2, seg["end_ms"] * 2 - mid)
            .otherwise(F.lit(0).cast("long"))
        )

    joined = words.join(segments_per_chunk(chunk_segments), CHUNK, "left").withColumn(
        "hit", F.when(F.col("segs").isNotNull(), _first_best(F.col("segs"), overlap))
    )
    near = F.when(
        F.col("segs").isNotNull() & F.col("hit.score").isNull(), _first_best(F.col("segs"), nearness)
    )
    return (
        joined.withColumn("near", near)
        .withColumn("speaker", F.coalesce("hit.speaker", "near.speaker", F.lit("speaker_0")))
        .withColumn("overlap_ms", F.col("hit.score"))
        .withColumn("distance_ms", -F.col("near.score") / 2)
        .withColumn(
            "how",
            F.when(F.col("hit.score").isNotNull(), "overlap")
            .when(F.col("near.score").isNotNull(), "nearest")
            .otherwise("default"),
        )
        .drop("segs", "hit", "near")
    )


def approximate_words(chunks: DataFrame) -> DataFrame:
    """Equal time slots for the words of a chunk text without timestamps."""
    tokens = F.filter(F.split(F.col("text"), r"\s+"), lambda t: t != "")
    rows = chunks.withColumn("_words", tokens).withColumn(
        "_slot",
        F.when(F.col("end_ms") > F.col("start_ms"), (F.col("end_ms") - F.col("start_ms")) / F.size("_words")).otherwise(
            F.lit(float(FALLBACK_WORD_MS))
        ),
    )
    return rows.select(
        *CHUNK, F.col("start_ms").alias("chunk_start_ms"), "_slot", F.posexplode("_words").alias("pos", "text")
    ).select(
        *CHUNK,
        F.col("pos").cast("long").alias("pos"),
        "text",
        (F.col("pos") * F.col("_slot")).alias("start_ms"),
        ((F.col("pos") + 1) * F.col("_slot")).alias("end_ms"),
        F.lit(True).alias("approximate_timing"),
    )


def dominant_speaker(chunk_segments: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """The speaker covering most time; the one seen first wins ties."""
    per = chunk_segments.groupBy(*keys, "speaker").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.min("seg_idx").alias("first_seg")
    )
    best = F.struct(F.col("covered_ms"), -F.col("first_seg"))
    return per.groupBy(*keys).agg(F.max_by("speaker", best).alias("speaker"), F.max("covered_ms").alias("covered_ms"))


def drop_repeated(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Without words that start in a chunk's tail and recur in the next chunk."""
    spans = chunks.select(*CHUNK, F.col("start_ms").alias("_from")).withColumn(
        "_next", F.lead("_from").over(W.partitionBy("call_id").orderBy("chunk_idx"))
    )
    return (
        words.join(spans, CHUNK)
        .where(F.col("_next").isNull() | (F.col("start_ms") + F.col("_from") < F.col("_next")))
        .drop("_from", "_next")
    )


def chunk_offsets(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Start time and number of preceding words of every chunk with words.

    A prefix sum over chunk rows: no window ever sees the words of a call.
    """
    counts = words.groupBy(*CHUNK).agg((F.max("pos") + 1).alias("_n"))
    before = W.partitionBy("call_id").orderBy("chunk_idx").rowsBetween(W.unboundedPreceding, -1)
    return counts.join(chunks.select(*CHUNK, F.col("start_ms").alias("_from")), CHUNK).select(
        *CHUNK, "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )


def place_words(words: DataFrame, offsets: DataFrame) -> DataFrame:
    """Concatenate chunk words: call-wide index and global times."""
    return (
        words.join(offsets, CHUNK)
        .withColumn("word_idx", F.col("pos") + F.col("_offset"))
        .withColumn("start_ms", F.col("start_ms") + F.col("_from"))
        .withColumn("end_ms", F.col("end_ms") + F.col("_from"))
        .drop("_offset", "_from")
    )
