"""From words and speaker segments to labelled transcripts, for a whole corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators import align, lines, repair, runs, smoothing
from callflow.operators.sequence import neighbours
from callflow.session import durable

SEGMENT_BLOCK_MS = 3_600_000

# Words per minute below / above which speech counts as slow / fast.
SLOW_WPM = 110
FAST_WPM = 170


def speaker_sets(segments: DataFrame) -> DataFrame:
    """Speaker count and names per call; duplicates go before the shuffle."""
    per = segments.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("num_speakers"),
        F.sum("n").alias("total_segments"),
        F.array_join(F.array_sort(F.collect_list("speaker")), ",").alias("speakers"),
    )


def talk_time(segments: DataFrame) -> DataFrame:
    return segments.groupBy("call_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"))


def speaker_segments(segments: DataFrame, speaker: str) -> DataFrame:
    return segments.where(F.col("speaker") == speaker)


def _adjacent_segments(segments: DataFrame) -> DataFrame:
    return neighbours(
        segments,
        ["call_id"],
        ["start_ms", "seg_idx"],
        F.floor(F.col("start_ms") / SEGMENT_BLOCK_MS),
        ["speaker", "end_ms"],
    )


def speaker_turns(segments: DataFrame) -> DataFrame:
    """Turns per call: changes of speaker along the segments, plus one."""
    change = (F.col("prev_speaker") != F.col("speaker")).cast("long")
    return (
        _adjacent_segments(segments).groupBy("call_id").agg((F.coalesce(F.sum(change), F.lit(0)) + 1).alias("turns"))
    )


def chunk_texts(chunk_words: DataFrame) -> DataFrame:
    """Text of each chunk from its words; a chunk bounds the group."""
    return chunk_words.groupBy("call_id", "chunk_idx").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text")
    )


def call_metadata(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    spans = chunks.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("start_ms").alias("first_start_ms"),
        F.max("end_ms").alias("last_end_ms"),
    )
    return spans.join(speaker_sets(segments).drop("speakers"), "call_id", "left").na.fill(
        0, ["num_speakers", "total_segments"]
    )


def conversation_metrics(segments: DataFrame, agent: str = "Agent", customer: str = "Customer") -> DataFrame:
    """Talk shares and interruptions (a new speaker starts before the last one ended)."""
    ms = F.col("end_ms") - F.col("start_ms")
    cut_in = F.col("has_prev") & (F.col("prev_speaker") != F.col("speaker")) & (F.col("start_ms") < F.col("prev_end_ms"))

    def share(who: str):
        return F.round(100.0 * F.sum(F.when(F.col("speaker") == who, ms).otherwise(0)) / F.sum(ms), 4)

    return _adjacent_segments(segments).groupBy("call_id").agg(
        F.count_distinct("speaker").alias("total_speakers"),
        share(agent).alias("agent_talk_percent"),
        share(customer).alias("customer_talk_percent"),
        F.sum(cut_in.cast("long")).alias("interruptions"),
    )


def questions_and_pace(words: DataFrame) -> DataFrame:
    minutes = (F.max("end_ms") - F.min("start_ms")) / 60000.0
    out = words.groupBy("call_id").agg(
        F.count_if(F.col("text").contains("?")).alias("question_count"),
        F.count(F.lit(1)).alias("n_words"),
        (F.count(F.lit(1)) / minutes).alias("_wpm"),
    )
    return out.select(
        "call_id",
        "question_count",
        "n_words",
        F.round("_wpm", 4).alias("words_per_minute"),
        F.when(F.col("_wpm") < SLOW_WPM, "slow").when(F.col("_wpm") > FAST_WPM, "fast").otherwise("normal").alias("pace_rating"),
    )


def _heard_words(words: DataFrame, segments: DataFrame, chunks: DataFrame, dedupe_overlap: bool) -> tuple[DataFrame, DataFrame]:
    """Words in chunk-local time, as given and with a speaker each."""
    local = words.select("call_id", "chunk_idx", "pos", "text", "start_ms", "end_ms")
    if "text" in chunks.columns:
        silent = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(
            local.select("call_id", "chunk_idx").distinct(), ["call_id", "chunk_idx"], "left_anti"
        )
        guessed = align.approximate_words(silent).select(
            "call_id",
            "chunk_idx",
            "pos",
            "text",
            F.round("start_ms").cast("long").alias("start_ms"),
            F.round("end_ms").cast("long").alias("end_ms"),
        )
        local = local.unionByName(guessed)
    if dedupe_overlap:
        local = align.drop_repeated(local, chunks)
    return local, align.align_words(local, align.clip_segments(segments, chunks))


def align_corpus(words: DataFrame, segments: DataFrame, chunks: DataFrame, dedupe_overlap: bool = False) -> DataFrame:
    """Aligned words of whole calls, in order, with a speaker each.

    ``chunks`` may carry ``text``: a chunk with text but no words gets
    approximate word times first.
    """
    local, aligned = _heard_words(words, segments, chunks, dedupe_overlap)
    return align.place_words(aligned, align.chunk_offsets(local, chunks))


def talk_and_turns(words: DataFrame, segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Talk time, turns and words per speaker and call."""
    spoken = durable(align_corpus(words, segments, chunks))
    return (
        runs.speaker_runs(spoken, F.col("chunk_idx"))
        .groupBy("call_id", "speaker")
        .agg(
            F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"),
            F.count(F.lit(1)).alias("turns"),
            F.sum("n_words").alias("n_words"),
        )
    )


@dataclass
class Transcripts:
    """Result of ``assemble_transcripts``: lazy frames over its two cuts."""

    aligned: DataFrame  # stretches of words within a chunk, numbered by base run
    base: DataFrame  # base runs with their final speaker and final run
    turns: DataFrame  # final runs

    def stretches(self) -> DataFrame:
        """Stretches of words with their final speaker and run, and where that run begins and ends."""
        ends = self.turns.select("call_id", F.col("run_idx").alias("turn_idx"), F.col("first_idx").alias("run_from"), F.col("last_idx").alias("run_to"))
        final = self.base.select("call_id", "turn_idx", F.col("run_idx").alias("base_idx"), "speaker").join(ends, ["call_id", "turn_idx"])
        return self.aligned.drop("speaker").join(final.withColumnRenamed("turn_idx", "run_idx"), ["call_id", "base_idx"]).drop("base_idx")

    def words(self) -> DataFrame:
        """Aligned words with their final speaker and run."""
        return runs.spread(self.stretches()).drop("run_from", "run_to")

    def lines(self) -> DataFrame:
        return lines.sentence_lines(lines.stretch_pieces(self.stretches()))

    def documents(self) -> DataFrame:
        return lines.documents(self.lines())


def assemble_transcripts(
    words: DataFrame, segments: DataFrame, chunks: DataFrame, dedupe_overlap: bool = False
) -> Transcripts:
    """Align, split single-speaker calls, smooth, repair sentences, renumber.

    Words are shuffled once, by ``(call_id, chunk_idx)``: there they are aligned
    and gathered into stretches of one speaker within a chunk, and places in the
    call, runs and lines follow from these. Only calls heard as one speaker are
    spread into words again. Two cuts of lineage, made here, keep later branches
    from repeating the alignment and the numbering.
    """
    _, heard_words = _heard_words(words, segments, chunks, dedupe_overlap)
    numbered = durable(runs.number_stretches(durable(runs.stretches(heard_words)), chunks))
    heard = runs.merge(numbered, "run_idx")
    totals = runs.call_totals(heard).select("call_id", "call_words", "call_speakers")
    lone = totals.where("call_speakers <= 1").select("call_id")
    # Calls heard as one speaker are cut at their silences instead.
    alone = runs.spread(numbered.join(lone, "call_id", "left_semi")).drop("run_idx")
    single = runs.gather(smoothing.number_silence_turns(alone, hold=lambda near: near))
    many = numbered.join(lone, "call_id", "left_anti")
    final = repair.repair_runs(runs.merge(many, "run_idx").unionByName(runs.merge(single, "run_idx")), totals)
    both = many.drop("chunk_idx").unionByName(single)
    return Transcripts(both.withColumnRenamed("run_idx", "base_idx"), final, runs.merge(final))
