"""Speaker segments from frame tables: filter, window, label, clean up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.operators import frames as fr
from callflow.operators import segments as sg
from callflow.operators.sequence import number_rows
from callflow.session import durable


def diarize_segments(speech_frames: DataFrame, features: DataFrame, label_windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Final speaker segments per call.

    ``label_windows`` adds ``label`` (a cluster number) to windows (call_id,
    win_idx, start_ms, end_ms), e.g. by joining vectors and their clusters.
    """
    non_speech = durable(fr.non_speech_segments(features))
    speech = sg.subtract(sg.speech_segments(speech_frames), non_speech)
    block = F.floor(F.col("start_ms") / sg.SEGMENT_BLOCK_MS)
    numbered = durable(number_rows(speech, ["call_id"], ["start_ms", "end_ms"], block, "seg_idx"))
    cut = sg.embedding_windows(numbered)
    windows = durable(number_rows(cut, ["call_id"], ["start_ms", "end_ms"], block, "win_idx"))
    labelled = durable(sg.label_segments(durable(label_windows(windows))))
    return sg.merge_adjacent(sg.remove_leading_ivr(labelled, non_speech))


def describe(segments: DataFrame) -> DataFrame:
    """Summary of a result per call: speakers and segments."""
    return segments.groupBy("call_id").agg(
        F.count_distinct("speaker").alias("num_speakers"), F.count(F.lit(1)).alias("total_segments"), F.max("end_ms").alias("end_ms")
    )
