"""Non-speech detection over per-frame audio features.

Features per frame: energy_std, dtmf, flatness, high_freq, zcr (any scale) and
time ``t_ms``; ``rms`` and ``std`` describe the signal of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.segments import CALL, FRAME_BLOCK
from callflow.operators.sequence import index_block, label_runs

# Z-score limits and durations.
HIGH_Z, LOW_FLAT_Z, LOW_VAR_Z = 2.0, -1.5, -1.0
HALF = 10
MIN_NON_SPEECH_MS = 1000
EARLY_MS, EARLY_SHARE = 15_000, 0.25
MIN_RMS, EARLY_STD, LOW_STD, EARLY_START_MS = 0.01, 0.02, 0.01, 3000
TINY = 1e-10
METRICS = ["energy_std", "dtmf", "flatness", "high_freq", "zcr"]


def around(frames: DataFrame, aggregates: dict[str, Column], before: int = HALF, after: int = HALF - 1) -> DataFrame:
    """Aggregates over ``frame_idx`` − before … + after, a few frames of halo per block.

    Rows near a block border are copied to the neighbouring block, so frames of
    one call are spread over many tasks and no second pass is needed.
    """
    at = F.col("frame_idx")
    homes = F.array_distinct(F.array(index_block(at, FRAME_BLOCK), index_block(at - after, FRAME_BLOCK), index_block(at + before, FRAME_BLOCK)))
    rows = frames.withColumn("_block", F.explode(homes))
    w = W.partitionBy(*CALL, "_block").orderBy("frame_idx").rangeBetween(-before, after)
    for name, aggregate in aggregates.items():
        rows = rows.withColumn(name, aggregate.over(w))
    return rows.where(F.col("_block") == index_block(at, FRAME_BLOCK)).drop("_block")


def per_call(frames: DataFrame, stats: DataFrame) -> DataFrame:
    """Frames with the row of their call in ``stats`` (with _last, the call's last frame).

    The small side is repeated for every block of the call, so that frames stay
    dealt by block and a long call does not end up in one task.
    """
    spread = stats.withColumn("_home", F.explode(F.sequence(F.lit(0).cast("long"), index_block("_last", FRAME_BLOCK))))
    return frames.withColumn("_home", index_block("frame_idx", FRAME_BLOCK)).join(spread, [*CALL, "_home"]).drop("_home")


def rolling_std(frames: DataFrame, value: str = "energy", out: str = "energy_std") -> DataFrame:
    """Population deviation over [i − 10, i + 10); 0 for the first and last ten frames."""
    last = frames.groupBy(*CALL).agg(F.max("frame_idx").alias("_last"))
    rows = around(per_call(frames, last), {"_std": F.stddev_pop(value)})
    inner = (F.col("frame_idx") >= HALF) & (F.col("frame_idx") <= F.col("_last") - HALF)
    return rows.withColumn(out, F.when(inner, F.col("_std")).otherwise(0.0)).drop("_std", "_last")


def z_scores(frames: DataFrame, metrics: list[str], **more: Column) -> DataFrame:
    """Per-call z-scores; 0 where a metric hardly varies. ``more`` adds aggregates of the call."""
    stats = frames.groupBy(*CALL).agg(
        F.max("frame_idx").alias("_last"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_dev") for m in metrics],
        *[c.alias(n) for n, c in more.items()],
    )
    out = per_call(frames, stats)
    for m in metrics:
        z = F.when(F.col(f"{m}_dev") < TINY, F.lit(0.0)).otherwise((F.col(m) - F.col(f"{m}_mean")) / F.col(f"{m}_dev"))
        out = out.withColumn(f"z_{m}", z).drop(f"{m}_mean", f"{m}_dev")
    return out


def flag_frames(frames: DataFrame) -> DataFrame:
    """Frames that look like tones, synthetic speech or an early announcement."""
    step = (F.max("t_ms") - F.min("t_ms")) / F.greatest(F.max("frame_idx") - F.min("frame_idx"), F.lit(1))
    z = z_scores(frames, METRICS, _total=F.max("t_ms"), _frame_ms=step)
    flat, calm = F.col("z_flatness") < LOW_FLAT_Z, F.col("z_energy_std") < LOW_VAR_Z
    crossing = F.col("z_zcr") > HIGH_Z
    tone = (F.col("z_dtmf") > HIGH_Z) & flat & crossing
    early = F.col("t_ms") < F.least(F.lit(float(EARLY_MS)), F.col("_total") * EARLY_SHARE)
    votes = sum(x.cast("int") for x in (flat, calm, crossing, F.col("z_high_freq") > HIGH_Z))
    raw = z.withColumn("raw", (tone | (flat & calm) | (early & (votes >= 3))).cast("int"))
    near = around(raw, {"_hits": F.sum("raw")})
    inner = (F.col("frame_idx") >= HALF) & (F.col("frame_idx") <= F.col("_last") - HALF)
    keep = (F.col("raw") == 1) & (~inner | (F.col("_hits") >= HALF))
    return near.withColumn("non_speech", keep.cast("int")).drop("_hits", "_total", "raw")


def non_speech_segments(frames: DataFrame) -> DataFrame:
    """Sustained non-speech over 1 s that is loud enough and monotone."""
    flagged = flag_frames(frames)
    runs = label_runs(flagged, CALL, ["frame_idx"], index_block("frame_idx", FRAME_BLOCK), "non_speech")
    spans = runs.groupBy("call_id", "run_idx").agg(
        F.min("non_speech").alias("flag"),
        F.min("t_ms").alias("start_ms"),
        F.max("t_ms").alias("_last_t"),
        F.max("frame_idx").alias("_last_i"),
        F.max("_last").alias("_last"),
        F.max("_frame_ms").alias("_frame_ms"),
        F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"),
        F.avg("std").alias("std"),
    )
    # a run ends where the next frame starts; at the end of the call, with its last frame
    ended = spans.where("flag = 1").withColumn(
        "end_ms", F.when(F.col("_last_i") == F.col("_last"), F.col("_last_t")).otherwise(F.col("_last_t") + F.col("_frame_ms"))
    )
    fine = ((F.col("start_ms") < EARLY_START_MS) & (F.col("std") < EARLY_STD)) | (F.col("std") < LOW_STD)
    return ended.where((F.col("end_ms") - F.col("start_ms") > MIN_NON_SPEECH_MS) & (F.col("rms") >= MIN_RMS) & fine).select(
        "call_id", F.col("start_ms").cast("long").alias("start_ms"), F.round("end_ms").cast("long").alias("end_ms")
    )
