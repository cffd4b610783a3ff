"""Operational reports over jobs, keys and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.operators import usage


def ops_report(jobs: DataFrame, keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Section / name / value rows; every input is aggregated before the union."""

    def rows(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))

    n = F.count(F.lit(1)).alias("n")
    state = F.when(F.col("is_active"), "active").otherwise("revoked").alias("state")
    waiting = usage.pending_async(jobs).agg(n)
    used = usage.key_usage(requests)
    peaks = usage.instant_counts(requests).agg(*[F.max(f"last_{w}").alias(w) for w in usage.WINDOWS_S])
    stats = usage.key_stats(keys, used).select("total_requests", F.round("audio_minutes", 4).alias("audio_minutes"), "most_used_requests")

    def turned(df: DataFrame, section: str) -> DataFrame:
        """One row per column of a frame of one row."""
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns]))
        return df.select(F.lit(section).alias("section"), pairs)

    return (
        rows(jobs.groupBy("status").agg(n), "jobs", F.col("status"), F.col("n"))
        .unionByName(rows(keys.groupBy(state).agg(n), "keys", F.col("state"), F.col("n")))
        .unionByName(rows(requests.agg(n), "requests", F.lit("total"), F.col("n")))
        .unionByName(rows(usage.rtf_by_month(jobs), "rtf", F.col("period"), F.round("mean_rtf", 6)))
        .unionByName(rows(waiting, "queue", usage.level(F.col("n"), usage.QUEUE_WARN, usage.QUEUE_ERROR), F.col("n")))
        .unionByName(rows(usage.pending_queue(jobs), "next", F.col("job_id").cast("string"), F.col("priority")))
        .unionByName(rows(used, "usage", F.col("key_id").cast("string"), F.col("total_requests")))
        .unionByName(turned(peaks, "peak"))
        .unionByName(turned(stats, "key_stats"))
    )


def dated_layout(jobs: DataFrame, extension: str = "wav") -> DataFrame:
    """Date folder and file path of each job's media."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    return jobs.withColumn("ingest_date", day).withColumn(
        "media_path", F.concat(day, F.lit("/"), F.col("job_id").cast("string"), F.lit(f".{extension}"))
    )


def write_dated(df: DataFrame, path: str) -> None:
    """Append partitioned by day; rows of a day are brought together first."""
    df.repartition("ingest_date", F.pmod(F.hash("job_id"), F.lit(16))).write.mode("append").partitionBy("ingest_date").parquet(path)


def retention(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Media of finished jobs past the retention time; nothing is deleted."""
    return dated_layout(usage.finished_before(jobs, now, days)).select("job_id", "media_path")
