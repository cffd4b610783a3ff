"""Streaming jobs over requests, job events, turns and the delivery log.

Each transformation takes a batch or a streaming frame alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callflow.streaming.keyed import BUCKETS, KeyedFolder

LATENESS = "10 minutes"
LOG_SCHEMA = "timestamp string, data string, headers map<string,string>, method string, url string"
#: Of changes at the same time the later one in the life of a job counts.
STATUS_ORDER = ["pending", "processing", "rejected", "failed", "completed"]
STUCK_SECONDS = 300  # how long a client waits for a job


def usage_counters(requests: DataFrame) -> DataFrame:
    """Requests, audio minutes and last use per key (update mode)."""
    return requests.groupBy("key_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.greatest("audio_seconds", F.lit(0.0)) / 60.0).alias("audio_minutes"),
        F.max("ts").alias("last_used"),
    )


def request_windows(requests: DataFrame, width: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Requests per key in tumbling windows on the reset grid."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy("key_id", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key_id", F.col("w.start").alias("window_start"), "n")
    )


def change_order() -> Column:
    """Which of two changes of a job is the newer one."""
    return F.struct(F.col("ts"), F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")))


def latest_state(changes: DataFrame) -> DataFrame:
    """Latest status of each job from its changes (job_id, status, ts)."""
    return changes.groupBy("job_id").agg(F.max_by("status", change_order()).alias("status"), F.max("ts").alias("ts"))


def job_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedFolder:
    """Folder of the latest change (job_id, status, ts) of every job."""
    return KeyedFolder(spark, path, "job_id", change_order, buckets)


def save_stream(results: DataFrame, kept: KeyedFolder, states: KeyedFolder, checkpoint: str):
    """Save results (job_id, ts, …) as they arrive, each batch first into ``kept``, then as completed jobs into ``states``.

    Null fields stay null in columns; ``result_json`` omits them. A batch that
    failed between the two folders finds its results saved and completes the jobs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept.upsert(batch.withColumn("result_json", F.to_json(F.struct(*batch.columns))), batch_id)
        states.upsert(batch.select("job_id", F.lit("completed").alias("status"), "ts"), batch_id)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(turns: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions of raw turn events (caller_id, ts) closed by silence."""
    return (
        turns.withWatermark("ts", lateness)
        .groupBy("caller_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_turns"))
        .select("caller_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_turns")
    )


def delivery_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def stuck_jobs(jobs: DataFrame, now, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Jobs neither finished nor refused within the waiting time."""
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 1_000_000
    return jobs.where(F.col("status").isin("pending", "processing") & (age > seconds)).withColumn("age_s", age)


class StuckJobs(StatefulProcessor):
    """Event-time timer per job: reports a job that stays unfinished."""

    def __init__(self, seconds: int = STUCK_SECONDS):
        self._wait_ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._status = handle.getValueState("status", "status string, ts_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rank = {s: i for i, s in enumerate(STATUS_ORDER)}
        seen = self._status.get() if self._status.exists() else None
        best = (int(seen[1]), rank.get(seen[0], -1), seen[0]) if seen else None
        fresh = False
        for part in rows:
            for status, ts in zip(part["status"], part["ts"], strict=True):
                change = (int(ts.timestamp() * 1000), rank.get(status, -1), status)
                if best is None or change[:2] > best[:2]:
                    best, fresh = change, True
        if not fresh:  # a late change does not undo a newer one
            return iter(())
        self._status.update((best[2], best[0]))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if best[2] in ("pending", "processing"):
            self._handle.registerTimer(best[0] + self._wait_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waited_since = expiredTimerInfo.getExpiryTimeInMs() - self._wait_ms
        yield pd.DataFrame({"job_id": [int(key[0])], "last_change_ms": [int(waited_since)]})

    def close(self) -> None:
        pass


def stuck_job_stream(changes: DataFrame, seconds: int = STUCK_SECONDS, lateness: str = LATENESS) -> DataFrame:
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=StuckJobs(seconds), outputStructType="job_id long, last_change_ms long", outputMode="Append", timeMode="EventTime"
        )
    )


def run_incremental(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Process what has arrived and stop; each batch replaces its own folder.

    A batch that is repeated after a failure overwrites what it wrote before,
    so the output holds every row once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
