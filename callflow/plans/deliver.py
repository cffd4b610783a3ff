"""Deliver finished results and keep a log of what was sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callflow.session import durable
from callflow.sources import delivery, files
from callflow.streaming.keyed import BUCKETS, KeyedFolder


def build_payloads(results: DataFrame) -> DataFrame:
    fields = {n: F.col(n) for n in delivery.OPTIONAL if n in results.columns}
    return results.select("job_id", "callback_url", delivery.payload(job_id=F.col("job_id"), **fields).alias("payload"))


def deliver_results(results: DataFrame, sender, **options) -> DataFrame:
    """Status per job. The result is durable, so reading it never sends again."""
    return durable(delivery.deliver(build_payloads(results), sender, **options))


def delivery_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedFolder:
    """Folder of the newest status (job_id, delivered, attempts, last_error, batch) of every job sent."""
    return KeyedFolder(spark, path, "job_id", lambda: F.struct("delivered", "batch"), buckets)


def deliver_stream(results: DataFrame, sender, states: KeyedFolder, log: str, checkpoint: str, at: Column | None = None, **options):
    """Deliver results as they arrive; ``log`` gets what was delivered, batch by batch.

    A batch is committed by publishing its statuses in ``states``. Jobs that a
    committed batch delivered are not sent again, whichever batch brings them
    back; those that failed are. Statuses and log entries of a batch that breaks
    off before its commit are written anew, and its jobs are sent again:
    delivery is at least once. ``committed_log`` reads the log of committed
    batches, each of them once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if states.committed(batch_id):
            return
        known = states.read()
        fresh = batch if known is None else batch.join(known.where("delivered").select("job_id"), "job_id", "left_anti")
        once = durable(fresh.dropDuplicates(["job_id"]))
        status = deliver_results(once, sender, **options).withColumn("batch", F.lit(batch_id).cast("long"))
        entries = log_entries(once, status, F.current_timestamp().cast("string") if at is None else at)
        entries.write.mode("overwrite").json(f"{log}/batch={batch_id}")
        states.upsert(status, batch_id)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_log(log: str, states: KeyedFolder) -> DataFrame | None:
    """Log entries of the committed batches; None before the first."""
    version = states.manifest()
    if version is None:
        return None
    return files.read_event_log(states.spark, log).where(F.col("batch") <= version["batch"])


def log_entries(results: DataFrame, status: DataFrame, at: Column) -> DataFrame:
    """What was delivered: time, payload, headers, method, address."""
    sent = build_payloads(results).join(status.where("delivered").select("job_id"), "job_id", "left_semi")
    headers = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    return sent.select(at.alias("timestamp"), F.col("payload").alias("data"), headers.alias("headers"), F.lit("POST").alias("method"), F.col("callback_url").alias("url"))


def log_deliveries(results: DataFrame, status: DataFrame, path: str, at: Column) -> None:
    """Append what was delivered to the log: time, payload, headers, method, address."""
    files.append_event_log(log_entries(results, status, at), path)
