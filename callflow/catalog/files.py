"""Round trips of the readers, writers and streams over the given tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.catalog.operations import EV, REPORT_SQL
from callflow.catalog.registry import query
from callflow.catalog.requests import CHANGES, accepts_even, no_wait
from callflow.operators import usage
from callflow.plans import deliver, evaluate
from callflow.sources import files
from callflow.streaming import jobs, rollup
from callflow.streaming.keyed import KeyedFolder, upsert_stream


def new_folder(t) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


@query("a5_rttm", "SELECT call_id, speaker, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM segments", "segments")
def a5(t):
    out = new_folder(t)
    seconds = lambda c: F.format_string("%d.%03d", F.floor(c / 1000), c % 1000)
    length = F.col("end_ms") - F.col("start_ms")
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.lit("call"), F.lit("1"), seconds(F.col("start_ms")), seconds(length), F.lit("<NA>"), F.lit("<NA>"), "speaker", F.lit("<NA>"), F.lit("<NA>"))
    t["segments"].select("call_id", line.alias("value")).repartition("call_id").write.partitionBy("call_id").text(out)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    call = F.regexp_extract("file", r"call_id=(\d+)", 1).cast("long")
    return files.read_rttm(t.spark, out).select(call.alias("call_id"), "speaker", ms("start").alias("start_ms"), ms("end").alias("end_ms"), ms("duration").alias("duration_ms"))


@query(
    "a6_transcript_files",
    """SELECT 'call_' || conv_id || '.wav' AS audio_file, CAST(count(*) + 0.25 AS DOUBLE) AS duration_s, 'm' || conv_id % 3 AS model, CAST(count(*) AS INT) AS chunks,
       string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
)
def a6(t):
    out = new_folder(t)
    c = t["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("text"))))["text"].alias("texts"))
    n = F.size("texts").cast("string")
    head = F.concat(
        F.lit("=== Results ===\nAudio File: call_"), F.col("conv_id").cast("string"), F.lit(".wav\nDuration: "), n, F.lit(".25s (1 minutes)\nModel: m"), (F.col("conv_id") % 3).cast("string"),
        F.lit("\nChunks Processed: "), n, F.lit("\nProcessing Time: 2.00s\nRTF: 0.049\nPerformance: 20.3x real-time\nGenerated: now\n\n=== TRANSCRIPTION ===\n"),
    )
    value = F.concat(head, F.array_join("texts", "\n"), F.lit("\n\n=== END ==="))
    c.select(value.alias("value")).write.text(out)  # a file for each would cost the driver a folder for each
    return files.read_transcript_files(t.spark, out, many=True).select("audio_file", "duration_s", "model", "chunks", "text")


@query("a7_labels", "SELECT predicted, actual, count(*) AS n FROM eval_labels GROUP BY 1, 2", "eval_labels")
def a7(t):
    out = new_folder(t)
    t["eval_labels"].select(F.col("predicted").alias("Sentiment"), F.col("actual").alias("Ground Truth")).write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(out)
    return files.read_labels(t.spark, out).groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


def _refuses_odd(url: str, body: str) -> int:
    return 200 if int(body.split(":")[1].split(",")[0].rstrip("}")) % 2 == 0 else 503


def delivered_log(t) -> str:
    """Deliver the results and append what was sent to a log, in two parts."""
    out = new_folder(t)
    every = t["results"].select("job_id", F.concat(F.lit("https://x.example/"), F.col("job_id") % 4).alias("callback_url"), F.col("text").alias("transcription"))
    for part in range(2):
        some = every.where(F.col("job_id") % 3 % 2 == part)
        status = deliver.deliver_results(some, _refuses_odd, sleep=lambda _: None)
        deliver.log_deliveries(some, status, out, F.lit("2024-01-01T00:00:00"))
    return out


LOG_SQL = "SELECT job_id, 'https://x.example/' || job_id % 4 AS url, 'POST' AS method, text AS transcription FROM results WHERE job_id % 2 = 0"


def _read(log: DataFrame) -> DataFrame:
    data = lambda name: F.get_json_object("data", f"$.{name}")
    return log.select(data("job_id").cast("long").alias("job_id"), "url", "method", data("transcription").alias("transcription"))


@query("a8_a13_delivery_log", LOG_SQL, "results")
def a8(t):
    return _read(files.read_event_log(t.spark, delivered_log(t)))


@query("a13_evaluation_report", REPORT_SQL, "eval_labels", **EV)
def a13(t):
    out = new_folder(t)
    files.write_eval_report(evaluate.report(t["eval_labels"]), out)
    return files.read_eval_report(t.spark, out).withColumn("value", F.round("value", 6))


@query("i4_delivery_log_stream", LOG_SQL, "results")
def i4(t):
    out = new_folder(t)
    stream = _read(jobs.delivery_log_stream(t.spark, delivered_log(t)))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("a10_save_results", "SELECT j.job_id, r.text, CASE WHEN r.job_id IS NULL THEN j.status ELSE 'completed' END AS status FROM jobs j LEFT JOIN results r ON r.job_id = j.job_id", "jobs results")
def a10(t):
    out = new_folder(t)
    kept, states = f"{out}/results", f"{out}/jobs"
    t["jobs"].write.parquet(f"{states}/batch=0")
    for batch in (1, 2, 1):  # the first batch is saved twice
        some = t["results"].where(F.col("job_id") % 2 == batch % 2)
        files.save_results(some, files.read_saved(t.spark, states), kept, states, batch)
    results = files.read_saved(t.spark, kept).select("job_id", F.get_json_object("result_json", "$.text").alias("text"))
    return files.read_saved(t.spark, states).select("job_id", "status").join(results, "job_id", "left")


def arriving(t, rows: DataFrame, out: str, parts: int) -> DataFrame:
    """The rows as a stream of ``parts`` files, one a batch."""
    rows.repartition(parts).write.parquet(out)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(out)


@query("i3_lifecycle_stream", "SELECT job_id, status FROM jobs", "jobs")
def i3_stream(t):
    out = new_folder(t)
    states = jobs.job_states(t.spark, f"{out}/states", buckets=8)
    upsert_stream(arriving(t, t.sql(CHANGES), f"{out}/in", 3), states, f"{out}/c", jobs.latest_state).awaitTermination()
    return states.read().select("job_id", "status")


@query("a10_save_stream", "SELECT j.job_id, r.text, CASE WHEN r.job_id IS NULL THEN j.status ELSE 'completed' END AS status FROM jobs j LEFT JOIN results r ON r.job_id = j.job_id", "jobs results")
def a10_stream(t):
    out = new_folder(t)
    kept, states = (KeyedFolder(t.spark, f"{out}/{name}", "job_id", jobs.change_order if name == "jobs" else lambda: F.struct("ts"), 8) for name in ("results", "jobs"))
    states.upsert(t["jobs"].select("job_id", "status", F.lit("1990-01-01").cast("timestamp").alias("ts")), -1)
    results = t["results"].withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    jobs.save_stream(arriving(t, results, f"{out}/in", 2), kept, states, f"{out}/c").awaitTermination()
    saved = kept.read().select("job_id", F.get_json_object("result_json", "$.text").alias("text"))
    return states.read().select("job_id", "status").join(saved, "job_id", "left")


@query("k8_deliver_stream", """SELECT job_id, job_id % 3 <> 0 AND job_id % 2 = 0 AS delivered, CASE WHEN job_id % 3 = 0 THEN 0 WHEN job_id % 2 = 0 THEN 1 ELSE 3 END AS attempts,
    CASE WHEN job_id % 3 <> 0 AND job_id % 2 = 0 THEN 'https://x.example/cb' END AS logged FROM results""", "results")
def k8_stream(t):
    out = new_folder(t)
    rows = t["results"].select("job_id", F.when(F.col("job_id") % 3 == 0, "ftp://x").otherwise("https://x.example/cb").alias("callback_url"), F.col("text").alias("transcription"))
    states = deliver.delivery_states(t.spark, f"{out}/states", 8)
    deliver.deliver_stream(arriving(t, rows, f"{out}/in", 2), accepts_even, states, f"{out}/log", f"{out}/c", sleep=no_wait).awaitTermination()
    log = deliver.committed_log(f"{out}/log", states).select(F.get_json_object("data", "$.job_id").cast("long").alias("job_id"), F.col("url").alias("logged"))
    return states.read().select("job_id", "delivered", "attempts").join(log, "job_id", "left")


@query(
    "i7_rollup_stream",
    f"""SELECT period, count(*) AS jobs, round(avg(v), 6) AS mean_rtf, round(max(mid) FILTER (WHERE mid_place), 6) AS median_rtf FROM (
        SELECT *, CASE WHEN v < 1e-9 THEN 0 ELSE pow({rollup.RATIO!r}, bin) * {2 / (rollup.RATIO + 1)!r} END AS mid, place = ceil(n / 2.0) AS mid_place FROM (
            SELECT strftime(created_at, '%Y-%m') AS period, processing_time / audio_duration AS v, ceil(ln(v) / {math.log(rollup.RATIO)!r}) AS bin,
                   row_number() OVER (PARTITION BY period ORDER BY bin) AS place, count(*) OVER (PARTITION BY period) AS n
            FROM jobs WHERE audio_duration > 0 AND processing_time > 0) a) b GROUP BY period""",
    "jobs",
)
def i7_rollup(t):
    out = new_folder(t)
    ratios = usage.with_rtf(t["jobs"]).where("processing_time > 0").select(
        F.col("job_id").alias("id"), F.lit(2).alias("version"), F.date_format("created_at", "yyyy-MM").alias("group"), F.col("rtf").alias("value")
    )
    kept = rollup.Rollup(t.spark, f"{out}/rollup", 8)
    early = ratios.where("id % 3 = 0").withColumn("version", F.lit(1)).withColumn("value", F.col("value") + 5)  # replaced later
    kept.add(early, -1)
    kept.follow(arriving(t, ratios, f"{out}/in", 2), f"{out}/c").awaitTermination()
    return kept.read().select(F.col("group").alias("period"), F.col("n").alias("jobs"), F.round("mean", 6).alias("mean_rtf"), F.round("quantile", 6).alias("median_rtf"))


@query("i7_incremental", "SELECT job_id, status FROM jobs", "jobs")
def i7(t):
    out = new_folder(t)
    changes = t.sql(CHANGES)
    changes.write.parquet(f"{out}/in")
    stream = t.spark.readStream.schema(changes.schema).parquet(f"{out}/in")
    jobs.run_incremental(stream, jobs.latest_state, f"{out}/out", f"{out}/state").awaitTermination()
    return jobs.latest_state(t.spark.read.parquet(f"{out}/out")).select("job_id", "status")
