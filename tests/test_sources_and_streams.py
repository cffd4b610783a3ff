"""Files, delivery, and streaming jobs against their batch results."""

import os
import random

from pyspark.sql import functions as F

from callflow.operators import usage
from callflow.plans import deliver, operations
from callflow.sources import files
from callflow.streaming import admission, jobs


def write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_rttm_and_transcripts(spark, folder):
    rttm = write(folder, "a.rttm", "SPEAKER f 1 0.5 1.25 <NA> <NA> speaker_1 <NA> <NA>\nshort line\n")
    assert [tuple(r)[1:] for r in files.read_rttm(spark, rttm).collect()] == [("speaker_1", 0.5, 1.75, 1.25)]
    text = write(folder, "t.txt", "=== Results ===\nAudio File: x.wav\nDuration: 40.48s (0.67 minutes)\nModel: m\nChunks Processed: 2\nProcessing Time: 2.00s\nRTF: 0.049\nPerformance: 20.3x real-time\nGenerated: now\n\n=== TRANSCRIPTION ===\nHello there.\n\n=== END ===\n")
    row = files.read_transcript_files(spark, text).first()
    assert (row.audio_file, row.duration_s, row.chunks, row.rtf, row.times_real_time, row.text) == ("x.wav", 40.48, 2, 0.049, 20.3, "Hello there.")


def test_labels_log_and_results(spark, folder):
    path = write(folder, "l.csv", "Sentiment,Ground Truth\npositive,Neutral\n")
    assert files.read_labels(spark, path).first().asDict() == {"predicted": "positive", "actual": "Neutral"}
    entry = spark.sql("SELECT '2024-01-01' AS timestamp, '{}' AS data, map('a','b') AS headers, 'POST' AS method, 'http://x' AS url")
    for _ in range(2):
        files.append_event_log(entry, f"{folder}/log")
    assert files.read_event_log(spark, f"{folder}/log").where("headers['a'] = 'b'").count() == 2
    results = spark.sql("SELECT 1L AS job_id, 'hi' AS text, CAST(NULL AS STRING) AS diarization")
    all_jobs = spark.sql("SELECT explode(array(1L, 2L)) AS job_id, 'processing' AS status")
    all_jobs.write.parquet(f"{folder}/jobs/batch=0")
    for _ in range(2):  # saving again changes nothing, and jobs may come from where they are written
        files.save_results(results, files.read_saved(spark, f"{folder}/jobs"), f"{folder}/results", f"{folder}/jobs", batch=1)
    files.save_results(results.withColumn("job_id", F.lit(2).cast("long")), all_jobs, f"{folder}/results", f"{folder}/jobs", batch=2)
    saved = {r.job_id: r.result_json for r in files.read_saved(spark, f"{folder}/results").collect()}
    assert saved == {1: '{"job_id":1,"text":"hi"}', 2: '{"job_id":2,"text":"hi"}'}
    assert files.read_tables(spark, folder, ["results"])["results"].count() == 2
    assert {r.job_id: r.status for r in files.read_saved(spark, f"{folder}/jobs").collect()} == {1: "completed", 2: "completed"}
    dated = operations.dated_layout(all_jobs.withColumn("created_at", F.lit("2024-05-06 07:00:00").cast("timestamp")))
    operations.write_dated(dated, f"{folder}/dated")
    assert spark.read.parquet(f"{folder}/dated").where("ingest_date = '2024-05-06'").count() == 2


def test_delivery_retries(spark):
    rows = spark.sql("SELECT job_id, url AS callback_url, 'text' AS transcription FROM VALUES (1L, ' https://ok.example/x; '), (2L, 'https://down.example'), (3L, 'ftp://no') t(job_id, url)")

    def sender(url, body):
        if "down" in url:
            raise OSError("refused")
        return 204

    got = {r.job_id: r for r in deliver.deliver_results(rows, sender, sleep=lambda s: None).collect()}
    assert (got[1].delivered, got[1].attempts) == (True, 1)
    assert (got[2].delivered, got[2].attempts, got[2].last_error) == (False, 3, "refused")
    assert (got[3].delivered, got[3].attempts) == (False, 0)


def request_rows(n=150):
    rnd = random.Random(3)
    t, rows = 1_700_000_000, []
    for i in range(n):
        t += rnd.choice([1, 5, 30, 600, 4000, 90000]) if rnd.random() < 0.9 else 0
        rows.append((rnd.randrange(3), i, t, 2, 5, 8))
    return rows


def admit_model(rows):
    past, out = {}, {}
    for key, rid, t, *limits in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = past.setdefault(key, [])
        ok = all(sum(t - x < w for x in seen) < m for w, m in zip((60, 3600, 86400), limits))
        if ok:
            seen.append(t)
        out[rid] = ok
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key_id long, request_id long, s long, requests_per_minute long, requests_per_hour long, requests_per_day long")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_admission_batch_and_stream(spark, folder):
    rows = request_rows()
    want = admit_model(rows)
    df = frame(spark, rows)
    assert {r.request_id: r.allowed for r in admission.admit_batch(df).collect()} == want
    # trailing counts over all attempts would refuse more: they are another report
    assert usage.trailing_counts(df).where("last_minute > 2").count() > 0
    for part in range(3):
        frame(spark, rows[part * 50 : part * 50 + 50]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = admission.admit_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert {r.request_id: r.allowed for r in spark.read.parquet(f"{folder}/out").collect()} == want


def test_windows_stream_equals_batch(spark, folder):
    df = frame(spark, request_rows())
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")

    def run(out, name, mode):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(180)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(jobs.request_windows(stream), "win", "complete") == sorted(map(tuple, jobs.request_windows(df).collect()))
    more = lambda d: jobs.usage_counters(d.withColumn("audio_seconds", F.lit(30.0)))
    assert run(more(stream), "use", "complete") == sorted(map(tuple, more(df).collect()))


def test_a_late_change_does_not_undo_a_newer_one(spark, folder):
    sql = "SELECT {0}L AS job_id, '{1}' AS status, timestamp'2024-01-01 {2}' AS ts"
    for part, rows in enumerate([[(1, "pending", "00:00:00")], [(1, "completed", "00:00:30")], [(1, "processing", "00:00:10"), (2, "pending", "00:00:20")], [(9, "completed", "03:00:00")], [(9, "completed", "06:00:00")]]):
        frames = [spark.sql(sql.format(*r)) for r in rows]
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(f"{folder}/in{part}")
    schema = spark.read.parquet(f"{folder}/in0").schema
    for part in range(5):
        spark.read.parquet(f"{folder}/in{part}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = jobs.stuck_job_stream(stream, lateness="1 hour").writeStream.format("memory").queryName("late").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert [r.job_id for r in spark.table("late").collect()] == [2]
    tied = spark.sql("SELECT 1L AS job_id, s AS status, timestamp'2024-01-01' AS ts FROM VALUES ('completed'), ('pending'), ('processing') t(s)")
    assert jobs.latest_state(tied).first().status == "completed"


def test_incremental_and_stuck_jobs(spark, folder):
    df = spark.sql("SELECT * FROM VALUES (1L, 'pending', timestamp'2024-01-01 00:00:00'), (2L, 'completed', timestamp'2024-01-01 00:00:10'), (3L, 'processing', timestamp'2024-01-01 02:00:00') t(job_id, status, ts)")
    for job in (1, 2, 3):
        df.where(f"job_id = {job}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    query = jobs.run_incremental(stream, jobs.latest_state, f"{folder}/out", f"{folder}/c1")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/out").count() == 3
    stuck = jobs.stuck_job_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), lateness="1 minute")
    query = stuck.writeStream.format("memory").queryName("stuck").option("checkpointLocation", f"{folder}/c2").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert [r.job_id for r in spark.table("stuck").collect()] == [1]


def test_transcripts_share_files(spark, folder, monkeypatch):
    from callflow.catalog import files as catalog, registry

    monkeypatch.setattr(catalog, "new_folder", lambda t: f"{folder}/x")
    rows = registry.queries()["a6_transcript_files"](spark, "/root/testdata/sf0.01").count()
    assert rows == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count() > 50
    written = [f for _, _, names in os.walk(f"{folder}/x") for f in names if f.endswith(".txt")]
    assert len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_transcripts_of_one_file_are_read_apart(spark, folder):
    one = "=== Results ===\nAudio File: c{0}.wav\nDuration: {0}.25s\nModel: m\nChunks Processed: {0}\n\n=== TRANSCRIPTION ===\nA == {0}.\n=== B =\n\n=== END ==="
    path = write(folder, "many.txt", "\n".join(one.format(i) for i in range(300)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")  # cuts fall anywhere, within end marks too
        got = files.read_transcript_files(spark, path, many=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.chunks, r.audio_file, r.duration_s, r.text) for r in got) == [(i, f"c{i}.wav", i + 0.25, f"A == {i}.\n=== B =") for i in range(300)]
