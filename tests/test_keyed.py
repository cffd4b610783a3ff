"""Keyed folders and streams into them: versions, repeats, failures, readers during a write."""

import pytest
from pyspark.sql import functions as F

from callflow.plans import deliver
from callflow.streaming import jobs
from callflow.streaming.keyed import KeyedFolder, upsert_stream

SQL = "SELECT {0}L AS job_id, '{1}' AS status, timestamp'2024-01-01 {2}' AS ts"


def changes(spark, *rows):
    out = None
    for row in rows:
        one = spark.sql(SQL.format(*row))
        out = one if out is None else out.unionByName(one)
    return out


def states(folder):
    return {r.job_id: r.status for r in folder.read().collect()}


def test_a_batch_is_published_whole_and_once(spark, folder):
    kept = jobs.job_states(spark, f"{folder}/k", buckets=4)
    assert kept.read() is None and not kept.committed(0)
    first = changes(spark, *[(i, "pending", "00:00:00") for i in range(20)])
    assert kept.upsert(first, 0)
    before = kept.read()  # a reader that opened the version before the next batch
    assert kept.upsert(changes(spark, (3, "completed", "00:10:00"), (4, "processing", "00:05:00"), (50, "pending", "00:00:00")), 1)
    assert {r.status for r in before.collect()} == {"pending"} and before.count() == 20
    want = {i: "pending" for i in range(20)} | {3: "completed", 4: "processing", 50: "pending"}
    assert states(kept) == want
    assert not kept.upsert(changes(spark, (3, "failed", "09:00:00")), 1)  # repeated after its commit
    assert states(kept) == want
    assert kept.upsert(changes(spark, (3, "pending", "00:00:01")), 2)  # an older change does not win
    assert states(kept) == want
    folders = kept.manifest()["folders"]
    assert len(set(folders.values())) == len(folders) <= 4


def test_a_batch_that_broke_off_is_not_seen(spark, folder):
    kept = jobs.job_states(spark, f"{folder}/k", buckets=2)
    kept.upsert(changes(spark, (1, "pending", "00:00:00")), 0)

    def fails(version):
        raise OSError("lost")

    whole, kept._publish = kept._publish, fails
    with pytest.raises(OSError):
        kept.upsert(changes(spark, (1, "completed", "00:10:00")), 1)
    assert states(kept) == {1: "pending"}  # its files are there, but no manifest names them
    kept._publish = whole
    assert kept.upsert(changes(spark, (1, "completed", "00:10:00")), 1)
    assert states(kept) == {1: "completed"}
    with pytest.raises(OSError):  # two writers of one batch: one of them loses
        kept._publish(kept.manifest())


def test_streams_into_a_folder(spark, folder):
    parts = [changes(spark, (1, "pending", "00:00:00"), (2, "pending", "00:00:00")), changes(spark, (1, "completed", "00:09:00")), changes(spark, (1, "processing", "00:05:00"), (3, "failed", "00:01:00"))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = jobs.job_states(spark, f"{folder}/k", buckets=4)
    upsert_stream(stream, kept, f"{folder}/c", jobs.latest_state).awaitTermination(120)
    assert states(kept) == {1: "completed", 2: "pending", 3: "failed"}
    parts[0].withColumn("status", F.lit("rejected")).withColumn("ts", F.lit("2025-01-01").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
    upsert_stream(stream, kept, f"{folder}/c", jobs.latest_state).awaitTermination(120)
    assert states(kept) == {1: "rejected", 2: "rejected", 3: "failed"}


def test_results_are_saved_as_a_stream(spark, folder):
    kept = KeyedFolder(spark, f"{folder}/r", "job_id", lambda: F.struct("ts"), 2)
    done = jobs.job_states(spark, f"{folder}/j", buckets=2)
    done.upsert(changes(spark, (1, "processing", "00:00:00"), (2, "processing", "00:00:00")), -1)
    row = spark.sql("SELECT 1L AS job_id, 'hi' AS text, CAST(NULL AS STRING) AS diarization, timestamp'2024-01-01 01:00:00' AS ts")
    row.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(row.schema).parquet(f"{folder}/in")
    jobs.save_stream(stream, kept, done, f"{folder}/c").awaitTermination(120)
    assert states(done) == {1: "completed", 2: "processing"}
    assert "diarization" not in kept.read().first().result_json


def test_delivered_jobs_are_not_sent_again(spark, folder):
    """A batch fails after sending and is repeated; jobs come back in later batches."""
    sent = f"{folder}/sent"
    spark.range(0).selectExpr("'x' AS value").write.text(sent)

    def sender(url, body):
        import uuid

        with open(f"{sent}/{uuid.uuid4().hex}.txt", "w") as f:  # one local machine in this test
            f.write(body)
        return 204 if "good" in url else 500

    def arrive(ids, url):
        spark.createDataFrame([(i, url, "text") for i in ids], "job_id long, callback_url string, transcription string").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    arrive([1, 1, 2], "https://good.example")
    arrive([3], "https://bad.example")
    rows = spark.readStream.schema("job_id long, callback_url string, transcription string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = deliver.delivery_states(spark, f"{folder}/k", 2)
    whole = kept._publish
    kept._publish = lambda version: (_ for _ in ()).throw(OSError("lost"))
    query = deliver.deliver_stream(rows, sender, kept, f"{folder}/log", f"{folder}/c", sleep=lambda s: None, max_attempts=2)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
    assert deliver.committed_log(f"{folder}/log", kept) is None
    kept._publish = whole

    def again():
        deliver.deliver_stream(rows, sender, kept, f"{folder}/log", f"{folder}/c", sleep=lambda s: None, max_attempts=2).awaitTermination(120)
        return sorted(int(r.value.split(":")[1].split(",")[0].rstrip("}")) for r in spark.read.text(sent).collect())

    assert again() == [1, 1, 2, 2, 3, 3]  # the broken batch twice, each job of it once a time; two attempts of 3
    arrive([1, 2, 3, 4], "https://good.example")
    assert again() == [1, 1, 2, 2, 3, 3, 3, 4]
    assert {r.job_id: (r.delivered, r.attempts) for r in kept.read().collect()} == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1)}
    assert sorted(r.data for r in deliver.committed_log(f"{folder}/log", kept).select("data").distinct().collect()) == sorted(f'{{"job_id":{i},"transcription":"text"}}' for i in (1, 2, 3, 4))
    assert deliver.committed_log(f"{folder}/log", kept).count() == 4


def test_a_bucket_is_merged_and_written_by_many_tasks(spark, folder):
    import glob

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = jobs.job_states(spark, f"{folder}/k", buckets=1)
        rows = spark.range(2000).selectExpr("id AS job_id", "'pending' AS status", "timestamp'2024-01-01 00:00:00' AS ts")
        kept.upsert(rows, 0)
        kept.upsert(rows.selectExpr("job_id", "'completed' AS status", "ts + INTERVAL 1 MINUTE AS ts").where("job_id % 2 = 0"), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert states(kept) == {i: "pending" if i % 2 else "completed" for i in range(2000)}
    for batch in range(2):
        assert len(glob.glob(f"{folder}/k/data/{batch:020d}-*/_bucket=0/*.parquet")) > 1
