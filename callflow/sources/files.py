"""Readers of media folders, RTTM, transcript files, labels, logs and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callflow.functions import formatting as fmt
from callflow.session import durable
from callflow.streaming.jobs import LOG_SCHEMA

HEADER = {
    "audio_file": "Audio File", "duration": "Duration", "model": "Model", "chunks": "Chunks Processed",
    "processing_time": "Processing Time", "rtf": "RTF", "performance": "Performance", "generated": "Generated",
}


def media_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, extension and type of files; their content is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        .select("path", F.col("length").alias("size"), "modificationTime")
    )
    ext = fmt.extension(F.col("path"))
    return files.withColumn("extension", ext).withColumn("mime", fmt.mime_type(F.lit(None).cast("string"), ext))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Speaker segments from RTTM lines with at least eight fields."""
    f = F.col("f")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.where(F.size(f) >= 8).select(
        "file", f[7].alias("speaker"), f[3].cast("double").alias("start"),
        (f[3].cast("double") + f[4].cast("double")).alias("end"), f[4].cast("double").alias("duration"),
    )


TRANSCRIPT_END = "=== END ==="


def read_transcript_files(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """Header values and body of transcript text files, one row per file.

    With ``many`` a file holds transcripts one after the other, a title line
    first and ``=== END ===`` last in each, and gives a row for each of them. A
    text that holds the end mark itself ends there, in either form.
    """
    if many:
        records = spark.read.text(path, lineSep=TRANSCRIPT_END).where(F.col("value").rlike(r"^\s*===[^\n]*===\s*\n"))
    else:
        records = spark.read.text(path, wholetext=True)
    raw = records.select(F.input_file_name().alias("file"), "value")

    def head(name: str):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{name}:[ ]*(.*)$", 1)), F.lit(""))

    def number(c):
        return F.regexp_extract(c, r"([0-9.]+)", 1).try_cast("double")

    h = {k: head(v) for k, v in HEADER.items()}
    return raw.select(
        "file", h["audio_file"].alias("audio_file"), number(h["duration"]).alias("duration_s"), h["model"].alias("model"),
        h["chunks"].try_cast("int").alias("chunks"), number(h["processing_time"]).alias("processing_s"), number(h["rtf"]).alias("rtf"),
        number(h["performance"]).alias("times_real_time"), h["generated"].alias("generated"),
        F.trim(F.regexp_extract("value", r"(?s)=== TRANSCRIPTION ===\s*(.*?)\s*(?:=== END ===|\z)", 1)).alias("text"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Predicted and actual labels from csv or parquet."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return df.select(F.col("Sentiment").alias("predicted"), F.col("`Ground Truth`").alias("actual"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def append_event_log(entries: DataFrame, path: str) -> None:
    """Append delivered payloads as JSON lines."""
    entries.select("timestamp", "data", "headers", "method", "url").write.mode("append").json(path)


def read_tables(spark: SparkSession, location: str, names: list[str], ids: dict[str, tuple[str, int, int]] | None = None, partitions: int = 200, **jdbc) -> dict[str, DataFrame]:
    """Service tables from a parquet folder, or over JDBC split by an id range.

    ``ids`` gives (column, lower, upper) per table for the JDBC split.
    """
    if not location.startswith("jdbc:"):
        return {n: spark.read.parquet(f"{location}/{n}") for n in names}
    out = {}
    for n in names:
        reader = spark.read.format("jdbc").options(url=location, dbtable=n, **jdbc)
        if ids and n in ids:
            column, low, high = ids[n]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions)
        out[n] = reader.load()
    return out


def save_results(results: DataFrame, jobs: DataFrame, results_path: str, jobs_path: str, batch: int = 0) -> None:
    """Write one batch of results, then its jobs as completed.

    Every batch has a folder of its own, which a repeated save replaces, so
    saving again changes nothing and other batches stay. Results go first: a job
    only ever reads as completed once its result is there. Null fields stay null
    in columns; ``result_json`` omits them. ``jobs`` may be read from
    ``jobs_path``: the rows to write are cut off from it before.
    """
    kept = f"{results_path}/batch={batch}"
    results.withColumn("result_json", F.to_json(F.struct(*results.columns))).write.mode("overwrite").parquet(kept)
    done = results.sparkSession.read.parquet(kept).select("job_id").distinct()
    finished = jobs.drop("batch").join(done, "job_id", "left_semi").withColumn("status", F.lit("completed"))
    durable(finished).write.mode("overwrite").parquet(f"{jobs_path}/batch={batch}")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Newest row of each job over all batches below ``path``."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return newest.select("_row.*")


def read_eval_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, label string, metric string, value double").json(path)


def write_eval_report(report: DataFrame, path: str) -> None:
    """The report (section, label, metric, value), a few rows, as one file of JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
