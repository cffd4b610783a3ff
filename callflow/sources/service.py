"""Readers of service outputs: call records, speech and speaker results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CDR_FIELDS = ["uniqueId", "src", "dst", "accountId", "disposition", "calldate", "agentExtension", "direction"]
CDR_SCHEMA = ", ".join(f"{f} string" for f in CDR_FIELDS)


def read_cdr(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Call records from JSON text: parsed rows and rejected rows with a reason."""
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    ok = F.coalesce(is_object, F.lit(False))
    good = rows.where(ok).withColumn("cdr", F.from_json(raw, CDR_SCHEMA))
    return good, rows.where(~ok).withColumn("reason", F.lit("invalid_call_metadata"))


def _first_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}", "string") for p in paths])


def read_asr_results(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Text and words of speech results.

    A word list that is not a list is empty; anything that is not a JSON object
    is taken as the text itself. Words may be under text, word or segment.
    """
    doc = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    scalar = F.try_variant_get(doc, "$", "string")
    words = F.from_json(
        F.get_json_object(raw, "$.word_timestamps"),
        "array<struct<text:string, word:string, segment:string, start:double, end:double>>",
    )
    tidy = F.transform(
        words,
        lambda w: F.struct(
            F.coalesce(w["text"], w["word"], w["segment"], F.lit("")).alias("text"),
            F.round(w["start"] * 1000).cast("long").alias("start_ms"),
            F.round(w["end"] * 1000).cast("long").alias("end_ms"),
        ),
    )
    return rows.withColumn(
        "text", F.when(is_object, F.try_variant_get(doc, "$.text", "string")).otherwise(F.coalesce(scalar, F.col(raw)))
    ).withColumn("words", F.when(is_object, F.coalesce(tidy, F.array())).otherwise(F.array().cast(
        "array<struct<text:string,start_ms:bigint,end_ms:bigint>>")))


def explode_words(results: DataFrame, *keys: str) -> DataFrame:
    return results.select(*keys, F.posexplode("words").alias("pos", "w")).select(
        *keys, F.col("pos").cast("long").alias("pos"), "w.text", "w.start_ms", "w.end_ms"
    )


DIARIZATION_SCHEMA = (
    "segments array<struct<speaker:string, start:double, end:double, duration:double>>, num_speakers long, "
    "total_segments long, duration double, inference_time double, ivr_detected boolean, status string, error string"
)


def read_diarization_results(rows: DataFrame, *keys: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Speaker segments, one row each, and the rows that carry an error."""
    parsed = rows.withColumn("d", F.from_json(raw, DIARIZATION_SCHEMA))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    failed = ~is_object | (F.coalesce(F.col("d.status"), F.lit("success")) == "error")
    good = parsed.where(~failed).select(
        *keys, F.col("d.num_speakers").alias("num_speakers"), F.posexplode_outer("d.segments").alias("seg_idx", "s")
    )
    segments = good.select(
        *keys,
        "num_speakers",
        F.col("seg_idx").cast("long").alias("seg_idx"),
        "s.speaker",
        F.round(F.col("s.start") * 1000).cast("long").alias("start_ms"),
        F.round(F.col("s.end") * 1000).cast("long").alias("end_ms"),
    )
    return segments, parsed.where(failed).select(*keys, F.col("d.error").alias("error"))
