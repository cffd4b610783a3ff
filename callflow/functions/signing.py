"""Keyed pseudonyms and the audit of signed requests.

HMAC-SHA256 is two SHA-256 over padded keys, so it stays in the engine. Pads
come from a table of keys joined by key id, never from literals, which would
show in plans and event logs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_MS = 300_000
BLOCK = 64
KEY_ID = "default"


def pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key; longer keys are hashed first."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def key_table(spark: SparkSession, keys: dict[str, str]) -> DataFrame:
    """One row per key: key_id and its pads."""
    return spark.createDataFrame([(k, *map(bytearray, pads(v))) for k, v in keys.items()], "key_id string, inner binary, outer binary")


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def with_hmac(df: DataFrame, message: Column, key: str, out: str) -> DataFrame:
    """Add the HMAC-SHA256 of ``message`` as hex."""
    table = F.broadcast(key_table(df.sparkSession, {KEY_ID: key}).select(F.col("key_id").alias("_key_id"), F.col("inner").alias("_inner"), F.col("outer").alias("_outer")))
    named = df.withColumn("_message", message).withColumn("_key_id", F.lit(KEY_ID))
    keyed = named.join(table, "_key_id")
    return keyed.withColumn(out, hmac_sha256(F.col("_message"), F.col("_inner"), F.col("_outer"))).drop("_key_id", "_message", "_inner", "_outer")


def with_signature(df: DataFrame, user: Column, timestamp: Column, body: Column, key: str, out: str) -> DataFrame:
    return with_hmac(df, F.concat_ws(":", user, timestamp, F.sha2(body, 256)), key, out)


def audit(log: DataFrame, key: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Verdict per logged request."""
    ts = F.col("timestamp").try_cast("long")
    signed = with_signature(log, F.col("user_id"), F.col("timestamp"), F.col("body"), key, "_expected")
    return signed.withColumn(
        "verdict",
        F.when(ts.isNull(), "invalid_timestamp")
        .when(F.abs(F.col("received_ms") - ts) > window_ms, "request_expired")
        .when(F.col("_expected") != F.col("signature"), "invalid_signature")
        .otherwise("ok"),
    ).drop("_expected")
