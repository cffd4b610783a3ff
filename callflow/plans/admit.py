"""Admission of requests: key checks, then the rate limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.operators import usage
from callflow.streaming import admission


def check_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with ``outcome``: checked, unknown_key, bad_format or revoked."""
    known = requests.join(keys, "key_id", "left")
    outcome = (
        F.when(F.col("key_type").isNull(), "unknown_key")
        .when(~usage.has_key_format(F.col("key_type")), "bad_format")
        .when(~F.col("is_active"), "revoked")
        .otherwise("checked")
    )
    return known.withColumn("outcome", outcome)


def admit(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Every request with its decision; only checked ones count for limits."""
    checked = check_keys(requests, keys)
    limited = admission.admit_batch(checked.where("outcome = 'checked'"))
    refused = checked.where("outcome <> 'checked'").select("request_id", "key_id", "ts", F.col("outcome").alias("decision"))
    decided = limited.withColumn("decision", F.when(F.col("allowed"), "admitted").otherwise("rate_limited"))
    return decided.unionByName(refused, allowMissingColumns=True)
