"""Delivery of results to callback addresses through an injected sender."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.functions import formatting as fmt

MAX_ATTEMPTS = 3
FIRST_DELAY_S = 1.0
STATUS = "job_id long, delivered boolean, attempts int, last_error string"
OPTIONAL = ["status", "error", "transcription", "ai_analysis", "diarized_transcription", "agent_tasks"]


def payload(*, job_id: Column, **fields: Column) -> Column:
    """JSON with the job id and the fields that are neither null nor empty."""
    parts = [F.nullif(fields[n], F.lit("")).alias(n) for n in OPTIONAL if n in fields]
    return F.to_json(F.struct(job_id.alias("job_id"), *parts))


def deliver(
    rows: DataFrame, sender: Callable[[str, str], int], sleep: Callable[[float], None] = time.sleep, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Send (job_id, callback_url, payload) rows; returns one status row each.

    ``sender(url, body)`` returns an HTTP status and may raise. Delivery is at
    least once: a task that is repeated sends again, receivers key on job_id.
    """
    usable = rows.withColumn("callback_url", fmt.clean_url(F.col("callback_url")))
    ok = fmt.valid_url(F.col("callback_url"))
    refused = usable.where(~ok).select(
        F.col("job_id").cast("long").alias("job_id"), F.lit(False).alias("delivered"), F.lit(0).alias("attempts"), F.lit("invalid url").alias("last_error")
    )

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for job_id, url, body in batch.itertuples(index=False):
                error, done, tries = None, False, 0
                while tries < max_attempts and not done:
                    if tries:
                        sleep(FIRST_DELAY_S * 2 ** (tries - 1))
                    tries += 1
                    try:
                        code = sender(url, body)
                        done, error = 200 <= code < 300, None if 200 <= code < 300 else f"HTTP {code}"
                    except Exception as failure:  # noqa: BLE001 - any failure is a failed attempt
                        error = str(failure)
                out.append([job_id, done, tries, error])
            yield pd.DataFrame(out, columns=["job_id", "delivered", "attempts", "last_error"])

    sent = usable.where(ok).select(F.col("job_id").cast("long").alias("job_id"), "callback_url", "payload").mapInPandas(send, STATUS)
    return sent.unionByName(refused)
