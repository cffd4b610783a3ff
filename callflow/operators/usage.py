"""Keys, requests, jobs: filters, joins, rollups and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.operators.sequence import dealt, order_numbers, running_sum

# Key prefixes, job states, windows and thresholds.
KEY_PREFIXES = ["bp-proj", "bp", "bp-svc"]
JOB_STATES = ["pending", "processing", "completed", "failed"]
WINDOWS_S = {"minute": 60, "hour": 3600, "day": 86400}
RTF_WARN, RTF_ERROR = 0.5, 1.0
QUEUE_WARN, QUEUE_ERROR = 50, 80
MEMORY_WARN, MEMORY_ERROR = 0.8, 0.9


def has_key_format(key: Column) -> Column:
    return key.rlike("^(" + "|".join(KEY_PREFIXES) + ")")


def active_requests(requests: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests of known active keys, and the refused ones with a reason."""
    joined = requests.join(keys.select("key_id", "is_active"), "key_id", "left")
    ok = F.coalesce("is_active", F.lit(False))
    return joined.where(ok).drop("is_active"), joined.where(~ok).withColumn("reason", F.lit("invalid_or_revoked_key")).drop("is_active")


def permitted(keys: DataFrame, permission: str) -> DataFrame:
    return keys.where(F.array_contains("permissions", permission))


def name_search(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.lower("name").contains(text.lower()))


def is_media(content_type: Column) -> Column:
    return content_type.rlike("^(audio|video)/")


def pending_async(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == "pending") & F.col("is_async"))


def finished_before(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return jobs.where(F.col("status").isin("completed", "failed") & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def lookup(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is in a request list."""
    return rows.join(wanted.select(on).distinct(), on, "left_semi")


def level(value: Column, warn: float, error: float) -> Column:
    return F.when(value > error, "error").when(value > warn, "warning").otherwise("ok")


def status_view(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """What a status request answers for every job."""
    both = jobs.join(results.select("job_id", "text", "chunks"), "job_id", "left")
    done = (F.col("status") == "completed") & F.col("text").isNotNull()
    broken = F.col("status").isin("failed", "rejected")
    return both.select(
        "job_id",
        "status",
        F.when(broken, F.col("error_message")).alias("error"),
        F.when(done, F.col("text")).alias("text"),
        F.when(done, F.coalesce("audio_duration", F.lit(0.0))).alias("duration"),
        F.when(done, F.coalesce("processing_time", F.lit(0.0))).alias("processing_time"),
        F.when(done, F.coalesce(F.nullif("chunks", F.lit(0)), F.lit(1))).alias("chunks"),
    )


def owned_revocations(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Revoke requests (key_id, user_id) by the key's owner only."""
    return requests.join(keys.select("key_id", "user_id"), ["key_id", "user_id"], "left_semi")


def new_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose e-mail and external id are both unused."""
    return candidates.join(users.select("email"), "email", "left_anti").join(
        users.select("external_id"), "external_id", "left_anti"
    )


def merge_partial(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null fields of ``updates`` override ``rows``; unmatched rows stay."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def cascade_delete(children: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    return children.join(removed.select(on), on, "left_anti")


def backfill(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Take ``column`` from a second table where the row has one there."""
    return merge_partial(rows, other, key, [column])


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES]
    )


def key_usage(requests: DataFrame) -> DataFrame:
    return requests.groupBy("key_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.when(F.col("audio_seconds") > 0, F.col("audio_seconds") / 60.0).otherwise(0.0)).alias("audio_minutes"),
        F.max("ts").alias("last_used"),
    )


def key_stats(keys: DataFrame, usage: DataFrame) -> DataFrame:
    used = keys.join(usage, "key_id", "left").select(
        "key_id", "name", "is_active", F.coalesce("total_requests", F.lit(0)).alias("n"), F.coalesce("audio_minutes", F.lit(0.0)).alias("m")
    )
    return used.agg(
        F.count(F.lit(1)).alias("total_keys"),
        F.count_if("is_active").alias("active_keys"),
        F.sum("n").alias("total_requests"),
        F.sum("m").alias("audio_minutes"),
        F.max_by("name", F.struct(F.col("n"), -F.col("key_id"))).alias("most_used"),
        F.max("n").alias("most_used_requests"),
    )


def dashboard(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("revoked")
    )


def with_rtf(jobs: DataFrame) -> DataFrame:
    ratio = F.when(F.col("audio_duration") > 0, F.col("processing_time") / F.col("audio_duration"))
    return jobs.withColumn("rtf", ratio).withColumn("times_real_time", F.when(F.col("rtf") > 0, 1 / F.col("rtf")))


def rtf_by_month(jobs: DataFrame) -> DataFrame:
    return (
        with_rtf(jobs)
        .groupBy(F.date_format("created_at", "yyyy-MM").alias("period"))
        .agg(F.count("rtf").alias("jobs"), F.avg("rtf").alias("mean_rtf"), F.max("rtf").alias("max_rtf"),
             F.percentile_approx("rtf", 0.5, F.lit(10000)).alias("median_rtf"))
    )


def instant_counts(requests: DataFrame, *aggregates: Column) -> DataFrame:
    """key_id, us, n, last_minute, last_hour, last_day and ``_dealt`` of every instant at which a key has attempts.

    Counts every attempt with age below the window. A sweep: each instant adds
    its attempts at ``us`` and asks at ``us`` and at ``us - window`` how many
    came until then; the count is the difference. Additions and questions are
    dealt into ranges along (key, time) and summed in two levels, so no task
    holds a key or a day. ``_dealt`` never decreases along the time of a key.
    Further ``aggregates`` are kept per instant.
    """
    instants = requests.groupBy("key_id", F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    kept = [c for c in instants.columns if c not in ("key_id", "us")]
    asked = F.explode(F.array(*[F.lit(s * 1_000_000) for s in (0, *WINDOWS_S.values())]))
    merged = instants.select("key_id", "us", asked.alias("back"), F.struct(*kept).alias("kept"))
    merged = merged.withColumn("at", F.col("us") - F.col("back")).withColumn("kept", F.when(F.col("back") == 0, F.col("kept")))
    ranges = dealt(merged, ["key_id", "at", "back"])
    swept = running_sum(ranges, ["key_id"], ["at", "back"], F.col("_dealt"), F.coalesce("kept.n", F.lit(0)), "until")
    found = swept.withColumnRenamed("_dealt", "range").groupBy("key_id", "us").agg(
        F.max("kept").alias("kept"),
        F.max(F.when(F.col("back") == 0, F.col("range"))).alias("_dealt"),
        F.max(F.when(F.col("back") == 0, F.col("until"))).alias("until"),
        *[F.max(F.when(F.col("back") == s * 1_000_000, F.col("until"))).alias(f"before_{w}") for w, s in WINDOWS_S.items()],
    )
    return found.select("key_id", "us", "kept.*", *[(F.col("until") - F.col(f"before_{w}")).alias(f"last_{w}") for w in WINDOWS_S], "_dealt")


def trailing_counts(requests: DataFrame) -> DataFrame:
    """Attempts of the key in the trailing minute, hour and day, for every request."""
    counts = instant_counts(requests).select("key_id", F.col("us").alias("_us"), *[f"last_{w}" for w in WINDOWS_S])
    return requests.withColumn("_us", F.unix_micros("ts")).join(counts, ["key_id", "_us"]).drop("_us")


def window_reset(epoch_s: Column, seconds: int) -> Column:
    return (F.floor(epoch_s / seconds) + 1) * seconds


def pending_queue(jobs: DataFrame, n: int = 10) -> DataFrame:
    return pending_async(jobs).orderBy(F.desc("priority"), "created_at", "job_id").limit(n)


def newest_keys(keys: DataFrame, n: int | None = None) -> DataFrame:
    ordered = keys.orderBy(F.desc("created_at"), F.desc("key_id"))
    return ordered if n is None else ordered.limit(n)


def key_places(keys: DataFrame) -> DataFrame:
    """``place`` of every key, newest first, over the whole table."""
    return order_numbers(keys, [F.desc("created_at"), F.desc("key_id")], "place")


def log_tail(log: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` entries, oldest first."""
    return log.orderBy(F.desc("ts"), F.desc("entry_id")).limit(n).orderBy("ts", "entry_id")


def with_reasons(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
