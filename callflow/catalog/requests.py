"""Queries on admission, stream twins, signatures and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from callflow.catalog.registry import query
from callflow.functions import signing
from callflow.plans import admit, deliver
from callflow.sources import delivery
from callflow.streaming import admission, jobs

ADMIT_SQL = {
    "req": """SELECT r.key_id, r.request_id, epoch_us(r.ts) AS us, k.requests_per_minute AS lm, k.requests_per_hour AS lh, k.requests_per_day AS ld,
       row_number() OVER (PARTITION BY r.key_id ORDER BY r.ts, r.request_id) AS rn FROM requests r JOIN api_keys k ON k.key_id = r.key_id WHERE k.is_active""",
    "walk": """SELECT key_id, request_id, us, rn, true AS allowed, [us] AS adm, greatest(0, lm - 1) AS remaining_minute, greatest(0, ld - 1) AS remaining_day FROM req WHERE rn = 1
       UNION ALL SELECT key_id, request_id, us, rn, allowed, CASE WHEN allowed THEN list_append(adm, us) ELSE adm END,
              greatest(0, lm - m - CASE WHEN allowed THEN 1 ELSE 0 END), greatest(0, ld - d - CASE WHEN allowed THEN 1 ELSE 0 END)
       FROM (SELECT *, m < lm AND h < lh AND d < ld AS allowed FROM (SELECT r.*, w.adm, len(list_filter(w.adm, lambda x: r.us - x < 60000000)) AS m,
              len(list_filter(w.adm, lambda x: r.us - x < 3600000000)) AS h, len(list_filter(w.adm, lambda x: r.us - x < 86400000000)) AS d
              FROM walk w JOIN req r ON r.key_id = w.key_id AND r.rn = w.rn + 1) a) b""",
}


def limited(t):
    return t["requests"].join(t["api_keys"].where("is_active"), "key_id")


@query(
    "i1_admission",
    """SELECT key_id, request_id, allowed, remaining_minute, remaining_day, CAST((floor(us / 3600000000) + 1) * 3600 AS BIGINT) AS reset_hour FROM walk""",
    "requests api_keys",
    **ADMIT_SQL,
)
def i1(t):
    return admission.admit_batch(limited(t)).select("key_id", "request_id", "allowed", "remaining_minute", "remaining_day", "reset_hour")


@query(
    "k7_admit",
    """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN allowed THEN 'admitted' ELSE 'rate_limited' END AS decision FROM walk
       UNION ALL SELECT CASE WHEN k.key_id IS NULL THEN 'unknown_key' ELSE 'revoked' END FROM requests r LEFT JOIN api_keys k ON k.key_id = r.key_id WHERE NOT coalesce(k.is_active, false)) t GROUP BY decision""",
    "requests api_keys",
    **ADMIT_SQL,
)
def k7(t):
    return admit.admit(t["requests"], t["api_keys"]).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("i2_usage_counters", "SELECT key_id, count(*) AS total_requests, round(sum(greatest(audio_seconds, 0) / 60.0), 6) AS audio_minutes FROM requests GROUP BY key_id", "requests")
def i2(t):
    return jobs.usage_counters(t["requests"]).select("key_id", "total_requests", F.round("audio_minutes", 6).alias("audio_minutes"))


CHANGES = """SELECT job_id, 'pending' AS status, created_at AS ts FROM jobs UNION ALL SELECT job_id, 'processing', created_at + INTERVAL 1 MINUTE FROM jobs WHERE status <> 'pending'
       UNION ALL SELECT job_id, status, created_at + INTERVAL 5 MINUTE FROM jobs WHERE status NOT IN ('pending', 'processing')"""


@query("i3_job_lifecycle", "SELECT job_id, status FROM jobs", "jobs")
def i3(t):
    return jobs.latest_state(t.sql(CHANGES)).select("job_id", "status")


@query("i5_request_windows", "SELECT key_id, CAST(floor(epoch_us(ts) / 60000000) * 60 AS BIGINT) AS window_start, count(*) AS n FROM requests GROUP BY 1, 2", "requests")
def i5(t):
    return jobs.request_windows(t["requests"]).select("key_id", F.unix_seconds("window_start").alias("window_start"), "n")


@query("i6_stuck_jobs", "SELECT job_id, status, CAST((epoch_us(TIMESTAMP '1998-01-01 00:00:00') - epoch_us(created_at)) / 1000000 AS DOUBLE) AS age_s FROM jobs WHERE status IN ('pending', 'processing') AND created_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 300 SECOND", "jobs")
def i6(t):
    return jobs.stuck_jobs(t["jobs"], F.lit("1998-01-01 00:00:00").cast("timestamp")).select("job_id", "status", "age_s")


@query(
    "i8_call_sessions",
    """SELECT user_id AS caller_id, CAST(min(s) AS BIGINT) AS first_second, count(*) AS n_turns FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
       FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, g""",
)
def i8(t):
    turns = t["events"].select(F.col("user_id").alias("caller_id"), "ts")
    return jobs.sessions(turns, "2 hours").select("caller_id", F.unix_seconds("session_start").alias("first_second"), "n_turns")


@query("h14_payload", """SELECT job_id, '{"job_id":' || CAST(job_id AS VARCHAR) || CASE WHEN status <> 'completed' THEN ',"status":"' || status || '"' ELSE '' END || CASE WHEN error_message IS NOT NULL THEN ',"error":"' || error_message || '"' ELSE '' END || '}' AS payload FROM jobs""", "jobs")
def h14(t):
    return t["jobs"].select("job_id", delivery.payload(job_id=F.col("job_id"), status=F.when(F.col("status") == "completed", "").otherwise(F.col("status")), error=F.col("error_message")).alias("payload"))


KEY = "test-key"


def hmac_sql(message: str) -> str:
    """HMAC-SHA256 of a text from its definition."""
    inner, outer = (p.hex() for p in signing.pads(KEY))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


@query("h22_pseudonymise", f"SELECT c_custkey, {hmac_sql('c_name')} AS alias FROM customer")
def h22(t):
    return signing.with_hmac(t["customer"].select("c_custkey", "c_name"), F.col("c_name"), KEY, "alias").select("c_custkey", "alias")


SIGNED_SQL = {
    "sent": """SELECT request_id, CAST(key_id AS VARCHAR) AS user_id, CASE WHEN request_id % 11 = 0 THEN 'soon' ELSE CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS timestamp,
       'body ' || request_id AS body FROM requests""",
}


@query(
    "h23_signed_requests",
    f"""SELECT request_id, CASE WHEN request_id % 7 = 0 THEN 'forged' ELSE {hmac_sql("user_id || ':' || timestamp || ':' || sha256(body)")} END AS signature,
       CASE WHEN request_id % 11 = 0 THEN 'invalid_timestamp' WHEN request_id % 5 = 0 THEN 'request_expired' WHEN request_id % 7 = 0 THEN 'invalid_signature' ELSE 'ok' END AS verdict FROM sent""",
    "requests",
    **SIGNED_SQL,
)
def h23(t):
    ms = F.unix_millis("ts")
    log = t["requests"].select(
        "request_id", F.col("key_id").cast("string").alias("user_id"), F.when(F.col("request_id") % 11 == 0, "soon").otherwise(ms.cast("string")).alias("timestamp"),
        F.concat(F.lit("body "), F.col("request_id").cast("string")).alias("body"), (ms + F.when(F.col("request_id") % 5 == 0, 300001).otherwise(1000)).alias("received_ms"),
    )
    log = signing.with_signature(log, F.col("user_id"), F.col("timestamp"), F.col("body"), KEY, "signature")
    log = log.withColumn("signature", F.when(F.col("request_id") % 7 == 0, "forged").otherwise(F.col("signature")))
    return signing.audit(log, KEY).select("request_id", "signature", "verdict")


def accepts_even(url: str, body: str) -> int:
    return 200 if int(body.split(":")[1].split(",")[0].rstrip("}")) % 2 == 0 else 503


@query("a12_k8_deliver", "SELECT job_id, job_id % 3 <> 0 AND job_id % 2 = 0 AS delivered, CASE WHEN job_id % 3 = 0 THEN 0 WHEN job_id % 2 = 0 THEN 1 ELSE 3 END AS attempts, CASE WHEN job_id % 3 = 0 THEN 'invalid url' WHEN job_id % 2 = 1 THEN 'HTTP 503' END AS last_error FROM results", "results")
def k8(t):
    out = t["results"].select("job_id", F.when(F.col("job_id") % 3 == 0, "ftp://x").otherwise("https://x.example/cb").alias("callback_url"), F.col("text").alias("transcription"))
    return deliver.deliver_results(out, accepts_even, sleep=no_wait)


def no_wait(_: float) -> None:
    return None
