"""Queries on keys, requests, jobs, gates and label evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from callflow.catalog.registry import query
from callflow.functions import formatting as fmt
from callflow.operators import evaluation as ev
from callflow.operators import usage
from callflow.plans import admit, evaluate, operations
from callflow.sources import files

NOW = "TIMESTAMP '1999-01-01 00:00:00'"


def now():
    return F.lit("1999-01-01 00:00:00").cast("timestamp")


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("b2_duration_gate", "SELECT job_id, CASE WHEN audio_duration < 100 THEN 'audio_too_short' WHEN audio_duration > 4000 THEN 'audio_too_long' END AS reason FROM jobs", "jobs")
def b2(t):
    return t["jobs"].select("job_id", fmt.duration_reason(F.col("audio_duration"), 100, 4000).alias("reason"))


MEDIA = "SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(o_totalprice * 1500 AS BIGINT) END AS size, 'dir/f' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '.ogg' END AS path, CASE o_orderkey % 3 WHEN 0 THEN 'audio/wave' WHEN 1 THEN 'text/plain' END AS mime FROM orders"
EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


@query("b1_media_gate", f"SELECT file_id, CASE WHEN size > 524288000 THEN 'file_too_large' WHEN size = 0 THEN 'file_empty' WHEN {EXT} NOT IN ('wav','mp3','flac','m4a','ogg','mp4') THEN 'unsupported_format' END AS reason FROM ({MEDIA}) m")
def b1(t):
    return t.sql(MEDIA).select("file_id", fmt.media_reason(F.col("size"), fmt.extension(F.col("path"))).alias("reason"))


@query("b3_mime_format", f"""SELECT file_id, CASE WHEN mime = 'audio/wave' THEN 'wav' ELSE CASE {EXT} WHEN 'wav' THEN 'wav' WHEN 'mp4' THEN 'm4a' WHEN 'ogg' THEN 'ogg' ELSE 'wav' END END AS format FROM ({MEDIA}) m""")
def b3(t):
    return t.sql(MEDIA).select("file_id", fmt.media_format(fmt.mime_type(F.col("mime"), fmt.extension(F.col("path")))).alias("format"))


@query("b4_callback_url", """SELECT page_id, u AS url, regexp_matches(u, '^https?://[^/?#]+') AS valid FROM (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN '"' || url || '"; ' WHEN 1 THEN replace(url, 'http', 'ftp') ELSE url END, '''"; ') AS u FROM pages) p""")
def b4(t):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"'), "url", F.lit('"; '))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    return t["pages"].select("page_id", fmt.clean_url(u).alias("url"), fmt.valid_url(u).alias("valid"))


@query("b5_key_format", "SELECT key_id, regexp_matches(k, '^(bp-proj|bp|bp-svc)') AS ok FROM (SELECT key_id, CASE WHEN key_id % 5 = 0 THEN 'sk-' ELSE '' END || key_type || '-x' AS k FROM api_keys) t", "api_keys")
def b5(t):
    k = F.concat(F.when(F.col("key_id") % 5 == 0, "sk-").otherwise(""), "key_type", F.lit("-x"))
    return t["api_keys"].select("key_id", usage.has_key_format(k).alias("ok"))


@query("b6_permission", "SELECT key_id FROM api_keys WHERE key_type <> 'bp'", "api_keys")
def b6(t):
    perms = F.when(F.col("key_type") == "bp", F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("transcribe")))
    return usage.permitted(t["api_keys"].withColumn("permissions", perms), "transcribe").select("key_id")


@query("b7_active_key", "SELECT r.request_id, r.key_id FROM requests r JOIN api_keys k ON r.key_id = k.key_id WHERE k.is_active", "requests api_keys")
def b7(t):
    return usage.active_requests(t["requests"], t["api_keys"])[0].select("request_id", "key_id")


@query("b8_name_search", "SELECT key_id, name FROM api_keys WHERE lower(name) LIKE '%customer#00000001%'", "api_keys")
def b8(t):
    return usage.name_search(t["api_keys"], "CUSTOMER#00000001").select("key_id", "name")


@query("b9_media_type", f"SELECT file_id, coalesce(regexp_matches(mime, '^(audio|video)/'), false) AS media FROM ({MEDIA}) m")
def b9(t):
    return t.sql(MEDIA).select("file_id", F.coalesce(usage.is_media(F.col("mime")), F.lit(False)).alias("media"))


@query("b10_status_filters", f"SELECT job_id, status FROM jobs WHERE status IN ('completed','failed') AND created_at < {NOW} - INTERVAL 7 DAY", "jobs")
def b10(t):
    return usage.finished_before(t["jobs"], now()).select("job_id", "status")


@query("b10_pending_async", "SELECT job_id FROM jobs WHERE status = 'pending' AND is_async", "jobs")
def b10_pending(t):
    return usage.pending_async(t["jobs"]).select("job_id")


@query("b26_label_cleaning", """SELECT item_id, CASE lower(trim(predicted)) WHEN 'postive' THEN 'Positive' ELSE p END AS predicted, actual FROM
    (SELECT *, CASE lower(trim(predicted)) WHEN 'very negative' THEN 'Very Negative' WHEN 'negative' THEN 'Negative' WHEN 'neutral' THEN 'Neutral' WHEN 'positive' THEN 'Positive' WHEN 'very positive' THEN 'Very Positive' END AS p FROM eval_labels) t
    WHERE p IS NOT NULL OR lower(trim(predicted)) = 'postive'""", "eval_labels")
def b26(t):
    return ev.clean_labels(t["eval_labels"])


@query("b28_masked_key", "SELECT key_id, CASE WHEN length(k) > 6 THEN substr(k, 1, 2) || '...' || right(k, 4) ELSE '***' END AS masked FROM (SELECT key_id, CASE WHEN key_id % 4 = 0 THEN key_type ELSE name END AS k FROM api_keys) t", "api_keys")
def b28(t):
    return t["api_keys"].select("key_id", fmt.masked(F.when(F.col("key_id") % 4 == 0, F.col("key_type")).otherwise(F.col("name"))).alias("masked"))


@query("b31_performance_level", "SELECT job_id, CASE WHEN r > 1.0 THEN 'error' WHEN r > 0.5 THEN 'warning' ELSE 'ok' END AS rtf_level, CASE WHEN q > 80 THEN 'error' WHEN q > 50 THEN 'warning' ELSE 'ok' END AS queue_level FROM (SELECT job_id, audio_duration / 3000 AS r, job_id % 100 AS q FROM jobs) t", "jobs")
def b31(t):
    return t["jobs"].select("job_id", usage.level(F.col("audio_duration") / 3000, usage.RTF_WARN, usage.RTF_ERROR).alias("rtf_level"), usage.level(F.col("job_id") % 100, usage.QUEUE_WARN, usage.QUEUE_ERROR).alias("queue_level"))


@query("b33_lookup_users", "SELECT user_id, email FROM users WHERE email IN (SELECT lower(n_name) || '@example.com' FROM nation WHERE n_regionkey < 2)", "users")
def b33(t):
    wanted = t["nation"].where("n_regionkey < 2").select(F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"))
    return usage.lookup(t["users"], wanted, "email").select("user_id", "email")


@query("b33_lookup_keys", "SELECT key_id, name FROM api_keys WHERE key_id IN (SELECT key_id FROM requests)", "api_keys requests")
def b33_keys(t):
    return usage.lookup(t["api_keys"], t["requests"], "key_id").select("key_id", "name")


@query("c5_job_status", """SELECT j.job_id, status, CASE WHEN status IN ('failed','rejected') THEN error_message END AS error, CASE WHEN ok THEN text END AS text,
    CASE WHEN ok THEN audio_duration END AS duration, CASE WHEN ok THEN processing_time END AS processing_time, CASE WHEN ok THEN chunks END AS chunks
    FROM (SELECT j.*, r.text, r.chunks, j.status = 'completed' AND r.job_id IS NOT NULL AS ok FROM jobs j LEFT JOIN results r ON j.job_id = r.job_id) j""", "jobs results")
def c5(t):
    return usage.status_view(t["jobs"], t["results"])


@query("c6_key_owner", "SELECT k.key_id, u.user_id FROM api_keys k JOIN users u ON u.user_id = k.user_id WHERE u.user_id = k.key_id % 25", "api_keys users")
def c6(t):
    asks = t["api_keys"].select("key_id", (F.col("key_id") % 25).cast("int").alias("user_id"))
    return usage.owned_revocations(asks, t["api_keys"].join(t["users"].select("user_id"), "user_id", "left_semi"))


@query("c7_new_users", """SELECT email, external_id FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'nation_' || CAST(s_suppkey % 50 AS VARCHAR) || '@example.com' ELSE 'new' || CAST(s_suppkey AS VARCHAR) || '@example.com' END AS email,
    'ext-' || CAST(s_suppkey AS VARCHAR) AS external_id FROM supplier) c WHERE email NOT IN (SELECT email FROM users) AND external_id NOT IN (SELECT external_id FROM users)""", "users")
def c7(t):
    k = F.col("s_suppkey")
    cands = t["supplier"].select(
        F.when(k % 2 == 0, F.concat(F.lit("nation_"), (k % 50).cast("string"), F.lit("@example.com"))).otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("ext-"), k.cast("string")).alias("external_id"),
    )
    return usage.new_users(cands, t["users"]).select("email", "external_id")


@query("c8_partial_update", "SELECT j.job_id, coalesce(CASE WHEN r.chunks > 5 THEN 'archived' END, j.status) AS status, coalesce(CASE WHEN r.job_id % 2 = 0 THEN 1 END, j.priority) AS priority FROM jobs j LEFT JOIN results r ON r.job_id = j.job_id", "jobs results")
def c8(t):
    upd = t["results"].select("job_id", F.when(F.col("chunks") > 5, "archived").alias("status"), F.when(F.col("job_id") % 2 == 0, 1).alias("priority"))
    return usage.merge_partial(t["jobs"], upd, "job_id", ["status", "priority"]).select("job_id", "status", "priority")


@query("c9_cascade_delete", "SELECT key_id, user_id FROM api_keys WHERE user_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", "api_keys")
def c9(t):
    gone = t["nation"].where("n_regionkey = 0").select(F.col("n_nationkey").alias("user_id"))
    return usage.cascade_delete(t["api_keys"], gone, "user_id").select("key_id", "user_id")


@query("c10_backfill", "SELECT j.job_id, CAST(r.chunks AS BIGINT) AS chunks FROM jobs j LEFT JOIN results r ON r.job_id = j.job_id", "jobs results")
def c10(t):
    return usage.backfill(t["jobs"].withColumn("chunks", F.lit(None).cast("long")), t["results"], "job_id", "chunks").select("job_id", "chunks")


@query("d7_job_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE status='pending') AS pending, count(*) FILTER (WHERE status='processing') AS processing, count(*) FILTER (WHERE status='completed') AS completed, count(*) FILTER (WHERE status='failed') AS failed FROM jobs", "jobs")
def d7(t):
    return usage.job_counts(t["jobs"])


@query("d8_key_usage", "SELECT key_id, count(*) AS total_requests, round(sum(greatest(audio_seconds, 0) / 60.0), 6) AS audio_minutes, epoch_us(max(ts)) AS last_used_us FROM requests GROUP BY key_id", "requests")
def d8(t):
    u = usage.key_usage(t["requests"])
    return u.select("key_id", "total_requests", *six("audio_minutes"), F.unix_micros("last_used").alias("last_used_us"))


@query("d9_key_stats", """SELECT count(*) AS total_keys, count(*) FILTER (WHERE is_active) AS active_keys, CAST(sum(n) AS BIGINT) AS total_requests, round(sum(m), 4) AS audio_minutes,
    arg_max(name, n * 10000000 - key_id) AS most_used, max(n) AS most_used_requests FROM (SELECT k.key_id, name, is_active, count(r.request_id) AS n, coalesce(sum(greatest(audio_seconds, 0) / 60.0), 0) AS m FROM api_keys k LEFT JOIN requests r ON r.key_id = k.key_id GROUP BY k.key_id, name, is_active) t""", "api_keys requests")
def d9(t):
    return usage.key_stats(t["api_keys"], usage.key_usage(t["requests"])).withColumn("audio_minutes", F.round("audio_minutes", 4))


@query("d9_keys_by_type", "SELECT key_type, count(*) AS n FROM api_keys GROUP BY key_type", "api_keys")
def d9_types(t):
    return t["api_keys"].groupBy("key_type").agg(F.count(F.lit(1)).alias("n"))


@query("d10_dashboard", "SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS revoked FROM api_keys", "api_keys")
def d10(t):
    return usage.dashboard(t["api_keys"])


CLEAN = """SELECT item_id, CASE lower(trim(predicted)) WHEN 'very negative' THEN 'Very Negative' WHEN 'negative' THEN 'Negative' WHEN 'neutral' THEN 'Neutral' WHEN 'positive' THEN 'Positive' WHEN 'postive' THEN 'Positive' WHEN 'very positive' THEN 'Very Positive' END AS predicted, actual FROM eval_labels"""
EV = {
    "cleaned": f"SELECT * FROM ({CLEAN}) c WHERE predicted IS NOT NULL",
    "levels": "SELECT * FROM (VALUES ('Very Negative', 0), ('Negative', 1), ('Neutral', 2), ('Positive', 3), ('Very Positive', 4)) l(label, i)",
    "scores": """SELECT label, tp / nullif(claimed, 0) AS p, tp / nullif(support, 0) AS r, support FROM (SELECT l.label, count(*) FILTER (WHERE c.actual = l.label AND c.predicted = l.label) AS tp,
        count(*) FILTER (WHERE c.actual = l.label) AS support, count(*) FILTER (WHERE c.predicted = l.label) AS claimed FROM levels l CROSS JOIN cleaned c GROUP BY l.label) t""",
    "full_scores": "SELECT label, coalesce(p, 0.0) AS precision, coalesce(r, 0.0) AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, support FROM scores",
}


@query("d11_confusion_matrix", """SELECT actual, count(*) FILTER (WHERE predicted='Very Negative') AS "Very Negative", count(*) FILTER (WHERE predicted='Negative') AS "Negative", count(*) FILTER (WHERE predicted='Neutral') AS "Neutral",
    count(*) FILTER (WHERE predicted='Positive') AS "Positive", count(*) FILTER (WHERE predicted='Very Positive') AS "Very Positive" FROM cleaned GROUP BY actual""", "eval_labels", **EV)
def d11(t):
    return evaluate.evaluate(t["eval_labels"])["confusion"]


@query("d12_d13_accuracy", "SELECT count(*) AS total, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN abs(a.i - p.i) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS adjacent_accuracy FROM cleaned c JOIN levels a ON a.label = c.actual JOIN levels p ON p.label = c.predicted", "eval_labels", **EV)
def d12(t):
    return evaluate.evaluate(t["eval_labels"])["accuracy"].select("total", *six("accuracy", "adjacent_accuracy"))


@query("d14_class_scores", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM full_scores", "eval_labels", **EV)
def d14(t):
    return evaluate.evaluate(t["eval_labels"])["classes"].select("label", *six("precision", "recall", "f1"), "support")


@query("d15_averages", """SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
    round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM full_scores""", "eval_labels", **EV)
def d15(t):
    a = evaluate.evaluate(t["eval_labels"])["averages"]
    return a.select(*six(*a.columns))


@query("d16_distributions", "SELECT 'actual' AS side, actual AS label, count(*) AS n FROM cleaned GROUP BY actual UNION ALL SELECT 'predicted', predicted, count(*) FROM cleaned GROUP BY predicted", "eval_labels", **EV)
def d16(t):
    return evaluate.evaluate(t["eval_labels"])["distributions"]


REPORT_SQL = """SELECT 'overall' AS section, 'all' AS label, 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cleaned
    UNION ALL SELECT 'overall', 'all', 'accuracy', round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) FROM cleaned
    UNION ALL SELECT 'overall', 'all', 'adjacent_accuracy', round(avg(CASE WHEN abs(a.i - p.i) <= 1 THEN 1.0 ELSE 0.0 END), 6) FROM cleaned c JOIN levels a ON a.label = c.actual JOIN levels p ON p.label = c.predicted
    UNION ALL SELECT 'class', label, unnest(['precision', 'recall', 'f1', 'support']), unnest([round(precision, 6), round(recall, 6), round(f1, 6), CAST(support AS DOUBLE)]) FROM full_scores
    UNION ALL SELECT 'average', 'all', unnest(['macro_precision', 'macro_recall', 'macro_f1', 'weighted_precision', 'weighted_recall', 'weighted_f1']),
      unnest([round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6)]) FROM full_scores
    UNION ALL SELECT 'distribution', 'actual:' || actual, 'n', CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY actual
    UNION ALL SELECT 'distribution', 'predicted:' || predicted, 'n', CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY predicted"""


@query("k5_evaluate", REPORT_SQL, "eval_labels", **EV)
def k5(t):
    return evaluate.report(t["eval_labels"]).withColumn("value", F.round("value", 6))


@query("d17_rtf", "SELECT strftime(created_at, '%Y-%m') AS period, count(rtf) AS jobs, round(avg(rtf), 6) AS mean_rtf, round(max(rtf), 6) AS max_rtf, round(quantile_disc(rtf, 0.5), 6) AS median_rtf FROM (SELECT created_at, CASE WHEN audio_duration > 0 THEN processing_time / audio_duration END AS rtf FROM jobs) t GROUP BY period", "jobs")
def d17(t):
    return usage.rtf_by_month(t["jobs"]).select("period", "jobs", *six("mean_rtf", "max_rtf", "median_rtf"))


def trailing(seconds):
    return f"count(*) OVER (PARTITION BY key_id ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1000000 - 1} PRECEDING AND CURRENT ROW)"


@query("e23_trailing_usage", f"SELECT request_id, key_id, {trailing(60)} AS last_minute, {trailing(3600)} AS last_hour, {trailing(86400)} AS last_day FROM requests", "requests")
def e23(t):
    return usage.trailing_counts(t["requests"]).select("request_id", "key_id", "last_minute", "last_hour", "last_day")


@query("f1_pending_queue", "SELECT job_id, priority FROM jobs WHERE status = 'pending' AND is_async ORDER BY priority DESC, created_at, job_id LIMIT 10", "jobs")
def f1(t):
    return usage.pending_queue(t["jobs"]).select("job_id", "priority")


KEYS_CREATED = "SELECT key_id, name, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (key_id % 1000) AS created_at FROM api_keys"


def created(keys):
    return keys.withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,CAST(key_id % 1000 AS INT))"))


@query("f2_keys_newest_first", f"SELECT key_id, row_number() OVER (ORDER BY created_at DESC, key_id DESC) AS place FROM ({KEYS_CREATED}) k", "api_keys")
def f2(t):
    return usage.key_places(created(t["api_keys"])).select("key_id", "place")


@query("f3_log_tail", "SELECT entry_id, epoch_us(ts) AS us FROM (SELECT event_id AS entry_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) t")
def f3(t):
    log = t["events"].select(F.col("event_id").alias("entry_id"), "ts")
    return usage.log_tail(log).select("entry_id", F.unix_micros("ts").alias("us"))


@query("f4_recent_keys", f"SELECT key_id FROM ({KEYS_CREATED}) k ORDER BY created_at DESC, key_id DESC LIMIT 2", "api_keys")
def f4(t):
    return usage.newest_keys(created(t["api_keys"]), 2).select("key_id")


@query("f8_most_used_key", "SELECT key_id, n FROM (SELECT key_id, count(*) AS n FROM requests GROUP BY key_id) t ORDER BY n DESC, key_id LIMIT 1", "requests")
def f8(t):
    per = usage.key_usage(t["requests"])
    return per.agg(F.max_by("key_id", F.struct(F.col("total_requests"), -F.col("key_id"))).alias("key_id"), F.max("total_requests").alias("n"))


@query("g4_valid_and_rejected", "SELECT r.request_id, CASE WHEN coalesce(k.is_active, false) THEN NULL ELSE 'invalid_or_revoked_key' END AS reason FROM requests r LEFT JOIN api_keys k ON r.key_id = k.key_id", "requests api_keys")
def g4(t):
    return usage.with_reasons(*usage.active_requests(t["requests"], t["api_keys"])).select("request_id", "reason")


@query("h18_formatting", """SELECT job_id, CASE WHEN d < 60 THEN printf('%.1fs', d) WHEN d < 3600 THEN printf('%.1fm', d / 60) ELSE printf('%.1fh', d / 3600) END AS duration,
    CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
         WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END AS size
    FROM (SELECT job_id, CAST((job_id % 9000) * 0.75 AS DOUBLE) AS d, CAST(job_id AS DOUBLE) * job_id * 64 AS b FROM jobs) t""", "jobs")
def h18(t):
    j = F.col("job_id")
    return t["jobs"].select("job_id", fmt.duration_text((j % 9000) * 0.75).alias("duration"), fmt.size_text(j.cast("double") * j * 64).alias("size"))


@query("h19_last_used", f"""SELECT key_id, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || ' mins ago' WHEN m < 1440 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR) || ' hours ago' ELSE CAST(CAST(floor(m / 1440) AS BIGINT) AS VARCHAR) || ' days ago' END AS last_used
    FROM (SELECT key_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 60000000) AS BIGINT) AS m FROM requests GROUP BY key_id) t""", "requests")
def h19(t):
    used = usage.key_usage(t["requests"])
    return used.select("key_id", fmt.last_used_text(F.col("last_used"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("last_used"))


@query("h20_elapsed", f"SELECT job_id, CAST((epoch_us({NOW}) - epoch_us(created_at)) / 1000000 AS DOUBLE) AS seconds FROM jobs", "jobs")
def h20(t):
    return t["jobs"].select("job_id", fmt.elapsed_seconds(now(), F.col("created_at")).alias("seconds"))


@query("h21_cost_estimate", "SELECT job_id, round(audio_duration * 0.1, 6) AS estimated_processing_time, 'standard' AS tier FROM jobs", "jobs")
def h21(t):
    c = t["jobs"].select("job_id", fmt.cost_estimate(F.col("audio_duration")).alias("c"))
    return c.select("job_id", F.round("c.estimated_processing_time", 6).alias("estimated_processing_time"), "c.tier")


@query("h25_window_reset", "SELECT request_id, CAST((floor(s / 60) + 1) * 60 AS BIGINT) AS reset_minute, CAST((floor(s / 3600) + 1) * 3600 AS BIGINT) AS reset_hour, CAST((floor(s / 86400) + 1) * 86400 AS BIGINT) AS reset_day FROM (SELECT request_id, epoch_us(ts) / 1000000 AS s FROM requests) t", "requests")
def h25(t):
    s = F.unix_micros("ts") / 1_000_000
    return t["requests"].select("request_id", *[usage.window_reset(s, w).alias(f"reset_{n}") for n, w in usage.WINDOWS_S.items()])


@query("a1_media_manifest")
def a1(t):
    m = files.media_manifest(t.spark, t.folder, "*.parquet")
    return m.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "extension")


@query("k6_ops_report", f"""SELECT 'jobs' AS section, status AS name, CAST(count(*) AS DOUBLE) AS value FROM jobs GROUP BY status
    UNION ALL SELECT 'keys', CASE WHEN is_active THEN 'active' ELSE 'revoked' END, count(*) FROM api_keys GROUP BY is_active
    UNION ALL SELECT 'requests', 'total', count(*) FROM requests
    UNION ALL SELECT 'rtf', strftime(created_at, '%Y-%m'), round(avg(processing_time / audio_duration), 6) FROM jobs WHERE audio_duration > 0 GROUP BY 2
    UNION ALL SELECT 'queue', CASE WHEN count(*) > 80 THEN 'error' WHEN count(*) > 50 THEN 'warning' ELSE 'ok' END, count(*) FROM jobs WHERE status = 'pending' AND is_async
    UNION ALL SELECT * FROM (SELECT 'next', CAST(job_id AS VARCHAR), priority FROM jobs WHERE status = 'pending' AND is_async ORDER BY priority DESC, created_at, job_id LIMIT 10) q
    UNION ALL SELECT 'usage', CAST(key_id AS VARCHAR), count(*) FROM requests GROUP BY key_id
    UNION ALL SELECT 'peak', w, max(n) FROM (SELECT unnest(['minute', 'hour', 'day']) AS w, unnest([{trailing(60)}, {trailing(3600)}, {trailing(86400)}]) AS n FROM requests) p GROUP BY w
    UNION ALL SELECT 'key_stats', unnest(['total_requests', 'audio_minutes', 'most_used_requests']), unnest([CAST(sum(n) AS DOUBLE), round(sum(m), 4), CAST(max(n) AS DOUBLE)])
        FROM (SELECT k.key_id, count(r.request_id) AS n, coalesce(sum(greatest(audio_seconds, 0) / 60.0), 0) AS m FROM api_keys k LEFT JOIN requests r ON r.key_id = k.key_id GROUP BY k.key_id) s""", "jobs api_keys requests")
def k6(t):
    return operations.ops_report(t["jobs"], t["api_keys"], t["requests"])


@query("k9_retention", f"SELECT job_id, strftime(created_at, '%Y-%m-%d') || '/' || CAST(job_id AS VARCHAR) || '.wav' AS media_path FROM jobs WHERE status IN ('completed','failed') AND created_at < {NOW} - INTERVAL 7 DAY", "jobs")
def k9(t):
    return operations.retention(t["jobs"], now())


@query("a11_dated_layout", "SELECT job_id, strftime(created_at, '%Y-%m-%d') AS ingest_date, strftime(created_at, '%Y-%m-%d') || '/' || CAST(job_id AS VARCHAR) || '.wav' AS media_path FROM jobs", "jobs")
def a11(t):
    return operations.dated_layout(t["jobs"]).select("job_id", "ingest_date", "media_path")


@query(
    "k7_admit_checks",
    """SELECT CASE WHEN key_type IS NULL THEN 'unknown_key' WHEN NOT regexp_matches(key_type, '^(bp-proj|bp|bp-svc)') THEN 'bad_format' WHEN NOT is_active THEN 'revoked' ELSE 'checked' END AS outcome, count(*) AS n
       FROM (SELECT r.request_id, CASE WHEN k.key_id % 9 = 0 THEN 'xx-' || k.key_type ELSE k.key_type END AS key_type, k.is_active FROM requests r LEFT JOIN api_keys k ON k.key_id = r.key_id) t GROUP BY 1""",
    "requests api_keys",
)
def k7_checks(t):
    keys = t["api_keys"].withColumn("key_type", F.when(F.col("key_id") % 9 == 0, F.concat(F.lit("xx-"), "key_type")).otherwise(F.col("key_type")))
    return admit.check_keys(t["requests"], keys).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
