"""Queries on model responses: salvage, normalisers, prompts, fan-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from callflow.catalog.registry import query
from callflow.functions import cleaning, prompts, records
from callflow.operators import responses
from callflow.plans import enrich
from callflow.sources import service

AN = "json_extract_string(js, '$.ai_analysis.{}')"


def analysis(t):
    doc = F.from_json("js", f"ai_analysis struct<{_colon(records.ANALYSIS_SCHEMA)}>")["ai_analysis"]
    return t["analysis_responses"].select("request_id", records.analysis_record(doc).alias("a"))


def _colon(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


CATEGORY_SQL = f"""SELECT request_id, CASE WHEN trim(v) = '' THEN 'Neutral' WHEN v LIKE '%no sentiment%' OR v LIKE '%n/a%' THEN 'No Sentiment'
          WHEN v LIKE '%very positive%' THEN 'Very Positive' WHEN v LIKE '%very negative%' THEN 'Very Negative'
          WHEN v LIKE '%positive%' THEN 'Positive' WHEN v LIKE '%negative%' THEN 'Negative' ELSE 'Neutral' END AS category
        FROM (SELECT request_id, lower({AN.format('sentiment.category')}) AS v FROM analysis_responses) t"""


@query("b11_sentiment_category", CATEGORY_SQL, "analysis_responses")
def b11(t):
    return analysis(t).select("request_id", F.col("a.sentiment.category").alias("category"))


PRODUCT_SQL = f"""SELECT request_id, CASE WHEN trim(n) = '' THEN 'Unknown Product' ELSE trim(n) END AS name,
          try_cast(q AS BIGINT) AS quantity, CASE WHEN lower(m) IN ('null','none','n/a') THEN NULL ELSE trim(m) END AS mentioned_at
        FROM (SELECT request_id, {AN.format('extracted_items.products[0].name')} AS n, {AN.format('extracted_items.products[0].quantity')} AS q,
          {AN.format('extracted_items.products[0].mentioned_at')} AS m FROM analysis_responses) t"""


@query("b12_product", PRODUCT_SQL, "analysis_responses")
def b12(t):
    return analysis(t).select("request_id", F.inline("a.extracted_items.products"))


CONTACT_SQL = f"""SELECT request_id, CASE WHEN lower(p) IN ('null','none','n/a','unknown') THEN NULL ELSE trim(p) END AS phone,
          CASE WHEN e NOT LIKE '%@%' THEN NULL ELSE e END AS email,
          CASE WHEN lower(n) IN ('null','none','n/a','unknown') THEN NULL ELSE trim(n) END AS name
        FROM (SELECT request_id, {AN.format('extracted_items.contact_info.phone')} AS p, lower(trim({AN.format('extracted_items.contact_info.email')})) AS e,
          {AN.format('extracted_items.contact_info.name')} AS n FROM analysis_responses) t"""


@query("b13_contact", CONTACT_SQL, "analysis_responses")
def b13(t):
    return analysis(t).select("request_id", "a.extracted_items.contact_info.*")


CONSENT_SQL = f"""SELECT request_id, lower({AN.format('recording_consent.agent_disclosed_recording')}) IN ('true','yes','y','1') AS agent_disclosed_recording,
          coalesce(lower({AN.format('recording_consent.customer_consented_to_recording')}) IN ('true','yes','y','1'), false) AS customer_consented_to_recording
        FROM analysis_responses"""


@query("b14_consent", CONSENT_SQL, "analysis_responses")
def b14(t):
    return analysis(t).select("request_id", "a.recording_consent.*")


TEXT_SQL = f"""SELECT request_id, CASE WHEN trim(d) = '' THEN 'No description' ELSE trim(d) END AS action, trim(pt) AS info_type, trim(pv) AS info_value,
          trim(o) AS opportunity, coalesce(r, '') AS risk, trim(ia) AS area, '' AS recommendation
        FROM (SELECT request_id, {AN.format('extracted_items.action_items[0].description')} AS d, {AN.format('extracted_items.personal_info[0].type')} AS pt,
          {AN.format('extracted_items.personal_info[0].value')} AS pv, {AN.format('business_intelligence.opportunities[0].description')} AS o,
          {AN.format('business_intelligence.risks[0].description')} AS r, {AN.format('improvement_recommendations[0].area_for_improvement')} AS ia
          FROM analysis_responses) t"""


@query("b15_text_fields", TEXT_SQL, "analysis_responses")
def b15(t):
    a = "a.extracted_items."
    return analysis(t).select(
        "request_id",
        F.col(a + "action_items")[0]["description"].alias("action"),
        F.col(a + "personal_info")[0]["type"].alias("info_type"),
        F.col(a + "personal_info")[0]["value"].alias("info_value"),
        F.col("a.business_intelligence.opportunities")[0]["description"].alias("opportunity"),
        F.col("a.business_intelligence.risks")[0]["description"].alias("risk"),
        F.col("a.improvement_recommendations")[0]["area_for_improvement"].alias("area"),
        F.col("a.improvement_recommendations")[0]["recommendation"].alias("recommendation"),
    )


SUMMARY_SQL = f"""SELECT request_id, CASE WHEN trim(v) = '' THEN 'No summary available' ELSE regexp_replace(trim(v), '\\s+', ' ', 'g') END AS summary
        FROM (SELECT request_id, {AN.format('summary')} AS v FROM analysis_responses) t"""


@query("b16_summary", SUMMARY_SQL, "analysis_responses")
def b16(t):
    return analysis(t).select("request_id", F.col("a.summary").alias("summary"))


@query(
    "b17_list_clean",
    """SELECT event_id AS request_id, CASE WHEN event_type < 'x' THEN 'a,' || event_type ELSE event_type END AS sorted_set,
          CASE WHEN event_id % 7 = 3 THEN '' ELSE event_type || ',x' END AS first_kept FROM events""",
)
def b17(t):
    a = analysis(t).select("request_id", F.array_join("a.sentiment.key_indicators", ",").alias("sorted_set"))
    f = fraud(t).select("request_id", F.array_join("f.evidence", ",").alias("first_kept"))
    return a.join(f, "request_id")


FR = "json_extract_string(js, '$.fraud_detection.{}')"
FRAUD_SQL = {
    "raw": "SELECT request_id, "
    + ", ".join(
        f"{FR.format(f)} AS {f}"
        for f in ("fraud_detected risk_level confidence_score fraud_category impersonation_detected urgency_tactics authority_tactics "
                  "payment_request_detected payment_method identity_verification_request policy_violation_detected violation_type "
                  "reasoning data_sufficient").split()
    )
    + " FROM fraud_responses",
    "norm": """SELECT *, CASE WHEN lower(fraud_category) IN ('null','none','n/a') THEN 'none' ELSE replace(lower(fraud_category), ' ', '_') END AS cat,
          replace(lower(payment_method), ' ', '_') AS pay, replace(lower(violation_type), ' ', '_') AS vio,
          CASE WHEN regexp_matches(lower(risk_level), 'high|critical|severe') THEN 'High'
               WHEN regexp_matches(lower(risk_level), 'medium|moderate|elevated') THEN 'Medium' ELSE 'Low' END AS risk,
          coalesce(least(1.0, greatest(0.0, try_cast(confidence_score AS DOUBLE))), 0.0) AS conf FROM raw""",
    "valid": """SELECT request_id, cat IN ('impersonation','social_engineering','financial_fraud','identity_phishing','policy_violation','none') AS ok,
          fraud_detected = 'true' AS fd, impersonation_detected = 'true' AS imp, urgency_tactics = 'true' AS urg, authority_tactics = 'true' AS auth,
          payment_request_detected = 'true' AS pr, identity_verification_request = 'true' AS idv, policy_violation_detected = 'true' AS pol,
          cat, pay, vio, risk, conf, data_sufficient <> 'false' AS enough FROM norm""",
    "usable": """SELECT request_id, ok, ok AND fd AS fd, ok AND imp AS imp, ok AND urg AS urg, ok AND auth AS auth, ok AND pr AS pr, ok AND idv AS idv, ok AND pol AS pol,
          CASE WHEN ok THEN cat ELSE 'none' END AS cat, CASE WHEN ok THEN vio ELSE 'none' END AS vio, CASE WHEN ok THEN pay ELSE 'none' END AS pay,
          CASE WHEN ok THEN risk ELSE 'Low' END AS risk, CASE WHEN ok THEN conf ELSE 0.0 END AS conf, NOT ok OR enough AS enough FROM valid""",
    "step1": "SELECT *, imp OR urg OR pr OR idv OR pol AS ind, fd OR imp OR urg OR pr OR idv OR pol AS det FROM usable",
    "step2": """SELECT *, CASE WHEN det AND cat = 'none' THEN CASE WHEN imp THEN 'impersonation' WHEN pr THEN 'financial_fraud' WHEN idv THEN 'identity_phishing'
          WHEN pol THEN 'policy_violation' WHEN urg OR auth THEN 'social_engineering' ELSE 'none' END ELSE cat END AS cat2 FROM step1""",
    "step3": """SELECT *, CASE WHEN pol AND vio IN ('threats','coercion') THEN 'High'
          WHEN cat2 IN ('impersonation','financial_fraud','identity_phishing') AND risk = 'Low' THEN 'Medium' ELSE risk END AS risk2,
          enough AND conf >= 0.3 AS enough2 FROM step2""",
}


def fraud(t):
    doc = F.from_json("js", f"fraud_detection struct<{_colon(records.FRAUD_SCHEMA)}>")["fraud_detection"]
    return t["fraud_responses"].select("request_id", records.fraud_record(doc).alias("f"))


@query("b18_fraud_risk_level", "SELECT request_id, risk AS risk_level FROM norm", "fraud_responses", **FRAUD_SQL)
def b18(t):
    risk = F.get_json_object("js", "$.fraud_detection.risk_level")
    return t["fraud_responses"].select("request_id", cleaning.first_match(risk, records.RISK_RULES, "Low").alias("risk_level"))


@query(
    "b19_fraud_enums",
    "SELECT request_id, ok AS valid, cat2 AS fraud_category, pay AS payment_method, vio AS violation_type FROM step2",
    "fraud_responses",
    **FRAUD_SQL,
)
def b19(t):
    return fraud(t).select("request_id", "f.valid", "f.fraud_category", "f.payment_method", "f.violation_type")


@query(
    "b20_sensitive_info",
    "SELECT u.request_id, CASE WHEN ok AND idv THEN 'ssn' ELSE 'none' END AS sensitive FROM usable u",
    "fraud_responses",
    **FRAUD_SQL,
)
def b20(t):
    return fraud(t).select("request_id", F.array_join("f.sensitive_info_requested", ",").alias("sensitive"))


@query(
    "b21_fraud_consistency",
    f"""SELECT request_id, det AND NOT (NOT enough2 AND NOT ind) AS fraud_detected, CASE WHEN NOT enough2 AND NOT ind THEN 'Low' ELSE risk2 END AS risk_level,
          cat2 AS fraud_category, conf AS confidence_score, enough2 AS data_sufficient, fd AS suspicious_language,
          CASE WHEN conf < 0.3 THEN '{records.LOW_CONFIDENCE}' WHEN NOT enough2 AND NOT ind THEN '{records.INSUFFICIENT}' END AS fallback_reason
        FROM step3""",
    "fraud_responses",
    **FRAUD_SQL,
)
def b21(t):
    names = "fraud_detected risk_level fraud_category confidence_score data_sufficient suspicious_language fallback_reason"
    return fraud(t).select("request_id", *[f"f.{n}" for n in names.split()])


@query(
    "b22_scoring",
    """SELECT request_id, CASE WHEN ok THEN CAST(least(100, greatest(0, coalesce(try_cast(o AS BIGINT), 0))) AS BIGINT) ELSE -1 END AS overall_score,
          CASE WHEN ok THEN coalesce(least(1.0, greatest(0.0, try_cast(c AS DOUBLE))), 0.0) ELSE 0.0 END AS confidence_score,
          CASE WHEN ok THEN CAST(g AS BIGINT) ELSE -1 END AS greeting, CASE WHEN ok THEN CAST(l AS BIGINT) ELSE -1 END AS listening_balance,
          CASE WHEN ok THEN 0 ELSE -1 END AS call_flow, CASE WHEN ok THEN CAST(floor(CAST(cc AS DOUBLE)) AS BIGINT) ELSE -1 END AS call_closure,
          CASE WHEN NOT ok THEN 'parse_error' WHEN ev < 'late' THEN ev || ',late' ELSE 'late,' || ev END AS flags
        FROM (SELECT *, CAST(g AS BIGINT) BETWEEN 0 AND 10 AS ok FROM (SELECT s.request_id, e.event_type AS ev,
          json_extract_string(js, '$.agent_scoring.overall_score') AS o, json_extract_string(js, '$.agent_scoring.confidence_score') AS c,
          json_extract_string(js, '$.agent_scoring.metrics.greeting') AS g, json_extract_string(js, '$.agent_scoring.metrics.listening_balance') AS l,
          json_extract_string(js, '$.agent_scoring.metrics.call_closure') AS cc FROM scoring_responses s JOIN events e ON e.event_id = s.request_id) a) b""",
    "scoring_responses",
)
def b22(t):
    return scoring(t).select(
        "request_id", "s.overall_score", "s.confidence_score", "s.metrics.greeting", "s.metrics.listening_balance", "s.metrics.call_flow",
        "s.metrics.call_closure", F.array_join("s.flags", ",").alias("flags"),
    )


def scoring(t):
    doc = F.from_json("js", f"agent_scoring struct<{_colon(records.SCORING_SCHEMA)}>")["agent_scoring"]
    return t["scoring_responses"].select("request_id", records.scoring_record(doc).alias("s"))


def dealt(t, name):
    """A view of model responses with the events it is made from dealt over all cores: searching a response costs far more than moving an event."""
    return t.dealt("events")[name]


TASK_SQL = {
    "docs": """SELECT request_id, raw, CASE WHEN regexp_matches(raw, '\\{.*\\}') THEN regexp_extract(raw, '\\{.*\\}') END AS doc FROM task_responses""",
    "tidy": """SELECT request_id, doc, json_extract_string(doc, '$.tasks[0].title') AS title,
       CASE lower(json_extract_string(doc, '$.tasks[0].task_type')) WHEN 'escalate' THEN 'escalation' WHEN 'call-back' THEN 'callback'
            WHEN 'document' THEN 'documentation' WHEN 'follow up' THEN 'follow_up' WHEN 'something_random' THEN 'other' END AS task_type,
       CASE lower(json_extract_string(doc, '$.tasks[0].priority')) WHEN 'critical' THEN 'urgent' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END AS priority,
       least(1.0, CAST(json_extract_string(doc, '$.tasks[0].confidence') AS DOUBLE)) AS confidence FROM docs""",
}


def tasks(t):
    # a step each: one expression would search and parse the response again for every field it takes
    found = dealt(t, "task_responses").select("request_id", responses.salvage(F.col("raw"), "tasks").alias("doc"))
    read = found.select("request_id", responses.parse(F.col("doc"), "tasks").alias("doc"))
    return read.select("request_id", records.tasks_record(F.col("doc")).alias("t"))


@query("b23_tasks", "SELECT request_id, title, task_type, priority, confidence FROM tidy WHERE doc IS NOT NULL", "task_responses", **TASK_SQL)
def b23(t):
    return tasks(t).select("request_id", F.inline("t.tasks")).select("request_id", "title", "task_type", "priority", "confidence")


@query(
    "b24_task_count",
    """SELECT request_id, CASE WHEN doc IS NULL THEN 0 ELSE 1 END AS task_count, doc IS NOT NULL AS data_sufficient,
          CASE WHEN doc IS NULL THEN 'Failed to parse task generation output' END AS fallback_reason FROM docs""",
    "task_responses",
    **TASK_SQL,
)
def b24(t):
    return tasks(t).select("request_id", "t.task_count", "t.data_sufficient", "t.fallback_reason")


EM = "json_extract_string(js, '$.follow_up_email.{}')"


EMAIL_SQL = f"""SELECT request_id, trim(s) AS subject, CASE WHEN tone IN ('friendly','urgent') THEN tone ELSE 'professional' END AS tone,
          CASE WHEN k = '' THEN 'general_follow_up' ELSE replace(k, ' ', '_') END AS email_type, k <> 'mystery' AS valid, b <> '' AS data_sufficient,
          CASE WHEN f IS NOT NULL THEN trim(f) WHEN g = '' AND b = '' THEN '' ELSE
            concat_ws(chr(10) || chr(10), nullif(g, ''), nullif(b, ''), nullif(c, ''), 'Bye') END AS full_email
        FROM (SELECT request_id, {EM.format('subject')} AS s, lower(trim({EM.format('tone')})) AS tone, lower(trim({EM.format('email_type')})) AS k,
          trim({EM.format('greeting')}) AS g, trim({EM.format('body')}) AS b, trim({EM.format('call_to_action')}) AS c, {EM.format('full_email')} AS f FROM email_responses) t"""


@query("b25_email", EMAIL_SQL, "email_responses")
def b25(t):
    doc = F.from_json("js", records.EMAIL_SCHEMA)
    return t["email_responses"].select("request_id", records.email_record(doc).alias("e")).select(
        "request_id", "e.subject", "e.tone", "e.email_type", "e.valid", "e.data_sufficient", "e.full_email"
    )


KNOWN_SQL = """SELECT t.request_id, t.title, c.agent_extension AS assigned_to, CASE WHEN t.request_id % 4 <> 0 THEN 'Name ' || CAST(e.user_id AS VARCHAR) END AS name, c.src AS number
        FROM tidy t JOIN cdr c ON c.request_id = t.request_id JOIN events e ON e.event_id = t.request_id WHERE t.doc IS NOT NULL"""


@query("b27_known_fields", KNOWN_SQL, "task_responses cdr", **TASK_SQL)
def b27(t):
    contact = analysis(t).select("request_id", "a.extracted_items.contact_info.name", "a.extracted_items.contact_info.phone")
    joined = tasks(t).join(t["cdr"], "request_id").join(contact, "request_id", "left")
    known = records.inject_known(F.col("t.tasks"), F.col("agent_extension"), F.col("name"), F.col("src"), F.col("phone"))
    return joined.select("request_id", F.inline(known)).select("request_id", "title", "assigned_to", "name", "number")


@query("h1_salvage", "SELECT request_id, title, doc IS NOT NULL AS found FROM tidy", "task_responses", **TASK_SQL)
def h1(t):
    doc = dealt(t, "task_responses").select("request_id", responses.salvage(F.col("raw"), "tasks").alias("doc"))
    return doc.select("request_id", F.get_json_object("doc", "$.tasks[0].title").alias("title"), F.col("doc").isNotNull().alias("found"))


KINDS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS n, count(*) AS found, CAST(max(length(json_extract_string(js, '$.{p}'))) AS BIGINT) AS longest FROM {k}_responses"
    for k, p in [("analysis", "ai_analysis.summary"), ("fraud", "fraud_detection.risk_level"), ("scoring", "agent_scoring.metrics.greeting"), ("email", "follow_up_email.subject")]
)


@query("h1_salvage_all_kinds", KINDS_SQL, "analysis_responses fraud_responses scoring_responses email_responses")
def h1_all(t):
    paths = {"analysis": "summary", "fraud": "risk_level", "scoring": "metrics.greeting", "email": "follow_up_email.subject"}
    every = None
    for kind in paths:
        part = dealt(t, f"{kind}_responses").select("request_id", F.lit(kind).alias("kind"), F.concat(F.lit("Sure: ```json\n"), "js", F.lit("\n``` // end")).alias("raw"))
        every = part if every is None else every.unionByName(part)
    docs = every.select("kind", responses.salvage(F.col("raw"), F.col("kind")).alias("doc"))
    longest = F.coalesce(*[F.when(F.col("kind") == k, F.length(F.get_json_object("doc", f"$.{p}"))) for k, p in paths.items()])
    return docs.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("doc").alias("found"), F.max(longest).cast("long").alias("longest")
    )


@query("h2_role_object", "SELECT request_id, CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.tasks[0].priority') END AS priority FROM docs", "task_responses", **TASK_SQL)
def h2(t):
    doc = t["task_responses"].select("request_id", responses.role_object(F.col("raw")).alias("doc"))
    return doc.select("request_id", F.get_json_object("doc", "$.tasks[0].priority").alias("priority"))


@query("h3_outer_object", "SELECT request_id, CASE WHEN json_valid(doc) THEN length(doc) END AS n_chars FROM docs", "task_responses", **TASK_SQL)
def h3(t):
    return t["task_responses"].select("request_id", F.length(responses.outer_object(F.col("raw"))).cast("long").alias("n_chars"))


@query(
    "h4_error_envelope",
    """SELECT request_id, 'Could not extract valid JSON from output' AS error, length(raw) AS output_length, contains(raw, '"tasks"') AS contains_marker,
          substr(raw, 1, 100) AS first_100_chars, right(raw, 100) AS last_100_chars FROM docs WHERE doc IS NULL""",
    "task_responses",
    **TASK_SQL,
)
def h4(t):
    rows = t["task_responses"].withColumn("doc", responses.salvage(F.col("raw"), "tasks"))
    return rows.where("doc IS NULL").select("request_id", F.inline(F.array(responses.error_envelope(F.col("raw"), "tasks"))))


@query("h5_unwrap", "SELECT request_id, json_extract_string(js, '$.fraud_detection.risk_level') AS risk_level FROM fraud_responses", "fraud_responses")
def h5(t):
    return t["fraud_responses"].select("request_id", F.get_json_object(responses.unwrap(F.col("js"), "fraud_detection"), "$.risk_level").alias("risk_level"))


@query("f6_longest_candidate", "SELECT request_id, regexp_extract(js, '\\{[^{}]*\\}') AS candidate FROM (SELECT request_id, CASE WHEN request_id % 5 < 3 THEN regexp_extract(raw, '\\{[^{}]*\\}') ELSE '' END AS js FROM task_responses) t WHERE js <> ''", "task_responses")
def f6(t):
    best = t["task_responses"].select("request_id", responses.candidates(F.col("raw")).alias("c"))
    return best.where(F.size("c") > 0).select("request_id", F.col("c")[0].alias("candidate"))


@query("g3_strategy_union", "SELECT request_id, CASE WHEN doc IS NULL THEN NULL WHEN json_valid(raw) THEN 0 ELSE 1 END AS strategy FROM docs", "task_responses", **TASK_SQL)
def g3(t):
    rows = t["task_responses"]
    plain = rows.select("request_id", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).alias("doc"))
    searched = rows.select("request_id", responses.salvage(F.col("raw"), "tasks").alias("doc"))
    return responses.by_strategy(rows, ["request_id"], [plain, searched]).select("request_id", "strategy")


@query("a2_cdr_rows", "SELECT request_id, json_extract_string(raw, '$.src') AS src, json_extract_string(raw, '$.calldate') AS calldate, json_extract_string(raw, '$.direction') AS direction FROM cdr_json WHERE request_id % 11 <> 0 AND request_id % 13 <> 0", "cdr_json")
def a2(t):
    good, _ = service.read_cdr(t["cdr_json"])
    return good.select("request_id", "cdr.src", "cdr.calldate", "cdr.direction")


@query("a2_cdr_rejected", "SELECT request_id, 'invalid_call_metadata' AS reason FROM cdr_json WHERE request_id % 11 = 0 OR request_id % 13 = 0", "cdr_json")
def a2_rejected(t):
    return service.read_cdr(t["cdr_json"])[1].select("request_id", "reason")


ASR = """SELECT event_id AS request_id, CASE event_id % 5
       WHEN 0 THEN '{"text": "hi there", "word_timestamps": [{"word": "hi", "start": ' || CAST(event_id % 100 AS STRING) || '.25, "end": ' || CAST(event_id % 100 AS STRING) || '.5}, {"text": "there", "start": 101, "end": 102.125}]}'
       WHEN 1 THEN '{"text": "no list", "word_timestamps": "x"}' WHEN 2 THEN '{"text": "bare"}' WHEN 3 THEN '"quoted"' ELSE 'plain ' || event_type END AS raw FROM events"""


@query("a3_asr_text", f"SELECT request_id, CASE WHEN request_id % 5 < 3 THEN json_extract_string(raw, '$.text') WHEN request_id % 5 = 3 THEN 'quoted' ELSE raw END AS text, CASE WHEN request_id % 5 = 0 THEN 2 ELSE 0 END AS n_words FROM ({ASR}) t")
def a3(t):
    return service.read_asr_results(t.sql(ASR)).select("request_id", "text", F.size("words").cast("long").alias("n_words"))


@query("a3_asr_words", f"""SELECT request_id, 0 AS pos, 'hi' AS text, request_id % 100 * 1000 + 250 AS start_ms, request_id % 100 * 1000 + 500 AS end_ms FROM ({ASR}) t WHERE request_id % 5 = 0
    UNION ALL SELECT request_id, 1, 'there', 101000, 102125 FROM ({ASR}) t WHERE request_id % 5 = 0""")
def a3_words(t):
    return service.explode_words(service.read_asr_results(t.sql(ASR)), "request_id")


DIAR = """SELECT event_id AS request_id, CASE event_id % 4
       WHEN 0 THEN '{"status": "error", "error": "E' || CAST(event_id AS STRING) || '", "segments": [], "num_speakers": 0}'
       WHEN 1 THEN 'garbage {'
       ELSE '{"segments": [{"speaker": "speaker_0", "start": 0.5, "end": ' || CAST(event_id % 50 + 1 AS STRING) || '.125, "duration": 1.0}, {"speaker": "speaker_1", "start": 60.0, "end": 61.5, "duration": 1.5}], "num_speakers": 2, "status": "success"}' END AS raw FROM events"""


@query("a4_diarization_segments", f"""SELECT request_id, 2 AS num_speakers, 0 AS seg_idx, 'speaker_0' AS speaker, 500 AS start_ms, (request_id % 50 + 1) * 1000 + 125 AS end_ms FROM ({DIAR}) t WHERE request_id % 4 > 1
    UNION ALL SELECT request_id, 2, 1, 'speaker_1', 60000, 61500 FROM ({DIAR}) t WHERE request_id % 4 > 1""")
def a4(t):
    return service.read_diarization_results(t.sql(DIAR), "request_id")[0]


@query("a4_diarization_errors", f"SELECT request_id, CASE WHEN request_id % 4 = 0 THEN 'E' || CAST(request_id AS VARCHAR) END AS error FROM ({DIAR}) t WHERE request_id % 4 < 2")
def a4_errors(t):
    return service.read_diarization_results(t.sql(DIAR), "request_id")[1]


@query("b29_sanitize_numbers", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 THEN NULL ELSE value END AS value FROM events")
def b29(t):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return t["events"].select("event_id", responses.sanitize_numbers(v).alias("value"))


@query(
    "b29_sanitize_nested",
    """SELECT event_id, v AS first, v AS inner_value, CAST(2.5 AS DOUBLE) AS kept, event_type AS name
       FROM (SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 THEN NULL ELSE value END AS v FROM events) e""",
)
def b29_nested(t):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    doc = F.struct(F.array(v, F.lit(2.5)).alias("list"), F.create_map(F.lit("k"), F.struct(v.alias("x"), F.col("event_type").alias("name"))).alias("map"))
    d = responses.sanitize_frame(t["events"].select("event_id", doc.alias("doc")))
    at = F.col("doc.map")["k"]
    return d.select("event_id", F.col("doc.list")[0].alias("first"), at["x"].alias("inner_value"), F.col("doc.list")[1].alias("kept"), at["name"].alias("name"))


@query("b30_response_defaults", """SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'pricing' ELSE 'general_discussion' END AS intent, 'neutral' AS sentiment,
       CAST(CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0.8 END AS DOUBLE) AS confidence_score, '' AS summary, 0 AS n_items FROM events""")
def b30(t):
    raw = F.concat(
        F.lit("{"),
        F.concat_ws(", ", F.when(F.col("event_id") % 3 == 0, '"intent": "pricing"'), F.when(F.col("event_id") % 2 == 0, '"confidence_score": 0.25')),
        F.lit("}"),
    )
    q = t["events"].select(F.col("event_id").alias("request_id"), enrich.quick_intelligence(raw).alias("q"))
    return q.select("request_id", "q.intent", "q.sentiment", "q.confidence_score", "q.summary", F.size("q.action_items").cast("long").alias("n_items"))


@query("b30_enhanced_defaults", """SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'sales_call' ELSE 'internal_meeting' END AS call_type, 'Ann' AS first_person,
       CAST(0.8 AS DOUBLE) AS completeness_score, 0 AS n_risks FROM events""")
def b30_enhanced(t):
    kind = F.when(F.col("event_id") % 3 == 0, '"call_type": "sales_call", ').otherwise("")
    raw = F.concat(F.lit("{"), kind, F.lit('"entities": {"people": [{"name": "Ann"}]}}'))
    e = t["events"].select(F.col("event_id").alias("request_id"), enrich.enhanced_intelligence(raw).alias("e"))
    return e.select("request_id", "e.call_type", F.col("e.people")[0]["name"].alias("first_person"), "e.completeness_score", F.size("e.risk_flags").cast("long").alias("n_risks"))


@query("b32_best_intelligence", "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'enhanced' WHEN event_id % 3 = 1 THEN 'quick' END AS source FROM events")
def b32(t):
    quick = F.when(F.col("event_id") % 3 < 2, "quick")
    deep = F.when(F.col("event_id") % 3 == 0, "enhanced")
    return t["events"].select(F.col("event_id").alias("request_id"), enrich.best_available(deep, quick).alias("source"))


CTX = """SELECT c.request_id, '- src: ' || src || chr(10) || '- dst: ' || dst || CASE WHEN agent_extension IS NOT NULL THEN chr(10) || '- agentExtension: ' || agent_extension ELSE '' END
       || chr(10) || '- direction: ' || direction AS metadata FROM cdr c"""


@query("h15_metadata_lines", CTX, "cdr")
def h15(t):
    fields = F.struct("src", "dst", F.col("agent_extension").alias("agentExtension"), "direction")
    return t["cdr"].select("request_id", prompts.metadata_lines(fields, ["src", "dst", "agentExtension", "direction"]).alias("metadata"))


@query(
    "h15_action_lines",
    f"""SELECT request_id, '- ' || CASE WHEN trim(d) = '' THEN 'No description' ELSE trim(d) END || ' (Owner: Agent)' AS lines
        FROM (SELECT request_id, {AN.format('extracted_items.action_items[0].description')} AS d FROM analysis_responses) t""",
    "analysis_responses",
)
def h15_actions(t):
    return analysis(t).select("request_id", prompts.action_lines(F.col("a.extracted_items.action_items")).alias("lines"))


@query("h16_prompt_wrap", "SELECT event_id, '[INST] system' || chr(10) || chr(10) || event_type || ' [/INST]' AS inst, '<|im_start|>system' || chr(10) || 'system<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || event_type || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat FROM events")
def h16(t):
    e = F.col("event_type")
    return t["events"].select("event_id", prompts.instruction(F.lit("system"), e).alias("inst"), prompts.chat(F.lit("system"), e).alias("chat"))


@query("h26_checklist", """SELECT request_id, '- [ ] T' || CAST(request_id AS VARCHAR) || CASE WHEN agent_extension IS NULL THEN '' ELSE ' (@' || agent_extension || ')' END || ' - Due: 3 days [high]' AS line FROM cdr""", "cdr")
def h26(t):
    items = F.array(F.struct(F.concat(F.lit("T"), F.col("request_id").cast("string")).alias("task"), F.col("agent_extension").alias("assignee"), F.lit("3 days").alias("due_date"), F.lit("high").alias("priority")))
    return t["cdr"].select("request_id", prompts.checklist(items).alias("line"))


@query("h26_contact_lines", """SELECT user_id, '- **' || name || '** - lead (' || email || ', 555)' AS line FROM users""", "users")
def h26_contacts(t):
    people = F.array(F.struct("name", F.lit("lead").alias("role"), F.lit(None).cast("string").alias("company"), "email", F.lit("555").alias("phone")))
    return t["users"].select(F.col("user_id"), prompts.contact_lines(people).alias("line"))


C11_SQL = {**FRAUD_SQL, **TASK_SQL}


@query(
    "c11_fan_in",
    """SELECT a.request_id, CASE WHEN f.conf < 0.3 THEN false ELSE f.enough2 END AS fraud_sufficient, td.title AS first_task, CASE WHEN c.request_id IS NULL THEN false ELSE true END AS has_tasks
       FROM analysis_responses a JOIN step3 f ON a.request_id = f.request_id LEFT JOIN cdr c ON c.request_id = a.request_id LEFT JOIN tidy td ON td.request_id = c.request_id""",
    "analysis_responses fraud_responses task_responses cdr",
    **C11_SQL,
)
def c11(t):
    merged = enrich.fan_in(
        analysis(t).withColumnRenamed("a", "analysis"), scoring(t).withColumnRenamed("s", "agent_scoring"), fraud(t).withColumnRenamed("f", "fraud_detection"),
        tasks(t).withColumnRenamed("t", "agent_tasks").join(t["cdr"].select("request_id"), "request_id", "left_semi"), None,
    )
    return merged.select(
        "request_id", F.col("document.fraud_detection.data_sufficient").alias("fraud_sufficient"),
        F.get("document.agent_tasks.tasks", 0)["title"].alias("first_task"), F.col("document.agent_tasks").isNotNull().alias("has_tasks"),
    )


TEXTS = ["action", "info_type", "info_value", "opportunity", "risk", "area", "recommendation"]
TOLD = ["category", "summary", "product", "quantity", "mentioned_at", "name", "phone", "contact_email", "agent_disclosed_recording", "customer_consented_to_recording", *TEXTS]
WRITTEN = ["subject", "tone", "email_type", "data_sufficient", "full_email"]
# Every thirteenth analysis is cut off; calls without words have no document.
K3_SQL = f"""SELECT c.request_id, f.risk_level, CASE WHEN s.ok THEN s.o ELSE CASE WHEN said THEN -1 END END AS overall_score, n.task_count, n.assigned_to,
       {", ".join(f"CASE WHEN c.request_id % 13 <> 0 THEN a.{x} END AS {x}" for x in TOLD)}, {", ".join(f"CASE WHEN m.valid THEN m.{x} END AS {x}" for x in WRITTEN)},
       CASE WHEN broken THEN 'Could not extract valid JSON from output' END AS error, CASE WHEN broken THEN length(cut) END AS output_length, CASE WHEN broken THEN contains(cut, '"ai_analysis"') END AS contains_marker,
       CASE WHEN broken THEN substr(cut, 1, 100) END AS first_100_chars, CASE WHEN broken THEN right(cut, 100) END AS last_100_chars
       FROM (SELECT *, coalesce(trim(transcript), '') <> '' AS said FROM call_texts) c
       LEFT JOIN fr f ON said AND f.request_id = c.request_id LEFT JOIN sc s ON said AND s.request_id = c.request_id LEFT JOIN tk n ON said AND n.request_id = c.request_id
       LEFT JOIN told a ON said AND a.request_id = c.request_id LEFT JOIN written m ON said AND m.request_id = c.request_id
       LEFT JOIN (SELECT request_id, request_id % 13 = 0 AS broken, substr(js, 1, length(js) // 2) AS cut FROM analysis_responses) r ON said AND r.request_id = c.request_id"""


@query(
    "k3_enrich",
    K3_SQL,
    "call_texts analysis_responses fraud_responses scoring_responses task_responses email_responses cdr",
    **FRAUD_SQL,
    **TASK_SQL,
    fr="SELECT request_id, CASE WHEN NOT enough2 AND NOT ind THEN 'Low' ELSE risk2 END AS risk_level FROM step3",
    sc="""SELECT request_id, CAST(json_extract_string(js, '$.agent_scoring.metrics.greeting') AS BIGINT) <= 10 AS ok,
       CAST(least(100, greatest(0, coalesce(try_cast(json_extract_string(js, '$.agent_scoring.overall_score') AS BIGINT), 0))) AS BIGINT) AS o FROM scoring_responses""",
    tk="""SELECT c.request_id, CASE WHEN d.doc IS NULL THEN 0 ELSE 1 END AS task_count, CASE WHEN d.doc IS NOT NULL THEN c.agent_extension END AS assigned_to
       FROM docs d JOIN cdr c ON c.request_id = d.request_id""",
    told=f"""SELECT * FROM ({CATEGORY_SQL}) a1 JOIN ({SUMMARY_SQL}) a2 USING (request_id) JOIN (SELECT request_id, name AS product, quantity, mentioned_at FROM ({PRODUCT_SQL}) p) a3 USING (request_id)
       JOIN (SELECT request_id, name, phone, email AS contact_email FROM ({CONTACT_SQL}) p) a4 USING (request_id) JOIN ({CONSENT_SQL}) a5 USING (request_id) JOIN ({TEXT_SQL}) a6 USING (request_id)""",
    written=EMAIL_SQL,
)
def k3(t):
    raw = None
    for kind, column in [("analysis", "js"), ("scoring", "js"), ("fraud", "js"), ("email", "js"), ("tasks", "raw")]:
        name = "task_responses" if kind == "tasks" else f"{kind}_responses"
        part = dealt(t, name).select("request_id", F.lit(kind).alias("kind"), F.col(column).alias("raw"))
        raw = part if raw is None else raw.unionByName(part)
    cut = F.substr("raw", F.lit(1), F.floor(F.length("raw") / 2).cast("int"))
    raw = raw.withColumn("raw", F.when((F.col("kind") == "analysis") & (F.col("request_id") % 13 == 0), cut).otherwise(F.col("raw")))
    d = enrich.enrich(t["call_texts"], t["cdr"], raw)
    a, e = F.col("document.analysis"), F.col("document.analysis_error")
    items, intel, wanted = a["extracted_items"], a["business_intelligence"], a["improvement_recommendations"]
    return d.select(
        "request_id", F.col("document.fraud_detection.risk_level").alias("risk_level"), F.col("document.agent_scoring.overall_score").alias("overall_score"),
        F.col("document.agent_tasks.task_count").alias("task_count"), F.get("document.agent_tasks.tasks", 0)["assigned_to"].alias("assigned_to"),
        a["sentiment"]["category"].alias("category"), a["summary"].alias("summary"),
        F.get(items["products"], F.lit(0))["name"].alias("product"), *[F.get(items["products"], F.lit(0))[x].alias(x) for x in ("quantity", "mentioned_at")],
        *[items["contact_info"][x].alias("contact_email" if x == "email" else x) for x in ("name", "phone", "email")],
        *[a["recording_consent"][x].alias(x) for x in ("agent_disclosed_recording", "customer_consented_to_recording")],
        F.get(items["action_items"], F.lit(0))["description"].alias("action"), F.get(items["personal_info"], F.lit(0))["type"].alias("info_type"), F.get(items["personal_info"], F.lit(0))["value"].alias("info_value"),
        F.get(intel["opportunities"], F.lit(0))["description"].alias("opportunity"), F.get(intel["risks"], F.lit(0))["description"].alias("risk"),
        F.get(wanted, F.lit(0))["area_for_improvement"].alias("area"), F.get(wanted, F.lit(0))["recommendation"].alias("recommendation"),
        *[F.col(f"document.follow_up_email.{x}").alias(x) for x in WRITTEN],
        *[e[x].alias(x) for x in ("error", "output_length", "contains_marker", "first_100_chars", "last_100_chars")],
    )
