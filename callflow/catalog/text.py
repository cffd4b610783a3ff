"""Queries on transcript text: phrases, roles, rule baselines, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from callflow.catalog import views
from callflow.catalog.alignment import LINE_SQL
from callflow.catalog.documents import CATEGORY_SQL, FRAUD_SQL, analysis, fraud, scoring
from callflow.catalog.registry import query
from callflow.functions import lexicons as lx
from callflow.functions import records
from callflow.operators import roles, rules, runs
from callflow.plans import label_roles

views.SHARED.update(
    {
        # Turns with a telling phrase in front; the rest of the text stays whole.
        "spoken_lines": """
SELECT conv_id AS call_id, turn AS line_no, 'speaker_' || CAST(CASE WHEN conv_id % 3 = 0 THEN turn % 3 ELSE turn % 2 END AS STRING) AS speaker,
       CASE (conv_id * 5 + turn * 3) % 11 WHEN 0 THEN 'Thank you for calling. Please hold. ' WHEN 1 THEN 'I''m with Acme, calling from the office. ' WHEN 2 THEN 'Front desk, how can I help? '
            WHEN 3 THEN 'Hello. ' WHEN 4 THEN 'I can take your information. ' WHEN 5 THEN 'This is Ann. ' WHEN 6 THEN 'Please leave a message after the tone. '
            WHEN 7 THEN 'Thanks, that is great, goodbye. ' WHEN 8 THEN 'I hate this terrible problem, I will cancel, call me back. ' WHEN 9 THEN 'Act immediately or face legal action, pay now with a gift card. ' ELSE '' END
       || translate(text, chr(10), ' ') AS text
FROM conversations""",
        # The same with phrases that run from one line of a speaker to the speaker's next one.
        "broken_lines": """
SELECT call_id, line_no, speaker, CASE WHEN call_id % 4 = 1 AND line_no = 2 THEN text || ' I can take your' WHEN call_id % 4 = 1 AND line_no IN (4, 5) THEN 'information. ' || text
       WHEN call_id % 4 = 2 AND line_no = 1 THEN text || ' Thank you for' WHEN call_id % 4 = 2 AND line_no IN (3, 4) THEN 'calling. Please hold. ' || text ELSE text END AS text
FROM spoken_lines""",
        "contact_texts": """
SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' mail a' || CAST(doc_id AS STRING) || '@ex.org or call 612-555-' || CAST(1000 + doc_id % 9000 AS STRING)
       WHEN 1 THEN ' on 2024-03-0' || CAST(1 + doc_id % 9 AS STRING) || ' for $1,200.50' ELSE '' END AS text FROM documents""",
    }
)


def rx(phrases) -> str:
    return "'" + lx.pattern(phrases).replace("'", "''") + "'"


def has(phrases, column="text") -> str:
    return f"regexp_matches(lower({column}), {rx(phrases)})"


def transcripts(t):
    """One document per call from its lines."""
    rows = t["spoken_lines"].select("call_id", "line_no", F.concat(F.lit("["), "speaker", F.lit("] "), "text").alias("line"))
    from callflow.operators.sequence import join_texts

    return join_texts(rows, ["call_id"], ["line_no"], F.col("line"), "\n", "transcript")


DOCS = {"docs": "SELECT call_id, string_agg('[' || speaker || '] ' || text, chr(10) ORDER BY line_no) AS transcript FROM spoken_lines GROUP BY call_id"}


@query("h6_ivr_phrases", f"SELECT call_id, line_no, {has(lx.IVR_PHRASES)} AS ivr FROM spoken_lines", "spoken_lines")
def h6(t):
    return t["spoken_lines"].select("call_id", "line_no", lx.looks_like_ivr(F.col("text")).alias("ivr"))


@query("h7_conversational_start", f"SELECT call_id, {has(lx.GREETINGS, 'f')} AND NOT {has(lx.IVR_PHRASES, 'f')} AS conversational FROM (SELECT call_id, split_part(transcript, chr(10), 1) AS f FROM docs) d", "spoken_lines", **DOCS)
def h7(t):
    return transcripts(t).select("call_id", lx.starts_conversational(F.col("transcript")).alias("conversational"))


@query("h8_speaker_labels", "SELECT call_id, string_agg(speaker, ',' ORDER BY f) AS labels FROM (SELECT call_id, speaker, min(line_no) AS f FROM spoken_lines GROUP BY call_id, speaker) t GROUP BY call_id", "spoken_lines")
def h8(t):
    return transcripts(t).select("call_id", F.array_join(lx.speaker_labels(F.col("transcript")), ",").alias("labels"))


@query("h9_parse_lines", "SELECT call_id, line_no, speaker, trim(text) AS text FROM spoken_lines", "spoken_lines")
def h9(t):
    return roles.parse_lines(transcripts(t))


@query("g2_word_overlap", """SELECT call_id, line_no, CASE WHEN a = '' THEN false ELSE contains(b, a) OR contains(a, b) OR len(list_intersect(wa, wb)) / least(len(wa), len(wb)) >= 0.6 END AS matches
    FROM (SELECT *, list_distinct(regexp_split_to_array(a, '\\s+')) AS wa, list_distinct(regexp_split_to_array(b, '\\s+')) AS wb FROM (SELECT call_id, line_no, lower(trim(text)) AS a, lower(trim(first_value(text) OVER (PARTITION BY call_id ORDER BY line_no))) AS b FROM spoken_lines) x) y""", "spoken_lines")
def g2(t):
    rows = t["spoken_lines"]
    first = rows.where("line_no = 0").select("call_id", F.col("text").alias("ivr_text"))
    return rows.join(first, "call_id").select("call_id", "line_no", lx.matches_announcement(F.col("text"), F.col("ivr_text")).alias("matches"))


def over_breaks(phrases) -> str:
    """Phrases that run over a line break in a speaker's lines."""
    pattern = rx(phrases).replace(" ", "[ \n]")
    return f"len(list_filter(regexp_extract_all(lower(broken), {pattern}), lambda m: contains(m, chr(10))))"


SIGNALS = f"""SELECT *, {has(lx.IVR_SPEAKER_PHRASES, 'joined')} AS ivr, {has(lx.CUSTOMER_PHRASES, 'joined')} AS cust, {has(lx.AGENT_PHRASES, 'joined')} AS agt,
    ahs + {over_breaks(lx.ROLE_RULES['Agent'])} AS ah, chs + {over_breaks(lx.ROLE_RULES['Customer'])} AS ch, row_number() OVER (PARTITION BY call_id ORDER BY first_line) - 1 AS place
    FROM (SELECT call_id, speaker, min(line_no) AS first_line, count(*) AS n_lines, string_agg(trim(text), ' ' ORDER BY line_no) AS joined, string_agg(trim(text), chr(10) ORDER BY line_no) AS broken,
    count(*) FILTER (WHERE {has(lx.ROLE_RULES['Agent'])}) AS ahs, count(*) FILTER (WHERE {has(lx.ROLE_RULES['Customer'])}) AS chs FROM broken_lines WHERE line_no < 30 GROUP BY call_id, speaker) g"""
ROLE_SQL = {
    "sig": SIGNALS,
    "ruled": "SELECT *, CASE WHEN ch > ah THEN 'Customer' WHEN ah > ch THEN 'Agent' WHEN place = 1 THEN 'Customer' ELSE 'Agent' END AS role FROM sig",
    "r1": """SELECT *, NOT (ivr AND n_lines <= 2) AS human FROM ruled""",
    "r2": """SELECT *, min(CASE WHEN human AND role = 'Agent' THEN place END) OVER w AS pa, min(CASE WHEN human AND role = 'Customer' THEN place END) OVER w AS pc, count(*) FILTER (WHERE human) OVER w AS nh, count(*) OVER w AS n FROM r1 WINDOW w AS (PARTITION BY call_id)""",
    "r3": """SELECT *, n >= 2 AND nh >= 2 AND coalesce(bool_or(place = pa AND cust) OVER w, false) AND coalesce(bool_or(place = pc AND agt) OVER w, false) AS swap FROM r2 WINDOW w AS (PARTITION BY call_id)""",
    "r4": "SELECT * EXCLUDE (role), CASE WHEN swap AND place = pa THEN 'Customer' WHEN swap AND place = pc THEN 'Agent' ELSE role END AS role FROM r3",
    "r5": "SELECT *, count(*) FILTER (WHERE role = 'Customer') OVER w AS nc, min(CASE WHEN role = 'Customer' THEN place END) OVER w AS fc FROM r4 WINDOW w AS (PARTITION BY call_id)",
    "final": "SELECT call_id, speaker, place, CASE WHEN nc = 0 AND n > 1 AND place = 1 THEN 'Customer' WHEN role = 'Customer' AND place > fc THEN 'Agent' ELSE role END AS role FROM r5",
}


def signals(t):
    return roles.speaker_signals(t["broken_lines"].where("line_no < 30"))


@query("h11_role_validation", "SELECT call_id, speaker, place, role FROM final", "broken_lines", **ROLE_SQL)
def h11(t):
    return roles.validate_roles(roles.rule_roles(signals(t))).withColumn("place", F.col("place").cast("long"))


@query("h12_fallback_roles", "SELECT call_id, speaker, CASE WHEN place = 1 THEN 'Customer' ELSE 'Agent' END AS role FROM sig", "broken_lines", **ROLE_SQL)
def h12(t):
    return roles.fallback_roles(signals(t)).select("call_id", "speaker", "role")


@query("j6_rule_roles", "SELECT call_id, speaker, role FROM ruled", "broken_lines", **ROLE_SQL)
def j6(t):
    return roles.rule_roles(signals(t)).select("call_id", "speaker", "role")


@query("h10_relabel_text", """SELECT s.call_id, s.line_no, '[' || CASE WHEN s.line_no = 0 THEN 'IVR' ELSE f.role END || '] ' || trim(s.text) AS line FROM spoken_lines s JOIN final f ON f.call_id = s.call_id AND f.speaker = s.speaker""", "broken_lines", **ROLE_SQL)
def h10(t):
    parsed = roles.parse_lines(transcripts(t))
    first = t["spoken_lines"].where("line_no = 0").select("call_id", F.col("text").alias("ivr_text"))
    return roles.relabel_text(parsed, roles.validate_roles(roles.rule_roles(signals(t))), first)


# Labels that the map has, that only contain or are contained in one it has, and that it does not know.
OTHER_LABELS = """SELECT call_id, word_idx, CASE WHEN speaker = 'IVR' THEN speaker WHEN call_id % 4 = 1 THEN 'the ' || speaker || ' again' WHEN call_id % 4 = 2 AND word_idx % 7 = 0 THEN 'speaker'
       WHEN call_id % 4 = 2 AND word_idx % 7 = 1 THEN 'ker_1' WHEN call_id % 4 = 3 AND word_idx % 5 = 0 THEN 'guest' WHEN call_id % 4 = 3 AND word_idx % 5 = 1 THEN 'speaker_10' ELSE speaker END AS speaker FROM {}"""


@query("h13_apply_roles", """SELECT w.call_id, w.word_idx, CASE WHEN w.speaker = 'IVR' THEN 'IVR' WHEN w.speaker = 'speaker_0' THEN 'Agent' WHEN w.speaker = 'speaker_1' THEN 'Customer'
    WHEN contains(w.speaker, 'speaker_0') OR contains('speaker_0', w.speaker) THEN 'Agent' WHEN contains(w.speaker, 'speaker_1') OR contains('speaker_1', w.speaker) THEN 'Customer' ELSE w.speaker END AS speaker FROM other w""", "noisy_words",
    other=OTHER_LABELS.format("noisy_words"))
def h13(t):
    t["noisy_words"].createOrReplaceTempView("noisy")
    words = t.spark.sql(OTHER_LABELS.format("noisy"))
    table = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f"speaker_{i}").alias("speaker"), F.lit(r).alias("role")) for i, r in enumerate(["Agent", "Customer"])])
    return roles.apply_roles(words, words.select("call_id").distinct().select("call_id", F.inline(table))).select("call_id", "word_idx", "speaker")


# Announcements by call: the first eight words; one of their words twice more than spoken, so that only the share decides; words that are not spoken.
IVR_TEXTS = """SELECT call_id, CASE call_id % 3 WHEN 0 THEN first8 WHEN 1 THEN first8 || ' zzzz' ELSE 'zzzz yyyy ' || first8 || ' xxxx wwww' END AS ivr_text
       FROM (SELECT call_id, array_to_string(list(text ORDER BY word_idx), ' ') AS first8 FROM words WHERE word_idx < 8 GROUP BY call_id) h"""


@query(
    "e22_ivr_prefix",
    r"""SELECT call_id, min(word_idx) AS ivr_end FROM (
         SELECT p.call_id, p.word_idx, p.prefix, lower(trim(i.ivr_text)) AS ivr, regexp_split_to_array(lower(trim(i.ivr_text)), '\s+') AS ivr_words, regexp_split_to_array(p.prefix, '\s+') AS said
         FROM prefixes p JOIN ivr_texts i ON p.call_id = i.call_id WHERE length(trim(i.ivr_text)) > 10) x
       WHERE contains(prefix, ivr) OR (len(said) >= len(ivr_words) AND len(list_intersect(list_distinct(said), list_distinct(ivr_words))) / len(list_distinct(ivr_words)) >= 0.8)
       GROUP BY call_id""",
    "words",
    ivr_texts=IVR_TEXTS,
    prefixes="SELECT call_id, word_idx, array_to_string(list(lower(text)) OVER (PARTITION BY call_id ORDER BY word_idx), ' ') AS prefix FROM words",
)
def e22(t):
    words = t["words"]
    first8 = words.where("word_idx < 8").groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("word_idx", "text")))["text"], " ").alias("first8"))
    text = F.when(F.col("call_id") % 3 == 0, F.col("first8")).when(F.col("call_id") % 3 == 1, F.concat("first8", F.lit(" zzzz"))).otherwise(F.concat(F.lit("zzzz yyyy "), "first8", F.lit(" xxxx wwww")))
    return roles.ivr_prefix(words, first8.select("call_id", text.alias("ivr_text"))).select("call_id", F.col("ivr_end").cast("long").alias("ivr_end"))


# Roles through model answers: fenced, in prose with an announcement, unreadable, and with a role that does not exist.
ANNOUNCEMENT = "thank you for calling please hold the line"
ANSWERED = f"""SELECT call_id, word_idx, CASE WHEN call_id % 4 = 1 AND word_idx < {len(ANNOUNCEMENT.split())} THEN split_part('{ANNOUNCEMENT}', ' ', CAST(word_idx + 1 AS INT)) ELSE text END AS text,
       start_ms, end_ms, speaker FROM noisy_words"""
ANSWERS = """SELECT call_id, CASE call_id % 4 WHEN 0 THEN '```json {"has_ivr": false, "ivr_text": "", "speaker_roles": {"speaker_0": "Customer", "speaker_1": "Agent"}} ```'
       WHEN 1 THEN 'Here it is: {"has_ivr": true, "ivr_text": "IVR_TEXT", "speaker_roles": {"speaker_0": "Agent", "speaker_1": "Customer"}} as asked.'
       WHEN 2 THEN 'I cannot tell.' ELSE '{"has_ivr": false, "ivr_text": "", "speaker_roles": {"speaker_0": "Boss", "speaker_1": "Customer"}}' END AS raw
       FROM (SELECT DISTINCT call_id FROM noisy_words) c""".replace("IVR_TEXT", ANNOUNCEMENT)
K2_SQL = {
    "said": ANSWERED,
    **{k: v.replace("noisy_words", "said") for k, v in LINE_SQL.items()},
    "sample": "SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY run_idx, line_idx) - 1 AS line_no FROM walk",
    "given": """SELECT call_id, speaker, place, CASE WHEN call_id % 4 = 2 THEN CASE WHEN place = 1 THEN 'Customer' ELSE 'Agent' END
       WHEN call_id % 4 = 0 AND speaker = 'speaker_0' OR call_id % 4 IN (1, 3) AND speaker = 'speaker_1' THEN 'Customer' ELSE 'Agent' END AS role
       FROM (SELECT call_id, speaker, row_number() OVER (PARTITION BY call_id ORDER BY min(line_no)) - 1 AS place FROM sample WHERE line_no < 30 GROUP BY call_id, speaker) p""",
    "counted": """SELECT *, count(*) FILTER (WHERE role = 'Customer') OVER w AS nc, min(CASE WHEN role = 'Customer' THEN place END) OVER w AS fc, count(*) OVER w AS n FROM given WINDOW w AS (PARTITION BY call_id)""",
    "settled": "SELECT call_id, speaker, CASE WHEN nc = 0 AND n > 1 AND place = 1 THEN 'Customer' WHEN role = 'Customer' AND place > fc THEN 'Agent' ELSE role END AS role FROM counted",
    "labelled": f"""SELECT s.call_id, s.word_idx, s.text, CASE WHEN s.speaker = 'IVR' OR (s.call_id % 4 = 1 AND s.word_idx < {len(ANNOUNCEMENT.split())}) THEN 'IVR' ELSE coalesce(r.role, s.speaker) END AS speaker
       FROM said s LEFT JOIN settled r ON r.call_id = s.call_id AND r.speaker = s.speaker""",
}


def labelled_words(t):
    words = runs.word_runs(t.sql(ANSWERED.replace("FROM noisy_words", "FROM noisy")))
    return label_roles.label_roles(words, t.sql(ANSWERS.replace("FROM noisy_words", "FROM noisy")))


@query("k2_label_roles", "SELECT call_id, word_idx, speaker FROM labelled", "noisy_words", **K2_SQL)
def k2(t):
    t["noisy_words"].createOrReplaceTempView("noisy")
    return labelled_words(t).select("call_id", "word_idx", "speaker")


@query(
    "k2_role_documents",
    """SELECT call_id, string_agg('[' || speaker || '] ' || line, chr(10) ORDER BY g) AS transcript FROM (
         SELECT call_id, g, min(speaker) AS speaker, string_agg(text, ' ' ORDER BY word_idx) AS line FROM (
           SELECT *, sum(turn) OVER (PARTITION BY call_id ORDER BY word_idx) AS g FROM (
             SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY call_id ORDER BY word_idx) THEN 0 ELSE 1 END AS turn FROM labelled) a) b GROUP BY call_id, g) c
       GROUP BY call_id""",
    "noisy_words",
    **K2_SQL,
)
def k2_documents(t):
    t["noisy_words"].createOrReplaceTempView("noisy")
    return label_roles.role_documents(labelled_words(t))


@query("j1_score_batch", "SELECT call_id, line_no, '{\"length\": ' || CAST(length(text) AS VARCHAR) || '}' AS response, CAST(NULL AS VARCHAR) AS error FROM spoken_lines", "spoken_lines")
def j1(t):
    return rules.score_batch(t["spoken_lines"].select("call_id", "line_no", "text"), rules.stub_scorer, "text").select("call_id", "line_no", "response", "error")


@query(
    "j1_token_batches",
    r"""SELECT call_id, line_no, least(n, 12) AS n_tokens, n > 12 AS cut, '{"length": ' || CAST(length(CASE WHEN n > 12 THEN head ELSE text END) AS VARCHAR) || '}' AS response FROM (
        SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS n, regexp_extract(text, '^(?:\s*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_\s])){12}') AS head FROM spoken_lines) t""",
    "spoken_lines",
)
def j1_tokens(t):
    lines = t["spoken_lines"].select("call_id", "line_no", "text")
    scored = rules.score_by_tokens(lines, rules.stub_scorer, "text", budget=64, context=rules.MAX_TOKENS + rules.CONTEXT_MARGIN + 12)
    return scored.select("call_id", "line_no", "n_tokens", "cut", "response")


def wb(words) -> str:
    return "regexp_matches(lower(text), '\\b(" + lx.pattern(words).replace("'", "''") + ")\\b')"


@query("j2_fraud_signals", "SELECT call_id, line_no, " + ", ".join(f"{wb(p)} AS {n}" for n, p in lx.FRAUD_LEXICON.items()) + ", len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 50 AS data_sufficient FROM spoken_lines", "spoken_lines")
def j2(t):
    s = t["spoken_lines"].select("call_id", "line_no", rules.fraud_signals(F.col("text")).alias("s"))
    return s.select("call_id", "line_no", *[f"s.{n}" for n in lx.FRAUD_LEXICON], "s.data_sufficient")


@query(
    "j2_fraud_documents",
    """SELECT call_id, line_no, impersonation OR urgency OR fear OR payment OR sensitive_info OR threats AS fraud_detected,
       CASE WHEN impersonation THEN 'impersonation' WHEN payment THEN 'financial_fraud' WHEN sensitive_info THEN 'identity_phishing' WHEN threats THEN 'policy_violation'
            WHEN urgency OR fear THEN 'social_engineering' ELSE 'none' END AS fraud_category FROM hits""",
    "spoken_lines",
    hits="SELECT call_id, line_no, " + ", ".join(f"{wb(p)} AS {n}" for n, p in lx.FRAUD_LEXICON.items()) + " FROM spoken_lines",
)
def j2_docs(t):
    d = records.fraud_record(rules.fraud_from_signals(rules.fraud_signals(F.col("text"))))
    return t["spoken_lines"].select("call_id", "line_no", d.alias("d")).select("call_id", "line_no", "d.fraud_detected", "d.fraud_category")


@query("j3_rule_tasks", "SELECT event_id, CASE event_type WHEN 'error' THEN 'escalation' WHEN 'signup' THEN 'callback' WHEN 'view' THEN 'documentation' ELSE 'follow_up' END AS task_type, CASE WHEN event_type = 'error' THEN 'high' ELSE 'medium' END AS priority FROM events")
def j3(t):
    items = analysis(t).select(F.col("request_id").alias("event_id"), F.explode("a.extracted_items.action_items").alias("i"))
    return items.select("event_id", F.inline(F.array(rules.action_task(F.col("i.description")))))


SENT = "CASE " + " ".join("WHEN tok IN (" + ", ".join(f"'{w}'" for w in ws) + f") THEN {v}" for (n, ws), v in zip(lx.SENTIMENT_LEXICON.items(), (2, 1, -1, -2))) + " ELSE 0 END"


@query("j4_sentiment_baseline", f"""SELECT call_id, CASE WHEN n < 5 THEN 'No Sentiment' WHEN s >= 4 THEN 'Very Positive' WHEN s >= 1 THEN 'Positive' WHEN s <= -4 THEN 'Very Negative' WHEN s <= -1 THEN 'Negative' ELSE 'Neutral' END AS category, CAST(s AS BIGINT) AS score
    FROM (SELECT call_id, coalesce(sum({SENT}) FILTER (speaker = 'speaker_1'), 0) AS s, count(*) FILTER (speaker = 'speaker_1') AS n FROM (SELECT call_id, speaker, regexp_replace(lower(w), '[^\\p{{L}}]', '', 'g') AS tok FROM (SELECT call_id, speaker, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM spoken_lines) a) b GROUP BY call_id) c""", "spoken_lines")
def j4(t):
    words = t["spoken_lines"].select("call_id", "speaker", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("text"))
    return rules.sentiment_tokens(words, "speaker_1").select("call_id", "category", "score")


N_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("j5_agent_scores", f"""SELECT call_id, CASE WHEN arg_min({wb(lx.OPENERS)}, line_no) FILTER (WHERE m) THEN 10 ELSE 0 END AS greeting, CASE WHEN arg_max({wb(lx.CLOSERS)}, line_no) FILTER (WHERE m) THEN 10 ELSE 0 END AS call_closure,
    greatest(0, least(10, CAST(round(20 * (1 - greatest(said / total, 1 - said / total))) AS INT))) AS listening_balance,
    greatest(0, 10 - 5 * count(*) FILTER (WHERE m AND {wb(lx.PROHIBITED)})) AS compliance
    FROM (SELECT *, sum(w) OVER (PARTITION BY call_id) AS total, sum(CASE WHEN m THEN w ELSE 0 END) OVER (PARTITION BY call_id) AS said FROM (SELECT *, speaker = 'speaker_0' AS m, {N_WORDS} AS w FROM spoken_lines) a) t GROUP BY call_id, said, total""", "spoken_lines")
def j5(t):
    return rules.agent_scores(t["spoken_lines"], "speaker_0").select("call_id", "greeting", "call_closure", "listening_balance", "compliance")


@query("j7_call_flags", "SELECT call_id, line_no, " + ", ".join(f"{has(p)} AS {n}" for n, p in lx.CALL_FLAGS.items()) + " FROM spoken_lines", "spoken_lines")
def j7(t):
    return t["spoken_lines"].select("call_id", "line_no", rules.call_flags(F.col("text")).alias("f")).select("call_id", "line_no", "f.*")


@query("j8_email_route", f"""SELECT call_id, line_no, "case", email_type, tone, data_sufficient, 'Hi Ann,' || chr(10) || chr(10) || CASE "case" WHEN 'voicemail' THEN 'Sorry I missed you.' WHEN 'very_negative' THEN 'I am sorry about your experience.' ELSE 'Thank you for your time.' END
       || chr(10) || chr(10) || 'Would a short call this week suit you?' || chr(10) || chr(10) || 'Best regards' AS email
    FROM (SELECT *, CASE WHEN "case" IN ('voicemail', 'ivr_only') THEN 're_engagement' WHEN "case" IN ('very_negative', 'cancellation') THEN 'problem_solving' ELSE 'general_follow_up' END AS email_type, "case" NOT IN ('voicemail', 'ivr_only', 'short') AS data_sufficient,
            CASE WHEN "case" = 'very_negative' THEN 'empathetic' ELSE 'professional' END AS tone
    FROM (SELECT call_id, line_no, CASE WHEN {has(lx.CALL_FLAGS['voicemail'])} THEN 'voicemail' WHEN {has(lx.IVR_PHRASES)} AND {N_WORDS} < 50 THEN 'ivr_only' WHEN line_no % 4 = 3 THEN 'very_negative' WHEN lower(text) LIKE '%cancel%' THEN 'cancellation' WHEN {N_WORDS} < 50 THEN 'short' ELSE 'regular' END AS "case" FROM spoken_lines) t) u""", "spoken_lines")
def j8(t):
    mood = F.when(F.col("line_no") % 4 == 3, "Very Negative").otherwise("Neutral")
    r = t["spoken_lines"].select("call_id", "line_no", rules.email_route(F.col("text"), mood).alias("r"))
    return r.select("call_id", "line_no", "r.case", "r.email_type", "r.tone", "r.data_sufficient", rules.fill_email(F.col("r"), F.lit("Ann")).alias("email"))


@query("j10_entities", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' || CAST(doc_id AS VARCHAR) || '@ex.org' END AS mail, list_aggregate(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), 'count') AS n_emails,
    list_aggregate(list_distinct(regexp_extract_all(text, '\\b\\d{3}[-. ]\\d{3}[-. ]\\d{4}\\b')), 'count') AS n_phones, list_aggregate(list_distinct(regexp_extract_all(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b')), 'count') AS n_dates, list_aggregate(list_distinct(regexp_extract_all(text, '\\$\\d+(?:,\\d{3})*(?:\\.\\d{2})?')), 'count') AS n_amounts FROM contact_texts""", "contact_texts")
def j10(t):
    e = t["contact_texts"].select("doc_id", rules.entities(F.col("text")).alias("e"))
    mine = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("@ex.org"))
    return e.select("doc_id", F.when(F.array_contains("e.emails", mine), mine).alias("mail"), *[F.size(f"e.{n}").cast("long").alias(f"n_{n}") for n in ("emails", "phones", "dates", "amounts")])


@query("h17_due_date", """SELECT request_id, strftime(CASE request_id % 4 WHEN 0 THEN d + 3 WHEN 1 THEN d + 7 WHEN 2 THEN d + 1 ELSE d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END END, '%Y-%m-%d') AS due FROM (SELECT request_id, CAST(calldate AS DATE) AS d FROM cdr) t""", "cdr")
def h17(t):
    phrase = F.when(F.col("request_id") % 4 == 0, "3 days").when(F.col("request_id") % 4 == 1, "next week").when(F.col("request_id") % 4 == 2, "tomorrow")
    return t["cdr"].select("request_id", rules.due_date(F.col("calldate"), phrase).cast("string").alias("due"))


@query("d20_risk_rollup", f"""SELECT direction, day, count(*) AS calls, count(*) FILTER (WHERE risk_level = 'High') AS high_risk, count(*) FILTER (WHERE fraud_detected) AS fraud,
    count(*) FILTER (WHERE category IN ('Negative', 'Very Negative')) AS negative FROM
    (SELECT c.direction, strftime(c.calldate, '%Y-%m') AS day, CASE WHEN NOT enough2 AND NOT ind THEN 'Low' ELSE risk2 END AS risk_level, det AND NOT (NOT enough2 AND NOT ind) AS fraud_detected, a.category
     FROM step3 s JOIN cdr c ON c.request_id = s.request_id JOIN ({CATEGORY_SQL}) a ON a.request_id = s.request_id) t GROUP BY ROLLUP (direction, day)""", "fraud_responses analysis_responses cdr", **FRAUD_SQL)
def d20(t):
    felt = analysis(t).select("request_id", F.col("a.sentiment.category").alias("category"))
    docs = fraud(t).join(t["cdr"], "request_id").join(felt, "request_id").select("direction", F.date_format("calldate", "yyyy-MM").alias("day"), "f.risk_level", "f.fraud_detected", "category")
    return rules.risk_rollup(docs, ["direction", "day"])


# What the responses give for each metric; a null or a word counts as 0.
METRICS = {"greeting": "g", "clarity": "c", "listening_balance": "l", "response_relevance": "r", "tone_professionalism": "t", "call_flow": "f", "call_closure": "cc", "compliance": "p"}


@query("d21_score_rollup", "SELECT count(*) AS scored, " + ", ".join(f"round(avg({a}), 6) AS {m}, round(avg({a}) / {records.SCORE_CAPS[m]}, 6) AS {m}_share" for m, a in METRICS.items())
    + f", count(*) FILTER (WHERE {' + '.join(METRICS.values())} <> o) AS mismatched FROM (SELECT "
    + ", ".join(f"coalesce(CAST(floor(try_cast(json_extract_string(js, '$.agent_scoring.metrics.{m}') AS DOUBLE)) AS BIGINT), 0) AS {a}" for m, a in METRICS.items())
    + ", least(100, greatest(0, coalesce(try_cast(json_extract_string(js, '$.agent_scoring.overall_score') AS BIGINT), 0))) AS o FROM scoring_responses) t WHERE g <= 10", "scoring_responses")
def d21(t):
    r = rules.score_rollup(scoring(t))
    return r.select(*[F.round(c, 6).alias(c) if c not in ("scored", "mismatched") else c for c in r.columns])
