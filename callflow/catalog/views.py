"""Conversation-shaped views over the driver tables, for Spark and for DuckDB.

Each stand-in exists as DuckDB text (inlined as a CTE by the oracle) and as a
Spark frame. Texts both engines accept are shared; those that would number the
rows of a whole call in one task are built on the Spark side from per-turn
counts and prefix sums instead.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.sequence import number_rows, running_sum
from callflow.session import durable, prepare

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TURN_BLOCK = 4096

# DuckDB spelling of the views built differently in Spark.
DUCK = {
    "tokens": r"""
SELECT conv_id, turn, role, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS tok
FROM (SELECT conv_id, turn, role, regexp_split_to_array(trim(text), '\s+') AS a FROM conversations) t""",
    "words": """
SELECT call_id, turn, word_idx, text, role,
       300 * word_idx + off AS start_ms, 300 * (word_idx + 1) + off AS end_ms
FROM (SELECT conv_id AS call_id, turn, role, tok AS text,
             CAST(700 * turn + 300 * floor(turn / 2) AS BIGINT) AS off,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS word_idx
      FROM tokens) t""",
    "segments": """
SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY s, turn) - 1 AS seg_idx,
       speaker, s AS start_ms, e AS end_ms, turn
FROM (SELECT call_id, turn,
             CASE role WHEN 'user' THEN 'speaker_0' WHEN 'assistant' THEN 'speaker_1' ELSE 'speaker_2' END AS speaker,
             greatest(0, min(start_ms) + 600 * ((turn * 7 + call_id) % 5 - 2)) AS s,
             greatest(300, max(end_ms) + 600 * ((turn * 7 + call_id) % 5 - 2)) AS e
      FROM words GROUP BY call_id, turn, role) t""",
    "chunks": """
SELECT call_id, i AS chunk_idx, 60000 * i AS start_ms, least(60000 * (i + 1) + 200, total) AS end_ms
FROM (SELECT call_id, total, unnest(generate_series(0, CAST(floor((total - 1) / 60000) AS BIGINT))) AS i
      FROM (SELECT call_id, max(end_ms) AS total FROM words GROUP BY call_id) t) u""",
    "chunk_words": """
SELECT w.call_id, c.chunk_idx,
       row_number() OVER (PARTITION BY w.call_id, c.chunk_idx ORDER BY w.word_idx) - 1 AS pos,
       w.word_idx AS spoken_idx, w.text, w.start_ms - c.start_ms AS start_ms, w.end_ms - c.start_ms AS end_ms
FROM words w JOIN chunks c ON w.call_id = c.call_id AND w.start_ms >= c.start_ms AND w.start_ms < c.end_ms""",
    "frames": """
SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
       least(value, 100) / 100 AS speech_prob
FROM events""",
    "user_turns": """
SELECT call_id, turn, role, min(word_idx) AS first_word, max(word_idx) + 1 AS past_word,
       min(start_ms) AS start_ms, max(end_ms) AS end_ms
FROM words GROUP BY call_id, turn, role""",
}

# Text both engines run unchanged.
SHARED = {
    "users": """
SELECT n_nationkey AS user_id, n_name AS name, lower(n_name) || '@example.com' AS email,
       'ext-' || CAST(n_nationkey AS STRING) AS external_id FROM nation""",
    "api_keys": """
SELECT c_custkey AS key_id, c_name AS name, c_nationkey AS user_id,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'bp-proj'
            WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'bp' ELSE 'bp-svc' END AS key_type,
       c_acctbal >= 0 AS is_active,
       1 AS requests_per_minute, 1 AS requests_per_hour, 3 AS requests_per_day
FROM customer""",
    "requests": "SELECT event_id AS request_id, user_id AS key_id, ts, value AS audio_seconds FROM events",
    "jobs": """
SELECT o_orderkey AS job_id, o_custkey AS key_id,
       CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'completed'
            ELSE CASE o_orderkey % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'rejected' END END AS status,
       o_orderkey % 2 = 0 AS is_async,
       5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
       o_orderdate AS created_at,
       o_totalprice / 100 AS audio_duration,
       o_totalprice / 100 * (1 + o_orderkey % 20) / 100 AS processing_time,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN 'decode error' END AS error_message
FROM orders""",
    "results": """
SELECT job_id, 'text ' || CAST(job_id AS STRING) AS text, CAST(1 + floor(audio_duration / 300) AS BIGINT) AS chunks
FROM jobs WHERE status = 'completed' AND job_id % 10 <> 0""",
    "eval_labels": """
SELECT item_id, lvl_a AS actual,
       CASE WHEN item_id % 97 = 0 THEN 'unknown' WHEN item_id % 13 = 0 THEN ' Postive '
            WHEN item_id % 11 = 0 THEN lower(lvl_p) ELSE lvl_p END AS predicted
FROM (SELECT item_id,
             CASE a WHEN 0 THEN 'Very Negative' WHEN 1 THEN 'Negative' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Positive' ELSE 'Very Positive' END AS lvl_a,
             CASE p WHEN 0 THEN 'Very Negative' WHEN 1 THEN 'Negative' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'Positive' ELSE 'Very Positive' END AS lvl_p
      FROM (SELECT event_id AS item_id, a, least(4, greatest(0, a + event_id % 4 - 1)) AS p
            FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS a
                  FROM events) x) y) z""",
    "task_responses": """
SELECT request_id,
       CASE request_id % 5
            WHEN 0 THEN js
            WHEN 1 THEN '```json ' || js || ' ```'
            WHEN 2 THEN 'Here is the result: ' || js || ' Done.'
            WHEN 3 THEN 'plain text only'
            ELSE substr(js, 1, 40) END AS raw
FROM (SELECT event_id AS request_id,
             '{"tasks": [{"task_type": "' ||
             CASE event_type WHEN 'error' THEN 'Escalate' WHEN 'signup' THEN 'Call-Back' WHEN 'view' THEN 'document'
                  WHEN 'click' THEN 'follow up' ELSE 'something_random' END ||
             '", "title": "T' || CAST(event_id AS STRING) || '", "priority": "' ||
             CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'low' ELSE 'x' END ||
             '", "confidence": ' || CASE WHEN event_id % 7 = 0 THEN '1.5' ELSE '0.5' END ||
             '}], "data_sufficient": true}' AS js
      FROM events) t""",
    "analysis_responses": """
SELECT event_id AS request_id,
       '{"ai_analysis": {"call_type": {"human_to_human": true, "ivr": ' || CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'false' END ||
       '}, "sentiment": {"category": "' ||
       CASE event_id % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN 'VERY positive' WHEN 2 THEN 'very negative tone' WHEN 3 THEN 'Positive'
            WHEN 4 THEN 'somewhat negative' WHEN 5 THEN '' WHEN 6 THEN 'mixed' ELSE 'no sentiment' END ||
       '", "confidence": 0.' || CAST(event_id % 10 AS STRING) || ', "key_indicators": [" ' || event_type || ' ", "", "' || event_type || '", "a"]}, ' ||
       '"summary": "' || CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'call  ' || CAST(event_id AS STRING) || '   about ' || event_type || ' ' END || '", ' ||
       '"recording_consent": {"agent_disclosed_recording": "' || CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN 'no' ELSE 'perhaps' END ||
       '", "customer_consented_to_recording": ' || CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'null' END || '}, ' ||
       '"extracted_items": {"products": [{"name": "' || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE ' P' || CAST(event_id % 50 AS STRING) END ||
       '", "quantity": ' || CASE event_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '"n/a"' WHEN 2 THEN '"12"' ELSE 'null' END ||
       ', "mentioned_at": "' || CASE WHEN event_id % 2 = 0 THEN 'None' ELSE '00:10 ' END || '"}], ' ||
       '"action_items": [{"description": " ' || CASE event_type WHEN 'error' THEN 'escalate to supervisor' WHEN 'signup' THEN 'call back tomorrow'
            WHEN 'view' THEN 'send the brochure' WHEN 'click' THEN 'check the account' ELSE '' END || ' ", "owner": "Agent"}], ' ||
       '"contact_info": {"phone": "' || CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE '555-' || CAST(event_id % 1000 AS STRING) END ||
       '", "email": "' || CASE event_id % 3 WHEN 0 THEN 'User' || CAST(user_id AS STRING) || '@Example.COM' WHEN 1 THEN 'none' ELSE 'broken.example' END ||
       '", "name": "' || CASE WHEN event_id % 4 = 0 THEN 'Null' ELSE ' Name ' || CAST(user_id AS STRING) END || '"}, ' ||
       '"personal_info": [{"type": " age ", "value": ' || CAST(event_id % 90 AS STRING) || '}]}, ' ||
       '"business_intelligence": {"opportunities": [{"description": " upsell ' || event_type || ' "}], "risks": [{"description": null}]}, ' ||
       '"improvement_recommendations": [{"area_for_improvement": " pace ", "recommendation": null}]}}' AS js
FROM events""",
    "fraud_responses": """
SELECT event_id AS request_id,
       '{"fraud_detection": {"fraud_detected": ' || CASE WHEN event_id % 9 = 0 THEN 'true' ELSE 'false' END ||
       ', "risk_level": "' || CASE event_id % 6 WHEN 0 THEN 'Severe' WHEN 1 THEN 'moderate' WHEN 2 THEN 'LOW' WHEN 3 THEN 'critical!' WHEN 4 THEN 'elevated' ELSE '' END ||
       '", "confidence_score": ' || CASE event_id % 5 WHEN 0 THEN '0.1' WHEN 1 THEN '1.7' WHEN 2 THEN '"bad"' WHEN 3 THEN '0.55' ELSE '0.9' END ||
       ', "fraud_category": "' || CASE event_id % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'Social Engineering' WHEN 2 THEN 'null' WHEN 3 THEN 'weird' ELSE 'n/a' END ||
       '", "impersonation_detected": ' || CASE WHEN event_id % 11 = 0 THEN 'true' ELSE 'false' END ||
       ', "urgency_tactics": ' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END ||
       ', "authority_tactics": ' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END ||
       ', "payment_request_detected": ' || CASE WHEN event_id % 13 = 0 THEN 'true' ELSE 'false' END ||
       ', "payment_method": "' || CASE WHEN event_id % 13 = 0 THEN 'Gift Card' ELSE 'none' END ||
       '", "identity_verification_request": ' || CASE WHEN event_id % 17 = 0 THEN 'true' ELSE 'false' END ||
       ', "sensitive_info_requested": ' || CASE WHEN event_id % 17 = 0 THEN '[" SSN ", ""]' ELSE '[]' END ||
       ', "policy_violation_detected": ' || CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END ||
       ', "violation_type": "' || CASE WHEN event_id % 20 = 0 THEN 'Threats' WHEN event_id % 10 = 0 THEN 'harassment' ELSE 'none' END ||
       '", "evidence": ["' || event_type || '", " ' || event_type || ' ", "", "x"], "reasoning": "' ||
       CASE WHEN event_id % 2 = 0 THEN 'because' ELSE '' END || '", "data_sufficient": ' || CASE WHEN event_id % 8 = 0 THEN 'false' ELSE 'true' END || '}}' AS js
FROM events""",
    "scoring_responses": """
SELECT event_id AS request_id,
       '{"agent_scoring": {"overall_score": ' || CASE event_id % 5 WHEN 0 THEN '130' WHEN 1 THEN '-4' WHEN 2 THEN '"71"' WHEN 3 THEN 'null' ELSE '64' END ||
       ', "confidence_score": ' || CASE event_id % 3 WHEN 0 THEN '1.4' WHEN 1 THEN '0.5' ELSE '"x"' END ||
       ', "metrics": {"greeting": ' || CAST(event_id % 12 AS STRING) || ', "clarity": ' || CAST(event_id % 15 AS STRING) ||
       ', "listening_balance": "' || CAST(event_id % 10 AS STRING) || '", "response_relevance": ' || CAST(event_id % 20 AS STRING) ||
       ', "tone_professionalism": null, "call_flow": "many", "call_closure": ' || CAST(event_id % 10 AS STRING) ||
       '.7, "compliance": 10}, "flags": [" ' || event_type || ' ", "late", "late", ""]}}' AS js
FROM events""",
    "email_responses": """
SELECT event_id AS request_id,
       '{"follow_up_email": {"subject": " Re ' || CAST(event_id AS STRING) || ' ", "greeting": "' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Hi ' END ||
       '", "body": "' || CASE WHEN event_id % 5 = 0 THEN ' ' ELSE ' about ' || event_type END ||
       '", "call_to_action": "' || CASE WHEN event_id % 2 = 0 THEN 'Reply' ELSE '' END || '", "closing": "Bye", "full_email": ' ||
       CASE WHEN event_id % 7 = 0 THEN '" given "' ELSE 'null' END || ', "tone": "' ||
       CASE event_id % 4 WHEN 0 THEN ' Friendly ' WHEN 1 THEN 'angry' WHEN 2 THEN '' ELSE 'URGENT' END || '", "email_type": "' ||
       CASE event_id % 4 WHEN 0 THEN 'Thank You' WHEN 1 THEN 'mystery' WHEN 2 THEN '' ELSE 'meeting_recap' END ||
       '"}, "data_sufficient": true}' AS js
FROM events""",
    "cdr": """
SELECT o_orderkey AS request_id, 'S' || CAST(o_custkey AS STRING) AS src, 'D' || CAST(o_orderkey AS STRING) AS dst,
       o_orderdate AS calldate,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'ext-' || CAST(o_custkey % 50 AS STRING) END AS agent_extension,
       CASE WHEN o_orderkey % 2 = 0 THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction
FROM orders""",
    "cdr_json": """
SELECT request_id,
       CASE WHEN request_id % 11 = 0 THEN '{"src": '
            WHEN request_id % 13 = 0 THEN '[1, 2]'
            ELSE '{"src": "' || src || '", "dst": "' || dst || '", "direction": "' || direction || '", "calldate": ' ||
                 CASE WHEN request_id % 5 = 0 THEN 'null' ELSE '"' || CAST(request_id AS STRING) || '"' END || '}' END AS raw
FROM cdr""",
    # What was said in the call of each request, some calls without a word and some unknown.
    "call_texts": """
SELECT e.event_id AS request_id, CASE WHEN e.event_id % 10 = 0 THEN '  ' ELSE c.text END AS transcript
FROM events e LEFT JOIN conversations c ON c.conv_id = e.event_id % 120 AND c.turn = e.event_id % 3""",
    "speaker_vectors": "SELECT label AS call_id, vec_id, embedding FROM embeddings",
}

NEEDS = {
    "words": ["tokens"],
    "segments": ["words"],
    "chunks": ["words"],
    "chunk_words": ["words", "chunks"],
    "user_turns": ["words"],
    "results": ["jobs"],
    "cdr_json": ["cdr"],
    "broken_lines": ["spoken_lines"],
}


def _closure(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def oracle(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named views (and what they build on) inlined as CTEs."""
    ctes = [(n, DUCK.get(n) or SHARED[n]) for n in _closure(list(names))] + list(extra.items())
    if not ctes:
        return body
    start = "WITH RECURSIVE " if "walk" in extra else "WITH "
    return start + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes) + "\n" + body


class Tables:
    """The driver tables of one folder and the views over them, as frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            for field in df.schema.fields:
                if field.dataType.typeName() == "timestamp_ntz":
                    df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
            self._read[name] = df
        return self._read[name]

    def dealt(self, name: str) -> Tables:
        """The same tables with the rows of one dealt evenly, where the work on a row outweighs moving it.

        A table in one file is otherwise read by as many tasks as it has row
        groups, few of them whatever the number of cores.
        """
        out = Tables(self.spark, self.folder)
        session = self.spark
        parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
        out._read = self._read | {name: self.base(name).repartition(parts)}
        return out

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in SHARED:
            return self.sql(SHARED[name])
        return getattr(self, f"_{name}")()

    def sql(self, text: str) -> DataFrame:
        for name in [*BASE, *SHARED, "words", "segments", "chunks"]:
            if re.search(rf"\b(FROM|JOIN) {name}\b", text):
                self[name].createOrReplaceTempView(name)
        return self.spark.sql(text)

    def _user_turns(self) -> DataFrame:
        # one row per turn, read by most views: written once instead of redone
        if "user_turns" not in self._read:
            self._read["user_turns"] = durable(self._placed_turns())
        return self._read["user_turns"]

    def _placed_turns(self) -> DataFrame:
        turns = self.base("conversations").select(
            F.col("conv_id").alias("call_id"),
            "turn",
            "role",
            "text",
            F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n"),
        )
        placed = running_sum(
            turns, ["call_id"], ["turn"], F.floor(F.col("turn") / TURN_BLOCK), F.col("n"), "past_word"
        )
        off = F.col("turn") * 700 + F.floor(F.col("turn") / 2) * 300
        return (
            placed.withColumn("first_word", F.col("past_word") - F.col("n"))
            .withColumn("off", off.cast("long"))
            .withColumn("start_ms", F.col("first_word") * 300 + F.col("off"))
            .withColumn("end_ms", F.col("past_word") * 300 + F.col("off"))
        )

    def _words(self) -> DataFrame:
        turns = self._user_turns()
        at = F.col("first_word") + F.col("pos")
        return turns.select(
            "call_id", "turn", "role", "first_word", "off", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "text")
        ).select(
            "call_id",
            "turn",
            at.alias("word_idx"),
            "text",
            "role",
            (at * 300 + F.col("off")).alias("start_ms"),
            ((at + 1) * 300 + F.col("off")).alias("end_ms"),
        )

    def _segments(self) -> DataFrame:
        shift = ((F.col("turn") * 7 + F.col("call_id")) % 5 - 2) * 600
        zero, least = F.lit(0).cast("long"), F.lit(300).cast("long")
        segs = self._user_turns().select(
            "call_id",
            "turn",
            F.when(F.col("role") == "user", "speaker_0")
            .when(F.col("role") == "assistant", "speaker_1")
            .otherwise("speaker_2")
            .alias("speaker"),
            F.greatest(zero, F.col("start_ms") + shift).alias("start_ms"),
            F.greatest(least, F.col("end_ms") + shift).alias("end_ms"),
        )
        return number_rows(
            segs, ["call_id"], ["start_ms", "turn"], F.floor(F.col("start_ms") / 3_600_000), "seg_idx"
        ).select("call_id", "seg_idx", "speaker", "start_ms", "end_ms", "turn")

    def _chunks(self) -> DataFrame:
        total = self._user_turns().groupBy("call_id").agg(F.max("end_ms").alias("total"))
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 60000)))
        return total.select("call_id", "total", i.alias("chunk_idx")).select(
            "call_id",
            "chunk_idx",
            (F.col("chunk_idx") * 60000).alias("start_ms"),
            F.least((F.col("chunk_idx") + 1) * 60000 + 200, F.col("total")).alias("end_ms"),
        )

    def _chunk_words(self) -> DataFrame:
        # The grid is known, so a word's chunks follow from its start: its own,
        # and the one before when it falls into that chunk's 200 ms tail.
        own = F.floor(F.col("start_ms") / 60000)
        tail = (F.col("start_ms") % 60000 < 200) & (F.col("start_ms") >= 60000)
        homes = F.explode(F.when(tail, F.array(own - 1, own)).otherwise(F.array(own)))
        rows = self._words().withColumn("chunk_idx", homes)
        local = rows.select(
            "call_id",
            "chunk_idx",
            F.col("word_idx").alias("spoken_idx"),
            "text",
            (F.col("start_ms") - F.col("chunk_idx") * 60000).alias("start_ms"),
            (F.col("end_ms") - F.col("chunk_idx") * 60000).alias("end_ms"),
        )
        first = F.min("spoken_idx").over(W.partitionBy("call_id", "chunk_idx"))  # a minute of words
        return local.withColumn("pos", F.col("spoken_idx") - first)

    def _frames(self) -> DataFrame:
        events = self.base("events").select(
            F.col("user_id").alias("call_id"),
            "ts",
            "event_id",
            (F.least("value", F.lit(100.0)) / 100).alias("speech_prob"),
        )
        return number_rows(
            events, ["call_id"], ["ts", "event_id"], F.floor(F.unix_seconds("ts") / 86400), "frame_idx"
        ).select("call_id", "frame_idx", "speech_prob")
