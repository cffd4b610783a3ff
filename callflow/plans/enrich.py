"""From raw model responses to one typed document per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.functions import records
from callflow.operators import responses

# Defaults of the intelligence documents.
QUICK_SCHEMA = (
    "summary string, intent string, sentiment string, action_items array<string>, key_entities array<string>, "
    "confidence_score double, processing_time double"
)
PEOPLE = "array<struct<name:string, role:string, company:string, email:string, phone:string>>"
ENHANCED_SCHEMA = (
    "call_type string, intent string, sentiment string, summary string, key_topics array<string>, "
    f"entities struct<people:{PEOPLE}, companies:array<string>, products:array<string>, emails:array<string>, "
    "phones:array<string>, dates:array<string>, financial_info:map<string,string>>, action_items array<string>, "
    "opportunity_info string, issues array<string>, conversation_metrics map<string,string>, confidence_score double, "
    "completeness_score double, recommendations array<string>, risk_flags array<string>"
)
RECORDS = {
    "analysis": records.analysis_record,
    "scoring": records.scoring_record,
    "fraud": records.fraud_record,
    "tasks": records.tasks_record,
    "email": records.email_record,
}


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.array() if default == [] else F.lit(default))


def quick_intelligence(raw: Column) -> Column:
    d = F.from_json(raw, QUICK_SCHEMA)
    return F.struct(
        _or(d["summary"], "").alias("summary"),
        _or(d["intent"], "general_discussion").alias("intent"),
        _or(d["sentiment"], "neutral").alias("sentiment"),
        _or(d["action_items"], []).alias("action_items"),
        _or(d["key_entities"], []).alias("key_entities"),
        _or(d["confidence_score"], 0.8).alias("confidence_score"),
        _or(d["processing_time"], 0.0).alias("processing_time"),
    )


def enhanced_intelligence(raw: Column) -> Column:
    d = F.from_json(raw, ENHANCED_SCHEMA)
    e = d["entities"]
    return F.struct(
        _or(d["call_type"], "internal_meeting").alias("call_type"),
        _or(d["intent"], "general_discussion").alias("intent"),
        _or(d["sentiment"], "neutral").alias("sentiment"),
        _or(d["summary"], "").alias("summary"),
        *[_or(e[f], []).alias(f) for f in ("people", "companies", "products", "emails", "phones", "dates")],
        F.coalesce(e["financial_info"], F.create_map().cast("map<string,string>")).alias("financial_info"),
        d["opportunity_info"].alias("opportunity_info"),
        F.coalesce(d["conversation_metrics"], F.create_map().cast("map<string,string>")).alias("conversation_metrics"),
        _or(d["confidence_score"], 0.8).alias("confidence_score"),
        _or(d["completeness_score"], 0.8).alias("completeness_score"),
        *[_or(d[f], []).alias(f) for f in ("key_topics", "action_items", "issues", "recommendations", "risk_flags")],
    )


def best_available(enhanced: Column, quick: Column) -> Column:
    return F.coalesce(enhanced, quick)


def fan_in(
    analysis: DataFrame, scoring: DataFrame, fraud: DataFrame, tasks: DataFrame | None, email: DataFrame | None
) -> DataFrame:
    """One ``document`` struct per request from frames keyed by request_id."""
    out = analysis.join(scoring, "request_id", "full").join(fraud, "request_id", "full")
    names = ["analysis", "agent_scoring", "fraud_detection"]
    for frame, name in ((tasks, "agent_tasks"), (email, "follow_up_email")):
        if frame is not None:
            out = out.join(frame, "request_id", "left")
            names.append(name)
    return out.select("request_id", F.struct(*names).alias("document"))


def enrich(transcripts: DataFrame, cdr: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents for all requests with a transcript.

    ``transcripts`` is (request_id, transcript), ``raw`` is (request_id, kind,
    raw and, if known, created_at). All kinds are searched in one pass and pivoted by one aggregation
    keyed on the request, instead of five joins. Empty transcripts get a null
    document; tasks exist only where a call record does.
    """
    usable = transcripts.where(F.trim(F.coalesce("transcript", F.lit(""))) != "").select("request_id")
    made = F.col("created_at") if "created_at" in raw.columns else F.lit(0)
    docs = raw.join(usable, "request_id", "left_semi").select(
        "request_id", "kind", "raw", responses.salvage(F.col("raw"), F.col("kind")).alias("doc"), made.alias("made")
    )

    def newest(kind: str, column: str, order: Column) -> Column:
        return F.max_by(column, F.when((F.col("kind") == kind) & F.col(column).isNotNull(), order))

    # of several responses the newest readable one counts; without a time, or at equal times, the one last in order
    wide = docs.groupBy("request_id").agg(
        *[newest(k, "doc", F.struct("made", "raw")).alias(f"doc_{k}") for k in RECORDS],
        newest("analysis", "raw", F.struct("made", "raw")).alias("raw_analysis"),
    )
    # parsed in a step of its own, once, however many fields a record takes
    read = wide.select(
        "request_id", "raw_analysis", F.col("doc_analysis").isNotNull().alias("parsed"), *[responses.parse(F.col(f"doc_{k}"), k).alias(k) for k in RECORDS]
    )
    typed = read.select("request_id", "raw_analysis", "parsed", *[record(F.col(k)).alias(k) for k, record in RECORDS.items()])
    called = typed.join(
        cdr.select("request_id", "src", "agent_extension", F.lit(True).alias("_called")), "request_id", "left"
    )
    who = F.col("analysis.extracted_items.contact_info")
    tasks = F.struct(
        records.inject_known(F.col("tasks.tasks"), F.col("agent_extension"), who["name"], F.col("src"), who["phone"]).alias("tasks"),
        F.col("tasks.task_count").alias("task_count"),
        F.col("tasks.data_sufficient").alias("data_sufficient"),
        F.col("tasks.fallback_reason").alias("fallback_reason"),
    )
    document = F.struct(
        F.when(F.col("parsed") & F.col("analysis.valid"), F.col("analysis")).alias("analysis"),
        F.when(~F.col("parsed"), responses.error_envelope(F.col("raw_analysis"), "ai_analysis")).alias("analysis_error"),
        F.col("scoring").alias("agent_scoring"),
        F.col("fraud").alias("fraud_detection"),
        F.when(F.col("_called"), tasks).alias("agent_tasks"),
        F.when(F.col("email.valid"), F.col("email")).alias("follow_up_email"),
    )
    built = called.select("request_id", document.alias("document"))
    return transcripts.select("request_id").join(built, "request_id", "left")
