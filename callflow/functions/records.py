"""Model response documents: schemas and their normalisation.

Each ``*_record`` takes the parsed document (all leaves strings) as a column
and returns the cleaned struct. Rule order matters and is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callflow.functions import cleaning as c

# Categories, caps and default texts the documents use.
SENTIMENT_RULES = [
    (r"no sentiment|n/a", "No Sentiment"),
    ("very positive", "Very Positive"),
    ("very negative", "Very Negative"),
    ("positive", "Positive"),
    ("negative", "Negative"),
]
RISK_RULES = [("high|critical|severe", "High"), ("medium|moderate|elevated", "Medium")]
PRIORITY_RULES = [("urgent|critical", "urgent"), ("high", "high"), ("low", "low")]
FRAUD_ENUMS = {
    "fraud_category": ["impersonation", "social_engineering", "financial_fraud", "identity_phishing", "policy_violation", "none"],
    "impersonation_type": ["authority_figure", "company_representative", "known_contact", "none"],
    "payment_method": ["credit_card", "wire_transfer", "gift_card", "cryptocurrency", "cash", "bank_transfer", "none"],
    "violation_type": ["threats", "harassment", "inappropriate_language", "coercion", "discrimination", "none"],
}
FRAUD_FLAGS = [
    "fraud_detected", "impersonation_detected", "urgency_tactics", "fear_tactics", "authority_tactics", "scarcity_tactics",
    "payment_request_detected", "identity_verification_request", "high_pressure_tactics", "emotional_manipulation",
    "repeated_demands", "policy_violation_detected", "abrupt_call_ending", "scripted_responses_detected", "evasive_behavior",
    "inconsistent_information", "suspicious_language",
]
FRAUD_INDICATORS = [
    "impersonation_detected", "urgency_tactics", "fear_tactics", "payment_request_detected",
    "identity_verification_request", "policy_violation_detected",
]
LOW_CONFIDENCE = "Low confidence in fraud assessment due to insufficient indicators"
INSUFFICIENT = "Insufficient data for confident fraud assessment"
SCORE_CAPS = {
    "greeting": 10, "clarity": 15, "listening_balance": 10, "response_relevance": 20,
    "tone_professionalism": 15, "call_flow": 10, "call_closure": 10, "compliance": 10,
}
TASK_TYPES = ["callback", "follow_up", "escalation", "documentation", "other"]
NO_TASKS = "No actionable tasks identified from the call"
EMAIL_TONES = ["professional", "friendly", "urgent", "consultative", "empathetic", "assertive"]
EMAIL_TYPES = [
    "demo_follow_up", "pricing_follow_up", "proposal_follow_up", "meeting_recap", "objection_handling",
    "next_steps_confirmation", "thank_you", "re_engagement", "contract_follow_up", "general_follow_up",
    "problem_solving", "information_follow_up",
]
CALL_TYPE = ["human_to_human", "ivr", "voicemail"]
CALL_STATUS = ["voicemail_message_request", "do_not_disturb", "wrong_number", "callback_requested"]
CONSENT = ["agent_disclosed_recording", "customer_consented_to_recording"]


def _strings(names) -> str:
    return ", ".join(f"{n} string" for n in names)


ANALYSIS_SCHEMA = f"""
call_type struct<{_strings(CALL_TYPE).replace(' string', ':string')}>,
sentiment struct<category:string, confidence:string, reasoning:string, key_indicators:array<string>>,
summary string,
call_status struct<{_strings(CALL_STATUS).replace(' string', ':string')}>,
recording_consent struct<{_strings(CONSENT).replace(' string', ':string')}>,
extracted_items struct<products:array<struct<name:string, quantity:string, mentioned_at:string>>,
  action_items:array<struct<description:string, owner:string>>,
  contact_info:struct<phone:string, email:string, name:string>,
  personal_info:array<struct<type:string, value:string>>>,
business_intelligence struct<opportunities:array<struct<description:string, potential_value:string>>,
  risks:array<struct<description:string, mitigation_strategy:string>>>,
improvement_recommendations array<struct<area_for_improvement:string, recommendation:string>>"""
FRAUD_SCHEMA = (
    _strings([*FRAUD_FLAGS, "risk_level", "confidence_score", *FRAUD_ENUMS, "reasoning", "data_sufficient",
              "fallback_reason", "potential_fraud", "reason"])
    + ", sensitive_info_requested array<string>, evidence array<string>, red_flags array<string>"
)
SCORING_SCHEMA = (
    "overall_score string, confidence_score string, metrics struct<"
    + ", ".join(f"{m}:string" for m in SCORE_CAPS)
    + ">, flags array<string>"
)
TASK_FIELDS = [
    "task_type", "title", "description", "priority", "due_date_relative", "due_date_estimated", "assigned_to", "name",
    "number", "source_action_item", "confidence",
]
TASKS_SCHEMA = (
    "tasks array<struct<" + ", ".join(f"{f}:string" for f in TASK_FIELDS) + ">>, data_sufficient string, fallback_reason string"
)
EMAIL_PARTS = ["subject", "greeting", "body", "call_to_action", "closing", "full_email"]
EMAIL_SCHEMA = (
    "follow_up_email struct<" + ", ".join(f"{f}:string" for f in [*EMAIL_PARTS, "tone", "email_type"]) + ">, data_sufficient string"
)


def sentiment_category(text: Column) -> Column:
    return F.when(c.blank(text), "Neutral").otherwise(c.first_match(text, SENTIMENT_RULES, "Neutral"))


def summary(text: Column) -> Column:
    return F.when(c.blank(text), "No summary available").otherwise(F.regexp_replace(c.strip(text), r"\s+", " "))


def product(p: Column) -> Column:
    quantity = F.when(F.lower(p["quantity"]).isin(c.NULL_WORDS), None).otherwise(c.whole(p["quantity"]))
    return F.struct(
        c.text_or(p["name"], "Unknown Product").alias("name"),
        quantity.alias("quantity"),
        c.optional_text(p["mentioned_at"], c.NULL_WORDS).alias("mentioned_at"),
    )


def contact(info: Column) -> Column:
    email = F.lower(c.strip(info["email"]))
    return F.struct(
        c.optional_text(info["phone"], c.NULL_WORDS_CONTACT).alias("phone"),
        F.when(c.blank(info["email"]) | email.isin(c.NULL_WORDS_CONTACT) | ~email.contains("@"), None)
        .otherwise(email)
        .alias("email"),
        c.optional_text(info["name"], c.NULL_WORDS_CONTACT).alias("name"),
    )


def _list(items: Column, fn) -> Column:
    """Apply ``fn`` to a list; a missing list is an empty one."""
    return F.coalesce(F.transform(items, fn), F.array())


def _clean(x: Column) -> Column:
    return F.coalesce(c.strip(x), F.lit(""))


def action_items(items: Column) -> Column:
    return _list(
        items,
        lambda a: F.struct(c.text_or(a["description"], "No description").alias("description"), a["owner"].alias("owner")),
    )


def analysis_record(doc: Column) -> Column:
    items, sentiment = doc["extracted_items"], doc["sentiment"]
    intel = doc["business_intelligence"]
    confidence = F.coalesce(sentiment["confidence"].try_cast("double"), F.lit(0.5))
    return F.struct(
        F.struct(*[c.json_flag(doc["call_type"][f]).alias(f) for f in CALL_TYPE]).alias("call_type"),
        F.struct(
            sentiment_category(sentiment["category"]).alias("category"),
            confidence.alias("confidence"),
            F.coalesce(sentiment["reasoning"], F.lit("")).alias("reasoning"),
            c.distinct_sorted(sentiment["key_indicators"]).alias("key_indicators"),
        ).alias("sentiment"),
        summary(doc["summary"]).alias("summary"),
        F.struct(*[c.json_flag(doc["call_status"][f]).alias(f) for f in CALL_STATUS]).alias("call_status"),
        F.struct(*[c.flag(doc["recording_consent"][f]).alias(f) for f in CONSENT]).alias("recording_consent"),
        F.struct(
            _list(items["products"], product).alias("products"),
            action_items(items["action_items"]).alias("action_items"),
            contact(items["contact_info"]).alias("contact_info"),
            _list(
                items["personal_info"],
                lambda p: F.struct(_clean(p["type"]).alias("type"), _clean(p["value"]).alias("value")),
            ).alias("personal_info"),
        ).alias("extracted_items"),
        F.when(
            intel.isNotNull(),
            F.struct(
                _list(
                    intel["opportunities"],
                    lambda o: F.struct(_clean(o["description"]).alias("description"), o["potential_value"].alias("potential_value")),
                ).alias("opportunities"),
                _list(
                    intel["risks"],
                    lambda r: F.struct(_clean(r["description"]).alias("description"), r["mitigation_strategy"].alias("mitigation_strategy")),
                ).alias("risks"),
            ),
        ).alias("business_intelligence"),
        _list(
            doc["improvement_recommendations"],
            lambda r: F.struct(
                _clean(r["area_for_improvement"]).alias("area_for_improvement"), _clean(r["recommendation"]).alias("recommendation")
            ),
        ).alias("improvement_recommendations"),
        # a confidence outside 0…1 rejects the whole document
        confidence.between(0.0, 1.0).alias("valid"),
    )


def enum_value(text: Column) -> Column:
    return F.when(F.coalesce(text == "", F.lit(True)) | F.lower(text).isin(c.NULL_WORDS), "none").otherwise(
        F.replace(F.lower(text), F.lit(" "), F.lit("_"))
    )


def _fraud_fields(doc: Column, ok: Column) -> Column:
    """Every field normalised on its own; defaults where the record is not ok."""
    empty = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")

    def use(value: Column, default) -> Column:
        return F.when(ok, value).otherwise(default if isinstance(default, Column) else F.lit(default))

    sensitive = c.let(
        c.text_list(doc["sensitive_info_requested"], lower=True),
        lambda x: F.when(F.size(x) == 0, F.array(F.lit("none"))).otherwise(x),
    )
    fields = {f: use(c.json_flag(doc[f]), False) for f in FRAUD_FLAGS}
    fields.update({name: use(enum_value(doc[name]), "none") for name in FRAUD_ENUMS})
    fields.update(
        risk_level=use(c.first_match(doc["risk_level"], RISK_RULES, "Low"), "Low"),
        confidence_score=use(c.unit_interval(doc["confidence_score"], 0.0), 0.0),
        reasoning=use(F.coalesce(doc["reasoning"], F.lit("")), ""),
        reason=use(doc["reason"], nothing),
        potential_fraud=use(F.when(doc["potential_fraud"].isNotNull(), c.json_flag(doc["potential_fraud"])), F.lit(None).cast("boolean")),
        sensitive_info_requested=use(sensitive, F.array(F.lit("none"))),
        evidence=use(c.distinct_in_order(doc["evidence"]), empty),
        red_flags=use(c.distinct_in_order(doc["red_flags"]), empty),
        data_sufficient=use(F.coalesce(F.lower(doc["data_sufficient"]) != "false", F.lit(True)), True),
        fallback_reason=use(doc["fallback_reason"], nothing),
        valid=ok & doc.isNotNull(),
    )
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _fraud_rules(v: Column) -> Column:
    """Consistency between the normalised fields, in their fixed order."""
    indicated = F.lit(False)
    for name in FRAUD_INDICATORS:
        indicated = indicated | v[name]
    detected = v["fraud_detected"] | F.coalesce(v["potential_fraud"], F.lit(False)) | indicated
    category = F.when(
        detected & (v["fraud_category"] == "none"),
        F.when(v["impersonation_detected"], "impersonation")
        .when(v["payment_request_detected"], "financial_fraud")
        .when(v["identity_verification_request"], "identity_phishing")
        .when(v["policy_violation_detected"], "policy_violation")
        .when(v["urgency_tactics"] | v["fear_tactics"] | v["authority_tactics"], "social_engineering")
        .otherwise("none"),
    ).otherwise(v["fraud_category"])
    serious = category.isin("impersonation", "financial_fraud", "identity_phishing") & (v["risk_level"] == "Low")
    level = F.when(v["policy_violation_detected"] & v["violation_type"].isin("threats", "coercion"), "High").otherwise(
        F.when(serious, "Medium").otherwise(v["risk_level"])
    )
    unsure = (v["confidence_score"] < 0.3) & _empty(v["fallback_reason"])
    enough = v["data_sufficient"] & ~unsure
    reset = ~enough & ~indicated
    why = F.when(unsure, LOW_CONFIDENCE).when(reset & _empty(v["fallback_reason"]), INSUFFICIENT).otherwise(v["fallback_reason"])
    changed = {
        "fraud_detected": detected & ~reset,
        "suspicious_language": v["suspicious_language"] | v["fraud_detected"],
        "fraud_category": category,
        "risk_level": F.when(reset, "Low").otherwise(level),
        "reason": F.when(_empty(v["reason"]) & ~_empty(v["reasoning"]), v["reasoning"]).otherwise(v["reason"]),
        "reasoning": F.when(_empty(v["reasoning"]) & ~_empty(v["reason"]), v["reason"]).otherwise(v["reasoning"]),
        "data_sufficient": enough,
        "fallback_reason": why,
    }
    names = [*FRAUD_FLAGS, *FRAUD_ENUMS, "risk_level", "confidence_score", "reasoning", "reason", "potential_fraud",
             "sensitive_info_requested", "evidence", "red_flags", "data_sufficient", "fallback_reason", "valid"]
    return F.struct(*[changed.get(n, v[n]).alias(n) for n in names])


def fraud_record(doc: Column) -> Column:
    """Normalised fraud document with the consistency rules applied in order.

    A value outside an enumeration replaces the whole record by the default.
    """

    def fields(d: Column) -> Column:
        ok = F.lit(True)
        for name, allowed in FRAUD_ENUMS.items():
            ok = ok & enum_value(d[name]).isin(allowed)
        return c.let(ok, lambda good: _fraud_fields(d, good))

    return c.let(c.let(doc, fields), _fraud_rules)


def scoring_record(doc: Column) -> Column:
    """Scores as integers; a metric beyond its cap makes an error record."""
    raw = {m: F.coalesce(c.whole(doc["metrics"][m]), F.lit(0).cast("long")) for m in SCORE_CAPS}
    ok = doc.isNotNull()
    for m, cap in SCORE_CAPS.items():
        ok = ok & raw[m].between(0, cap)
    overall = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(c.whole(doc["overall_score"]), F.lit(0))))
    return F.struct(
        F.when(ok, overall).otherwise(-1).cast("long").alias("overall_score"),
        F.when(ok, c.unit_interval(doc["confidence_score"], 0.0)).otherwise(0.0).alias("confidence_score"),
        F.struct(*[F.when(ok, raw[m]).otherwise(-1).cast("long").alias(m) for m in SCORE_CAPS]).alias("metrics"),
        F.when(ok, c.distinct_sorted(doc["flags"])).otherwise(F.array(F.lit("parse_error"))).alias("flags"),
    )


def task_type(text: Column) -> Column:
    low = F.translate(F.lower(text), " -", "__")
    return (
        F.when(F.coalesce(text == "", F.lit(True)) | F.lower(text).isin(c.NULL_WORDS), "follow_up")
        .when(low.contains("call") & low.contains("back"), "callback")
        .when(low.contains("follow"), "follow_up")
        .when(low.contains("escalat"), "escalation")
        .when(low.contains("doc"), "documentation")
        .when(low.isin(TASK_TYPES), low)
        .otherwise("other")
    )


def task_priority(text: Column) -> Column:
    return c.first_match(text, PRIORITY_RULES, "medium")


def task(t: Column) -> Column:
    plain = {
        "title": F.coalesce(t["title"], F.lit("No title")),
        "description": F.coalesce(t["description"], F.lit("No description")),
        "source_action_item": F.coalesce(t["source_action_item"], F.lit("")),
        "task_type": task_type(t["task_type"]),
        "priority": task_priority(t["priority"]),
        "confidence": c.unit_interval(t["confidence"], 0.5),
    }
    return F.struct(*[plain.get(f, t[f]).alias(f) for f in TASK_FIELDS])


def tasks_record(doc: Column) -> Column:
    tasks = _list(doc["tasks"], task)
    reason = F.when(
        doc.isNull(), "Failed to parse task generation output"
    ).when((F.size(tasks) == 0) & (F.coalesce(doc["fallback_reason"], F.lit("")) == ""), NO_TASKS).otherwise(doc["fallback_reason"])
    return F.struct(
        tasks.alias("tasks"),
        F.size(tasks).cast("long").alias("task_count"),
        (doc.isNotNull() & F.coalesce(F.lower(doc["data_sufficient"]) != "false", F.lit(True))).alias("data_sufficient"),
        reason.alias("fallback_reason"),
    )


def inject_known(tasks: Column, extension: Column, name: Column, source: Column, phone: Column) -> Column:
    """Known call fields override what the model wrote, where they are non-empty."""

    def known(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    number = F.coalesce(known(source), known(phone))
    return F.transform(
        tasks,
        lambda t: F.struct(
            *[
                F.coalesce(
                    {"assigned_to": known(extension), "name": known(name), "number": number}.get(f, F.lit(None)), t[f]
                ).alias(f)
                if f in ("assigned_to", "name", "number")
                else t[f].alias(f)
                for f in TASK_FIELDS
            ]
        ),
    )


def email_record(doc: Column) -> Column:
    """E-mail parts trimmed, tone and type normalised, full text assembled."""
    e = doc["follow_up_email"]
    part = {p: F.coalesce(c.strip(e[p]), F.lit("")) for p in EMAIL_PARTS}
    tone = F.lower(c.strip(e["tone"]))
    kind = F.when(F.coalesce(e["email_type"] == "", F.lit(True)), "general_follow_up").otherwise(
        F.replace(F.lower(c.strip(e["email_type"])), F.lit(" "), F.lit("_"))
    )
    pieces = F.filter(F.array(*[part[p] for p in EMAIL_PARTS[1:5]]), lambda x: x != "")
    full = F.when(
        (part["full_email"] == "") & ((part["greeting"] != "") | (part["body"] != "")), F.array_join(pieces, "\n\n")
    ).otherwise(part["full_email"])
    enough = F.coalesce(F.lower(doc["data_sufficient"]) != "false", F.lit(True)) & (part["body"] != "")
    return F.struct(
        *[(full if p == "full_email" else part[p]).alias(p) for p in EMAIL_PARTS],
        F.when(tone.isin(EMAIL_TONES), tone).otherwise("professional").alias("tone"),
        kind.alias("email_type"),
        enough.alias("data_sufficient"),
        (doc.isNotNull() & kind.isin(EMAIL_TYPES)).alias("valid"),
    )
