"""Rule baselines over text, and the batch scorer that can replace them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from callflow.functions import lexicons as lx
from callflow.functions import records

# The model's context, what an answer may take of it, and the margin.
CONTEXT_TOKENS, MAX_TOKENS, CONTEXT_MARGIN = 8192, 800, 100
#: Padded tokens of a batch, and how far a task reads ahead to find prompts of like length.
TOKEN_BUDGET, AHEAD, AHEAD_CHARS = 32_768, 2048, 1 << 24
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
SHORT_CALL_WORDS = 50
EMAIL, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b"
DATE, AMOUNT = r"\b\d{4}-\d{2}-\d{2}\b", r"\$\d+(?:,\d{3})*(?:\.\d{2})?"


def score_batch(df: DataFrame, scorer: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "response") -> DataFrame:
    """Call a batch model on a prompt column; a failing row keeps its error and does not lose its neighbours."""
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = _answers(scorer, batch[prompt].tolist())
            yield batch.assign(**{out: [a for a, _ in answers], "error": [e for _, e in answers]})

    return df.mapInPandas(run, schema)


def _answers(scorer: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Answer and error of each prompt; a batch that fails as a whole is retried row by row."""
    try:
        return [(a, None) for a in scorer(prompts)]
    except Exception:  # noqa: BLE001
        out: list[tuple[str | None, str | None]] = []
        for p in prompts:
            try:
                out.append((scorer([p])[0], None))
            except Exception as failure:  # noqa: BLE001
                out.append((None, str(failure)))
        return out


def word_ends(text: str) -> list[int]:
    """Where the tokens of a text end: words and single signs. A model's own tokenizer may take its place."""
    return [m.end() for m in TOKEN.finditer(text)]


def token_batches(lengths: Sequence[int], budget: int) -> list[list[int]]:
    """Places of ``lengths`` in batches of neighbouring length; a batch, padded to its longest, fits ``budget``."""
    batches: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if batches and max(1, lengths[batches[-1][0]]) * (len(batches[-1]) + 1) <= budget:
            batches[-1].append(i)
        else:
            batches.append([i])
    return batches


def score_by_tokens(
    df: DataFrame,
    scorer: Callable[[list[str]], list[str]],
    prompt: str = "prompt",
    out: str = "response",
    ends: Callable[[str], Sequence[int]] = word_ends,
    budget: int = TOKEN_BUDGET,
    max_tokens: int = MAX_TOKENS,
    context: int = CONTEXT_TOKENS,
) -> DataFrame:
    """Call a batch model on prompts dealt by length; adds ``out``, error, n_tokens and cut.

    A prompt keeps the tokens that leave room in the model's context for its
    answer and a margin; ``cut`` tells those that lost some. A task reads ahead
    ``AHEAD`` rows or ``AHEAD_CHARS`` characters, orders them by length and calls
    the model with batches that fit ``budget`` when padded. The answer to a row
    does not depend on its batch. A batch that fails is retried row by row, and
    a failing row keeps its error. Null prompts count as empty.
    """
    limit = context - max_tokens - CONTEXT_MARGIN
    if not 0 < limit <= budget:
        raise ValueError("a prompt of the longest kind must fit the budget")
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField("error", StringType()), StructField("n_tokens", LongType()), StructField("cut", BooleanType())])

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        prompts, lengths, cut = [], [], []
        for text in rows[prompt]:
            text = text or ""
            stops = ends(text)
            cut.append(len(stops) > limit)
            prompts.append(text[: stops[limit - 1]] if cut[-1] else text)
            lengths.append(min(len(stops), limit))
        answers: list = [None] * len(prompts)
        for batch in token_batches(lengths, budget):
            for i, answer in zip(batch, _answers(scorer, [prompts[i] for i in batch]), strict=True):
                answers[i] = answer
        return rows.assign(**{out: [a for a, _ in answers], "error": [e for _, e in answers], "n_tokens": lengths, "cut": cut})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begin, held = 0, 0
            for i, size in enumerate(batch[prompt].str.len().fillna(0).astype(int).tolist()):
                if i > begin and (i - begin == AHEAD or held + size > AHEAD_CHARS):
                    yield scored(batch.iloc[begin:i])
                    begin, held = i, 0
                held += size
            if begin < len(batch):
                yield scored(batch.iloc[begin:])

    return df.mapInPandas(run, schema)


def stub_scorer(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the length of each prompt."""
    return [f'{{"length": {len(p)}}}' for p in prompts]


def fraud_signals(text: Column) -> Column:
    """Indicator and evidence per tactic; short calls lack data."""
    hits = {name: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + lx.pattern(p) + r")\b"), 1)) for name, p in lx.FRAUD_LEXICON.items()}
    found = {name: F.size(h) > 0 for name, h in hits.items()}
    return F.struct(
        *[found[n].alias(n) for n in hits],
        F.flatten(F.array(*hits.values())).alias("evidence"),
        (lx.word_count(text) >= SHORT_CALL_WORDS).alias("data_sufficient"),
    )


def fraud_from_signals(s: Column) -> Column:
    """Raw fraud document of a signal struct, for the consistency rules."""
    strong = sum(s[n].cast("int") for n in lx.FRAUD_LEXICON)
    fields = {
        "impersonation_detected": s["impersonation"], "urgency_tactics": s["urgency"], "fear_tactics": s["fear"],
        "authority_tactics": s["authority"], "scarcity_tactics": s["scarcity"], "payment_request_detected": s["payment"],
        "identity_verification_request": s["sensitive_info"], "high_pressure_tactics": s["pressure"],
        "policy_violation_detected": s["threats"], "data_sufficient": s["data_sufficient"],
    }
    named = {k: v.cast("string") for k, v in fields.items()}
    named["violation_type"] = F.when(s["threats"], "threats")
    named["confidence_score"] = F.least(F.lit(0.9), F.lit(0.5) + 0.1 * strong).cast("string")
    named["evidence"] = s["evidence"]
    columns = []
    for field in StructType.fromDDL(records.FRAUD_SCHEMA).fields:
        columns.append(named.get(field.name, F.lit(None).cast(field.dataType)).alias(field.name))
    return F.struct(*columns)


def action_task(description: Column) -> Column:
    """Task type and priority of one action item."""
    low = F.lower(description)
    kind = (
        F.when(low.rlike("escalat|supervisor"), "escalation").when(low.rlike("call ?back"), "callback")
        .when(low.rlike("send|document|update"), "documentation").otherwise("follow_up")
    )
    return F.struct(kind.alias("task_type"), F.when(kind == "escalation", "high").otherwise("medium").alias("priority"))


def sentiment_tokens(words: DataFrame, customer: str | None = "Customer") -> DataFrame:
    """Six-class sentiment per call from lexicon hits on the customer's words.

    ``words`` has (call_id, speaker, text); without a ``customer`` all words count.
    """
    said = F.lit(True) if customer is None else F.coalesce(F.col("speaker") == customer, F.lit(False))
    tidy = F.regexp_replace(F.lower("text"), r"[^\p{L}]", "")
    weight = (
        F.when(tidy.isin(lx.SENTIMENT_LEXICON["very_positive"]), 2).when(tidy.isin(lx.SENTIMENT_LEXICON["positive"]), 1)
        .when(tidy.isin(lx.SENTIMENT_LEXICON["negative"]), -1).when(tidy.isin(lx.SENTIMENT_LEXICON["very_negative"]), -2)
    )
    per = words.groupBy("call_id").agg(F.sum(F.when(said, F.coalesce(weight, F.lit(0))).otherwise(0)).alias("score"), F.count_if(said).alias("n_words"))
    s = F.col("score")
    category = (
        F.when(F.col("n_words") < 5, "No Sentiment").when(s >= 4, "Very Positive").when(s >= 1, "Positive")
        .when(s <= -4, "Very Negative").when(s <= -1, "Negative").otherwise("Neutral")
    )
    return per.withColumn("category", category)


def agent_scores(lines: DataFrame, agent: str = "Agent") -> DataFrame:
    """Greeting, closure, balance and compliance points from agent lines.

    ``lines`` is (call_id, line_no, speaker, text). Points stay in the caps.
    """
    mine = F.col("speaker") == agent
    words = lx.word_count(F.col("text"))
    marked = lines.select(
        "call_id", "line_no", mine.alias("mine"), words.alias("w"),
        (mine & lx.word_mentions(F.col("text"), lx.OPENERS)).alias("opens"), (mine & lx.word_mentions(F.col("text"), lx.CLOSERS)).alias("closes"),
        (mine & lx.word_mentions(F.col("text"), lx.PROHIBITED)).alias("bad"),
    )
    per = marked.groupBy("call_id").agg(
        F.min(F.when(F.col("mine"), F.struct("line_no", "opens"))).alias("first"), F.max(F.when(F.col("mine"), F.struct("line_no", "closes"))).alias("last"),
        F.sum(F.when(F.col("mine"), F.col("w")).otherwise(0)).alias("said"), F.sum("w").alias("total"), F.count_if("bad").alias("bad"),
    )
    share = F.col("said") / F.col("total")
    caps = records.SCORE_CAPS

    def points(ok: Column, cap: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), caps[cap]).otherwise(0).alias(cap)

    balance = F.greatest(F.lit(0), F.least(F.lit(caps["listening_balance"]), F.round(20 * (1 - F.greatest(share, 1 - share))).cast("int")))
    return per.select(
        "call_id", points(F.col("first.opens"), "greeting"), points(F.col("last.closes"), "call_closure"), balance.alias("listening_balance"),
        F.greatest(F.lit(0), caps["compliance"] - 5 * F.col("bad")).alias("compliance"),
    )


def call_flags(text: Column) -> Column:
    return F.struct(*[lx.mentions(text, p).alias(n) for n, p in lx.CALL_FLAGS.items()])


def email_route(text: Column, sentiment: Column) -> Column:
    """Which e-mail a call gets, with tone and whether data suffices."""
    case = (
        F.when(lx.mentions(text, lx.CALL_FLAGS["voicemail"]), "voicemail").when(lx.looks_like_ivr(text) & (lx.word_count(text) < SHORT_CALL_WORDS), "ivr_only")
        .when(sentiment == "Very Negative", "very_negative").when(lx.mentions(text, ["cancel"]), "cancellation")
        .when(lx.word_count(text) < SHORT_CALL_WORDS, "short").otherwise("regular")
    )
    kind = F.when(case.isin("voicemail", "ivr_only"), "re_engagement").when(case.isin("very_negative", "cancellation"), "problem_solving").otherwise("general_follow_up")
    return F.struct(
        case.alias("case"), kind.alias("email_type"), F.when(case == "very_negative", "empathetic").otherwise("professional").alias("tone"),
        (~case.isin("voicemail", "ivr_only", "short")).alias("data_sufficient"),
    )


def fill_email(route: Column, name: Column) -> Column:
    who = F.coalesce(name, F.lit("there"))
    body = F.when(route["case"] == "voicemail", "Sorry I missed you.").when(route["case"] == "very_negative", "I am sorry about your experience.").otherwise("Thank you for your time.")
    return F.format_string("Hi %s,\n\n%s\n\nWould a short call this week suit you?\n\nBest regards", who, body)


def due_date(calldate: Column, relative: Column) -> Column:
    """Date from the call date and a phrase such as ``3 days`` or ``next week``.

    Without a phrase it is one business day; weekends are skipped.
    """
    text = F.lower(F.coalesce(relative, F.lit("1 business day")))
    n = F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(1))
    day = F.to_date(calldate)
    weekday = F.weekday(day)  # Monday is 0
    base = F.least(weekday, F.lit(4))  # a weekend counts from its Friday
    friday = F.date_sub(day, weekday - base)
    business = F.date_add(friday, n + 2 * F.floor((base + n) / 5).cast("int"))
    return (
        F.when(text.contains("business"), business).when(text.contains("tomorrow"), F.date_add(day, 1)).when(text.contains("next week"), F.date_add(day, 7))
        .when(text.contains("week"), F.date_add(day, n * 7)).when(text.contains("month"), F.add_months(day, n)).when(text.contains("day"), F.date_add(day, n)).otherwise(business)
    )


def entities(text: Column) -> Column:
    def every(p: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0))

    return F.struct(every(EMAIL).alias("emails"), every(PHONE).alias("phones"), every(DATE).alias("dates"), every(AMOUNT).alias("amounts"))


def risk_rollup(documents: DataFrame, by: list[str]) -> DataFrame:
    """Calls, high risk, flags and negative sentiment per group and in total."""
    return documents.rollup(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("risk_level") == "High").alias("high_risk"),
        F.count_if(F.col("fraud_detected")).alias("fraud"), F.count_if(F.col("category").isin("Negative", "Very Negative")).alias("negative"),
    )


def score_rollup(scores: DataFrame) -> DataFrame:
    """Average points and share of cap per metric, and totals that do not add up."""
    s, caps = F.col("s"), records.SCORE_CAPS
    good = scores.where(s["overall_score"] >= 0)
    total = sum(s["metrics"][m] for m in caps)
    return good.agg(
        F.count(F.lit(1)).alias("scored"), *[F.avg(s["metrics"][m]).alias(m) for m in caps],
        *[(F.avg(s["metrics"][m]) / cap).alias(f"{m}_share") for m, cap in caps.items()], F.count_if(total != s["overall_score"]).alias("mismatched"),
    )
