"""Roles for whole transcripts: sample, propose, validate, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.functions import lexicons as lx
from callflow.operators import lines, responses, roles, runs
from callflow.operators.sequence import index_block
from callflow.session import durable

STRETCH_WORDS = 1024
ANSWER = "has_ivr boolean, ivr_text string, speaker_roles map<string,string>"


def propose(sample: DataFrame, answers: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Roles per speaker from model answers (call_id, raw), else from rules."""
    signals = roles.speaker_signals(sample)
    if answers is None:
        return roles.rule_roles(signals), None
    # cut off, or the filters on an answer that follows from its call are run on every word of the call
    parsed = durable(answers.select("call_id", F.from_json(responses.role_object(F.col("raw")), ANSWER).alias("a")))
    given = signals.join(parsed, "call_id", "left").withColumn(
        "role",
        F.when(F.col("a").isNull(), F.when(F.col("place") == 1, "Customer").otherwise("Agent")).otherwise(
            F.coalesce(F.try_element_at(F.col("a.speaker_roles"), F.col("speaker")), F.lit("Agent"))
        ),
    )
    ivr = parsed.where(F.col("a.has_ivr") & lx.looks_like_ivr(F.col("a.ivr_text"))).select("call_id", F.col("a.ivr_text").alias("ivr_text"))
    return given.drop("a"), ivr


def label_roles(words: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Words with ``speaker`` replaced by Agent, Customer or IVR.

    ``words`` carry final speakers and ``run_idx``. Roles come from the first
    30 lines of each call; the text of the rest is not looked at. The sample, the
    announcements and the labels read the words, which are cut off from their
    runs here.
    """
    words = durable(words)
    pieces = lines.run_pieces(words)
    head = lines.first_lines(lines.sentence_lines(pieces.where(F.col("run_idx") < roles.SAMPLE_LINES)), roles.SAMPLE_LINES)
    sample = durable(
        head.select("call_id", F.col("line_no").cast("long").alias("line_no"), "speaker", F.regexp_replace("line", r"^\[[^\]]+\]\s*", "").alias("text"))
    )
    proposed, ivr = propose(sample, answers)
    final = roles.validate_roles(proposed)
    end = roles.ivr_prefix(words, ivr) if ivr is not None else None
    return roles.apply_roles(words, final, end)


def role_documents(labelled: DataFrame) -> DataFrame:
    """Transcripts with one line per turn of a role.

    ``labelled`` as from ``label_roles``: a role holds through a run, or from the
    end of the announcement on, so words are shuffled once, into stretches of a
    run, and turns follow from these.
    """
    item = F.struct("word_idx", "text")
    place = F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"), F.array_sort(F.collect_list(item)).alias("items")
    parts = durable(labelled.groupBy("call_id", F.col("run_idx").alias("heard_idx"), "speaker", index_block("word_idx", STRETCH_WORDS).alias("_part")).agg(*place).drop("_part"))
    turns = runs.label_runs(parts.drop("heard_idx"), runs.CALL, ["first_idx"], index_block("first_idx"), "speaker")
    ends = turns.groupBy("call_id", "run_idx").agg(F.min("first_idx").alias("run_from"), F.max("last_idx").alias("run_to"))
    return lines.documents(lines.plain_lines(lines.stretch_pieces(turns.join(ends, ["call_id", "run_idx"]))))
