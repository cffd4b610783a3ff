"""Agent / Customer / IVR roles per speaker, as rows keyed by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.functions import lexicons as lx
from callflow.operators.sequence import index_block, running_sum

# Role names and thresholds.
VALID = ["Agent", "Customer", "Agent_2"]
SAMPLE_LINES = 30
IVR_MAX_LINES = 2
IVR_MIN_CHARS = 10
IVR_SHARE = 0.8


def parse_lines(transcripts: DataFrame) -> DataFrame:
    """Rows (call_id, line_no, speaker, text) of ``[label] text`` documents."""
    rows = transcripts.select("call_id", F.posexplode(F.split("transcript", "\n")).alias("line_no", "line"))
    label = F.regexp_extract("line", r"^\[([^\]]+)\]\s*(.*)$", 1)
    return rows.select(
        "call_id", F.col("line_no").cast("long").alias("line_no"), F.nullif(label, F.lit("")).alias("speaker"),
        F.when(label != "", F.trim(F.regexp_extract("line", r"^\[([^\]]+)\]\s*(.*)$", 2))).otherwise(F.col("line")).alias("text"),
    )


def speaker_signals(sample: DataFrame) -> DataFrame:
    """Per speaker: order of appearance and what the sample lines contain.

    Phrases are tested on a speaker's lines joined in order, so that they may run
    over a line break; hits are lines with a phrase and phrases over a break.
    ``sample`` has a few lines a call (``SAMPLE_LINES``), whose text is collected.
    """
    lines = F.array_sort(F.collect_list(F.struct("line_no", F.trim("text").alias("text"))))["text"]

    def seen(phrases: list[str]) -> Column:
        return lx.mentions(F.array_join("_lines", " "), phrases)

    def over_breaks(phrases: list[str]) -> Column:
        found = F.regexp_extract_all(F.lower(F.array_join("_lines", "\n")), F.lit(lx.pattern(phrases).replace(" ", "[ \n]")), F.lit(0))
        return F.size(F.filter(found, lambda m: m.contains("\n")))

    per = sample.where(F.col("speaker").isNotNull()).groupBy("call_id", "speaker").agg(
        F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("n_lines"),
        *[F.sum(lx.mentions(F.col("text"), p).cast("int")).alias(f"{r.lower()}_hits") for r, p in lx.ROLE_RULES.items()],
        lines.alias("_lines"),
    )
    per = per.select(
        "call_id", "speaker", "first_line", "n_lines", seen(lx.IVR_SPEAKER_PHRASES).alias("ivr_phrase"),
        seen(lx.CUSTOMER_PHRASES).alias("customer_signal"), seen(lx.AGENT_PHRASES).alias("agent_signal"),
        *[(F.col(f"{r.lower()}_hits") + over_breaks(p)).alias(f"{r.lower()}_hits") for r, p in lx.ROLE_RULES.items()],
    )
    order = F.row_number().over(W.partitionBy("call_id").orderBy("first_line")) - 1
    return per.withColumn("place", order)


def fallback_roles(signals: DataFrame) -> DataFrame:
    return signals.withColumn("role", F.when(F.col("place") == 1, "Customer").otherwise("Agent"))


def rule_roles(signals: DataFrame) -> DataFrame:
    """Role by the phrases a speaker used most; undecided ones by order."""
    return signals.withColumn(
        "role",
        F.when(F.col("customer_hits") > F.col("agent_hits"), "Customer")
        .when(F.col("agent_hits") > F.col("customer_hits"), "Agent")
        .otherwise(F.when(F.col("place") == 1, "Customer").otherwise("Agent")),
    )


def validate_roles(signals: DataFrame) -> DataFrame:
    """Make one Customer and the rest Agents, swapping on clear contradictions.

    Windows run over the distinct speakers of a call.
    """
    call = W.partitionBy("call_id")
    rows = signals.withColumn("role", F.when(F.col("role").isin(VALID), F.col("role")).otherwise("Agent"))
    human = ~(F.col("ivr_phrase") & (F.col("n_lines") <= IVR_MAX_LINES))
    rows = rows.withColumn("_human", human)

    def first(role: str, what: Column) -> Column:
        return F.min(F.when(F.col("_human") & (F.col("role") == role), what)).over(call)

    place = F.col("place")
    rows = (
        rows.withColumn("_agent", first("Agent", place))
        .withColumn("_customer", first("Customer", place))
        .withColumn("_humans", F.count_if("_human").over(call))
        .withColumn("_speakers", F.count(F.lit(1)).over(call))
    )
    rows = rows.withColumn("_contra", F.max((place == F.col("_agent")) & F.col("customer_signal")).over(call)).withColumn(
        "_contra2", F.max((place == F.col("_customer")) & F.col("agent_signal")).over(call)
    )
    swap = (
        (F.col("_speakers") >= 2) & (F.col("_humans") >= 2) & F.coalesce(F.col("_contra"), F.lit(False)) & F.coalesce(F.col("_contra2"), F.lit(False))
    )
    role = (
        F.when(swap & (place == F.col("_agent")), "Customer").when(swap & (place == F.col("_customer")), "Agent").otherwise(F.col("role"))
    )
    rows = rows.withColumn("role", role)
    rows = rows.withColumn("_n_customer", F.count_if(F.col("role") == "Customer").over(call)).withColumn(
        "_first_customer", F.min(F.when(F.col("role") == "Customer", place)).over(call)
    )
    final = (
        F.when((F.col("_n_customer") == 0) & (F.col("_speakers") > 1) & (place == 1), "Customer")
        .when((F.col("role") == "Customer") & (place > F.col("_first_customer")), "Agent")
        .when(F.col("role") == "Agent_2", "Agent")
        .otherwise(F.col("role"))
    )
    return rows.withColumn("role", final).select("call_id", "speaker", "place", "role")


def ivr_prefix(words: DataFrame, announcements: DataFrame) -> DataFrame:
    """Index of the last word of the announcement at the start of a call.

    Shortest prefix of the call's words that contains the announcement, or
    that has at least as many words and shares 80 % of its distinct words.
    ``announcements`` is (call_id, ivr_text) with more than ten characters.
    Word counts replace growing prefix strings: a prefix shares w distinct
    words once w first occurrences lie in it, and contains the announcement
    once its words stand in sequence.
    """
    texts = announcements.where(F.length(F.trim("ivr_text")) > IVR_MIN_CHARS).select(
        "call_id", F.filter(F.split(F.lower(F.trim("ivr_text")), r"\s+"), lambda w: w != "").alias("ivr")
    )
    said = words.select("call_id", "word_idx", F.lower("text").alias("w"))
    sizes = texts.select("call_id", F.size("ivr").alias("n"), F.size(F.array_distinct("ivr")).alias("d"))
    # a word inside the announcement stands alone in it and must be equal; only its first and last word may be part of a longer one
    inner = texts.select("call_id", F.size("ivr").alias("n"), F.posexplode("ivr").alias("j", "w")).where("j > 0 AND j < n - 1")
    middle = said.join(inner, ["call_id", "w"]).select("call_id", "word_idx", "n", "j")
    outer = texts.select("call_id", F.size("ivr").alias("n"), F.element_at("ivr", 1).alias("head"), F.element_at("ivr", -1).alias("tail"))
    sides = said.join(outer, "call_id")
    alone = sides.where((F.col("n") == 1) & F.col("w").contains(F.col("head"))).select("call_id", "word_idx", "n", F.lit(0).alias("j"))
    first = sides.where((F.col("n") > 1) & F.col("w").endswith(F.col("head"))).select("call_id", "word_idx", "n", F.lit(0).alias("j"))
    final = sides.where((F.col("n") > 1) & F.col("w").startswith(F.col("tail"))).select("call_id", "word_idx", "n", (F.col("n") - 1).alias("j"))
    spots = middle.unionByName(alone).unionByName(first).unionByName(final)
    # words of one placement share word_idx − j
    whole = (
        spots.groupBy("call_id", (F.col("word_idx") - F.col("j")).alias("start"), "n").agg(F.count(F.lit(1)).alias("hits"))
        .where("hits = n").groupBy("call_id").agg(F.min(F.col("start") + F.col("n") - 1).alias("whole_idx"))
    )
    kinds = texts.select("call_id", F.explode(F.array_distinct("ivr")).alias("w")).join(sizes, "call_id")
    new = said.join(kinds, ["call_id", "w"]).groupBy("call_id", "w", "n", "d").agg(F.min("word_idx").alias("word_idx"))
    counted = running_sum(new, ["call_id"], ["word_idx"], index_block("word_idx"), F.lit(1), "shared")
    shared = (
        counted.where(F.col("shared") / F.col("d") >= IVR_SHARE).groupBy("call_id")
        .agg(F.min(F.greatest(F.col("word_idx"), F.col("n") - 1)).alias("shared_idx"))
    )
    last = words.groupBy("call_id").agg(F.max("word_idx").alias("_last"))
    return (
        texts.select("call_id").join(whole, "call_id", "left").join(shared, "call_id", "left").join(last, "call_id")
        .select("call_id", F.least("whole_idx", "shared_idx").alias("ivr_end"), "_last")
        .where(F.col("ivr_end").isNotNull() & (F.col("ivr_end") <= F.col("_last"))).drop("_last")
    )


def apply_roles(words: DataFrame, roles: DataFrame, ivr_end: DataFrame | None = None) -> DataFrame:
    """Words with their role as speaker; the announcement prefix becomes IVR.

    A label missing from the map takes the role of the first mapped label that
    contains it or is contained in it.
    """
    out = words
    if ivr_end is not None:
        out = out.join(ivr_end, "call_id", "left")
    else:
        out = out.withColumn("ivr_end", F.lit(None).cast("long"))
    # one row per call: its few speakers and their roles
    maps = roles.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "role"))).alias("_roles"))
    exact = F.filter("_roles", lambda r: r["speaker"] == F.col("speaker"))
    near = F.filter("_roles", lambda r: F.col("speaker").contains(r["speaker"]) | r["speaker"].contains(F.col("speaker")))
    role = F.coalesce(F.get(exact, F.lit(0))["role"], F.get(near, F.lit(0))["role"], F.col("speaker"))
    marked = F.coalesce(F.col("word_idx") <= F.col("ivr_end"), F.lit(False))
    return (
        out.join(maps, "call_id", "left")
        .withColumn("original_speaker", F.when(marked, F.col("speaker")))
        .withColumn("speaker", F.when(marked | (F.col("speaker") == "IVR"), "IVR").otherwise(role))
        .drop("_roles", "ivr_end")
    )


def relabel_text(parsed: DataFrame, roles: DataFrame, announcements: DataFrame | None = None) -> DataFrame:
    """Lines with roles put in; the first line like the announcement is IVR."""
    named = parsed.join(roles.select("call_id", "speaker", "role"), ["call_id", "speaker"], "left")
    if announcements is None:
        hit = F.lit(False)
    else:
        named = named.join(announcements.select("call_id", "ivr_text"), "call_id", "left")
        like = named.where(F.col("speaker").isNotNull() & lx.matches_announcement(F.col("text"), F.col("ivr_text")))
        first = like.groupBy("call_id").agg(F.min("line_no").alias("_ivr_line"))
        named = named.join(first, "call_id", "left")
        hit = F.coalesce(F.col("line_no") == F.col("_ivr_line"), F.lit(False))
    label = F.when(hit, "IVR").otherwise(F.coalesce("role", "speaker"))
    return named.select(
        "call_id", "line_no",
        F.when(F.col("speaker").isNull(), F.col("text")).otherwise(F.concat(F.lit("["), label, F.lit("] "), F.col("text"))).alias("line"),
    )
