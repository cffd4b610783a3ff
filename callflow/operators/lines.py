"""Transcript text from words: pieces, lines and whole documents.

Words are gathered in pieces of at most two ``PIECE_WORDS`` blocks. A line that
runs across pieces is put together again from its fragments, so pieces never
show in the result: a line is as long as the rule says, whatever its run's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.operators.sequence import join_texts
from callflow.session import durable

PIECE_WORDS = 4096
LINE_WORDS = 8
STATES = LINE_WORDS + 2  # words in the open line: 0 … 8, and "more than 8"


def run_pieces(words: DataFrame) -> DataFrame:
    """Words grouped per run: ordered texts in bounded pieces.

    Blocks of a run meet its ends by ``(call_id, run_idx, block)``, so that a run
    of many blocks is never in one task.
    """
    item = F.struct("word_idx", "text")
    run = ["call_id", "run_idx"]
    blocks = words.groupBy(*run, F.floor(F.col("word_idx") / PIECE_WORDS).alias("_block")).agg(
        F.min("speaker").alias("speaker"), F.array_sort(F.collect_list(item)).alias("_items"), F.min("word_idx").alias("_from")
    )
    narrow = words.groupBy(*run, F.floor(F.col("word_idx") / PIECE_WORDS).alias("_block")).agg(F.min("word_idx").alias("_from"))
    ends = narrow.groupBy(*run).agg(F.min("_from").alias("first_idx"), F.max("_from").alias("_to"), F.collect_list("_block").alias("_blocks"))
    spread = ends.select(*run, "first_idx", "_to", F.explode("_blocks").alias("_block"))
    piece = lambda at: F.floor((F.col(at) - F.col("first_idx")) / PIECE_WORDS)
    placed = blocks.join(spread, [*run, "_block"]).withColumn("piece", piece("_from")).withColumn("last_piece", piece("_to"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_from", F.col("_items")["text"].alias("texts")))), lambda b: b["texts"])
    return (
        placed.groupBy(*run, "piece")
        .agg(F.min("speaker").alias("speaker"), F.min("first_idx").alias("first_idx"), F.min("last_piece").alias("last_piece"), F.min("_from").alias("from_idx"), F.flatten(texts).alias("texts"))
        .select(*run, "speaker", "first_idx", "piece", "last_piece", "from_idx", "texts")
    )


def stretch_pieces(parts: DataFrame) -> DataFrame:
    """The same from stretches of words that know where their run begins and ends (``run_from``, ``run_to``)."""
    piece = lambda at: F.floor((F.col(at) - F.col("run_from")) / PIECE_WORDS)
    texts = F.array_sort(F.collect_list(F.struct("first_idx", F.col("items")["text"].alias("texts"))))
    return (
        parts.groupBy("call_id", "run_idx", piece("first_idx").alias("piece"))
        .agg(F.min("speaker").alias("speaker"), F.min("run_from").alias("_run_from"), F.max(piece("run_to")).alias("last_piece"), F.min("first_idx").alias("from_idx"), F.flatten(F.transform(texts, lambda p: p["texts"])).alias("texts"))
        .select("call_id", "run_idx", "speaker", F.col("_run_from").alias("first_idx"), "piece", "last_piece", "from_idx", "texts")
    )


def _labelled(line):
    return F.concat(F.lit("["), F.col("speaker"), F.lit("] "), line)


def plain_lines(pieces: DataFrame) -> DataFrame:
    """One line per run: ``[speaker] words``."""
    text = F.struct("piece", F.array_join("texts", " ").alias("text"))
    runs = pieces.groupBy("call_id", "run_idx", "speaker").agg(F.array_sort(F.collect_list(text)).alias("_texts"), F.min("from_idx").alias("from_idx"))
    return runs.select("call_id", "run_idx", "speaker", "from_idx", _labelled(F.array_join(F.col("_texts")["text"], " ")).alias("line"))


def _ends(text):
    return text.rlike(r"[.?!]$")


def _stops(texts):
    """Places, from one, of the words that end a sentence."""
    return F.array_compact(F.transform(texts, lambda t, i: F.when(_ends(t), i + 1)))


def _transfer(texts):
    """For each state at the start of a piece, the state at its end and the lines closed in it.

    Only sentence ends are walked along; ``last`` is where the open line starts,
    before the piece if words came in with it.
    """
    states = F.array(*[F.struct(F.lit(-s).alias("last"), F.lit(0).alias("closed")) for s in range(STATES)])

    def step(acc, at):
        return F.transform(acc, lambda s: F.when(at - s["last"] > LINE_WORDS, F.struct(at.alias("last"), (s["closed"] + 1).alias("closed"))).otherwise(s))

    ended = lambda s: F.struct(F.least(F.size(texts) - s["last"], F.lit(STATES - 1)).alias("state"), s["closed"].alias("closed"))
    return F.aggregate(_stops(texts), states, step, lambda acc: F.transform(acc, ended))


def _fold(texts, open_words):
    """Lines of a piece that starts ``open_words`` into a line; the last one may stay open."""
    seed = F.struct((-open_words).alias("last"), F.array().cast("array<int>").alias("ends"))
    step = lambda acc, at: F.when(
        at - acc["last"] > LINE_WORDS, F.struct(at.alias("last"), F.array_append(acc["ends"], at).alias("ends"))
    ).otherwise(acc)
    ends = F.aggregate(_stops(texts), seed, step, lambda acc: F.when(acc["last"] < F.size(texts), F.array_append(acc["ends"], F.size(texts))).otherwise(acc["ends"]))
    spans = lambda ends: F.zip_with(F.concat(F.array(F.lit(0)), ends), ends, lambda a, z: F.when(z.isNotNull(), F.slice(texts, a + 1, z - a)))
    return F.array_compact(F.get(F.transform(F.array(ends), spans), F.lit(0)))


def _entries(pieces: DataFrame) -> DataFrame:
    """How each piece of a run of several starts: words in the open line, and that line's number."""
    moves = (
        pieces.select("call_id", "run_idx", F.struct("piece", _transfer(F.col("texts")).alias("move")).alias("m"))
        .groupBy("call_id", "run_idx")
        .agg(F.array_sort(F.collect_list("m")).alias("moves"))
    )
    at = lambda state, closed: F.struct(state.alias("state"), closed.alias("closed"))
    seed = F.struct(at(F.lit(0), F.lit(0)).alias("now"), F.array().cast("array<struct<state:int,closed:int>>").alias("starts"))

    def step(acc, m):
        move = F.get(m["move"], acc["now"]["state"])
        return F.struct(
            at(move["state"], acc["now"]["closed"] + move["closed"]).alias("now"), F.array_append(acc["starts"], acc["now"]).alias("starts")
        )

    starts = F.aggregate("moves", seed, step, lambda acc: acc["starts"])
    entry = F.explode(F.arrays_zip(F.col("moves")["piece"].alias("piece"), starts.alias("start"))).alias("e")
    return moves.select("call_id", "run_idx", entry).select(
        "call_id", "run_idx", F.col("e.piece").alias("piece"), F.col("e.start.state").alias("open_words"), F.col("e.start.closed").alias("first_line")
    )


def sentence_lines(pieces: DataFrame) -> DataFrame:
    """Lines per run: a line closes after a sentence end past eight words.

    The rule is a small state machine (words in the open line), so a run of
    several pieces composes their transitions to know how each one starts, and
    fragments of a line that crosses a border join by the line's number. Runs of
    a single piece need neither.
    """
    pieces = durable(pieces)
    text = F.array_join("_line", " ")
    single = pieces.where("last_piece = 0").withColumn("_f", _fold(F.col("texts"), F.lit(0)))
    short = single.select("call_id", "run_idx", "speaker", "from_idx", F.posexplode("_f").alias("line_idx", "_line")).select(
        "call_id", "run_idx", "line_idx", "speaker", "from_idx", text.alias("text")
    )
    several = pieces.where("last_piece > 0")
    split = several.join(_entries(several), ["call_id", "run_idx", "piece"]).withColumn("_f", _fold(F.col("texts"), F.col("open_words")))
    fragments = split.select(
        "call_id", "run_idx", "piece", "speaker", "from_idx", "first_line", F.posexplode("_f").alias("_at", "_line")
    ).withColumn("line_idx", F.col("first_line") + F.col("_at"))
    whole = fragments.groupBy("call_id", "run_idx", "line_idx").agg(
        F.min("speaker").alias("speaker"), F.min("from_idx").alias("from_idx"), F.array_sort(F.collect_list(F.struct("piece", text.alias("text")))).alias("_texts")
    )
    long = whole.select("call_id", "run_idx", "line_idx", "speaker", "from_idx", F.array_join(F.col("_texts")["text"], " ").alias("text"))
    return short.unionByName(long).select("call_id", "run_idx", "line_idx", "speaker", "from_idx", _labelled(F.col("text")).alias("line"))


def documents(lines: DataFrame, order: tuple[str, ...] = ("run_idx", "line_idx")) -> DataFrame:
    """Whole labelled transcripts, one row per call; a call is at most five hours of speech."""
    have = [c for c in order if c in lines.columns]
    return join_texts(lines, ["call_id"], have, F.col("line"), "\n", "transcript")


def raw_transcript(chunks: DataFrame) -> DataFrame:
    """Chunk texts joined by a space in chunk order."""
    return join_texts(chunks, ["call_id"], ["chunk_idx"], F.col("text"), " ", "raw_text")


def first_lines(lines: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` lines of every call, numbered from zero.

    Each partition keeps its own first candidates before the final ranking, so
    the ranking never sees a whole call.
    """
    order = [c for c in ("run_idx", "line_idx") if c in lines.columns]
    block = F.floor(F.col("run_idx") / 64)
    w0 = W.partitionBy("call_id", "_b").orderBy(*order)
    w1 = W.partitionBy("call_id").orderBy(*order)
    near = lines.withColumn("_b", block).withColumn("_r", F.row_number().over(w0)).where(F.col("_r") <= n)
    return (
        near.where(F.col("_b") <= n // 64)  # 64 runs give at least 64 lines, so later blocks are past the first n
        .withColumn("line_no", F.row_number().over(w1) - 1)
        .where(F.col("line_no") < n)
        .drop("_b", "_r")
    )
