"""Sentence lines of long runs: the rule on a word after the other, and time that follows the words."""

import random
import time

from pyspark.sql import functions as F

from callflow.operators import lines


def plain(texts):
    out, line = [], []
    for t in texts:
        line.append(t)
        if t[-1] in ".?!" and len(line) > lines.LINE_WORDS:
            out, line = [*out, line], []
    return [" ".join(x) for x in [*out, *([line] if line else [])]]


def test_lines_across_pieces_follow_the_rule(spark):
    rng = random.Random(5)
    runs = [[rng.choice(["w", "w", "w", "w", "x.", "y?"]) if k % 3 else "w" for _ in range(n)] for k, n in enumerate((3, 4096, 4097, 9000, 12288, 20001))]
    words = spark.createDataFrame([(0, k, i, t) for k, texts in enumerate(runs) for i, t in enumerate(texts)], "call_id long, run_idx long, word_idx long, text string")
    got = lines.sentence_lines(lines.run_pieces(words.withColumn("speaker", F.lit("s")))).orderBy("run_idx", "line_idx").collect()
    assert [(r.run_idx, r.line_idx, r.line) for r in got] == [(k, i, f"[s] {x}") for k, texts in enumerate(runs) for i, x in enumerate(plain(texts))]


def test_a_piece_without_sentence_end_takes_linear_time(spark):
    piece = spark.range(0, 800, 1, 8).select(F.transform(F.sequence(F.lit(0), F.lit(8191)), lambda i: F.concat(F.lit("w"), (F.col("id") + i).cast("string"))).alias("texts"))
    began = time.time()
    assert piece.select(F.sum(F.size(lines._fold(F.col("texts"), F.lit(0))))).first()[0] == 800
    assert time.time() - began < 15


def test_pieces_of_a_run_lie_in_many_tasks(spark):
    words = spark.range(0, 20 * lines.PIECE_WORDS, 1, 4).select(F.lit(7).cast("long").alias("call_id"), F.lit(0).cast("long").alias("run_idx"), F.col("id").alias("word_idx"), F.lit("w").alias("text"), F.lit("s").alias("speaker"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        pieces = lines.run_pieces(words)
        assert pieces.count() == 20
        assert pieces.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
