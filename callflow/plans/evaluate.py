"""Evaluation of predicted labels: one pass over the rows, then small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.operators import evaluation as ev


def evaluate(labels: DataFrame) -> dict[str, DataFrame]:
    cells = ev.confusion(ev.clean_labels(labels))
    scores = ev.class_scores(cells)
    return {
        "confusion": ev.confusion_matrix(cells),
        "accuracy": ev.accuracy(cells),
        "classes": scores,
        "averages": ev.averages(scores),
        "distributions": ev.distributions(cells),
    }


def report(labels: DataFrame) -> DataFrame:
    """All figures in long form: section, label, metric, value."""
    parts = evaluate(labels)

    def long(df: DataFrame, section: str, label, metrics: list[str]) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), label.alias("label"), rows.alias("r")).select("section", "label", "r.metric", "r.value")

    every = F.lit("all")
    return (
        long(parts["accuracy"], "overall", every, ["total", "accuracy", "adjacent_accuracy"])
        .unionByName(long(parts["classes"], "class", F.col("label"), ["precision", "recall", "f1", "support"]))
        .unionByName(long(parts["averages"], "average", every, [f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]))
        .unionByName(long(parts["distributions"].withColumn("label", F.concat_ws(":", "side", "label")), "distribution", F.col("label"), ["n"]))
    )
