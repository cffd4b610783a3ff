"""Predicted against actual labels: confusion, accuracy, per-class scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordinal levels, and a spelling found in label files.
LEVELS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
SPELLING = {"Postive": "Positive"}


def clean_label(label: Column) -> Column:
    tidy = F.initcap(F.lower(F.trim(label)))
    for wrong, right in SPELLING.items():
        tidy = F.when(tidy == wrong, right).otherwise(tidy)
    return tidy


def clean_labels(rows: DataFrame) -> DataFrame:
    """Rows whose predicted and actual label are both one of the levels."""
    out = rows.withColumn("predicted", clean_label(F.col("predicted"))).withColumn("actual", clean_label(F.col("actual")))
    return out.where(F.col("predicted").isin(LEVELS) & F.col("actual").isin(LEVELS))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts per (actual, predicted); everything else derives from this table."""
    return rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(cells: DataFrame) -> DataFrame:
    return cells.groupBy("actual").pivot("predicted", LEVELS).agg(F.sum("n")).na.fill(0)


def level_index(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), label)


def accuracy(cells: DataFrame) -> DataFrame:
    n, near = F.col("n"), F.abs(level_index(F.col("actual")) - level_index(F.col("predicted"))) <= 1
    return cells.agg(
        F.sum("n").alias("total"),
        (F.sum(F.when(F.col("actual") == F.col("predicted"), n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        (F.sum(F.when(near, n).otherwise(0)) / F.sum(n)).alias("adjacent_accuracy"),
    )


def class_scores(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label present; 0 for 0/0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    precision = F.coalesce(F.col("tp") / F.nullif("claimed", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), "support").select(
        "label",
        "precision",
        "recall",
        F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)).alias("f1"),
        "support",
    )


def averages(scores: DataFrame) -> DataFrame:
    names = ["precision", "recall", "f1"]
    return scores.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in names],
    )


def distributions(cells: DataFrame) -> DataFrame:
    both = cells.select("n", F.explode(F.array(F.struct(F.lit("actual").alias("side"), F.col("actual").alias("label")), F.struct(F.lit("predicted").alias("side"), F.col("predicted").alias("label")))).alias("s"))
    return both.groupBy("s.side", "s.label").agg(F.sum("n").alias("n"))
