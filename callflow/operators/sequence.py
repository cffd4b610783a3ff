"""Ordered per-key computation that does not need a whole key in one task.

A call (or an API key) may hold a large share of all rows, so a window
partitioned by the key alone would put that share into one task. Everything
here works in two levels instead: rows are partitioned by ``(key, block)``,
where ``block`` is a value that never decreases along the order (an index
divided by a block size, a chunk number, a time bucket). Each block yields one
summary row; the window over a whole key only ever sees summaries, and their
result joins back on ``(key, block)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.session import durable

BLOCK_ROWS = 65536

_B = "_block"


def index_block(index: str | Column, size: int = BLOCK_ROWS) -> Column:
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(size)).cast("long")


def _local(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys, _B).orderBy(*order)


def _blocks(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(_B)


def _up_to_now(window):
    return window.rowsBetween(W.unboundedPreceding, W.currentRow)


def _place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``."""
    rows = df.withColumn(_B, block).withColumn("_v", value)
    sums = rows.groupBy(*keys, _B).agg(F.sum("_v").alias("_total"))
    before = sums.withColumn(
        "_before", F.sum("_total").over(_up_to_now(_blocks(keys))) - F.col("_total")
    ).drop("_total")
    return (
        rows.join(before, [*keys, _B])
        .withColumn(out, F.sum("_v").over(_up_to_now(_local(keys, order))) + F.col("_before"))
        .drop(_B, "_v", "_before")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Largest ``value`` so far along ``order`` within ``keys``, the row's own counted if ``inclusive``."""
    rows = df.withColumn(_B, block).withColumn("_v", value)
    tops = rows.groupBy(*keys, _B).agg(F.max("_v").alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(_blocks(keys).rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    here = F.max("_v").over(_local(keys, order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    return rows.join(before, [*keys, _B]).withColumn(out, F.greatest(here, "_before")).drop(_B, "_v", "_before")


def dealt(df: DataFrame, order: Sequence[str | Column], out: str = "_dealt") -> DataFrame:
    """Deal rows into ranges of about equal size along ``order``; ``out`` numbers the range of each row.

    A key that holds a third of all rows fills a third of the ranges, however
    short the time it took, if ``order`` tells its rows apart. The number never
    decreases along ``order``, so it serves as a block.
    """
    return durable(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id().cast("long")))


def order_numbers(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Place of each row, from one, in a total order of the whole table.

    Only the sizes of the ranges, a row each, meet in one task.
    """
    rows = dealt(df, order, _B)
    sizes = rows.groupBy(_B).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(_B, (F.sum("_size").over(W.orderBy(_B).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")).alias("_before"))
    return rows.join(before, _B).withColumn(out, F.row_number().over(W.partitionBy(_B).orderBy(*order)) + F.col("_before")).drop(_B, "_before")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str
) -> DataFrame:
    """Dense zero-based position along ``order`` within ``keys``."""
    one = running_sum(df, keys, order, block, F.lit(1).cast("long"), out)
    return one.withColumn(out, F.col(out) - 1)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` from the adjacent rows of the key.

    ``has_prev`` and ``has_next`` tell a missing neighbour from a null value.
    """
    rows = df.withColumn(_B, block)
    back = F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in previous])
    fore = F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in following])
    ends = rows.groupBy(*keys, _B).agg(
        F.max_by(back, _place(order)).alias("_last"), F.min_by(fore, _place(order)).alias("_first")
    )
    over = _blocks(keys)
    carry = ends.select(
        *keys,
        _B,
        F.lag("_last").over(over).alias("_carry_back"),
        F.lead("_first").over(over).alias("_carry_fore"),
    )
    w = _local(keys, order)
    out = rows.join(carry, [*keys, _B])
    drop = [_B, "_carry_back", "_carry_fore"]
    if previous:
        out = out.withColumn("_back", F.coalesce(F.lag(back).over(w), F.col("_carry_back")))
        for c in previous:
            out = out.withColumn(f"prev_{c}", F.col("_back")[c])
        out = out.withColumn("has_prev", F.col("_back").isNotNull())
        drop.append("_back")
    if following:
        out = out.withColumn("_fore", F.coalesce(F.lead(fore).over(w), F.col("_carry_fore")))
        for c in following:
            out = out.withColumn(f"next_{c}", F.col("_fore")[c])
        out = out.withColumn("has_next", F.col("_fore").isNotNull())
        drop.append("_fore")
    return out.drop(*drop)


def label_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    label: str,
    out: str = "run_idx",
) -> DataFrame:
    """Number maximal runs of equal ``label`` along ``order``, from zero."""
    w = _local(keys, order)
    rows = (
        df.withColumn(_B, block)
        .withColumn(
            "_turn",
            F.when(F.row_number().over(w) == 1, 0)
            .when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0)
            .otherwise(1)
            .cast("long"),
        )
        .withColumn("_step", F.sum("_turn").over(_up_to_now(w)))
    )
    ends = rows.groupBy(*keys, _B).agg(
        F.min_by(F.struct(label), _place(order)).alias("_first"),
        F.max_by(F.struct(label), _place(order)).alias("_last"),
        F.max("_step").alias("_steps"),
    )
    over = _blocks(keys)
    joins = ends.withColumn("_before", F.lag("_last").over(over)).withColumn(
        "_joint",
        F.when(F.col("_before").isNull(), 0)
        .when(F.col("_before").eqNullSafe(F.col("_first")), 0)
        .otherwise(1),
    )
    carry = joins.select(
        *keys,
        _B,
        (F.sum(F.col("_steps") + F.col("_joint")).over(_up_to_now(over)) - F.col("_steps")).alias("_base"),
    )
    return (
        rows.join(carry, [*keys, _B])
        .withColumn(out, (F.col("_step") + F.col("_base")).cast("long"))
        .drop(_B, "_turn", "_step", "_base")
    )


def join_texts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    separator: str = " ",
    out: str = "text",
) -> DataFrame:
    """Concatenate texts in order, one row per key."""
    rows = df.select(*keys, *order, text.alias("_text"))
    return (
        rows.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, F.col("_text")))).alias("_rows"))
        .select(*keys, F.array_join(F.col("_rows")["_text"], separator).alias(out))
    )
