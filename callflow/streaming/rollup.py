"""Rollups that follow changing rows: counts, means and quantiles per group, kept by differences.

Every row (a job, a call) contributes one value to one group. What each row
contributes is kept by its id with a digest; a batch is compared with that, and
only new and changed rows make a difference: what they gave before is taken
back, what they give now is added. Differences are sums per (group, bin), where
bins grow by a constant ratio, so they merge in any order and batches leave the
same state as one full run. A quantile is read off the bins and is off by at
most ``ERROR`` of its value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callflow.session import durable
from callflow.streaming.keyed import BUCKETS, KeyedFolder

ERROR = 0.01
RATIO = (1 + ERROR) / (1 - ERROR)
#: Values below count as zero, in a bin of their own.
LEAST = 1e-9
ZERO_BIN = -(1 << 30)
#: Sums are of decimals, so what is taken back leaves nothing behind; values reach 10^15 and count to 12 places.
EXACT, TOTAL = "decimal(27,12)", "decimal(38,12)"


def value_bin(value: Column) -> Column:
    """Bin of a value from zero: the whole power of ``RATIO`` at or above it."""
    return F.when(value < LEAST, ZERO_BIN).otherwise(F.ceil(F.log(value) / F.lit(math.log(RATIO)))).cast("int")


def bin_value(number: Column) -> Column:
    """The value that is nearest to all of a bin, by ratio."""
    return F.when(number == ZERO_BIN, 0.0).otherwise(F.pow(F.lit(RATIO), number) * (2 / (RATIO + 1)))


class Rollup:
    """Rollup below ``path`` of rows (id, version, group, value); value null or group null: no contribution."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.rows = KeyedFolder(spark, f"{path}/rows", "id", lambda: F.col("version"), buckets)
        self.bins = KeyedFolder(spark, f"{path}/bins", "key", None, buckets, sums=("n", "total"))

    def newer(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch``, one an id, that are newer than what is kept, with what they gave before (``was``)."""
        known = self.rows.read()
        if known is None:
            return batch.withColumn("was", F.lit(None).cast("struct<group:string,value:double>")).withColumn("changed", F.lit(True))
        old = known.select("id", F.col("version").alias("_version"), F.col("digest").alias("_digest"), F.struct("group", "value").alias("was"))
        joined = batch.join(old, "id", "left").where(F.col("_version").isNull() | (F.col("version") > F.col("_version")))
        return joined.withColumn("changed", ~F.col("digest").eqNullSafe(F.col("_digest"))).drop("_version", "_digest")

    def differences(self, newer: DataFrame) -> DataFrame:
        """What changed rows change per (group, bin)."""
        parts = F.array(
            F.struct(F.col("group"), F.col("value"), F.lit(1).cast("long").alias("n")),
            F.struct(F.col("was.group").alias("group"), F.col("was.value").alias("value"), F.lit(-1).cast("long").alias("n")),
        )
        each = newer.where("changed").select(F.inline(parts)).where("group IS NOT NULL AND value IS NOT NULL").withColumn("bin", value_bin(F.col("value")))
        exact = F.col("value").cast(EXACT)
        sums = each.groupBy("group", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, exact).otherwise(-exact)).cast(TOTAL).alias("total"))
        return sums.select(F.concat_ws("\x00", "group", F.col("bin").cast("string")).alias("key"), "group", "bin", "n", "total")

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in one batch; one that was taken in before changes nothing.

        Of rows of one id the highest version counts, of equal versions in two
        batches the first. Sums are published before the rows, each with the
        batch's number: a repeat after a failure between the two finds the sums done.
        """
        if self.rows.committed(number):
            return
        digest = F.sha2(F.concat_ws("\x00", F.coalesce("group", F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit(""))), 256)
        newest = batch.groupBy("id").agg(F.max_by(F.struct("version", "group", "value"), "version").alias("_row")).select("id", "_row.*")
        typed = newest.withColumn("group", F.col("group").cast("string")).withColumn("value", F.col("value").cast("double"))
        newer = durable(self.newer(typed.withColumn("digest", digest)))
        if not self.bins.committed(number):
            self.bins.upsert(self.differences(newer), number)
        self.rows.upsert(newer.drop("was", "changed"), number)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Take in what has arrived on a stream of rows, and stop."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, quantile: float = 0.5) -> DataFrame | None:
        """group, n, mean, quantile and largest of every group that has rows; the last two within ``ERROR``."""
        bins = self.bins.read()
        if bins is None:
            return None
        held = bins.where("n > 0")
        along = W.partitionBy("group").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        whole = W.partitionBy("group")
        ranked = held.withColumn("_upto", F.sum("n").over(along)).withColumn("_n", F.sum("n").over(whole))
        return ranked.groupBy("group").agg(
            F.sum("n").alias("n"),
            (F.sum("total").cast("double") / F.sum("n")).alias("mean"),
            F.min(F.when(F.col("_upto") >= F.lit(quantile) * F.col("_n"), bin_value(F.col("bin")))).alias("quantile"),
            F.max(bin_value(F.col("bin"))).alias("largest"),
        )
