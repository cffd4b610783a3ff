"""What the operators of this subpackage share: white space, row ids, shared files, columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callflow.session import prepare

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor repeats the read, not the work, and
    unlike ``checkpoint()`` the columns stay compressed and can be pruned.
    """
    folder = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def only(df: DataFrame, *names: str) -> list[Column]:
    """The named columns by resolved reference, whatever else the table holds."""
    return [df[n].alias(n) for n in names]


def documents(df: DataFrame, *names: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and further named columns, nothing else."""
    return df.select(df["doc_id"].alias("doc_id"), F.coalesce(df["text"], F.lit("")).alias("text"), *only(df, *names))


def row_id(df: DataFrame) -> Column:
    """Digest of id and text; only rows that agree in both share it."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(df["doc_id"].cast("string"), F.lit("?")), F.coalesce(df["text"], F.lit("")))))


def rows_of(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose row id is in the column rid of ``rids``; repeated rows once."""
    marked = docs.withColumn("_llm_rid", row_id(docs))
    return marked.join(rids.select(F.col("rid").alias("_llm_rid")), "_llm_rid", "left_semi").dropDuplicates(["_llm_rid"]).drop("_llm_rid")
