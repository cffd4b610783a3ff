"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "callflow", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone and make sure a checkpoint folder is known.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only where
    that is unset (tests, local runs) a temporary folder is used.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage where a frame feeds several branches.

    The rows go to the shared checkpoint folder once, so neither a second
    branch nor the loss of an executor repeats the joins above it.
    """
    prepare(df.sparkSession)
    return df.checkpoint()
