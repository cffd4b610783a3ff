"""A folder that holds the newest row of every key, kept up to date by a stream.

Rows are dealt into buckets by the hash of their key. A batch rewrites only the
buckets it touches, into a folder of its own, and then publishes a manifest
that names the folder of every bucket. A manifest appears by one rename and
nothing it names changes later, so a reader always sees one whole version:
the one before or the one after a batch, never a mixture. Manifests hold the
number of their batch, so a batch that is repeated after its commit is skipped,
and one that failed before it is done anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeyedFolder:
    """One row of each ``key`` below ``path``.

    ``order`` tells which of two rows of a key is newer; with ``sums`` the named
    columns are added up instead.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Callable[[], Column] | None = None, buckets: int = BUCKETS, sums: Sequence[str] = ()):
        self.spark, self.path, self.key, self.order, self.buckets, self.sums = spark, path, key, order, buckets, sums

    def _merged(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in ("_bucket", "_part")]
        grouped = rows.groupBy(self.key, "_bucket", "_part")
        if self.sums:
            same = [F.first(c).alias(c) for c in names if c not in (self.key, *self.sums)]
            return grouped.agg(*same, *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in self.sums]).select("_bucket", *names)
        return grouped.agg(F.max_by(F.struct(*names), self.order()).alias("_row")).select("_bucket", "_row.*")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifest(self) -> dict | None:
        """The newest published version: its batch, schema and the folder of each bucket."""
        system, folder = self._files(f"{self.path}/manifests")
        if not system.exists(folder):
            return None
        names = sorted(x.getPath().getName() for x in system.listStatus(folder) if x.getPath().getName().endswith(".json"))
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def committed(self, batch: int) -> bool:
        version = self.manifest()
        return version is not None and version["batch"] >= batch

    def _publish(self, version: dict) -> None:
        system, draft = self._files(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        _, name = self._files(f"{self.path}/manifests/{version['batch']:020d}.json")
        if not system.rename(draft, name):
            raise OSError(f"batch {version['batch']} of {self.path} was published by another writer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_bucket`` dealt by parts of buckets, so that neither merging nor writing a bucket is one task."""
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return rows.withColumn("_part", F.pmod(F.hash(F.col(self.key)), F.lit(parts))).repartition("_bucket", "_part")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """Rows of the newest version, of some buckets only if asked; None before the first batch."""
        version = self.manifest()
        if version is None:
            return None
        folders = [f"{self.path}/{f}" for b, f in version["folders"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], version["schema"])
        return self.spark.read.schema(version["schema"]).parquet(*folders)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge one batch and publish it; False if it had been published before.

        Of the rows of a key, old and new, the one last in ``order`` stays, or
        their sums do.
        """
        before = self.manifest()
        if before is not None and before["batch"] >= batch:
            return False
        dealt = rows.withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())  # at most the number of buckets
        old = self.read(touched) if before is not None else None
        both = dealt if old is None else dealt.unionByName(old.withColumn("_bucket", self._bucket()), allowMissingColumns=True)
        newest = self._merged(self._spread(both))
        folder = f"data/{batch:020d}-{uuid.uuid4().hex}"
        newest.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = dict(before["folders"]) if before is not None else {}
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in newest.drop("_bucket").schema)
        self._publish({"batch": batch, "schema": schema, "folders": folders})
        return True


def upsert_stream(stream: DataFrame, folder: KeyedFolder, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """Keep ``folder`` up to date with what has arrived, batch by batch, and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not folder.committed(batch_id):
            folder.upsert(transform(batch.repartition(F.col(folder.key))), batch_id)  # a batch of one file is not one task

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
