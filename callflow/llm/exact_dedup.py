"""Exact deduplication over an extendible-hash index on shared files.

Every partition of the input writes its part of the index to the shared folder:
one entry per distinct text it holds (key, bytes, best row, number of rows) and
one member per row. A directory over the leading bits of the keys is doubled
until no bucket is overfull. Owner tasks take whole buckets in key order, chain
the entries of equal keys, compare their bytes and settle each class of equal
texts; members look up what their entry's class decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import SPACE_BYTES, documents, row_id, rows_of, stored

#: Leading bits of the key that the directory may use at most: 65,536 slots.
DIRECTORY_BITS = 16
#: Bytes of text a bucket should hold.
BUCKET_BYTES = 8 << 20
#: Bytes of distinct texts a task remembers while it writes its part of the index.
REMEMBERED_BYTES = 64 << 20

ENTRY = "struct<points: long, doc_id: long, row: long>"
INDEX = "entry long, row long, doc_id long, rid binary, key long, best " + ENTRY + ", copies long, body binary, sha string"
SETTLED = "entry long, keep_id long, keep_row long, group_size long, sha string"


def better(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` stays rather than ``b``: more code points, then smaller doc_id (null last), then first read."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


ENTRY_TYPE = pa.struct([("points", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64())])
INDEX_SCHEMA = pa.schema(
    [("entry", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.binary()), ("key", pa.int64()), ("best", ENTRY_TYPE), ("copies", pa.int64()), ("body", pa.binary()), ("sha", pa.string())]
)
SETTLED_SCHEMA = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def write_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and entries of one partition, in the order of its rows."""
    base = TaskContext.get().partitionId() << 33
    row, chains, held = base, {}, 0

    def entries() -> pa.RecordBatch:
        out = [(e[1], None, None, None, k, dict(zip(("points", "doc_id", "row"), e[2], strict=True)), e[3], e[0], hashlib.sha256(e[0]).hexdigest()) for k, c in chains.items() for e in c]
        return table(out, INDEX_SCHEMA)

    for batch in batches:
        members = []
        for doc_id, rid, points, text in zip(batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), batch["points"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            body = text.translate(None, SPACE_BYTES)
            chain = chains.setdefault(signed(xxhash.xxh3_64_intdigest(body)), [])
            mine = (points, doc_id, row)
            entry = next((e for e in chain if e[0] == body), None)
            if entry is None:
                chain.append(entry := [body, row, mine, 0])
                held += len(body) + 200
            elif better(mine, entry[2]):
                entry[2] = mine
            entry[3] += 1
            members.append((entry[1], row, doc_id, rid, None, None, None, None, None))
            row += 1
        yield table(members, INDEX_SCHEMA)
        if held > REMEMBERED_BYTES:
            yield entries()
            chains, held = {}, 0
    if chains:
        yield entries()


def directory(loads: dict[int, int], bits: int, capacity: int) -> tuple[int, list[int]]:
    """Depth of the directory and the bucket of each of its slots.

    Starts with one bucket; every overfull bucket splits on its next bit, and
    the directory doubles when a bucket is as deep as it. ``loads`` has bytes by
    the leading ``bits`` bits of the key.
    """
    sums = [0, *accumulate(loads.get(i, 0) for i in range(1 << bits))]
    todo, buckets, depth = [(0, 0)], [], 0
    while todo:
        prefix, local = todo.pop()
        width = 1 << (bits - local)
        if local == bits or sums[(prefix + 1) * width] - sums[prefix * width] <= capacity:
            buckets.append((prefix, local))
            continue
        depth = max(depth, local + 1)
        todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
    slots = [0] * (1 << depth)
    for n, (prefix, local) in enumerate(buckets):
        width = 1 << (depth - local)
        slots[prefix * width : (prefix + 1) * width] = [n] * width
    return depth, slots


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order: chain those of one key, tell texts apart by their bytes, and settle each class."""
    key, chain = None, []

    def settled() -> list[tuple]:
        return [(e, c["best"][1], c["best"][2], c["copies"], c["sha"]) for c in chain for e in c["entries"]]

    for batch in batches:
        out = []
        for k, entry, best, copies, body, sha in zip(*(batch[n].to_pylist() for n in ("key", "entry", "best", "copies", "body", "sha")), strict=True):
            if k != key:
                out += settled()
                key, chain = k, []
            mine = (best["points"], best["doc_id"], best["row"])
            same = next((c for c in chain if c["body"] == body), None)
            if same is None:
                chain.append({"body": body, "best": mine, "copies": copies, "entries": [entry], "sha": sha})
                continue
            same["entries"].append(entry)
            same["copies"] += copies
            if better(mine, same["best"]):
                same["best"] = mine
        yield table(out, SETTLED_SCHEMA)
    yield table(settled(), SETTLED_SCHEMA)


def classes(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """doc_id, rid, keep_id, group_size, kept, text_sha256 of every row."""
    d = documents(docs)
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    read = d.select("doc_id", row_id(d).alias("rid"), F.length("text").cast("long").alias("points"), "text")
    index = stored(read.mapInArrow(write_index, INDEX))
    entries = index.where(F.col("key").isNotNull())
    slot = F.shiftrightunsigned("key", 64 - DIRECTORY_BITS)
    loads = {r[0]: r[1] for r in entries.groupBy(slot).agg(F.sum(F.octet_length("body") + 100)).collect()}
    depth, slots = directory(loads, DIRECTORY_BITS, bucket_bytes)
    spark = docs.sparkSession
    owners = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket int")
    at = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    placed = entries.select("key", "entry", "best", "copies", "body", "sha", at.alias("slot")).join(F.broadcast(owners), "slot")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    owned = placed.drop("slot").repartition(parts, "bucket").sortWithinPartitions("bucket", "key")
    settled = owned.select("key", "entry", "best", "copies", "body", "sha").mapInArrow(settle, SETTLED)
    members = index.where(F.col("key").isNull()).select("entry", "row", "doc_id", "rid")
    return members.join(settled, "entry").select(
        "doc_id", "rid", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row
    with the most code points stays, then the smallest doc_id (null last), then
    the first one read, so exactly one row of a class has ``kept``.

    Null text counts as empty; all empty texts are one class. Repeated rows are
    members of their class. Empty table: no rows. Other columns are ignored.
    A text that a third of all rows share gives one entry per partition.
    """
    return classes(docs, bucket_bytes).drop("rid")


def unique(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that stay."""
    return rows_of(docs, classes(docs, bucket_bytes).where("kept"))
