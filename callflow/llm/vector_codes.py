"""Vector code compression: product quantisation in integers, by limb-split exact matrix products.

Components are scaled and floored to integers. Squared distances to the
codebook entries follow from dot products, and these come from float64 BLAS
without rounding: both factors are broken into limbs of so few bits that no
sum of products reaches 2^53, and the products of limbs are shifted and added
in int64. The nearest entry is the first minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import only, stored

#: Vectors that meet the codebooks at once; it bounds a task's memory.
BLOCK = 4096
CODES = "vec_id long, label string, code string, error long"
SUMS = "part int, entry int, position int, total long, members long"


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays whose sum, shifted by ``bits`` each, is ``values``; all but the last are in [0, 2^bits)."""
    out = []
    while True:
        if -(1 << bits) <= values.min(initial=0) and values.max(initial=0) < 1 << bits:
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of int64 matrices, exact as long as the result fits int64."""
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest row of ``c`` to every row of ``x``, and the squared distance."""
    distance = (x * x).sum(1)[:, None] - 2 * exact_products(x, c) + (c * c).sum(1)[None, :]
    entry = distance.argmin(1)
    return entry, distance[np.arange(len(x)), entry]


def integers(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """Rows of ``width`` integers; a shorter vector ends in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(True))


class Codebooks:
    """Entries of every part: an array (parts, entries, width of a part)."""

    def __init__(self, entries: np.ndarray, scale: int):
        self.entries, self.scale = entries, scale
        self.parts, self.size, self.width = entries.shape

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                yield part, integers(part["vector"], self.scale, self.parts * self.width).reshape(len(part), self.parts, self.width)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def member_sums(vectors: DataFrame, books: Codebooks) -> np.ndarray:
    """Componentwise sums and, last, the number of members of every entry, over all ``vectors``.

    A task adds up what it reads and hands on a row per entry and position; the
    driver gets the model's own size, however many vectors there are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((books.parts, books.size, books.width), np.int64)
        members = np.zeros((books.parts, books.size), np.int64)
        for _, x in books.blocks(batches):
            for p in range(books.parts):
                entry, _ = nearest(x[:, p], books.entries[p])
                np.add.at(total[p], entry, x[:, p])
                members[p] += np.bincount(entry, minlength=books.size)
        part, entry = np.nonzero(members)
        columns = [np.repeat(v, books.width) for v in (part, entry)] + [np.tile(np.arange(books.width), len(part)), total[part, entry].ravel(), np.repeat(members[part, entry], books.width)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)], ["part", "entry", "position", "total", "members"])

    sums = vectors.select("vector").mapInArrow(add, SUMS).groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).toArrow()
    out = np.zeros((books.parts, books.size, books.width + 1), np.int64)
    part, entry, position = (sums[c].to_numpy() for c in ("part", "entry", "position"))
    out[part, entry, position] = sums["total"].to_numpy()
    out[part, entry, books.width] = sums["members"].to_numpy()
    return out


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks after ``rounds`` of assignment and flooring means; None without vectors."""
    size = vectors.agg(F.max(F.size("vector"))).first()[0]
    if size is None:
        return None
    width = -(-size // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    books = Codebooks(integers(first, scale, parts * width).reshape(-1, parts, width).swapaxes(0, 1).copy(), scale)
    for _ in range(rounds):
        sums = member_sums(vectors, books)
        members = sums[:, :, -1:]
        books = Codebooks(np.where(members > 0, sums[:, :, :-1] // np.maximum(members, 1), books.entries), scale)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector; nothing is shuffled."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in books.blocks(batches):
            codes = np.zeros((len(batch), books.parts), np.int64)
            error = np.zeros(len(batch), np.int64)
            for p in range(books.parts):
                codes[:, p], distance = nearest(x[:, p], books.entries[p])
                error += distance
            texts = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(code, CODES)


def compress_vectors(vectors: DataFrame, vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of ``vectors`` (vec_id, label, ``vector``).

    Components become ``floor(scale * x)``; a vector is cut into ``parts`` equal
    parts and each takes the index of the nearest of ``entries`` (at most 256)
    codebook entries. Codebooks start as the vectors of the smallest vec_ids
    and take ``rounds`` of flooring means.

    Rows whose vector is null or holds a null or non-finite component are
    dropped. Vectors of another length, or one that parts do not divide, count
    as ending in zeros; an empty vector is all zeros. Null vec_id: kept, last
    in order. Equal vec_ids: ordered by their vectors. Null labels are one
    label. Fewer rows than entries: as many entries as rows. Empty table: no
    rows. Other columns are ignored. Squared errors are exact while a vector's
    sum is below 2^63, that is for components up to some 10^6 times a unit
    vector's; codebooks are ``parts * entries`` integers of a part each, all that the driver
    and a broadcast hold.
    """
    kept = vectors.select(*only(vectors, "vec_id"), vectors["label"].cast("string").alias("label"), vectors[vector].alias("vector"))
    kept = kept.withColumn("vec_id", F.col("vec_id").cast("long")).where(usable(F.col("vector")))
    books = fit(kept, parts, entries, rounds, scale)
    if books is None:
        books = Codebooks(np.zeros((parts, 1, 1), np.int64), scale)
    coded = stored(encode(kept, books))
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    a, b = coded.alias("a"), totals.alias("b")
    return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label"))).select("a.vec_id", "a.code", "a.error", "b.label_error", F.lit(books.digest()).alias("codebooks_sha256"))
