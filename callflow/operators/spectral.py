"""Spectral clustering of speaker vectors within each call, without pairs.

The affinity of two unit vectors is (1 + u·v) / 2, the product of f = (1, u)/√2
with itself, so the affinity matrix of a call is F·Fᵀ and its degrees are
products with the sum of F. The normalised affinity is B·Bᵀ with rows
b = f / √degree, and its leading eigenvectors follow from those of the small
matrix Bᵀ·B, a sum over vectors whose size is that of a vector squared. Each
vector then has its place in the embedding by itself, and k-means runs there.

Vectors of a call are dealt over blocks in every step; what meets per call is
one row of sums, of the small matrix, or of centres. The rounds of k-means move
the places alone, for all counts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.operators.speakers import ALL_SLOTS, COUNTS, SLOTS, beside, by_slot, clusters_of, first_of, like_given, lists, name_speakers, numbers, products, unit_vectors, vector_sums
from callflow.session import durable

#: Rounds of k-means at most; ``settled`` tells the calls that stopped moving before.
ROUNDS = 30
#: Eigenvalues below this share of the first count as zero.
RANK = 1e-10
#: A centre that moves less than this has stopped.
STILL = 1e-9


def _weighed(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """f of each vector, without its 1/√2, and its degree."""
    unit = numbers(rows["unit"])
    degree = (table["n"].to_numpy()[at] + products(unit, at, numbers(table["total"], 1, unit.shape[1]))[:, 0]) / 2
    return np.concatenate([np.ones((len(unit), 1)), unit], axis=1), degree


def _outer_sums(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Bᵀ·B of the vectors of a call in a batch; memory is one small matrix."""
    f, degree = _weighed(rows, at, table)
    b = f / np.sqrt(2 * degree)[:, None]
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        gram = b[begin:end].T @ b[begin:end]
        yield pa.RecordBatch.from_arrays([table["call_id"].slice(int(at[begin]), 1), lists(gram.reshape(1, -1))], ["call_id", "gram"])


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading eigenvectors of each small matrix over the root of their eigenvalues."""
    for batch in batches:
        bases = []
        for gram in batch["gram"].to_pylist():
            size = int(len(gram) ** 0.5)
            values, vectors = np.linalg.eigh(np.asarray(gram).reshape(size, size))
            values, vectors = values[::-1][: max(COUNTS)], vectors[:, ::-1][:, : max(COUNTS)]
            whole = values > RANK * values[0]
            scaled = np.zeros((max(COUNTS), size))
            scaled[: len(values)][whole] = (vectors[:, whole] / np.sqrt(values[whole])).T
            bases.append(scaled.tolist())
        yield pa.RecordBatch.from_arrays([batch["call_id"], pa.array(bases, pa.list_(pa.list_(pa.float64())))], ["call_id", "basis"])


def _places(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    f, degree = _weighed(rows, at, table)
    # 1/√2 of f and of b cancel against the degree's own
    place = products(f, at, numbers(table["basis"], max(COUNTS), f.shape[1])) / (np.sqrt(2.0) * degree)[:, None]
    yield pa.RecordBatch.from_arrays([rows["call_id"], rows["vec_id"], rows["unit"], rows["_block"], lists(place)], ["call_id", "vec_id", "unit", "_block", "place"])


def spectral_embedding(vectors: DataFrame) -> DataFrame:
    """call_id, vec_id, unit, _block and ``place``: the first eigenvectors of the
    normalised affinity, over the root of the degree, as far as any count of speakers needs.

    Directions without an eigenvalue (fewer vectors than directions) are zero.
    A vector of zeros has an affinity of a half to itself.
    """
    units = unit_vectors(vectors)
    sums = durable(vector_sums(units, ["call_id"]))
    parts = beside(units, sums, ["call_id"], _outer_sums, "call_id long, gram array<double>")
    grams = parts.groupBy("call_id").agg(Summarizer.sum(array_to_vector("gram")).alias("_sum")).select("call_id", vector_to_array("_sum").alias("gram"))
    bases = durable(grams.mapInArrow(_leading, "call_id long, basis array<array<double>>"))
    return beside(units, sums.join(bases, "call_id"), ["call_id"], _places, "call_id long, vec_id long, unit array<double>, _block int, place array<double>")


def _apart(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> np.ndarray:
    """Squared distance of each place from every centre, in as many directions as its count has speakers."""
    place, centres = numbers(rows["place"], max(COUNTS)), numbers(table["centres"], ALL_SLOTS, max(COUNTS))
    out = np.zeros((len(place), ALL_SLOTS))
    for k, first in SLOTS:
        for i in range(k):
            out[:, first : first + k] += (centres[:, first : first + k, i][at] - place[:, i, None]) ** 2
    return out


def _nearest(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> np.ndarray:
    """Slot of the nearest centre of each place, for every count tried."""
    far = _apart(rows, at, table)
    return np.stack([first + far[:, first : first + k].argmin(axis=1) for k, first in SLOTS], axis=1)


def _seeds(points: DataFrame) -> DataFrame:
    """Per call and count the place of its first vector, then again and again the one farthest from those chosen."""

    def farthest(chosen: int):
        def work(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            apart, place, ids = _apart(rows, at, table), numbers(rows["place"], max(COUNTS)), rows["vec_id"].to_numpy()
            for k, first in SLOTS:
                if chosen >= k:
                    continue
                near = apart[:, first : first + chosen].min(axis=1)
                best = first_of(at, -near, ids)
                slot = np.full(len(best), first + chosen)
                yield pa.RecordBatch.from_arrays(
                    [rows["call_id"].take(pa.array(best)), pa.array(slot, pa.int32()), pa.array(-near[best]), rows["vec_id"].take(pa.array(best)), lists(place[best])],
                    ["call_id", "slot", "near", "vec_id", "place"],
                )

        return work

    centres = points.groupBy("call_id").agg(F.array_repeat(F.min_by("place", "vec_id"), ALL_SLOTS).alias("centres"))
    for chosen in range(1, max(COUNTS)):
        least = beside(points, durable(centres), ["call_id"], farthest(chosen), "call_id long, slot int, near double, vec_id long, place array<double>")
        found = by_slot(least.groupBy("call_id", "slot").agg(F.min_by("place", F.struct("near", "vec_id")).alias("place")), F.col("place"), "_next")
        turned = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("_next", i), c))
        centres = durable(centres.join(found, "call_id").select("call_id", turned.alias("centres")))
    return centres


def settle(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """call_id, centres and settled (a flag for every count): k-means over ``place`` until no centre moves.

    A count whose centres have stopped keeps them; only calls with a count that still
    moves take part in a further round. After ``rounds`` what moves keeps its last
    centres with ``settled`` false.
    """
    moving = _seeds(points).withColumn("settled", F.array(*[F.lit(False) for _ in COUNTS]))
    done = None

    def apart(a, b, k):
        return F.aggregate(F.slice(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), 1, k), F.lit(0.0), lambda s, x: s + x)

    for _ in range(rounds):
        mean = F.transform("total", lambda x: x / F.col("n"))
        moved = by_slot(clusters_of(points, moving, _nearest, "place"), mean, "_moved")
        centres, settled = [], []
        for i, (k, first) in enumerate(SLOTS):
            stays, old = F.col("settled")[i], [F.col("centres")[first + j] for j in range(k)]
            new = [F.when(stays, c).otherwise(F.coalesce(F.try_element_at("_moved", F.lit(first + j)), c)) for j, c in enumerate(old)]  # a centre without vectors stays
            centres += new
            settled.append(stays | (F.greatest(*[apart(a, b, k) for a, b in zip(old, new, strict=True)]) <= STILL * STILL))
        turned = durable(moving.join(moved, "call_id").select("call_id", F.array(*centres).alias("centres"), F.array(*settled).alias("settled")))
        all_settled = F.forall("settled", lambda x: x)
        rest = turned.where(all_settled)
        done = rest if done is None else done.unionByName(rest)
        moving = turned.where(~all_settled)
        if moving.isEmpty():
            break
    return durable(done.unionByName(moving) if done is not None else moving)


def spectral_speakers(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """speaker_no and ``settled`` of each vector (call_id, vec_id, embedding), clustered within its call.

    For 2 to 4 speakers the vectors are clustered in the embedding by as many
    eigenvectors; the count with the best quality wins. A call of one vector
    has one speaker, of fewer than four two. Speakers are numbered from zero
    without gaps.
    """
    embedded = durable(spectral_embedding(vectors))
    points = durable(embedded.select("call_id", "vec_id", "_block", "place"))
    return like_given(name_speakers(embedded, settle(points, rounds), _nearest), vectors)
