"""Speaker vectors: normalisation, affinity, clustering and its quality.

Cosine sums over pairs equal products with summed vectors, so affinity degrees,
silhouette and Davies–Bouldin need one pass over the vectors and one small
table of sums per cluster; pairs are never listed. All calls are clustered
together: what is kept per call is at most four centres per tried count. Vectors
stream past these in ``BLOCKS`` blocks per call, so a long call is not one task,
and give a row of sums per batch and cluster; centres are never copied to vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.session import durable

COUNTS = (2, 3, 4)  # speakers a call is tried with
ROUNDS = 4
BLOCKS = 16

#: Centres of all counts stand in one row per call: each count with the slot of its first.
SLOTS = [(k, sum(c for c in COUNTS if c < k)) for k in COUNTS]
ALL_SLOTS = sum(COUNTS)

SILHOUETTE_WEIGHT, DB_WEIGHT = 0.7, 0.3
PREFERRED_K, K_MARGIN = 3, 0.1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    # the norm is bound by a transform of its own, or it would be computed anew for every element
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))[0]


def vector_sums(vectors: DataFrame, keys: list[str], vector: str = "unit") -> DataFrame:
    """Element-wise sums per key."""
    sums = vectors.groupBy(*keys).agg(Summarizer.sum(array_to_vector(F.col(vector))).alias("_sum"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, vector_to_array("_sum").alias("total"), "n")


def _block() -> Column:
    return F.pmod(F.hash("vec_id"), F.lit(BLOCKS)).cast("int")


def beside(vectors: DataFrame, small: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` over batches of vectors (with _block) that stream past the row of their keys in a small table.

    The small table is repeated for every block and sorted in front of its vectors.
    ``work(rows, at, table)`` gets record batches; ``at`` is the place of each row's
    partner in ``table``. Vectors without a partner are left out, as in a join.
    """
    near = small.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("_vector", F.lit(False))
    both = vectors.withColumn("_vector", F.lit(True)).unionByName(near, allowMissingColumns=True)
    dealt = both.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the small table, whose vectors may go on in the next batch
        for batch in batches:
            is_vector = batch["_vector"].to_numpy(zero_copy_only=False)
            at = (np.cumsum(~is_vector) - 1 + (held is not None))[is_vector]
            rows, table = batch.filter(batch["_vector"]), batch.filter(pc.invert(batch["_vector"]))
            if held is not None:
                table = pa.Table.from_batches([held, table]).combine_chunks().to_batches()[0]
            if not len(table):
                continue
            held = table.slice(len(table) - 1)
            met = at >= 0
            for c in [*keys, "_block"]:
                met &= pc.equal(rows[c], table[c].take(pa.array(np.maximum(at, 0)))).fill_null(False).to_numpy(zero_copy_only=False)
            if met.any():
                yield from work(rows.filter(pa.array(met)), at[met], table)

    return dealt.mapInArrow(run, schema)


def numbers(column: pa.Array, *shape: int) -> np.ndarray:
    """Doubles of a column of (nested) lists of one size, a row each."""
    flat = column
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), *(shape or (-1,)))


def lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def products(rows: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Dot products of each row with the vectors of its place in ``table``, summed in order of the elements as ``dot`` does."""
    out, columns = np.zeros((len(rows), table.shape[1])), np.ascontiguousarray(table.transpose(2, 0, 1))
    for x, column in zip(np.ascontiguousarray(rows.T), columns, strict=True):
        out += x[:, None] * column[at]
    return out


def slot_sums(values: np.ndarray, slots: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Place in the table, slot, count and sums of ``values`` of every slot that occurs; a row of ``slots`` may name several."""
    found, group = np.unique(at[:, None] * size + slots, return_inverse=True)
    group, each = group.ravel(), slots.shape[1]
    sums = np.stack([np.bincount(group, np.repeat(v, each), len(found)) for v in values.T], axis=1)
    return found // size, found % size, np.bincount(group, minlength=len(found)), sums


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of sums (keys, total, n) of batches, one per key."""
    sums = parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector("total")).alias("_sum"), F.sum("n").alias("n"))
    return sums.select(*keys, vector_to_array("_sum").alias("total"), "n")


def by_slot(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """call_id and a map of slots to ``value``."""
    return rows.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", value.alias("value")))).alias(out))


def affinity_degree(vectors: DataFrame) -> DataFrame:
    """Row sums of the affinity matrix ((cos + 1) / 2, diagonal 1) per call."""
    unit = vectors.withColumn("unit", normalise(F.col("embedding")))
    sums = vector_sums(unit, ["call_id"])
    own = dot(F.col("unit"), F.col("unit"))
    degree = (dot(F.col("unit"), F.col("total")) - own + F.col("n") - 1) / 2 + 1
    return unit.join(sums, "call_id").select("call_id", "vec_id", degree.alias("degree"), F.col("n").alias("n_vectors"))


def pair_affinity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Affinity of requested pairs (call_id, left_id, right_id)."""
    unit = vectors.select("call_id", "vec_id", normalise(F.col("embedding")).alias("u"))
    left = unit.select("call_id", F.col("vec_id").alias("left_id"), F.col("u").alias("lu"))
    right = unit.select("call_id", F.col("vec_id").alias("right_id"), F.col("u").alias("ru"))
    both = pairs.join(left, ["call_id", "left_id"]).join(right, ["call_id", "right_id"])
    value = F.when(F.col("left_id") == F.col("right_id"), 1.0).otherwise((dot(F.col("lu"), F.col("ru")) + 1) / 2)
    return both.select("call_id", "left_id", "right_id", value.alias("affinity"))


def cluster_tables(sums: DataFrame, keys: list[str], cluster: str = "cluster") -> DataFrame:
    """Per key its clusters with their counts and vector sums, in order."""
    sums = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(cluster, "n", "total"))).alias("sums"))
    return sums.select(*keys, *[F.col("sums")[c].alias(f"{c}s") for c in (cluster, "n", "total")])


def tabled(table: pa.RecordBatch, names: str, size: int | None = None) -> tuple[np.ndarray, ...]:
    """Names, counts and sums of ``cluster_tables``, padded to one size; with ``size`` names are places.

    A cluster that is not there counts zero.
    """
    many = pc.list_value_length(table[names]).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(table)), many)
    name = table[names].flatten().to_numpy(zero_copy_only=False)
    place = name if size else np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    shape = (len(table), size or int(many.max()))
    sums = table["totals"].flatten()
    label, n, totals = np.zeros(shape, name.dtype), np.zeros(shape), np.zeros((*shape, len(sums[0])))
    label[row, place], n[row, place] = name, table["ns"].flatten().to_numpy(zero_copy_only=False)
    totals[row, place] = numbers(sums)
    return label, n, totals


def fit(rows: np.ndarray, at: np.ndarray, own: np.ndarray, n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Silhouette over distance (1 − cos) / 2 of each row in its cluster, and its distance from the centre."""
    each, size, like = np.arange(len(rows)), n[at], products(rows, at, totals)
    mine, apart = size[each, own], np.zeros(len(rows))
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = (mine - like[each, own]) / 2 / (mine - 1)
        others = np.where(size > 0, (1 - like / size) / 2, np.inf)
        others[each, own] = np.inf
        other = others.min(axis=1)
        most = np.maximum(inside, other)
        value = np.where((mine > 1) & np.isfinite(other) & (most != 0), (other - inside) / most, 0.0)
        centres = totals / n[..., None]
    for x, column in zip(rows.T, centres.transpose(2, 0, 1), strict=True):
        apart += (x - column[at, own]) ** 2
    return np.stack([value, np.sqrt(apart)], axis=1)


def scores(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Silhouette, Davies–Bouldin index and their mix per key.

    ``clusters`` has a row per key and cluster: n, total, fit (the sums of its silhouettes and distances).
    """
    centre = F.transform("total", lambda x: x / F.col("n"))
    made = F.struct("cluster", (F.col("fit")[1] / F.col("n")).alias("spread"), centre.alias("centre"))
    row = clusters.groupBy(*keys).agg((F.sum(F.col("fit")[0]) / F.sum("n")).alias("silhouette"), F.array_sort(F.collect_list(made)).alias("made"))

    def distance(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    # the few clusters of one key are compared inside its row
    worst = F.transform(
        "made",
        lambda a: F.array_max(
            F.transform(F.filter("made", lambda b: b["cluster"] != a["cluster"]), lambda b: (a["spread"] + b["spread"]) / distance(a["centre"], b["centre"]))
        ),
    )
    mean = F.aggregate(worst, F.lit(0.0), lambda s, x: s + x) / F.size("made")
    both = row.select(*keys, "silhouette", mean.alias("davies_bouldin"), F.size("made").alias("clusters"))
    combined = SILHOUETTE_WEIGHT * F.col("silhouette") + DB_WEIGHT / (1 + F.col("davies_bouldin"))
    return both.withColumn("combined", combined)


def quality(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Silhouette, Davies–Bouldin index, clusters and combined score per key of vectors with their cluster."""
    unit = labelled.select(*keys, F.col("cluster").cast("long").alias("cluster"), normalise(F.col("embedding")).alias("unit"), _block().alias("_block"))
    sums = vector_sums(unit, [*keys, "cluster"])

    def work(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, n, totals = tabled(table, "clusters")
        own = ((names[at] == rows["cluster"].to_numpy()[:, None]) & (n[at] > 0)).argmax(axis=1)
        of, slot, count, total = slot_sums(fit(numbers(rows["unit"]), at, own, n, totals), own[:, None], at, n.shape[1])
        columns = [*[table[c].take(pa.array(of)) for c in keys], pa.array(names[of, slot]), lists(total), pa.array(count)]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "cluster", "total", "n"])

    kinds = ", ".join(f"`{c}` {unit.schema[c].dataType.simpleString()}" for c in keys)
    parts = beside(unit, cluster_tables(sums, keys), keys, work, f"{kinds}, cluster long, total array<double>, n long")
    fits = added(parts, [*keys, "cluster"]).select(*keys, "cluster", F.col("total").alias("fit"))
    return scores(sums.join(fits, [*keys, "cluster"]), keys)


def best_count(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster count with the best score (k, score) per key, the smallest of equals.

    More than three fall back to three when the margin is under 0.1 and at
    least three counts were tried.
    """
    order = F.struct(F.col("score"), -F.col("k"))
    best = scores.groupBy(*keys).agg(
        F.max_by("k", order).alias("k"), F.max("score").alias("score"),
        F.coalesce(F.max(F.when(F.col("k") == PREFERRED_K, F.col("score"))), F.lit(0.0)).alias("score3"),
        F.count(F.lit(1)).alias("tried"),
    )
    back = (F.col("k") > PREFERRED_K) & (F.col("tried") >= 3) & (F.col("score") - F.col("score3") < K_MARGIN)
    return best.select(*keys, F.when(back, PREFERRED_K).otherwise(F.col("k")).cast("long").alias("k"), "score")


def first_of(at: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The first row of every place in order."""
    by = np.lexsort((*order[::-1], at))
    return by[np.unique(at[by], return_index=True)[1]]


def _seeds(units: DataFrame) -> DataFrame:
    """Per call its first vector, then again and again the one least like those chosen."""

    def work(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unit = numbers(rows["unit"])
        near = products(unit, at, numbers(table["seeds"], len(table["seeds"][0]), unit.shape[1])).max(axis=1)
        first = first_of(at, near, rows["vec_id"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [rows["call_id"].take(pa.array(first)), pa.array(near[first]), rows["vec_id"].take(pa.array(first)), lists(unit[first])], ["call_id", "near", "vec_id", "unit"]
        )

    chosen = durable(units.groupBy("call_id").agg(F.array(F.min_by("unit", "vec_id")).alias("seeds")))
    for _ in range(max(COUNTS) - 1):
        least = beside(units, chosen, ["call_id"], work, "call_id long, near double, vec_id long, unit array<double>")
        far = least.groupBy("call_id").agg(F.min_by("unit", F.struct("near", "vec_id")).alias("_next"))
        chosen = durable(chosen.join(far, "call_id").select("call_id", F.array_append("seeds", F.col("_next")).alias("seeds")))
    return chosen


def _nearest(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> np.ndarray:
    """Slot of the nearest centre of each vector, for every count tried."""
    unit = numbers(rows["unit"])
    like = products(unit, at, numbers(table["centres"], ALL_SLOTS, unit.shape[1]))
    return np.stack([first + like[:, first : first + k].argmax(axis=1) for k, first in SLOTS], axis=1)


def clusters_of(units: DataFrame, centres: DataFrame, nearest: Callable, value: str = "unit") -> DataFrame:
    """call_id, slot, total and n: sums of the vectors that are nearest to each centre."""

    def work(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, slot, count, total = slot_sums(numbers(rows[value]), nearest(rows, at, table), at, ALL_SLOTS)
        yield pa.RecordBatch.from_arrays([table["call_id"].take(pa.array(of)), pa.array(slot, pa.int32()), lists(total), pa.array(count)], ["call_id", "slot", "total", "n"])

    return added(beside(units, centres, ["call_id"], work, "call_id long, slot int, total array<double>, n long"), ["call_id", "slot"])


def name_speakers(units: DataFrame, centres: DataFrame, nearest: Callable) -> DataFrame:
    """call_id, vec_id, speaker_no and settled: each vector in its cluster of the best count of its call.

    ``centres`` has call_id, centres and settled, a flag for every count.
    """
    sums = durable(clusters_of(units, centres, nearest))
    tables = cluster_tables(sums, ["call_id"], "slot")
    of_count = F.coalesce(*[F.when(F.col("slot") < first + k, F.lit(k)) for k, first in SLOTS]).alias("k")

    def fits(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slots, unit = nearest(rows, at, table), numbers(rows["unit"])
        _, n, totals = tabled(table, "slots", ALL_SLOTS)
        for i, (k, first) in enumerate(SLOTS):
            own = slots[:, i] - first
            values = fit(unit, at, own, n[:, first : first + k], totals[:, first : first + k])
            of, slot, count, total = slot_sums(values, own[:, None], at, k)
            yield pa.RecordBatch.from_arrays(
                [table["call_id"].take(pa.array(of)), pa.array(first + slot, pa.int32()), lists(total), pa.array(count)], ["call_id", "slot", "total", "n"]
            )

    parts = beside(units, centres.join(tables, "call_id"), ["call_id"], fits, "call_id long, slot int, total array<double>, n long")
    of_slot = added(parts, ["call_id", "slot"]).select("call_id", "slot", F.col("total").alias("fit"))
    judged = scores(sums.join(of_slot, ["call_id", "slot"]).select("call_id", of_count, F.col("slot").alias("cluster"), "total", "n", "fit"), ["call_id", "k"])
    sizes = sums.where(F.col("slot") < COUNTS[0]).groupBy("call_id").agg(F.sum("n").alias("size"))
    tried = judged.join(sizes, "call_id").where("clusters = k AND k < size AND size >= 4")
    best = best_count(tried.withColumnRenamed("combined", "score"), ["call_id"]).select("call_id", F.col("k").alias("_best"))
    count = F.when(F.col("size") < 2, 1).when(F.col("size") < 4, 2).otherwise(F.coalesce("_best", F.lit(2)))
    # a call of one vector is read from its first trial, where it is alone in a cluster
    trial = (F.greatest(count, F.lit(COUNTS[0])) - COUNTS[0]).cast("int").alias("trial")
    used = sums.groupBy("call_id").agg(F.collect_set("slot").alias("used"))
    chosen = sizes.join(best, "call_id", "left").select("call_id", trial).join(used, "call_id").join(centres, "call_id")

    def names(rows: pa.RecordBatch, at: np.ndarray, table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trial = table["trial"].to_numpy()[at]
        slot = nearest(rows, at, table)[np.arange(len(rows)), trial]
        used = np.zeros((len(table), ALL_SLOTS), int)
        used[np.repeat(np.arange(len(table)), pc.list_value_length(table["used"])), table["used"].flatten()] = 1
        before = np.concatenate([np.zeros((len(table), 1), int), used.cumsum(axis=1)], axis=1)
        number = before[at, slot] - before[at, np.array([first for _, first in SLOTS])[trial]]
        settled = numbers(table["settled"], len(COUNTS))[at, trial] > 0
        yield pa.RecordBatch.from_arrays([rows["call_id"], rows["vec_id"], pa.array(number), pa.array(settled)], ["call_id", "vec_id", "speaker_no", "settled"])

    return beside(units, chosen, ["call_id"], names, "call_id long, vec_id long, speaker_no long, settled boolean")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """call_id, vec_id, unit and _block of vectors that belong to a call."""
    kept = vectors.where("call_id IS NOT NULL").select(F.col("call_id").cast("long").alias("call_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # few files would be few tasks
    units = kept.repartition("vec_id").select("call_id", "vec_id", normalise(F.col("embedding")).alias("unit"))
    return durable(units.withColumn("_block", _block()))


def like_given(named: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids in the types they were given in."""
    return named.withColumns({c: F.col(c).cast(vectors.schema[c].dataType) for c in ("call_id", "vec_id")})


def cluster_calls(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """speaker_no of each vector (call_id, vec_id, embedding), clustered within its call.

    Spherical k-means from deterministic seeds for 2 to 4 speakers; the count
    with the best quality wins. A call of one vector has one speaker, of fewer
    than four two. Speakers are numbered from zero without gaps.
    """
    units = unit_vectors(vectors)
    centres = _seeds(units).select("call_id", F.concat(*[F.slice("seeds", 1, k) for k in COUNTS]).alias("centres"))
    for _ in range(rounds):
        moved = by_slot(clusters_of(units, centres, _nearest), normalise(F.col("total")), "_moved")
        kept = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("_moved", i), c))  # a centre without vectors stays
        centres = durable(centres.join(moved, "call_id").select("call_id", kept.alias("centres")))
    settled = F.array(*[F.lit(True) for _ in COUNTS]).alias("settled")
    return like_given(name_speakers(units, centres.select("*", settled), _nearest), vectors).drop("settled")
