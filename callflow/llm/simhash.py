"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are laid out as a binary trie (a sorted array, whose ranges of a
common prefix are the nodes). Pairs of nodes are traversed together: descending
adds a bit of difference where the branches differ, and a pair is pruned once it
exceeds its budget. Of two fingerprints within ``d`` bits, some half differs in
at most ``d/2`` and some quarter of it in at most ``d/4`` bits; so four tries,
each with another quarter in front, need only that much budget at their top.

The top of each trie is cut into nodes of bounded load; a task joins one pair of
nodes. Nodes that the deepest cut leaves too heavy are dealt into chunks. A task
reports which fingerprints it has found connected, not every pair, and skips
node pairs it has already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.components import components
from callflow.llm.shared import documents, row_id, rows_of, stored

BITS, QUARTER = 64, 16
#: Quarter in front, the other quarter of its half, the other half.
ORDERS = ((0, 1, 2, 3), (1, 0, 2, 3), (2, 3, 0, 1), (3, 2, 0, 1))
SHINGLE = 4
SEED = 42
#: Fingerprints of one node: a share of all of them within these limits.
NODE_LEAST, NODE_MOST, NODE_SHARE = 2048, 65536, 32
#: Side of a fingerprint in a pair of a node with itself.
OWN = 2
#: Node pairs that a task expands at a time, and pairs of fingerprints from which a node pair is simply compared.
BLOCK, COMPARED = 1 << 18, 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of all shingles, repeats included; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rid and fp (the fingerprint as a signed 64-bit integer) of every whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(found)], ["doc_id", "rid", "fp"])

    d = documents(docs)
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    return d.withColumn("rid", row_id(d)).mapInArrow(hashed, "doc_id long, rid binary, fp long")


def permuted(x: np.ndarray, order: tuple[int, ...], back: bool = False) -> np.ndarray:
    """Quarters of each number in the given order, or put back."""
    out = np.zeros_like(x)
    for to, of in enumerate(order):
        if back:
            to, of = of, to
        out |= ((x >> np.uint64(48 - QUARTER * of)) & np.uint64(0xFFFF)) << np.uint64(48 - QUARTER * to)
    return out


def allowed(depth: int, distance: int) -> int:
    """Differing bits that two nodes at this depth may have."""
    return distance // 4 if depth <= QUARTER else distance // 2 if depth <= 2 * QUARTER else distance


@dataclass
class Routes:
    """Where the fingerprints of one trie go: chunks of nodes, and the node pairs that each takes part in."""

    starts: np.ndarray  # first slot of each node
    chunks: np.ndarray  # chunks of each node
    base: np.ndarray  # number of the node's first chunk
    begin: np.ndarray  # first entry of each chunk in pair and side
    size: np.ndarray  # entries of each chunk
    pair: np.ndarray
    side: np.ndarray


def top_routes(loads: np.ndarray, distance: int, most: int, first_pair: int) -> tuple[Routes, int]:
    """Cut the top of a trie into nodes by the load of its slots and pair those within the budget."""
    sums = np.concatenate([[0], np.cumsum(loads)])
    leaves: dict[tuple[int, int], int] = {}

    def load(depth: int, prefix: int) -> int:
        width = 1 << (QUARTER - depth)
        return int(sums[(prefix + 1) * width] - sums[prefix * width])

    todo = [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        if depth == QUARTER or load(depth, prefix) <= most:
            leaves[depth, prefix] = len(leaves)
        else:
            todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
    chunks = [max(1, -(-load(*leaf) // most)) for leaf in leaves]
    base = [0, *accumulate(chunks)]
    met: list[list[tuple[int, int]]] = [[] for _ in range(base[-1])]
    pairs = first_pair
    stack = [((0, 0), (0, 0), 0)]
    while stack:
        a, b, errors = stack.pop()
        if a in leaves and b in leaves:
            i, j = leaves[a], leaves[b]
            for x in range(base[i], base[i + 1]):
                for y in range(x if i == j else base[j], base[j + 1]):
                    met[x].append((pairs, OWN if x == y else 0))
                    if x != y:
                        met[y].append((pairs, 1))
                    pairs += 1
            continue
        below = lambda node: [node] if node in leaves else [(node[0] + 1, 2 * node[1]), (node[0] + 1, 2 * node[1] + 1)]
        for x in below(a):
            for y in below(b):
                if a == b and x > y:
                    continue
                shared = min(x[0], y[0])
                differ = errors if shared == min(a[0], b[0]) else ((x[1] >> (x[0] - shared)) ^ (y[1] >> (y[0] - shared))).bit_count()
                if differ <= allowed(shared, distance):
                    stack.append((x, y, differ))
    sizes = [len(m) for m in met]
    flat = [e for m in met for e in m]
    return Routes(
        np.array([p << (QUARTER - d) for d, p in leaves], np.int64), np.array(chunks, np.int64), np.array(base[:-1], np.int64),
        np.array([0, *accumulate(sizes)][:-1], np.int64), np.array(sizes, np.int64), np.array([e[0] for e in flat], np.int64), np.array([e[1] for e in flat], np.int8),
    ), pairs


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; every label points at the smallest index of its component afterwards."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


def pairs_of(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the given pairs of ranges."""
    width = bhi - blo
    count = (ahi - alo) * width
    of = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return alo[of] + k // width[of], blo[of] + k % width[of]


def join_nodes(a: np.ndarray, b: np.ndarray | None, distance: int) -> np.ndarray:
    """Component labels over ``a`` followed by ``b`` (None: a joined with itself), both sorted; links within ``distance`` connect."""
    own = b is None
    x = a if own else np.concatenate([a, b])
    labels = np.arange(len(x))
    offset = 0 if own else len(a)
    ends = [(0, len(a))] if own else [(0, len(a)), (len(a), len(x))]
    for lo, hi in ends:
        near = lo + np.flatnonzero(np.bitwise_count(x[lo + 1 : hi] ^ x[lo : hi - 1]) <= distance)
        merge(labels, near, near + 1)
    sides = (a, a if own else b)
    one = lambda v: np.array([v], np.int64)
    stack = [(0, one(0), one(len(a)), one(offset), one(len(x)), one(0))]
    while stack:
        depth, alo, ahi, blo, bhi, errors = stack.pop()
        if len(alo) > BLOCK:
            stack.append((depth, *(v[BLOCK:] for v in (alo, ahi, blo, bhi, errors))))
            alo, ahi, blo, bhi, errors = (v[:BLOCK] for v in (alo, ahi, blo, bhi, errors))
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        joined = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (labels[alo] == labels[blo])
        few = (ahi - alo) * (bhi - blo) <= COMPARED
        some = few & ~joined
        if some.any():
            i, j = pairs_of(alo[some], ahi[some], blo[some], bhi[some])
            close = np.bitwise_count(x[i] ^ x[j]) <= distance
            merge(labels, i[close], j[close])
        rest = ~few & ~joined
        if not rest.any():
            continue
        alo, ahi, blo, bhi, errors = (v[rest] for v in (alo, ahi, blo, bhi, errors))
        low = np.uint64((1 << (BITS - depth)) - 1)
        bit = np.uint64(1 << (BITS - 1 - depth))
        amid = np.searchsorted(sides[0], (x[alo] & ~low) | bit)
        bmid = offset + np.searchsorted(sides[1], (x[blo] & ~low) | bit)
        same = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, blo, bmid, errors, None),
            (amid, ahi, bmid, bhi, errors, None),
            (alo, amid, bmid, bhi, errors + 1, None),
            (amid, ahi, blo, bmid, errors + 1, ~same),
        ]
        kept = []
        for c in children:
            go = (c[0] < c[1]) & (c[2] < c[3]) & (c[4] <= allowed(depth + 1, distance))
            if c[5] is not None:
                go &= c[5]
            kept.append([v[go] for v in c[:5]])
        stack.append((depth + 1, *(np.concatenate(v) for v in zip(*kept, strict=True))))
        if not len(stack[-1][1]):
            stack.pop()
    return labels


def near_components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fp, root of every distinct fingerprint that another one is within ``distance`` bits of, links followed transitively.

    ``fps`` has a column fp without repeats. What reaches the driver are loads of
    65,536 slots per trie, whatever the input.
    """
    quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("trie"), (F.shiftrightunsigned("fp", 48 - QUARTER * i).bitwiseAND(F.lit(0xFFFF))).cast("int").alias("slot")) for i in range(len(ORDERS))]))
    loads = np.zeros((len(ORDERS), 1 << QUARTER), np.int64)
    for trie, slot, n in fps.select(quarter.alias("q")).groupBy("q.trie", "q.slot").count().collect():
        loads[trie, slot] = n
    most = max(NODE_LEAST, min(NODE_MOST, int(loads[0].sum()) // NODE_SHARE))
    routes, pairs = [], 0
    for trie in range(len(ORDERS)):
        r, pairs = top_routes(loads[trie], distance, most, pairs)
        routes.append(r)
    shared = fps.sparkSession.sparkContext.broadcast(routes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for trie, r in enumerate(shared.value):
                key = permuted(fp, ORDERS[trie])
                node = np.searchsorted(r.starts, (key >> np.uint64(48)).astype(np.int64), "right") - 1
                chunk = r.base[node] + ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % r.chunks[node]
                size = r.size[chunk]
                of = np.repeat(np.arange(len(fp)), size)
                at = r.begin[chunk][of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(r.pair[at]), pa.array(r.side[at]), pa.array(np.full(len(of), trie, np.int8)), pa.array(key[of].view(np.int64))], ["pair", "side", "trie", "key"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        key, side = rows["key"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        a, b = np.sort(key[side != 1]), np.sort(key[side == 1])
        own = side[0] == OWN
        if not own and not (len(a) and len(b)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x = np.concatenate([a, b])
        labels = join_nodes(a, None if own else b, distance)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        back = permuted(x, ORDERS[rows["trie"].iloc[0]], back=True).view(np.int64)
        return pd.DataFrame({"a": back[moved], "b": back[labels[moved]]})

    links = fps.select("fp").mapInArrow(spread, "pair long, side byte, trie byte, key long").groupBy("pair").applyInPandas(link, "a long, b long")
    return components(stored(links.distinct()), "a", "b").select(F.col("node").alias("fp"), "root")


def classes(hashed: DataFrame, distance: int) -> DataFrame:
    """fp, root (a fingerprint) and component_id of every distinct fingerprint."""
    fps = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = fps.join(near_components(fps, distance), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "root", "component_id")
    own = F.col("root").isNull()
    return fps.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(own, F.col("first")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+`` and
    4-word shingles; fewer words are one shingle. Fingerprints link at
    ``distance`` or fewer differing bits, links are transitive, and component_id
    is the smallest doc_id reachable, the document's own included.

    Null, empty and blank texts have fingerprint zero, linked like any other.
    Null doc_ids are never a component's smallest; a component of null ids only
    has a null id. Repeated rows come back as often as they occur. Empty table:
    no rows. Other columns are ignored. Copies share a fingerprint and enter the
    tries once, however many they are.
    """
    hashed = stored(fingerprints(docs))
    joined = hashed.join(classes(hashed, distance), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each component, all columns: the smallest doc_id (null last), of several rows with it an arbitrary but fixed one."""
    hashed = stored(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))).alias("row")
    # copies share a fingerprint and are settled before they meet its component
    best = hashed.groupBy("fp").agg(first).join(classes(hashed, distance).select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    return rows_of(docs, best.select("row.rid"))
