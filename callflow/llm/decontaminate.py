"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a run of ``min_match`` words)
are compared: the longest common runs of unmarked words are found by running
Karp-Rabin over ever shorter lengths, marked, and never overlap. An item whose
words are covered by tiles to a given share contaminates the document, in
whatever order its passages occur.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import documents

MIN_MATCH = 5
COVERAGE = 0.6
#: Bytes of benchmark text that are indexed and sent to the tasks at a time.
BLOCK_BYTES = 4 << 20
#: Everything in ASCII that is neither letter nor digit parts words.
PARTS = bytes(32 if chr(i) in string.punctuation + string.whitespace or i < 32 else i for i in range(256))
BASE = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(PARTS).split()


def run_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` ids, modulo 2**64."""
    out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for j in range(length):
        out = out * np.uint64(BASE) + ids[j : len(ids) - length + 1 + j].astype(np.uint64)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x94D049BB133111EB)


@dataclass
class Index:
    """Benchmark items of one block: word numbers, and where each seed occurs."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int | None, np.ndarray]]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    min_match: int


def build_index(rows: Iterable[tuple[int | None, str]], min_match: int) -> Index:
    vocabulary: dict[bytes, int] = {}
    items, seeds, item, place = [], [], [], []
    for item_id, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
        if len(ids) < min_match:
            continue
        seeds.append(run_hashes(ids, min_match))
        item.append(np.full(len(seeds[-1]), len(items), np.int32))
        place.append(np.arange(len(seeds[-1]), dtype=np.int32))
        items.append((item_id, ids))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, item, place)]
    order = np.argsort(joined[0], kind="stable")
    return Index(vocabulary, items, joined[0][order], joined[1][order], joined[2][order], min_match)


def common_runs(a: np.ndarray, b: np.ndarray, a_marked: np.ndarray, b_marked: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs (length, start in a, start in b) of unmarked words, at least ``length`` long."""
    free = lambda marked: np.convolve(marked, np.ones(length, np.int64), "valid") == 0
    if min(len(a), len(b)) < length:
        return []
    ia, ib = np.flatnonzero(free(a_marked)), np.flatnonzero(free(b_marked))
    ha, hb = run_hashes(a, length)[ia], run_hashes(b, length)[ib]
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    count = hi - lo
    of = np.repeat(np.arange(len(hb)), count)
    pa_ = ia[order[lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]]
    pb = ib[of]
    if not len(pa_):
        return []
    by = np.lexsort((pa_, pb - pa_))
    pa_, pb = pa_[by], pb[by]
    new = np.concatenate([[True], (np.diff(pb - pa_) != 0) | (np.diff(pa_) != 1)])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(pa_))) + length - 1
    found = zip(runs.tolist(), pa_[first].tolist(), pb[first].tolist(), strict=True)
    return [(n, i, j) for n, i, j in found if (a[i : i + n] == b[j : j + n]).all()]


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> tuple[int, int]:
    """Words of the item covered by tiles, and the number of tiles."""
    marked, used, tiles = np.zeros(len(item), np.int64), np.zeros(len(text), np.int64), 0
    length = max(min_match, len(item))
    while True:
        runs = sorted(common_runs(item, text, marked, used, length), key=lambda r: (-r[0], r[1], r[2]))
        for n, i, j in runs:
            if not marked[i : i + n].any() and not used[j : j + n].any():
                marked[i : i + n] = 1
                used[j : j + n] = 1
                tiles += 1
        if runs:
            continue
        if length == min_match:
            return int(marked.sum()), tiles
        length = max(min_match, length // 2)


def matches(index: Index, text: str, coverage: float) -> list[tuple[int | None, int, int, int]]:
    """(item_id, words covered, words of the item, tiles) of each item that contaminates the text."""
    k, get = index.min_match, index.vocabulary.get
    ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
    if len(ids) < k:
        return []
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    at = np.flatnonzero(known[k:] - known[:-k] == k)
    if not len(at):
        return []
    hashes = run_hashes(ids, k)[at]
    lo, hi = np.searchsorted(index.seeds, hashes, "left"), np.searchsorted(index.seeds, hashes, "right")
    hit = hi > lo
    if not hit.any():
        return []
    at, lo, count = at[hit], lo[hit], (hi - lo)[hit]
    of = np.repeat(np.arange(len(at)), count)
    entry = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    item, place, where = index.item[entry], index.place[entry], at[of]
    found = []
    for n in np.unique(item):
        mine = item == n
        item_id, words = index.items[n]
        seeded = np.zeros(len(words) + 1, np.int64)
        np.add.at(seeded, np.unique(place[mine]), 1)
        reach = np.convolve(seeded[: len(words)], np.ones(k, np.int64))[: len(words)] > 0
        if reach.sum() < coverage * len(words):
            continue
        # only the words that a seed touches can be in a tile; a number no word has keeps the stretches apart
        touched = np.zeros(len(ids) + k, bool)
        for j in range(k):
            touched[where[mine] + j] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], touched[: len(ids)].astype(np.int8), [0]])))
        stretches = [x for a, b in runs.reshape(-1, 2) for x in (ids[a:b], [-1])]
        covered, tiles = tile(words, np.concatenate(stretches).astype(np.int64), k)
        if covered >= coverage * len(words):
            found.append((item_id, covered, len(words), tiles))
    return found


def blocks(benchmark: DataFrame, min_match: int, block_bytes: int) -> Iterator[Index]:
    """Indexes over the benchmark, each of about ``block_bytes`` of text."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        index = build_index(sorted(((r[0], r[1]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), min_match)
        if index.items:
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered, n_words, coverage of each document and item it contaminates.

    Words are lower-cased and parted by ASCII punctuation and white space. Items
    of fewer than ``min_match`` words are too short to be told and match nothing.
    The benchmark is a query set: it goes to the tasks in blocks of bounded
    size, and each block is held against all documents, which are not shuffled.

    Null and empty texts match nothing. Null ids and repeated rows are reported
    as they are. Runs of equal length are marked in order of their place in the
    item, then in the document. Either table empty: no rows. Other columns are
    ignored.
    """
    schema = "doc_id long, item_id long, n_tiles int, n_covered int, n_words int, coverage double"
    d = documents(docs)
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    out = docs.sparkSession.createDataFrame([], schema)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    for index in blocks(benchmark, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, m[0], m[3], m[1], m[2], m[1] / m[2]) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for m in matches(shared.value, t, coverage)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "item_id", "n_tiles", "n_covered", "n_words", "coverage"])

        out = out.unionByName(d.mapInArrow(search, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whatever their columns, that no benchmark item contaminates."""
    text = docs.columns.index("text")
    for index in blocks(benchmark, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not (t and matches(shared.value, t, coverage)) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
