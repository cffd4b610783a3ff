"""Remove repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every window of ``length`` bytes is assigned to an anchor, the leftmost smallest
rolling hash in it, so equal windows have equal anchors at equal places. Windows
of one anchor form a span; spans that share the bytes around their anchor meet
in a group, and only in a group can their windows be equal. Groups are joined to
texts of bounded size. For each text a suffix order gives the Burrows-Wheeler
transform; breadth-first backward extension finds the boundaries between
suffixes by increasing common prefix and stops at ``length``. What lies between
two boundaries shares a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import documents, row_id, stored

LENGTH = 400
#: Bytes scanned at a time; positions within them take PLACE bits.
SCANNED, PLACE = 1 << 19, 20
#: Bytes of groups that a task sorts at a time, and of one group before it is refined.
SORTED_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
#: Ends a span; no byte of UTF-8.
END = b"\xff"
ODD = 0x9E3779B97F4A7C15
SPAN = "key long, span long, rid binary, start int, windows int, anchor int"
RUNS = "key long, span long, first int, last int"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Anchors:
    """Anchors of all windows in a piece of bytes."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length * 4 // 25)
        self.side = (length - self.gram) // 2
        n = SCANNED + 2 * length + 1
        self.up, self.down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
        for x in (self.up, self.down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(text, offset, bytes) in batches of about SCANNED bytes; long texts overlap so that no window is lost."""
        batch, held = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text) - self.length + 1, SCANNED):
                piece = text[at : at + SCANNED + self.length - 1]
                if held and held + len(piece) > SCANNED + self.length:
                    yield batch
                    batch, held = [], 0
                batch.append((i, at, piece))
                held += len(piece)
        if batch:
            yield batch

    def spans(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last window, start of the key of each span, in order of the joined pieces."""
        k, length, n = self.gram, self.length, len(joined)
        width = length - k + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(joined, np.uint8) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams &= np.uint64((1 << 64) - (1 << PLACE))
        grams |= np.arange(len(grams), dtype=np.uint64)
        rows = -(-len(grams) // width)
        padded = np.full(rows * width, np.uint64((1 << 64) - 1))
        padded[: len(grams)] = grams
        before = np.minimum.accumulate(padded.reshape(rows, width), axis=1).ravel()
        after = np.minimum.accumulate(padded.reshape(rows, width)[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - length + 1
        least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
        new = np.empty(windows, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        inside = np.ones(windows, bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            inside[max(a, b - length + 1) : b] = False
            if a < windows:
                new[a] = True
        new[1:] |= inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], windows) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        place = (least[first] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        turn = place - self.side
        left, right = first <= turn, last > turn
        lo = np.concatenate([first[left], np.maximum(first, turn + 1)[right]])
        hi = np.concatenate([np.minimum(last, turn)[left], last[right]])
        key = np.concatenate([turn[left], place[right]])
        by = np.argsort(lo, kind="stable")
        return lo[by], hi[by], key[by]

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
        """(text, start, windows, anchor within the span, key bytes, span bytes) of every span."""
        common = self.gram + self.side
        for batch in self.pieces(texts):
            joined = b"".join(p[2] for p in batch)
            sizes = np.array([len(p[2]) for p in batch])
            starts = np.cumsum(sizes) - sizes
            lo, hi, key = self.spans(joined, sizes)
            piece = np.searchsorted(starts, lo, "right") - 1
            text = np.array([p[0] for p in batch])[piece]
            at = np.array([p[1] for p in batch])[piece] + lo - starts[piece]
            for i, s, a, b, c in zip(text.tolist(), at.tolist(), lo.tolist(), hi.tolist(), key.tolist(), strict=True):
                yield i, s, b - a + 1, c - a, joined[c : c + common], joined[a : b + self.length]


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by at least ``length`` bytes, class starts at a smaller depth, that depth.

    Prefix doubling from as many bytes as fit a number; only classes that are
    still tied are sorted again.
    """
    n, depth = len(text), 1
    while depth * 2 <= min(8, length):
        depth *= 2
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key[: n - j] |= text[j:].astype(np.uint64) << np.uint64(8 * (depth - 1 - j))
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.zeros(n, np.int64)
    start[1:] = np.where(key[1:] != key[:-1], np.arange(1, n), 0)
    np.maximum.accumulate(start, out=start)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start
    shallow, at = start.copy(), depth
    while depth < length:
        shallow, at = start.copy(), depth
        tied = np.zeros(n, bool)
        tied[1:] = start[1:] == start[:-1]
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if len(where):
            items = order[where]
            key = (start[where].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(items + depth, n)] + 1).astype(np.uint64)
            by = np.argsort(key)
            key, items = key[by], items[by]
            order[where] = items
            fresh = np.zeros(len(where), np.int64)
            fresh[0] = where[0]
            fresh[1:] = np.where(key[1:] != key[:-1], where[1:], 0)
            start[where] = np.maximum.accumulate(fresh)
            rank[items] = start[where]
        depth *= 2
    return order, shallow, at


def boundaries(text: np.ndarray, order: np.ndarray, shallow: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Where neighbours in the suffix order share fewer than ``length`` bytes.

    Backward extension by one byte turns a boundary at common prefix ``v`` into
    boundaries at ``v + 1``: for each byte that precedes the class behind it, the
    first such suffix there. Boundaries are found breadth first, by increasing
    value, from ``depth`` on; ``shallow`` has the class starts at that depth.
    """
    n = len(text)
    bwt = text[order - 1]
    column = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[column] = np.arange(n)
    before = np.full(n, -1, np.int64)
    same = bwt[column[1:]] == bwt[column[:-1]]
    before[column[1:][same]] = column[:-1][same]
    runs = np.append(np.flatnonzero(bwt[1:] != bwt[:-1]) + 1, n)
    other = np.repeat(runs, np.diff(runs, prepend=0))
    found = np.zeros(n, bool)
    found[shallow] = True
    heads = np.append(np.flatnonzero(found), n)
    end = np.repeat(heads[1:], np.diff(heads))
    if depth >= length:
        return found
    count = np.cumsum(found)
    next_found = np.zeros(n, bool)
    next_found[step] = (before < 0) | (count > count[before])
    edge = np.flatnonzero(next_found & ~found)
    found[edge] = True
    for _ in range(depth, length - 1):
        fresh, p, q, stop = [], edge, edge, end[edge]
        while len(q):
            to = step[q]
            hit = (before[q] >= 0) & (before[q] < p) & ~found[to]
            fresh.append(to[hit])
            q = other[q]
            go = q < stop
            p, q, stop = p[go], q[go], stop[go]
        edge = np.unique(np.concatenate(fresh)) if fresh else edge[:0]
        if not len(edge):
            break
        found[edge] = True
    return found


def repeated_runs(spans: list[bytes], weights: list[int], length: int) -> list[tuple[int, int, int]]:
    """(span, first window, last window) of windows that occur at least twice, a span counting as often as its weight."""
    text = np.frombuffer(END.join(spans) + END, np.uint8)
    sizes = np.array([len(s) + 1 for s in spans])
    owner = np.repeat(np.arange(len(spans)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(text))
    whole = ends[owner] - 1 - place >= length
    order, shallow, depth = suffix_order(text, length)
    group = np.cumsum(boundaries(text, order, shallow, depth, length)) - 1
    total = np.bincount(group, np.asarray(weights, float)[owner[order]] * whole[order])
    repeated = np.zeros(len(text) + 1, bool)
    repeated[order] = total[group] >= 2
    repeated[:-1] &= whole
    turns = np.flatnonzero(np.diff(np.concatenate([[False], repeated]).astype(np.int8)))
    first, last = turns[::2], turns[1::2] - 1
    of = owner[first]
    base = (ends - sizes)[of]
    return list(zip(of.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True))


GROUP = {
    "key": pa.int64(), "origin": pa.int64(), "span": pa.int64(), "weight": pa.int64(), "at": pa.int32(), "anchor": pa.int32(), "low": pa.int32(), "high": pa.int32(), "body": pa.binary()
}


def refine(groups: DataFrame, length: int, limit: int) -> DataFrame:
    """Split groups of more than ``limit`` bytes until none is left.

    The windows of a group lie within ``side`` bytes of its anchor. Those in one
    half of that stretch share more bytes than the key, so each half is grouped
    anew by what it shares; at a single window the key is the window itself.
    ``groups`` has key, span, weight, at (first window, counted in the span),
    anchor, reach (lowest, highest distance of a window from the anchor) and body.
    """
    while True:
        heavy = groups.groupBy("key").agg(F.sum(F.octet_length("body")).alias("bytes"), F.max(F.col("high") - F.col("low")).alias("wide")).where((F.col("bytes") > limit) & (F.col("wide") > 0))
        if heavy.isEmpty():
            return groups
        marked = groups.join(heavy.select("key", F.lit(True).alias("heavy")), "key", "left")

        def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if not r["heavy"] or r["low"] == r["high"]:
                        rows.append(tuple(r[c] for c in GROUP))
                        continue
                    middle = (r["low"] + r["high"]) // 2
                    for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                        # window w of the body begins w - anchor bytes from the anchor
                        a, b = max(0, low + r["anchor"]), min(len(r["body"]) - length, high + r["anchor"])
                        if a > b:
                            continue
                        shared = r["body"][high + r["anchor"] : low + r["anchor"] + length]
                        key = signed(xxhash.xxh3_64_intdigest(shared, (low & 0xFFFF) << 16 | (high & 0xFFFF)))
                        rows.append((key, r["origin"], r["span"], r["weight"], r["at"] + a, r["anchor"] - a, low, high, r["body"][a : b + length]))
                cols = list(zip(*rows, strict=True)) or [[] for _ in GROUP]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, GROUP.values(), strict=True)], list(GROUP))

        groups = stored(marked.mapInArrow(halve, groups.schema))


def arrow(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, columns.values(), strict=True)], list(columns))


def scan(length: int, whole: bool):
    """Keys of all spans, or the spans themselves."""
    columns = {"key": pa.int64(), "span": pa.int64(), "rid": pa.binary(), "start": pa.int32(), "windows": pa.int32(), "anchor": pa.int32()}

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, h = Anchors(length), xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            if not whole:
                keys = np.fromiter((h(k) for *_, k, _ in anchors.of(texts)), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])
                continue
            rids = batch["rid"].to_pylist()
            rows = [(signed(h(k)), signed(h(b, 1)), rids[i], at, n, a) for i, at, n, a, k, b in anchors.of(texts)]
            for part in range(0, max(1, len(rows)), 1 << 16):
                yield arrow(rows[part : part + (1 << 16)], columns)

    return spans


def cut(length: int, low: int):
    """Bytes of the spans that a text was chosen for."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["wanted"].to_pylist(), strict=True):
                yield arrow([(w["key"], w["key"], w["span"], w["weight"], 0, w["anchor"], low, 0, text[w["start"] : w["start"] + w["windows"] - 1 + length]) for w in wanted], GROUP)

    return bodies


def expand(length: int):
    """Repeated windows of whole groups, gathered in key order up to SORTED_BYTES."""
    columns = {"key": pa.int64(), "span": pa.int64(), "first": pa.int32(), "last": pa.int32()}

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        runs = repeated_runs([r[4] for r in rows], [r[3] for r in rows], length)
        return arrow([(rows[i][0], rows[i][1], rows[i][2] + a, rows[i][2] + b) for i, a, b in runs], columns)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, key = [], 0, None
        for batch in batches:
            for k, *r in zip(*(batch[c].to_pylist() for c in ("key", "origin", "span", "at", "weight", "body")), strict=True):
                if k != key and held >= SORTED_BYTES:
                    yield settle(rows)
                    rows, held = [], 0
                key = k
                rows.append(r)
                held += len(r[4])
        if rows:
            yield settle(rows)

    return groups


def finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Take the bytes that repeated windows cover out of each text."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            sizes, kept, spans = [], [], []
            for text, runs in zip(part["text"].cast(pa.binary()).to_pylist(), part["runs"].to_pylist(), strict=True):
                found: list[list[int]] = []
                for a, b in sorted((r["first"], r["last"] + length) for r in runs or ()):
                    if found and a <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], b)
                    else:
                        found.append([a, b])
                edges = [0, *(x for f in found for x in f), len(text)]
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], ["doc_id", "n_bytes", "kept", "spans"]
            )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (start, stop of each removed run) of every document.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else in the table, in the same text included. All copies go, as
    strings are judged on the input.

    Null text: empty. Texts shorter than ``length`` keep everything. Null ids
    and repeated rows are texts like any other, so a repeated row of enough
    bytes goes whole. Empty table: no rows. Other columns are ignored. Texts of
    any length are scanned whole. Groups of any size are split until a task can
    hold one; spans of equal bytes count by their weight and are sent once.
    """
    d = documents(docs)
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    d = d.select("doc_id", "text", row_id(d).alias("rid"))
    long_enough = d.where(F.octet_length("text") >= length)
    keys = long_enough.select("text").mapInArrow(scan(length, False), "key long")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    places = stored(long_enough.select("text", "rid").mapInArrow(scan(length, True), SPAN).join(shared, "key", "left_semi"))

    spans = places.groupBy("key", "span").agg(F.count("*").alias("weight"), F.min(F.struct("rid", "start")).alias("seen"), F.max("windows").alias("windows"), F.max("anchor").alias("anchor"))
    spans = stored(spans)
    several = spans.groupBy("key").count().where("count > 1").select("key")
    alone = spans.join(several, "key", "left_anti").select("key", "span", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    wanted = F.collect_list(F.struct("key", "span", "weight", "windows", "anchor", F.col("seen.start").alias("start")))
    chosen = spans.join(several, "key", "left_semi").groupBy(F.col("seen.rid").alias("rid")).agg(wanted.alias("wanted"))
    anchors = Anchors(length)
    low = anchors.gram + anchors.side - length
    schema = "key long, origin long, span long, weight long, at int, anchor int, low int, high int, body binary"
    bodies = long_enough.select("rid", "text").join(chosen, "rid").select("text", "wanted").mapInArrow(cut(length, low), schema)
    groups = refine(stored(bodies), length, GROUP_BYTES)

    grouped = groups.where("low < high").repartition("key").sortWithinPartitions("key").mapInArrow(expand(length), RUNS)
    single = groups.where("low = high")
    twice = single.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    singles = single.join(twice, "key", "left_semi").select(F.col("origin").alias("key"), "span", F.col("at").alias("first"), F.col("at").alias("last"))
    runs = alone.unionByName(grouped).unionByName(singles)
    run = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    marks = places.join(runs, ["key", "span"]).groupBy("rid").agg(F.collect_list(run).alias("runs"))
    out = "doc_id long, n_bytes long, kept binary, spans array<struct<start: int, stop: int>>"
    return d.join(marks, "rid", "left").select("doc_id", "text", "runs").mapInArrow(lambda batches: finish(batches, length), out)
