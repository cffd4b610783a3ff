"""Packing token sequences by non-negative least squares over a length histogram.

Every document is tokenised once. As many whole windows as it fills go out as
they are; what is left of it, shorter than a window, is counted in a histogram
of lengths. Combinations of two or three lengths that fill a window exactly are
enumerated, and non-negative least squares says how often to use each so that
together they meet the histogram. Rounded to what the histogram holds, they cut
nothing. Residual pieces are packed greedily: longest first, end to end, cut
where a window is full; the last, unfilled window is cut into powers of two.

The histogram and the plan have a size that depends on the window alone. A
piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callflow.llm.shared import documents, stored

WINDOW = 2048
#: Chunks whose ids a task remembers before the older ones are forgotten, and the bytes of the longest.
REMEMBERED, LONGEST = 700_000, 64
#: Chunks encoded in one call, and documents and bytes of text handled at once (one document at least); all bound a task's memory.
CALL, SLICE, SLICE_BYTES = 2048, 4096, 1 << 24
#: Sweeps of the solver at most; it stops earlier when no count moves by half a repeat.
SWEEPS = 200
TOKENS = "doc_id long, ids binary, doc_tokens long, part int, rest int, rest_no long, full_no long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``SLICE`` rows and, unless it is one row, ``SLICE_BYTES`` in ``column``."""
    for batch in batches:
        begin, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch[column]).to_pylist()):
            if i > begin and (i - begin == SLICE or held + size > SLICE_BYTES):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


class Encoder:
    """Token ids of texts as little-endian bytes, by chunks between ASCII white space.

    A tokenizer that splits by a pattern and removes what is between its
    matches drops white space, and no token or normalisation crosses it: the
    ids of a text are those of its chunks. Chunks seen of late are remembered.
    Texts for any other tokenizer are encoded whole.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        split = json.loads(model).get("pre_tokenizer") or {}
        split = (split.get("pretokenizers") or [split])[0]
        pattern = (split.get("pattern") or {}).get("Regex", "")
        self.by_chunk = split.get("behavior") == "Removed" and split.get("invert", False) and pattern.endswith(r"[^\s\p{L}\p{N}]+")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk; the chunks of a call are encoded as one text and told apart by where its tokens begin."""
        out: list[bytes] = []
        for at in range(0, len(chunks), CALL):
            texts = [c.decode() for c in chunks[at : at + CALL]]
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.asarray(encoded.ids, self.kind)
            begins = np.fromiter((x for x, _ in encoded.offsets), np.int64, len(ids))
            ends = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def encode(self, texts: pa.Array, end: int) -> Iterator[bytes]:
        """Ids of each text, then ``end``."""
        last = np.asarray([end], self.kind).tobytes()
        if not self.by_chunk:
            for text in texts.to_pylist():
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + last
            return
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()  # every distinct chunk is looked up once
        distinct = chunks.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, distinct))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        fresh = self.fresh([distinct[i] for i in gaps])
        for i in gaps:
            found[i] = fresh[distinct[i]]
        ids = pa.array(found, pa.binary()).take(chunks.indices)
        for text in pc.binary_join(pa.ListArray.from_arrays(pc.subtract(split.offsets, split.offsets[0]), ids), b""):
            yield text.as_py() + last

    def fresh(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not among the latest ones; now they are."""
        out = {c: ids for c in chunks if (ids := self.older.get(c)) is not None}
        unknown = [c for c in chunks if c not in out]
        out.update(zip(unknown, self.ids(unknown), strict=True))
        self.known.update((c, ids) for c, ids in out.items() if len(c) <= LONGEST)
        return out


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def tokenised(docs: DataFrame, tokenizer: str, end: int, window: int) -> DataFrame:
    """Documents with their ids, the task that made them and their places among that task's documents, in shared files.

    ``rest`` is the length left after whole windows, ``rest_no`` counts those of
    the same rest before it in the task, ``full_no`` the whole windows before it.
    """
    with open(tokenizer, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(model.value), TaskContext.get().partitionId()
        seen, fulls = np.zeros(window, np.int64), 0
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), code.encode(batch["text"], end), strict=True):
                n = len(ids) // code.kind.itemsize
                full, rest = divmod(n, window)
                rows.append((doc_id, ids, n, part, rest, int(seen[rest]), fulls))
                seen[rest] += 1
                fulls += full
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[f.split()[0] for f in TOKENS.split(", ")])

    d = documents(docs)
    return stored(d.withColumn("doc_id", d["doc_id"].cast("long")).mapInArrow(run, TOKENS))


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, falling, of those given, that add up to ``window``; the third is 0 in a pair."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    lengths = np.sort(lengths)
    found = []
    for a in lengths[lengths * 3 >= window].tolist():
        b = lengths[(lengths <= a) & (lengths <= window - a)]
        c = window - a - b
        keep = (c <= b) & there[c]
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_squares(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the combinations with least ``|sum of x * columns - counts|^2``.

    Block coordinate descent: each sweep moves combinations without a length in
    common, those with the largest steps first, to their own minimum. It stops
    when the largest step is below half a repeat, after ``SWEEPS`` at most.
    """
    x = np.zeros(len(columns))
    weight = (columns > 0).astype(float)
    # the squared norm of a column in which a length stands more than once
    norm = sum(weight[:, i] * weight[:, j] * (columns[:, i] == columns[:, j]) for i in range(3) for j in range(3))
    residual = counts.astype(float)
    residual[0] = 0
    for _ in range(SWEEPS if len(columns) else 0):
        step = np.maximum(residual[columns].sum(1) / norm, -x)
        order = np.flatnonzero(np.abs(step) >= 0.5)
        if not len(order):
            break
        order = order[np.argsort(-np.abs(step[order]), kind="stable")]
        free = np.ones(len(counts), bool)
        for i, (a, b, c) in zip(order.tolist(), columns[order].tolist(), strict=True):
            if free[a] and free[b] and (free[c] or not c):
                free[[a, b, c]] = False
                x[i] += step[i]
                for length in (a, b, c):
                    if length:
                        residual[length] -= step[i]
    return x


@dataclass
class Plan:
    """Where the pieces of each length go, by rank.

    ``slots``: per length, parallel arrays of first rank, first sequence and
    offset, the ranks rising; a rank above the first one of a slot goes as many
    sequences further. Ranks from ``loose[length]`` on lie end to end from
    ``begin[length]``, a position in the stream of residual tokens.
    """

    window: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    loose: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: int = 0
    whole: int = 0
    tail: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sequences: int = 0

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of what is ``length`` long and has this rank."""
        if rank < self.loose[length]:
            ranks, sequences, offsets = self.slots[length]
            i = int(np.searchsorted(ranks, rank, "right")) - 1
            return [(0, length, int(sequences[i]) + rank - int(ranks[i]), int(offsets[i]))]
        at, done, out = int(self.begin[length]) + (rank - int(self.loose[length])) * length, 0, []
        while done < length:
            if at < self.whole * self.window:
                sequence, offset, room = self.first + at // self.window, at % self.window, self.window - at % self.window
            else:  # the tail's borders, from its beginning
                beyond = at - self.whole * self.window
                i = int(np.searchsorted(self.tail, beyond, "right")) - 1
                sequence, offset, room = self.first + self.whole + i, beyond - int(self.tail[i]), int(self.tail[i + 1]) - beyond
            n = min(room, length - done)
            out.append((done, n, sequence, offset))
            done, at = done + n, at + n
        return out


def plan_packing(counts: np.ndarray, window: int) -> Plan:
    """Plan for ``counts[length]`` pieces of each length below ``window``."""
    columns = combinations(np.flatnonzero(counts[1:]) + 1, window)
    repeats = least_squares(columns, counts)
    used = np.zeros(window, np.int64)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for i in np.argsort(-repeats, kind="stable"):
        if (n := round(repeats[i])) < 1:
            break
        lengths = [x for x in columns[i].tolist() if x]
        n = min(n, *((int(counts[x]) - int(used[x])) // lengths.count(x) for x in lengths))
        if n < 1:
            continue
        offset = 0
        for x in lengths:
            slots.setdefault(x, []).append((int(used[x]), sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    left = counts - used
    left[0] = 0
    lengths = np.arange(window)
    tokens = left * lengths
    begin = np.zeros(window, np.int64)
    begin[::-1] = np.cumsum(tokens[::-1]) - tokens[::-1]
    whole, rest = divmod(int(tokens.sum()), window)
    tail = np.cumsum([0] + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1])
    arrays = {x: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for x, rows in slots.items()}
    return Plan(window, arrays, used, begin, sequence, whole, tail, sequence + whole + len(tail) - 1)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A document is its token ids (no special tokens added; ``tokenizer`` is the
    path of a tokenizers file on the driver) and the id ``end``. Sequences hold
    at most ``window`` tokens, from offset 0 without a gap, and all but the
    last few are full; those have powers of two as lengths, so none is padded.

    Null and empty text: the id ``end`` alone. Null doc_id and repeated rows:
    documents of their own. Ties: equal lengths rank by the task and row that
    tokenised them. Very long texts: cut into whole windows and a rest. Empty
    table: no rows. Other columns are ignored. The driver holds a histogram of
    ``window`` lengths, tasks a plan of at most as many slots as there are
    combinations of three lengths.
    """
    ids = tokenised(docs, tokenizer, end, window)
    blocks = ids.groupBy("part", "rest").agg(F.count("*").alias("n"))
    # whole windows of a task count as the length ``window``
    fulls = ids.groupBy("part").agg(F.sum(F.expr(f"doc_tokens div {window}")).alias("n")).select("part", F.lit(window).alias("rest"), "n")
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = stored(blocks.unionByName(fulls).withColumn("before", F.coalesce(before, F.lit(0))))
    counts = np.zeros(window, np.int64)
    for r in placed.where(F.col("rest") < window).groupBy("rest").agg(F.sum("n").alias("n")).collect():
        counts[r.rest] = r.n
    plan = docs.sparkSession.sparkContext.broadcast(plan_packing(counts, window))

    rests = placed.where(F.col("rest") < window).select("part", "rest", F.col("before").alias("rest_before"))
    wholes = placed.where(F.col("rest") == window).select("part", F.col("before").alias("full_before"))
    starts = stored(rests.join(wholes, "part"))
    a, b = ids.alias("a"), starts.alias("b")
    ranked = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.rest") == F.col("b.rest"))).select(
        "a.doc_id", "a.ids", "a.doc_tokens", "a.rest", (F.col("a.rest_no") + F.col("b.rest_before")).alias("rest_no"), (F.col("a.full_no") + F.col("b.full_before")).alias("full_no")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = plan.value
        for batch in slices(batches, "ids"):
            rows: list[tuple] = []
            for r in batch.to_pylist():
                n = r["doc_tokens"]
                words = np.frombuffer(r["ids"], f"<u{len(r['ids']) // n}").astype("<u4")
                full = n // window
                cuts = [(i * window, window, places.sequences + r["full_no"] + i, 0) for i in range(full)]
                if r["rest"]:
                    cuts += [(full * window + at, size, sequence, offset) for at, size, sequence, offset in places.place(r["rest"], r["rest_no"])]
                rows += [(r["doc_id"], at, size, zlib.crc32(words[at : at + size]), n, sequence, offset) for at, size, sequence, offset in cuts]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)

    return ranked.mapInArrow(pieces, PIECES)
