"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted texts. Words that make up a millionth of the
trusted words or more are its vocabulary, so everything sent to all tasks has at
most a million entries. The others form a pool that stands as one word in the
bigrams; charged, a word of the pool takes only its own share of the pool's
probability. Counts of bigrams and of pooled words grow with the input and live
in shards by their hash. A document's bigrams are
settled where it is read if they are very frequent (a millionth of all bigrams
or more, again a million at most); the others meet their counts in the shards.
Perplexities above a quantile of held-out trusted texts of the same language are
turned down.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import documents, only, stored

#: Relative frequency from which a word is in the vocabulary and a bigram is frequent.
FREQUENT = 1e-6
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]")
ID_BITS = 20
#: Keys of pooled words stand above those of all bigrams.
POOLED = 1 << 62
#: Trusted words per shard of the model, bigrams and distinct words held before a task writes their counts, documents scored at a time.
SHARD_WORDS, COUNTED, COUNTED_WORDS, SCORED = 2_000_000, 1 << 19, 1 << 17, 512
#: Bits of the filters that spare needless shuffling; a fixed size, so a filter grows weaker, not larger.
FILTER_BITS = 1 << 26
QUANTILE = 0.99
UNKNOWN = 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def columns(df: DataFrame) -> list[np.ndarray]:
    """Integer columns of a frame of bounded size, collected as Arrow."""
    table = df.toArrow()
    return [table.column(i).to_numpy() for i in range(table.num_columns)]


class Filter:
    """Bloom filter over 64-bit keys: never denies a key it holds."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, low = mixed(keys), np.uint64(FILTER_BITS - 1)
        return h & low, (h >> np.uint64(32)) & low

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From a column of longs; the words of the filter, a fixed number, are all that is collected."""

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(cls.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
                word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

        found = keys.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        word, mask = columns(found)
        words[word] = mask.view(np.uint64)
        return cls(words)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest bytes; the upper ones are nearly all alike and take no room."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, whose upper bytes are mostly zero."""
    return planes(np.diff(keys, prepend=np.int64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.int64))


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (compressed) of the documents whose id is in ``ids``; most others are left out before the join."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter.of(ids))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value.holds(batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([zlib.compress(t, 3) for t in batch["text"].cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "body"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(likely, "doc_id long, body binary").join(ids, "doc_id", "left_semi").select("body")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for body in batch["body"].to_pylist():
            counts.update(TOKEN.findall(zlib.decompress(body).lower()))
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts.clear()
    yield out()


def bigrams(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Keys of the bigrams of a text; the first word follows the start mark, the id after the vocabulary."""
    ids = np.array([len(vocabulary) + 1, *[vocabulary.get(w, UNKNOWN) for w in words]], np.int64)
    return (ids[:-1] << ID_BITS) | ids[1:]


def pooled_keys(words: list[bytes]) -> np.ndarray:
    return np.array([POOLED | xxhash.xxh64_intdigest(w) >> 2 for w in words], np.int64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by shard, and the shard of each."""
    shard = (mixed(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def in_shards(keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """A row of packed keys and counts for each shard that has some of the sorted keys."""
    order, shard = by_shard(keys, shards)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[edges[:-1]], pa.int64()), pa.array([packed(keys[p]) for p in parts], pa.binary()), pa.array([counts[p].astype(np.int64).tobytes() for p in parts], pa.binary())],
        ["shard", "keys", "counts"],
    )


def discounts(counts: dict[int, float]) -> np.ndarray:
    """Discount of a count of 0, 1, 2, and 3 or more, from how many occur once to four times."""
    n = [counts.get(i, 0.0) for i in range(5)]
    if not (n[1] and n[2]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
    return np.clip(np.array(d), [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


@dataclass
class Model:
    """What every task needs of the model; bounded by the vocabulary."""

    vocabulary: dict[bytes, int]
    total: np.ndarray  # occurrences of each word as a context
    backoff: np.ndarray  # log weight of the lower order after each context
    lower: np.ndarray  # log probability of each word in the lower order
    discount: np.ndarray
    frequent: np.ndarray  # keys of frequent bigrams, sorted
    gain: np.ndarray  # what each adds to the backed-off log probability
    held: Filter  # bigrams and pooled words the model has
    shards: int
    pool: float = 0.0  # log of the trusted words outside the vocabulary
    charged: bool = True  # whether a word of the pool takes only its share

    def gains(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability of counted bigrams less the backed-off one; of pooled words, what their count adds to a word seen once."""
        if len(keys) and keys[-1] >= POOLED:
            of = np.searchsorted(keys, POOLED)
            return np.concatenate([self.gains(keys[:of], counts[:of]), np.log(counts[of:])])
        v, w = keys >> ID_BITS, keys & ((1 << ID_BITS) - 1)
        back = self.backoff[v] + self.lower[w]
        own = (counts - self.discount[np.minimum(counts, 3)]) / self.total[v]
        return np.log(own + np.exp(back)) - back


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Train on a column ``body`` of compressed texts. Returns the bounded part and the shards of bigram counts."""
    spark = texts.sparkSession
    words = texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * FREQUENT))
    kept = words.where(F.col("n") >= least).select("word").toArrow().column(0)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(kept.to_pylist()))}
    pool = words.where(F.col("n") < least).agg(F.sum("n")).first()[0] or 0
    shards = max(8, -(-total // SHARD_WORDS))
    shared = spark.sparkContext.broadcast(vocabulary)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return in_shards(keys, counts, shards)

        for batch in batches:
            for body in batch["body"].to_pylist():
                found.append(bigrams(TOKEN.findall(zlib.decompress(body).lower()), shared.value))
                held += len(found[-1])
                if held > COUNTED:
                    yield out()
                    found, held = [], 0
        yield out()

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpacked(k) for k in rows["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in rows["counts"]])
        key, inverse = np.unique(keys, return_inverse=True)
        summed = np.bincount(inverse, counts, len(key)).astype(np.int64)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "keys": [packed(key)], "counts": [summed.tobytes()]})

    def count_pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = pooled_keys(batch["word"].to_pylist()), batch["n"].to_numpy(zero_copy_only=False)
            order = np.argsort(keys)
            yield in_shards(keys[order], counts[order], shards)

    schema = "shard long, keys binary, counts binary"
    model = stored(texts.mapInArrow(count_bigrams, schema).groupBy("shard").applyInPandas(add, schema))

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: context, with its occurrences and followers seen once, twice, more often; 1: word, with the contexts before it; 2: bigrams by count; 3: frequent ones."""
        for batch in batches:
            for data, number in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                keys, counts = unpacked(data), np.frombuffer(number, np.int64)
                v, at = np.unique(keys >> ID_BITS, return_inverse=True)
                w, seen = np.unique(keys & ((1 << ID_BITS) - 1), return_counts=True)
                c, many = np.unique(np.minimum(counts, 5), return_counts=True)
                big = counts >= max(1, total * FREQUENT)
                one = [np.bincount(at, counts, len(v)), *[np.bincount(at, k, len(v)) for k in (counts == 1, counts == 2, counts > 2)]]
                blank = lambda n: [np.zeros(n)] * 3
                parts = [(0, v, one), (1, w, [seen, *blank(len(w))]), (2, c, [many, *blank(len(c))]), (3, keys[big], [counts[big], *blank(big.sum())])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(i), k) for k, i, _ in parts]), pa.int32()), pa.array(np.concatenate([i for _, i, _ in parts]), pa.int64())]
                    + [pa.array(np.concatenate([x[j] for *_, x in parts]).astype(np.int64)) for j in range(4)],
                    ["kind", "id", "a", "b", "c", "d"],
                )

    stats = model.mapInArrow(statistics, "kind int, id long, a long, b long, c long, d long").groupBy("kind", "id").agg(*[F.sum(x).alias(x) for x in "abcd"])
    kind, *rest = columns(stats)
    context, word, number, big = ([x[kind == k] for x in rest] for k in range(4))
    size = len(vocabulary) + 2
    d = discounts(dict(zip(number[0].tolist(), number[1].tolist(), strict=True)))
    at, n, once, twice, more = context
    totals, backoff = np.ones(size), np.zeros(size)
    totals[at] = n
    backoff[at] = np.log((d[1] * once + d[2] * twice + d[3] * more) / n)
    before = np.zeros(size)
    before[word[0]] = word[1]
    dl = discounts(Counter(before[before > 0].astype(int).tolist()))
    spared = dl[np.minimum(before, 3).astype(int)]
    lower = np.log((before - spared) / max(1.0, before.sum()) + (spared.sum() / before.sum() if before.sum() else 1.0) / (size - 1))
    # words seen once count like unseen ones and need no entry
    rare = stored(words.where(F.col("n").between(2, least - 1)).mapInArrow(count_pooled, schema).groupBy("shard").applyInPandas(add, schema))
    model = model.unionByName(rare)
    keys = model.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(unpacked(k))], ["key"]) for b in batches for k in b["keys"].to_pylist()), "key long")
    order = np.argsort(big[0])
    out = Model(vocabulary, totals, backoff, lower, d, big[0][order], np.zeros(0), Filter.of(keys), int(shards), math.log(max(1, pool)))
    out.gain = out.gains(out.frequent, big[1][order])
    return out, model


ROUTED = {
    "shard": pa.int64(), "kind": pa.int32(), "batch": pa.int64(), "at": pa.binary(), "keys": pa.binary(), "counts": pa.binary(),
    "doc_id": pa.list_(pa.int64()), "lang": pa.list_(pa.string()), "words": pa.list_(pa.int64()), "base": pa.list_(pa.float64()),
}
ROUTED_SQL = "shard long, kind int, batch long, at binary, keys binary, counts binary, doc_id array<long>, lang array<string>, words array<long>, base array<double>"


def routed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in ROUTED.items()], list(ROUTED))


def log_probabilities(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, lang, words, log_probability of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = shared.value, TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, len(whole), SCORED):
                batch = whole.slice(start, SCORED)
                split = [TOKEN.findall(t.lower()) for t in batch["text"].cast(pa.binary()).to_pylist()]
                made = [bigrams(words, m.vocabulary) for words in split]
                sizes = np.array([len(x) for x in made])
                doc, keys = np.repeat(np.arange(len(made)), sizes), np.concatenate(made)
                score = m.backoff[keys >> ID_BITS] + m.lower[keys & ((1 << ID_BITS) - 1)]
                place = np.searchsorted(m.frequent, keys)
                known = np.zeros(len(keys), bool)
                if len(m.frequent):
                    place = np.minimum(place, len(m.frequent) - 1)
                    known = m.frequent[place] == keys
                    score[known] += m.gain[place[known]]
                if m.charged:
                    unknown = (keys & ((1 << ID_BITS) - 1)) == UNKNOWN
                    score[unknown] -= m.pool
                base = np.bincount(doc, score, len(made))
                if m.charged:
                    keys = np.concatenate([keys, pooled_keys([w for words in split for w in words if w not in m.vocabulary])])
                    doc, known = np.concatenate([doc, doc[unknown]]), np.concatenate([known, np.zeros(unknown.sum(), bool)])
                ask = ~known & m.held.holds(keys.view(np.uint64))
                order = np.argsort(keys[ask], kind="stable")
                wanted, of = keys[ask][order], doc[ask][order]
                by, shard = by_shard(wanted, m.shards)
                edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
                rows = [{"shard": int(shard[a]), "kind": 1, "batch": number, "at": planes(of[by[a:b]].astype(np.uint16)), "keys": packed(wanted[by[a:b]])} for a, b in zip(edges[:-1], edges[1:], strict=True)]
                rows.append({"shard": number % m.shards, "kind": 2, "batch": number, "doc_id": batch["doc_id"].to_pylist(), "lang": batch["lang"].to_pylist(), "words": sizes.tolist(), "base": base.tolist()})
                number += 1
                yield routed(rows)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a shard come first; requests leave as gains per document, all else passes."""
        m, keys, gains = shared.value, np.zeros(0, np.int64), np.zeros(0)
        shard = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    # bigrams and pooled words of a shard come as a row each
                    if r["shard"] != shard:
                        shard, keys, gains = r["shard"], np.zeros(0, np.int64), np.zeros(0)
                    more = unpacked(r["keys"])
                    keys, gains = np.concatenate([keys, more]), np.concatenate([gains, m.gains(more, np.frombuffer(r["counts"], np.int64))])
                    order = np.argsort(keys, kind="stable")
                    keys, gains = keys[order], gains[order]
                elif r["kind"] == 2:
                    rows.append(r)
                elif r["shard"] == shard and len(keys):
                    wanted, at = unpacked(r["keys"]), numbers(r["at"], np.uint16)
                    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    got = np.bincount(at, np.where(keys[place] == wanted, gains[place], 0.0), SCORED)
                    hit = np.flatnonzero(got)
                    if len(hit):
                        rows.append({"kind": 1, "batch": r["batch"], "at": hit.astype(np.uint16).tobytes(), "counts": got[hit].tobytes()})
            yield routed(rows)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["kind"] == 2].iloc[0]
        score = np.array(head["base"], float)
        parts = rows[rows["kind"] == 1]
        # gains are added in the order of their documents and size, so that reruns agree to the last bit
        at = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, np.uint16) for x in parts["at"]]]).astype(np.int64)
        gain = np.concatenate([np.zeros(0), *[np.frombuffer(x, float) for x in parts["counts"]]])
        by = np.lexsort((gain, at))
        score += np.bincount(at[by], gain[by], len(score))[: len(score)]
        return pd.DataFrame({"doc_id": pd.array(list(head["doc_id"]), "Int64"), "lang": list(head["lang"]), "words": np.array(head["words"], np.int64), "log_probability": score})

    asked = docs.select("doc_id", "text", "lang").mapInArrow(read, ROUTED_SQL)
    none = [F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in ROUTED_SQL.split(", ")[6:]]
    have = counts.select("shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("batch"), F.lit(None).cast("binary").alias("at"), "keys", "counts", *none)
    met = have.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(look_up, ROUTED_SQL)
    return met.select("kind", "batch", "at", "counts", "doc_id", "lang", "words", "base").groupBy("batch").applyInPandas(gather, "doc_id long, lang string, words long, log_probability double")


def classify_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, charged: bool = False) -> DataFrame:
    """doc_id, lang, words, perplexity, threshold, kept of every document.

    Trusted are documents labelled quality 1 and not toxic; four fifths of them
    (by crc32 of the id) train the model, the rest sets the thresholds: the
    ``quantile`` of their perplexity in each language. Languages without such
    texts, null included, take the quantile over all. Kept is a perplexity at or
    below the threshold. ``charged``: a word outside the vocabulary has the
    probability of the pool times its share of the pooled trusted words, an unseen
    one that of a word seen once; else each has that of the whole pool.

    Null and empty texts have no perplexity and are not kept. A null doc_id is
    never trusted. Repeated rows come back as often as they occur; repeated
    labels count once. Without a trusted text thresholds are null and every
    document with a word is kept. Empty table: no rows. Other columns are ignored.
    """
    d = documents(docs, "lang")
    d = d.withColumn("doc_id", d["doc_id"].cast("long"))
    doc_id, quality, toxic = only(labels, "doc_id", "quality", "toxic")
    marked = labels.select(doc_id.cast("long").alias("doc_id"), quality, toxic).where("doc_id IS NOT NULL")
    trusted = marked.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select("doc_id")
    aside = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model, counts = fit(stored(trusted_texts(d, trusted.where(~aside))))
    model.charged = charged
    scored = stored(log_probabilities(d, model, counts))
    perplexity = F.when(F.col("words") > 0, F.exp(-F.col("log_probability") / F.col("words")))
    scored = scored.select("doc_id", "lang", "words", perplexity.alias("perplexity"))
    base = scored.join(trusted.where(aside), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    at = F.percentile_approx("perplexity", quantile, 100000)
    own = base.where("lang IS NOT NULL").groupBy("lang").agg(at.alias("own"))
    every = base.agg(at).first()[0]
    limits = scored.join(own, "lang", "left")
    limit = F.coalesce("own", F.lit(every).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return limits.select("doc_id", "lang", "words", "perplexity", limit.alias("threshold"), kept.alias("kept"))
