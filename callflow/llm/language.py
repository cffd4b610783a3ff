"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter keeps its maximum, and a softmax layer gives a probability
per language. The network is trained in numpy. For prediction the embedding and
the filters are folded into tables over byte pairs, so a window needs two
lookups per byte; a text's prediction is the mean over all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import documents, only

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray  # languages


def windows(text: bytes) -> np.ndarray:
    """All windows of a text in ASCII lower case, the last one padded with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text.lower(), np.uint8)
    return out.reshape(n, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(data: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network by Adam on windows and the number of their language."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(total), "w": rng.normal(0, 0.1, (total, len(languages))), "o": np.zeros(len(languages))}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            x, n = data[take].astype(np.int64), len(take)
            short = rng.random(n) < 0.4  # texts shorter than a window must be told apart too
            x[short[:, None] & (np.arange(WINDOW) >= rng.integers(8, WINDOW + 1, n)[:, None])] = 0
            emb = p["e"][x]
            pooled, where = [], []
            for w in WIDTHS:
                spans = np.concatenate([emb[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                conv = spans @ p[f"f{w}"]
                best = conv.argmax(axis=1)
                pooled.append(np.take_along_axis(conv, best[:, None], axis=1)[:, 0])
                where.append((spans, best))
            raw = np.concatenate(pooled, axis=1) + p["b"]
            hidden = np.maximum(raw, 0)
            delta = softmax(hidden @ p["w"] + p["o"])
            delta[np.arange(n), labels[take]] -= 1
            delta /= n
            back = (delta @ p["w"].T) * (raw > 0)
            grad = {"w": hidden.T @ delta, "o": delta.sum(axis=0), "b": back.sum(axis=0), "e": np.zeros_like(p["e"])}
            rows = np.arange(n)[:, None]
            for i, w in enumerate(WIDTHS):
                spans, best = where[i]
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = spans[rows, best]  # n x FILTERS x (w * EMBEDDING)
                grad[f"f{w}"] = np.einsum("nfd,nf->df", chosen, g)
                to_bytes = g[:, :, None] * p[f"f{w}"].T[None]
                for j in range(w):
                    np.add.at(grad["e"], x[rows, best + j], to_bytes[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p["e"], [p[f"f{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS], p["b"], p["w"], p["o"])


class Predictor:
    """The network folded into tables over byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        if not net.languages:
            return
        first, second, third = [], [], []
        for w, f in zip(WIDTHS, net.filters, strict=True):
            t = [net.embedding @ f[j] for j in range(w)]
            first.append(t[0])
            second.append(t[1])
            if w > 2:
                third.append((t[2], t[3] if w > 3 else np.zeros_like(t[2])))
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        self.head = pair(np.concatenate(first, axis=1), np.concatenate(second, axis=1))
        self.tail = pair(np.concatenate([a for a, _ in third], axis=1), np.concatenate([b for _, b in third], axis=1))

    def texts(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        names, scores = [], []
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256)
            known = [bool(self.net.languages and t and LETTER.search(t)) for t in part.to_pylist()]
            chosen = [windows(t) for t, k in zip(part.cast(pa.binary()).to_pylist(), known, strict=True) if k]
            if chosen:
                stacked = np.concatenate(chosen)
                weights = (stacked != 0).sum(axis=1, keepdims=True).astype(float)
                starts = np.cumsum([0, *map(len, chosen[:-1])])
                means = np.add.reduceat(self.probabilities(stacked) * weights, starts) / np.maximum(np.add.reduceat(weights, starts), 1)
                best = iter(zip(means.argmax(axis=1).tolist(), means.max(axis=1).tolist(), strict=True))
            for k in known:
                i, s = next(best) if k else (None, 0.0)
                names.append(self.net.languages[i] if k else "und")
                scores.append(min(1.0, max(0.0, s)))
        return names, scores

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """Probability of each language for each window."""
        out = []
        for at in range(0, len(data), 64):
            x = data[at : at + 64].astype(np.int64)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            head = self.head[pairs]
            two = head[:, :, :FILTERS].max(axis=1)
            three = head[:, : WINDOW - 2, FILTERS : 2 * FILTERS]
            # the pair at offset 2 covers the third byte of width 3 and, one position fewer, the third and fourth of width 4
            padded = np.concatenate([pairs[:, 2:], x[:, -1:] * 256], axis=1)
            tail = self.tail[padded]
            three = (three + tail[:, :, :FILTERS]).max(axis=1)
            four = (head[:, : WINDOW - 3, 2 * FILTERS :] + tail[:, : WINDOW - 3, FILTERS:]).max(axis=1)
            hidden = np.maximum(np.concatenate([two, three, four], axis=1) + self.net.bias, 0)
            out.append(softmax(hidden @ self.net.weights + self.net.offset))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))


def sample_windows(labelled: DataFrame, per_language: int, per_text: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Up to about ``per_language`` texts of each language and ``per_text`` windows of each, in a seeded order."""
    rows = documents(labelled, "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)).cast("double") / float(1 << 53)
    totals = rows.groupBy("lang").count()  # a row per language, as many as the network tells apart
    picked = rows.join(F.broadcast(totals), "lang").where(chance < per_language / F.col("count")).select("lang", "text", chance.alias("chance"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, text, c in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["chance"].to_pylist(), strict=True):
                w = windows(text)
                every = max(1, len(w) // per_text)
                found += [(lang, c, i, w[i].tobytes()) for i in range(0, len(w), every)][:per_text]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int32(), pa.binary()), strict=True)], ["lang", "chance", "no", "bytes"])

    got = sorted(tuple(r) for r in picked.mapInArrow(cut, "lang string, chance double, no int, bytes binary").collect())
    languages = sorted({g[0] for g in got})
    data = np.frombuffer(b"".join(bytes(g[3]) for g in got), np.uint8).reshape(-1, WINDOW)
    return data, np.array([languages.index(g[0]) for g in got], np.int64), languages


def fit(labelled: DataFrame, per_language: int = 400, per_text: int = 6, seed: int = 7) -> Network:
    """Train on labelled rows (doc_id, text, lang).

    The sample is bounded by ``per_language`` texts of each language (chosen by
    a hash, so slightly more or fewer) and ``per_text`` windows of each; rows
    with a null language or no text teach nothing.
    """
    data, labels, languages = sample_windows(labelled, per_language, per_text, seed)
    return train(data, labels, languages, seed=seed) if languages else Network([], np.zeros(0), [], *[np.zeros(0)] * 3)


def predict(docs: DataFrame, net: Network, *keep: str) -> DataFrame:
    """Add lang_pred and score to doc_id and the columns named in ``keep``.

    The score is the mean probability of the predicted language over all windows
    of the whole text, each weighed by its bytes. ``und`` with score 0 where the
    text is null, empty or without a letter, or where nothing was learned.
    Equal probabilities: the language first in order. Null ids and repeated rows
    come back as they are. Empty table: no rows. No rows are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = documents(docs, *keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            names, scores = predictor.texts(batch["text"])
            rest = [batch[n] for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [n for n in batch.schema.names if n != "text"] + ["lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(apply, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network, least: float) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text has a language, with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            names, scores = predictor.texts(batch.column(text))
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify_languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    labelled = docs.where(~held_out(docs["doc_id"])).select(*only(docs, "doc_id", "text", "lang"))
    out = predict(docs, fit(labelled, per_language))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
