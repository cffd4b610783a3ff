"""Mixing, quality and the pipeline against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callflow.llm import language, mixing, quality
from callflow.llm.shared import stored

WEIGHTS = (5, 2, 1)


def plain_targets(sizes):
    """Share by weight, stop at twice a source's size, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
        free -= above
        left -= sum(target[s] for s in above)
    return target


def assert_near(target, taken, documents):
    """No other choice of documents comes nearer to a source's target."""
    for source in target:
        sizes = [n for s, n in documents if s == source]
        whole = sum(sizes)
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        goal = round(target[source])
        copies = goal // whole if whole else 0
        assert abs(taken[source] - goal) == min(abs(copies * whole + x - goal) for x in sums)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    rows = df.collect()
    sizes, docs = Counter(), Counter()
    for r in rows:
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        docs[r.doc_id, r.source, n] += 1
    target = plain_targets(sizes)
    got = mixing.mix_sources(df).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == docs
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r.size and r.copies <= 2
        taken[r.source] += r.taken
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    assert_near(target, taken, [(r.source, r.size) for r in got])


def test_mix_splits_heavy_lengths(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(3000)], "doc_id long, text string, source string")
    once, again = (Counter((r.source, r.copies) for r in mixing.mix_sources(df, group_rows=n).collect()) for n in (50, 10_000))
    assert once == again and sum(once.values()) == 3000


def test_knapsack():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes, counts = np.unique(rng.integers(1, 15, 4)), None
        counts = rng.integers(0, 4, len(sizes))
        budget = int(rng.integers(0, 40))
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        take = mixing.knapsack(sizes, counts, budget)
        assert (take <= counts).all() and abs(int(take @ sizes) - budget) == min(abs(x - budget) for x in sums)


def test_fit_counts_is_close_for_large_budgets():
    rng = np.random.default_rng(8)
    sizes = np.arange(0, 3000)
    counts = rng.integers(0, 50, 3000)
    budget = int(sizes @ counts) // 3
    take = mixing.fit_counts(sizes, counts, budget)
    assert (take <= counts).all() and int(take @ sizes) == budget


def plain_model(texts):
    """Interpolated modified Kneser-Ney over bigrams, in dictionaries."""
    split = [quality.TOKEN.findall(t.encode().lower()) for t in texts]
    words = Counter(w for s in split for w in s)
    total = sum(words.values())
    vocabulary = {w for w, n in words.items() if n >= max(2, math.ceil(total * 1e-6))}
    unk = lambda w: w if w in vocabulary else None
    pairs = Counter(p for s in split for p in zip(["^", *map(unk, s)], map(unk, s), strict=False))

    def discount(values):
        n = Counter(min(v, 5) for v in values)
        if not (n[1] and n[2]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
        return [0, *(min(max(x, 0.01), i) for i, x in zip((1, 2, 3), d, strict=True))]

    high = discount(pairs.values())
    before = Counter(w for _, w in pairs)
    low = discount(before.values())
    context = defaultdict(Counter)
    for (v, w), n in pairs.items():
        context[v][w] = n
    size, types = len(vocabulary) + 1, sum(before.values())
    spare = sum(low[min(n, 3)] for n in before.values()) / types if types else 1.0

    def lower(w):
        return (before[w] - low[min(before[w], 3)]) / max(1, types) + spare / size

    def probability(v, w):
        seen = context.get(v)
        if not seen:
            return lower(w)
        n = sum(seen.values())
        return (seen[w] - high[min(seen[w], 3)]) / n + sum(high[min(c, 3)] for c in seen.values()) / n * lower(w)

    def perplexity(text):
        s = [unk(w) for w in quality.TOKEN.findall(text.encode().lower())]
        return math.exp(-sum(math.log(probability(v, w)) for v, w in zip(["^", *s], s, strict=False)) / len(s)) if s else None

    return perplexity


def trusted(labels):
    q, t = {}, {}
    for r in labels:
        if r.doc_id is not None:
            q[r.doc_id] = min(q.get(r.doc_id, 1), r.quality if r.quality is not None else 1)
            t[r.doc_id] = max(t.get(r.doc_id, 0), r.toxic or 0)
    return {d for d in q if q[d] == 1 and not t[d]}


@pytest.mark.parametrize("frequent", [1e-6, 1e-3])
def test_perplexity_equals_a_plain_model(spark, docs, monkeypatch, frequent):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ids = trusted(labels.collect())
    rows = docs.collect()
    learn = {d for d in ids if zlib.crc32(str(d).encode()) % 5}
    if frequent != 1e-6:
        # fewer frequent bigrams, so that more of them meet in the shards; the vocabulary stays
        original = quality.fit

        def fewer(texts):
            model, counts = original(texts)
            model.frequent, model.gain = model.frequent[::7], model.gain[::7]
            return model, counts

        monkeypatch.setattr(quality, "fit", fewer)
    perplexity = plain_model([r.text or "" for r in rows if r.doc_id in learn])
    got = {r.doc_id: r for r in quality.classify_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = perplexity(r.text or "")
        assert (want is None and got[r.doc_id].perplexity is None) or math.isclose(got[r.doc_id].perplexity, want, rel_tol=1e-6)
    by = defaultdict(list)
    for r in rows:
        if r.doc_id in ids - learn and got[r.doc_id].perplexity is not None:
            by[r.lang].append(got[r.doc_id].perplexity)
    for r in got.values():
        if by[r.lang]:
            values = sorted(by[r.lang])
            assert r.threshold == values[math.ceil(0.99 * len(values)) - 1]
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold)


@pytest.mark.parametrize("share", [1e-6, 1e-3])
def test_words_outside_the_vocabulary_take_their_share_of_the_pool(spark, docs, monkeypatch, share):
    monkeypatch.setattr(quality, "FREQUENT", share)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    strange = spark.createDataFrame([(-1, " ".join(f"zq{i}xv" for i in range(300)), "en")], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionByName(strange)
    learn = {d for d in trusted(labels.collect()) if zlib.crc32(str(d).encode()) % 5}
    split = {r.doc_id: quality.TOKEN.findall((r.text or "").encode().lower()) for r in df.collect()}
    words = Counter(w for d in learn for w in split.get(d, ()))
    least = max(2, math.ceil(sum(words.values()) * share))
    pool = sum(n for n in words.values() if n < least)
    bare = {r.doc_id: r for r in quality.classify_quality(df, labels).collect()}
    got = {r.doc_id: r for r in quality.classify_quality(df, labels, charged=True).collect()}
    assert share == 1e-6 or any(2 <= n < least for n in words.values())
    for d, s in split.items():
        charge = sum(math.log(pool / max(1, words[w])) for w in s if words[w] < least)
        assert not s or math.isclose(math.log(got[d].perplexity / bare[d].perplexity) * len(s), charge, rel_tol=1e-6, abs_tol=1e-6)
    assert bare[-1].kept and not got[-1].kept


def test_quality_edge_rows(spark, odd, none):
    schema = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame([(1, 1, 0, "x"), (7, 1, None, "x"), (7, 1, 0, "x"), (8, None, 0, "x"), (None, 1, 0, "x"), (9, 1, 1, "x")], schema)
    got = quality.classify_quality(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(r.perplexity is None and not r.kept for r in got if r.words == 0)
    bare = quality.classify_quality(odd, labels.limit(0)).collect()
    assert all(r.threshold is None and r.kept == (r.words > 0) for r in bare)
    assert quality.classify_quality(none, labels).count() == 0


def plain_pipeline(spark, docs, folder):
    from test_dedup import SPACES, plain_components
    from test_text import plain_tiles

    from callflow.llm.decontaminate import words_of

    net = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    predictor = language.Predictor(net)
    import pyarrow as pa

    rows = docs.collect()
    names, scores = predictor.texts(pa.array([r.text or "" for r in rows], pa.string()))
    rows = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= 0.3]
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(SPACES)].append(r)
    rows = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    classes = {d: c for d, _, c in plain_components([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if classes[r.doc_id] == r.doc_id]
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def dirty(text):
        words = words_of(text)
        have = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item, g in zip(items, grams, strict=True):
            if len(g & have) * 5 >= 0.6 * len(item) and plain_tiles(item, words, 5) >= 0.6 * len(item):
                return True
        return False

    rows = [r for r in rows if not dirty(r.text)]
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text.encode().split())
    return {r.doc_id for r in rows}, plain_targets(sizes)


def test_pipeline(spark, docs):
    folder = "/root/testdata/sf0.001"
    kept, targets = plain_pipeline(spark, docs, folder)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(spark, at, folder))
        assert at.columns == docs.columns, name
    assert sorted(r.doc_id for r in at.collect()) == sorted(kept)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= kept and all(r.copies > 0 for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9)
    at = at.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("size"))
    assert_near(targets, taken, [(r.source, r.size) for r in at.collect()])


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    folder = "/root/testdata/sf0.001"
    for df in (odd, none):
        at = df
        for _, stage in corpus_pipeline.STAGES:
            at = stored(stage(spark, at, folder))
        assert (at.count() > 0) == (df is odd)
        assert stored(corpus_pipeline.drop_near_copies(spark, df, folder)).columns == df.columns
