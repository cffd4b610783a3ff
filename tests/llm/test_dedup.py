"""Near, exact and substring deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from callflow.llm import exact_dedup, queries, repeats, simhash
from callflow.llm.components import components

SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=4):
    """(doc_id, fingerprint, component) of (doc_id, text) rows, all pairs compared."""
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = defaultdict(list)
    for (doc_id, _), x in zip(rows, label, strict=True):
        if doc_id is not None:
            least[x].append(doc_id)
    return [(r[0], f"{f:016x}", min(least[x], default=None)) for r, f, x in zip(rows, fps, label, strict=True)]


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    want = plain_components([(r.doc_id, r.text) for r in df.collect()])
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == Counter(want)


def test_trie_join_at_every_cut():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = [v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for v in base[:150] for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = np.arange(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)
        simhash.merge(want, np.full(len(j), i), j)
    for most in (20, 200, 5000):
        got, pairs = np.arange(len(fps)), 0
        for order in simhash.ORDERS:
            key = simhash.permuted(fps, order)
            assert (simhash.permuted(key, order, back=True) == fps).all()
            slot = (key >> np.uint64(48)).astype(int)
            r, pairs = simhash.top_routes(np.bincount(slot, minlength=1 << 16), 4, most, pairs)
            chunk = r.base[np.searchsorted(r.starts, slot, "right") - 1]
            met = defaultdict(list)
            for i, c in enumerate(chunk):
                for e in range(r.begin[c], r.begin[c] + r.size[c]):
                    met[int(r.pair[e])].append((int(r.side[e]), int(key[i]), i))
            for rows in met.values():
                a, b = (sorted((k, i) for s, k, i in rows if (s == 1) == second) for second in (False, True))
                own = rows[0][0] == simhash.OWN
                if not own and not (a and b):
                    continue
                at = np.array([i for _, i in a + b])
                labels = simhash.join_nodes(np.array([k for k, _ in a], np.uint64), None if own else np.array([k for k, _ in b], np.uint64), 4)
                simhash.merge(got, at, at[labels])
        assert (got == want).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_exact_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[text.translate(SPACES)].append((-len(text), doc_id is None, doc_id or 0, i))
    want = Counter()
    for body, members in groups.items():
        best = min(members)
        for m in members:
            want[rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_duplicates(df).collect())) == want
    assert exact_dedup.unique(df).count() == len(groups)
    assert exact_dedup.unique(df).columns == df.columns


def test_colliding_keys_are_told_apart_by_their_bytes(spark, monkeypatch):
    batch = exact_dedup.table([(7, 1, {"points": 3, "doc_id": 5, "row": 0}, 2, b"abc", "x"), (7, 2, {"points": 3, "doc_id": 4, "row": 9}, 1, b"abd", "y"), (7, 3, {"points": 4, "doc_id": 9, "row": 5}, 1, b"abc", "x")],
                              __import__("pyarrow").schema([("key", "int64"), ("entry", "int64"), ("best", exact_dedup.ENTRY_TYPE), ("copies", "int64"), ("body", "binary"), ("sha", "string")]))
    got = [r for b in exact_dedup.settle(iter([batch])) for r in b.to_pylist()]
    assert {(r["entry"], r["keep_id"], r["group_size"]) for r in got} == {(1, 9, 3), (3, 9, 3), (2, 4, 1)}


def test_directory_doubles_only_where_buckets_are_overfull():
    depth, slots = exact_dedup.directory({0: 10, 1: 10, 2: 1, 12: 5}, 4, 12)
    assert depth == 4 and len(slots) == 16
    assert slots[0] != slots[1] and slots[8] == slots[15] and len(set(slots)) == 5
    assert exact_dedup.directory({}, 4, 12) == (0, [0])


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(t), bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(g and not p for g, p in zip(gone, b"\0" + gone))))  # noqa: B905
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_repeated_bytes(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = Counter((d, *p) for (d, _), p in zip(rows, plain_repeats([t for _, t in rows], 400), strict=True))
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(df).collect())
    assert got == want


@pytest.mark.parametrize("length", [1, 2, 7, 8, 20, 50])
def test_interval_expansion(length):
    rng = random.Random(length)
    for trial in range(8):
        letters = "ab" if trial % 2 else "abcdefg"
        spans = ["".join(rng.choice(letters) for _ in range(rng.randint(length, 120 + length))).encode() for _ in range(6)]
        spans += [spans[0][:length] + b"z" + spans[1], b"q" * (length + 5)]
        weights = [rng.randint(1, 2) for _ in spans]
        seen = Counter()
        for s, w in zip(spans, weights, strict=True):
            for i in range(len(s) - length + 1):
                seen[s[i : i + length]] += w
        want = {(i, j) for i, s in enumerate(spans) for j in range(len(s) - length + 1) if seen[s[j : j + length]] > 1}
        assert {(i, j) for i, a, b in repeats.repeated_runs(spans, weights, length) for j in range(a, b + 1)} == want


def test_heavy_groups_are_refined(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 300)
    rng = random.Random(2)
    common = "".join(rng.choice("abcdef") for _ in range(120))
    texts = ["".join(rng.choice("abcdef") for _ in range(60)) + common[rng.randint(0, 20) :][:90] + "".join(rng.choice("abcdef") for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *p) for i, p in enumerate(plain_repeats([t.encode() for t in texts], 50)))
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.remove_repeats(df, 50).collect()) == want


def test_op10_counts_the_kept_text_in_code_points(spark, tmp_path):
    spark.createDataFrame([(1, "für über größe"), (2, "plain"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_repeated_bytes(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_kept, r.text) for r in got] == [(18, 0, 14, "für über größe"), (5, 0, 5, "plain"), (0, 0, 0, "")]
