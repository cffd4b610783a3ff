"""Spelling variants, vector codes and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from callflow.llm import packing, variants, vector_codes

MODEL = public_tokenizers.path("word_bpe_49k.json")


def plain_counts(rows, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts, ratio=5):
    cuts, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in counts:
                near[w].add(x)
                near[x].add(w)
    for group in cuts.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_variants(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = variants.spelling_variants(df, spoil_every=199).collect()
    assert Counter(map(tuple, got)) == Counter(plain_variants(plain_counts(rows)))


@pytest.mark.parametrize("state_words", [1, 3, 40, 10_000])
def test_variants_split_heavy_states(spark, state_words):
    """A third of all words share a long prefix; states of one word and of all words give the same."""
    rng = random.Random(state_words)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(500)}
    words |= {"prefix" * 4 + "".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)}
    words |= {"a" * n for n in range(1, 40)} | {"longword" * 3000, "longword" * 2999 + "longwird"}
    counts = {w: rng.randint(1, 4) ** rng.randint(1, 9) for w in sorted(words)}
    got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), state_words=state_words).collect()
    assert Counter(map(tuple, got)) == Counter(plain_variants(counts))


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("t", "l", "br") for b in ("ake", "aking", "akes"))
    acceptor = variants.Acceptor(words)
    assert len(acceptor.final) == 9  # the endings are held once
    plain = plain_variants(dict.fromkeys(words, 1))
    assert sum(n for *_, n, _ in plain) == 2 * len(list(acceptor.pairs()))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Python integers only."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    xs = [[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for *_, v in kept]
    books = [[x[p * width : (p + 1) * width] for x in xs[:entries]] for p in range(parts)]

    def assign():
        out = []
        for x in xs:
            row = []
            for p in range(parts):
                own = x[p * width : (p + 1) * width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(own, c, strict=True)), k) for k, c in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            members = defaultdict(list)
            for x, row in zip(xs, near, strict=True):
                members[row[p][1]].append(x[p * width : (p + 1) * width])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total, out = Counter(), []
    for (i, label, _), row in zip(kept, assign(), strict=True):
        error = sum(d for d, _ in row)
        total[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in row), error, label))
    return Counter((i, code, e, total[label], digest) for i, code, e, label in out)


def vector_rows(n=150):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.choice([0, 1, None]), [rng.gauss(0, 0.2) for _ in range(32)]) for i in range(n)]
    rows += [(5, 1, rows[9][2]), (5, 1, rows[9][2]), (None, 2, rows[3][2]), (900, 1, None), (901, 1, [nan] * 32), (902, None, [0.0] * 31 + [inf]), (903, 1, [None] * 32), (904, 1, []), (905, 1, [1.0] * 7), (906, 0, [-1e5, 1e5, 123456.789] + [0.0] * 29)]
    return [(i, label, v, "x", 1, 2, "p") for i, label, v in rows]


VECTORS = "vec_id long, label int, embedding array<double>, vector string, error int, part int, code string"


@pytest.mark.parametrize("n", [150, 3])
def test_codes(spark, n):
    rows = vector_rows(n) if n > 9 else vector_rows()[:n]
    got = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert Counter(map(tuple, got)) == plain_codes([r[:3] for r in rows])


def test_codes_of_nothing(spark):
    assert vector_codes.compress_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.compress_vectors(spark.createDataFrame([(1, 1, None, "x", 1, 2, "p")], VECTORS)).collect() == []


def test_codes_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = vector_codes.compress_vectors(df).collect()
    assert Counter(map(tuple, got)) == plain_codes([(r.vec_id, r.label, r.embedding) for r in df.collect()])


def test_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 29):
        x, c = rng.integers(-(1 << bits), 1 << bits, (50, 8)), rng.integers(-(1 << bits), 1 << bits, (9, 8))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x]
        assert vector_codes.exact_products(x, c).tolist() == want
        assert sum(len(vector_codes.limbs(v, 24)) for v in (x, c)) == 2 * (1 + (bits > 24))
    assert vector_codes.nearest(np.array([[2, 0]]), np.array([[1, 0], [3, 0]]))[0].tolist() == [0]


def assert_packed(rows, got, window):
    """Every id in exactly one piece, sequences without a gap, no padding, whole windows as they are."""
    tokenizer = Tokenizer.from_file(MODEL)
    documents, pieces, sequences = Counter(), defaultdict(list), defaultdict(list)
    want = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        documents[doc_id, len(ids)] += 1
        want[doc_id] += len(ids)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == want
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        same = [r for r in pieces[doc_id] if r.doc_tokens == len(ids)]
        spans = Counter((r.start, r.length, r.ids_crc32) for r in same)
        times = documents[doc_id, len(ids)]
        if sum(1 for i, _ in rows if i == doc_id) == 1:
            at = 0
            for r in sorted(same, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        assert sum(n * c for (_, n, _), c in spans.items()) == times * len(ids)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & (at - 1) == 0
        total += at
    assert total == sum(want.values())
    assert sum(1 for v in sequences.values() if sum(n for _, n in v) < window) <= window.bit_length()


@pytest.mark.parametrize("which,window", [("odd", 2048), ("odd", 16), ("docs", 2048), ("docs", 64), ("none", 2048)])
def test_pack(request, which, window):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    if rows:
        rows.append((-7, "<|endoftext|>ﬀ Ω É'LL\u0085 \x1c12 é ΣΑΣ"))
        df = df.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert_packed(rows, packing.pack(df, MODEL, window).collect(), window)


def test_chunks_encode_as_whole_texts():
    rng = random.Random(9)
    signs = ["a", "B", "'", "s", "é", "é", " ", "\t", "\n\n", " ", " ", "1", "-", "<|endoftext|>", "Σ", "ß", "漢", "🙂", "́", "\x1f", "\x85", "İ", ".", ",", ":", "?!", "'S", "e\u0301", "\u1112\u1161\u11ab", "ﬀ", "\u0338", "=", "<"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(6000)] + ["x" * 100_000, "ab " * 50_000]
    code, whole = packing.encoder(open(MODEL, "rb").read()), Tokenizer.from_file(MODEL)
    assert code.by_chunk
    got = [np.frombuffer(b, code.kind).tolist() for at in range(0, len(texts), 500) for b in code.encode(pa.array(texts[at : at + 500]), 1)]
    assert got == [[*e.ids, 1] for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    code, whole = packing.encoder(open(path, "rb").read()), Tokenizer.from_file(path)
    texts = ["two  spaces, kept", "", "a\nb"]
    assert not code.by_chunk
    assert [np.frombuffer(b, code.kind).tolist() for b in code.encode(pa.array(texts), 7)] == [[*whole.encode(t).ids, 7] for t in texts]


def test_plan_of_few_and_many():
    """Ranks of a plan cover all sequences once, whatever the counts."""
    rng = np.random.default_rng(2)
    for counts in (np.zeros(32, int), rng.integers(0, 3, 32), rng.integers(0, 50, 32), np.eye(32, dtype=int)[20] * 1000, np.eye(32, dtype=int)[16] * 7):
        counts[0] = 0
        plan, filled = packing.plan_packing(counts, 32), defaultdict(list)
        for length in range(1, 32):
            for rank in range(counts[length]):
                for _, n, sequence, offset in plan.place(length, rank):
                    filled[sequence].append((offset, n))
        assert sum(n for v in filled.values() for _, n in v) == int((counts * np.arange(32)).sum())
        assert len(filled) == plan.sequences
        for v in filled.values():
            assert [o for o, _ in sorted(v)] == list(np.cumsum([0] + [n for _, n in sorted(v)])[:-1])


def test_solver_meets_a_histogram_it_can_meet():
    """A histogram made of full combinations is packed without a cut, and the gradient vanishes."""
    rng = np.random.default_rng(4)
    columns = packing.combinations(np.arange(1, 64), 64)
    assert (columns.sum(1) == 64).all() and len(columns) == len({tuple(c) for c in columns.tolist()})
    counts = np.zeros(64, int)
    for i in rng.integers(0, len(columns), 30):
        for x in columns[i]:
            counts[x] += 1000 * (x > 0)
    x = packing.least_squares(columns, counts)
    fit = np.zeros(64)
    for i in range(3):
        np.add.at(fit, columns[:, i], x)
    fit[0] = 0
    assert (x >= 0).all() and np.abs(fit - counts).max() < 0.02 * counts.max()
