"""Token counts, chat formatting, HTML extraction, decontamination and language ID."""

import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from callflow.llm import chat, decontaminate, html_text, language, queries, token_counts
from callflow.llm.queries import QUERIES, SQL
from check import canonical

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    df, cursor = QUERIES[name](spark, TABLES), duck.execute(SQL[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [d[0] for d in cursor.description])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_token_counts(request, which):
    df = request.getfixturevalue(which)
    with open(token_counts.TOKENIZER, "rb") as file:
        model = token_counts.unigram(file.read())
    longest = max(map(len, model.scores))

    def plain(word):
        """Every split point against every piece, nothing shared."""
        best = [(0.0, 0)] + [None] * len(word)
        for j in range(1, len(word) + 1):
            options = [(best[i][0] + model.scores[word[i:j]], best[i][1] - 1) for i in range(max(0, j - longest), j) if word[i:j] in model.scores]
            if word[j - 1] not in model.scores:
                n = len(word[j - 1].encode())
                options.append((best[j - 1][0] + n * model.byte, best[j - 1][1] - n))
            best[j] = max(options)
        return -best[-1][1]

    known, want = {}, Counter()
    for r in df.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        for w in set(words) - known.keys():
            known[w] = plain("▁" + w)
        want[r.doc_id, len(words), sum(known[w] for w in words)] += 1
    assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == want


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ ok [/INST]<|done|>"), (1, 2, "assistant", None), (2, 0, None, "<|turn|>x"), (2, None, "system", ""), (None, 0, "assistant", "né 𝒳"),
    (3, 0, "assistant", "\\<\\/s>\\"), (3, 0, "assistant", "\\<\\/s>\\"), (4, 5, "user\nassistant", "a" * 50_000),
]


def test_prefixes_are_scored_once_for_a_batch(spark, monkeypatch):
    df = spark.createDataFrame([(1, "prefixing"), (2, "prefixes prefix")], "doc_id long, text string")
    functions, calls = [], []
    mapped, counts = type(df).mapInArrow, token_counts.Unigram.counts
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: functions.append(f) or mapped(self, f, schema))
    monkeypatch.setattr(token_counts.Unigram, "counts", lambda self, words: calls.append(sorted(words)) or counts(self, calls[-1]))
    token_counts.count_tokens(df)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()])
    assert [r["n_words"] for b in functions[0](iter([batch])) for r in b.to_pylist()] == [1, 2]
    assert calls == [[token_counts.WORD_START + w for w in ("prefix", "prefixes", "prefixing")]]


def test_chat_round_trip(spark):
    import hashlib

    df = spark.createDataFrame([(*r, "x", 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, ids string, mask int")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in CONVERSATIONS}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in CONVERSATIONS if r[0] == conv)
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    rows = sorted(formatted.where("conv_id = 1").collect(), key=lambda r: r.position)
    assert [r.first_token for r in rows] == np.cumsum([0, *[len(r.ids) for r in rows[:-1]]]).tolist()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_turns_are_shuffled_once(spark):
    df = spark.createDataFrame([r[:4] for r in CONVERSATIONS], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1


def test_chat_batch_is_assembled_turn_by_turn():
    with open(chat.TOKENIZER, "rb") as file:
        enc = chat.encoding(file.read())
    start, says, done = (enc.max_token_value + 1 + i for i in range(3))
    roles, texts = ["user", "assistant", "", "assistant", "assistant"], ["hi </s>", "", "\\ x", "né 𝒳 <|done|>", "a" * 5_000]
    ids, mask = chat.assemble(enc, roles, texts, ("assistant",))
    for role, text, i, m in zip(roles, texts, ids.to_pylist(), mask.to_pylist(), strict=True):
        who, said = (enc.encode_ordinary(chat.escape(s)) for s in (role, text))
        assert i == [start, *who, says, *said, done]
        assert m == [False] * (len(who) + 2) + [role == "assistant"] * len(said) + [False]
    assert [len(a) for a in chat.assemble(enc, [], [], ("assistant",))] == [0, 0]


def test_chat_broken_turns_are_refused(spark, monkeypatch):
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string"))
    functions, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: functions.append(f) or mapped(self, f, schema))
    chat.read_back(df)
    whole = [r.asDict() for r in df.orderBy("position").collect()]
    start, says = whole[1]["ids"][0], next(i for i in whole[1]["ids"][1:] if i > whole[1]["ids"][0])

    def digests(ids, mask):
        rows = [whole[0], whole[1] | {"ids": ids, "mask": mask}]
        fields = pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])
        return [r for b in functions[0](iter([pa.RecordBatch.from_pylist(rows, fields)])) for r in b.to_pylist()]

    ids, mask = whole[1]["ids"], whole[1]["mask"]
    assert digests(ids, mask) == [r.asDict() for r in chat.read_back(df).collect()]
    for broken in (ids[1:], ids[:-1], [i for i in ids if i != says], [start, says, *ids[1:]], []):
        with pytest.raises(ValueError):
            digests(broken, [False] * len(broken))
    for covered in ([True] * len(ids), mask[:-1]):
        with pytest.raises(ValueError):
            digests(ids, covered)


@pytest.mark.parametrize("text", ["", "\\", "<|turn|>", "<\\|turn|>", "[INST][/INST]</s>", "<<SYS>>\\<</SYS>>", "<<s>s>"])
def test_escape(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a> tagline, of the site</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more, all of them, really, accept.</div>
<div id=main><div class=content><h1>A title</h1><p>First paragraph, with commas, and <a href=x>a link</a> in it,
over lines&nbsp;&amp; with entities &lt;b&gt;.<p>Second paragraph<br>is long enough, too, to score, one hopes, in the end.
<div class="ad">Buy, buy, buy, now, or never, and again.</div><ul><li>kept item</li></ul><ul><li><a href=1>Related one</a><li><a href=2>Related two</a></ul>
<form>Your name, please <input name=a></form><table><tr><td>cell</td></tr></table></div>
<div class="comments"><p>A reader says, at length, that this, and that, is wrong, and goes on, and on.</p></div></div>
<aside>Most read, today, all of it</aside><footer>Copyright, imprint</footer></body>"""


def test_html():
    assert html_text.main_blocks(PAGE) == [
        "A title", "First paragraph, with commas, and a link in it, over lines & with entities <b>.", "Second paragraph is long enough, too, to score, one hopes, in the end.", "kept item", "cell",
    ]
    assert html_text.main_blocks("<article><p>One.<p>Two.</article><footer>f</footer><p>after") == ["One.", "Two."]
    assert html_text.main_blocks("plain, without markup < 3 &") == ["plain, without markup < 3 &"]
    for text in ("", "<", "<p", "<!-- open", "<script>a", "<p></p>", "<nav>a, b</nav>", "</div></p>"):
        assert isinstance(html_text.main_blocks(text), list)
    assert html_text.main_blocks("<div>" * 5000 + "<p>deep, text" + "</div>" * 5000) == ["deep, text"]


def test_html_wrappers_keep_their_article():
    first, second = "The council met on Monday, and it voted, after a long debate.", "Nobody, it seems, was surprised by the result, least of all the mayor."
    text = [first, second]
    body = f"<p>{first}</p><p>{second}</p>"
    aside = "<div class='sidebar'><p>Most read, today</p></div>"
    for page in (
        f"<body><form id='aspnetForm' action='x'><input name='v'><div>{body}</div></form></body>",
        f"<body><form><div class='header'>Shop</div><article>{body}</article><select><option>a</option></select></form></body>",
        f"<body><div class='page has-sidebar'><article>{body}</article>{aside}</div></body>",
        f"<body><div class='no-sidebar'><main>{body}</main></div>{aside}</body>",
        f"<body><div class='layout has-sidebar'><div>{body}</div></div></body>",
        f"<article><div class='review'>{body}</div></article>",
    ):
        assert html_text.main_blocks(page) == text, page
    comments = "".join(f"<article><p>I agree, number {i}</p></article>" for i in range(5))
    for page in (
        f"<body><div>{body}</div><form><p>Your name, please</p></form></body>",
        f"<body><div>{body}</div><div class='comments'>{comments}</div></body>",
        f"<article>{body}<div class='related'><article><p>Another, other story</p></article></div></article>",
    ):
        assert html_text.main_blocks(page) == text, page


def test_html_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a  b</p>", "y"), (1, "u", None, "x"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = Counter(map(tuple, html_text.extract_text(df).collect()))
    assert got == Counter({(1, "u", "", 0, 0): 2, (None, None, "a b", 3, 1): 1, (2, "v", "", 0, 0): 1})
    assert html_text.extract_text(df.limit(0)).count() == 0


def plain_tiles(item, text, least):
    """Greedy string tiling word by word."""
    a_used, b_used = [False] * len(item), [False] * len(text)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a_used[i + n] and not b_used[j + n]:
                    n += 1
                if (n, -i, -j) > best:
                    best = (n, -i, -j)
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(a_used)
        a_used[i : i + n] = [True] * n
        b_used[j : j + n] = [True] * n


def test_tiling_against_plain():
    rng = np.random.default_rng(3)
    for _ in range(40):
        item = rng.integers(1, 6, 30)
        text = np.concatenate([rng.integers(1, 6, 20), item[12:25], rng.integers(1, 6, 5), item[:10]])
        assert decontaminate.tile(item, text, 3)[0] == plain_tiles(item.tolist(), text.tolist(), 3)


def test_decontamination(spark, odd, none):
    item = " ".join(f"word{i}" for i in range(40))
    words = item.split()
    texts = [
        (1, "Before. " + item.upper() + "! After."), (2, "x " + " ".join(words[20:]) + " y z " + " ".join(words[:20])), (3, " ".join(words[:15]) + " and nothing else"),
        (4, "unrelated " * 30), (None, item), (5, ", ".join(words)), (5, ", ".join(words)),
    ]
    docs = spark.createDataFrame([(i, t, "q") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 2), (9, "too short", 3), (None, "only these five words here", 4)], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == Counter({(1, 7, 1, 40): 1, (2, 7, 2, 40): 1, (None, 7, 1, 40): 1, (5, 7, 1, 40): 2})
    assert got == Counter((r.doc_id, r.item_id, r.n_tiles, r.n_covered) for r in decontaminate.contaminated(docs, bench, block_bytes=100).collect())
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [3, 4]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.contaminated(odd, bench).count() == decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_finds_what_plain_tiling_finds(spark, docs):
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    items = {r.item_id: decontaminate.words_of(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = decontaminate.words_of(r.text or "")
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item_id, words in items.items():
            touched = [i for i, w in enumerate(text) if w in set(words)]
            if any(tuple(words[i : i + 5]) in grams for i in range(len(words) - 4)):
                lo, hi = touched[0], touched[-1] + 1
                number = {w: n for n, w in enumerate(words)}
                covered = plain_tiles([number[w] for w in words], [number.get(w, -1 - k) for k, w in enumerate(text[lo:hi])], 5)
                if covered >= 0.6 * len(words):
                    want.add((r.doc_id, item_id))
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    aside = [r for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert len(aside) > 100 and np.mean([got[r.doc_id].lang_pred == r.lang for r in aside]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_rows(odd, none):
    got = language.identify_languages(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6, 10, None}
    assert language.identify_languages(none).count() == 0
    net = language.fit(none)
    assert {(r.lang_pred, r.score) for r in language.predict(odd, net).collect()} == {("und", 0.0)}
    assert language.accepted(odd, net, 0.3).count() == 0


def test_folded_tables_equal_the_network():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, (6, language.WINDOW)).astype(np.uint8)
    data[0, 40:] = 0
    net = language.train(data, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"], epochs=2)
    emb, pooled = net.embedding[data.astype(int)], []
    for w, f in zip(language.WIDTHS, net.filters, strict=True):
        conv = sum(emb[:, j : language.WINDOW - w + 1 + j] @ f[j] for j in range(w))
        pooled.append(conv.max(axis=1))
    want = language.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.weights + net.offset)
    assert np.allclose(language.Predictor(net).probabilities(data), want, atol=1e-4)


def test_queries_module_reads_whole_tables():
    text = open(queries.__file__).read()
    assert "limit(" not in text and "sample(" not in text


BODY = "<p>The first paragraph of the story, which is long enough, says what happened and where, in some detail.</p><p>The second one, also long, adds who was there, what they said, and why it matters to them.</p>"


@pytest.mark.parametrize(
    "inside, kept, lost",
    [
        ('<header class="entry-header"><h1>Big Headline</h1></header>' + BODY, ["Big Headline", "second one"], []),
        ('<div class="article-header"><h1>Big Headline</h1></div>' + BODY, ["Big Headline"], []),
        ('<div class="side-by-side"><p>A comparison, both halves of it, told in words.</p></div>' + BODY, ["A comparison"], []),
        (BODY + '<h2>Sources</h2><ul><li><a href="a">Report of the office</a></li><li><a href="b">Interview</a></li></ul>', ["Report of the office", "Interview"], []),
        (BODY + '<ul class="related"><li><a href="a">Another story</a></li></ul>', [], ["Another story"]),
        (BODY + '<ul><li><a href="a">Elsewhere</a></li></ul>', [], ["Elsewhere"]),
        (BODY + "<section><h2>12 Responses</h2><ol><li>I do not agree, not at all, with any of this.</li></ol></section>", ["first paragraph"], ["agree", "Responses"]),
        (BODY + '<h3>Comments (2)</h3><div>I do not agree, not at all.</div><div>Nor do I.</div>', ["second one"], ["agree", "Nor"]),
        (BODY + "<h2>Responses of the ministry</h2><p>It said, at some length, that all is well, and will be.</p>", ["all is well", "Responses of the ministry"], []),
        (BODY + '<div class="ad-slot">Buy, buy, buy.</div><div class="notice">We moved.</div>', [], ["Buy", "moved"]),
    ],
)
def test_articles_are_kept_whole(inside, kept, lost):
    page = f"<html><body><nav><a href='x'>Home</a></nav><div class='wrap'><article>{inside}</article></div><footer>Imprint</footer></body></html>"
    text = " ".join(html_text.main_blocks(page))
    assert all(k in text for k in ["first paragraph", *kept]) and not any(x in text for x in ["Home", "Imprint", *lost]), text


@pytest.mark.parametrize("opened, ends", [("<div>", "</foo>"), ("<foo>", "</bar>"), ("<b>", "</i>"), ("<foo>", "<p>x, y"), ("<i><div><b>", "</i>")])
def test_broken_pages_take_linear_time(opened, ends):
    began = time.time()
    text = " ".join(html_text.main_blocks("<article><p>Some words, to be kept, at the beginning.</p>" + opened * 5_000 + ends * 50_000 + "</article>"))
    assert text and time.time() - began < 10
