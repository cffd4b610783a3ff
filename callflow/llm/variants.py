"""Spelling variants by finite-state composition.

The vocabulary is an acceptor A. A transducer E copies its input and makes one
edit on the way: a replaced, deleted or inserted code point. A o E o A accepts
the pairs of words that are one edit apart. Its states are (p, q, 0) before the
edit, where both sides have read the same and p = q, and (p, q, 1) after it,
where E only copies and both sides must go on alike.

The composition is cut into partitions by its initial states, one for each
prefix that few enough words share: a task builds the minimised acceptor of
its prefix's words and enumerates the pairs whose edit comes later. An edit
above such a state leaves E copying, so these pairs are words of which the rest
agrees: an equi-join on the word without the edited code point. Every pair has
one such place, the length of the common prefix, so none comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import only, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of an initial state that one task composes; longer prefixes split what is heavier.
STATE_WORDS = 4_000
PAIRS = "a string, a_n long, b string, b_n long"


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words; ``start`` is its initial state."""

    def __init__(self, words: Sequence[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.known: dict[tuple[int, int], bool] = {}
        register: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]

        def settle(final: list[bool], arcs: dict[str, int]) -> int:
            state = register.setdefault((final[0], tuple(arcs.items())), len(self.final))
            if state == len(self.final):
                self.final.append(final[0])
                self.arcs.append(arcs)
            return state

        before = ""
        for word in [*words, ""]:
            keep = 0
            while keep < min(len(word), len(before)) and word[keep] == before[keep]:
                keep += 1
            while len(path) > keep + 1:  # nothing is added below these states any more
                closed = settle(*path.pop())
                path[-1][1][before[len(path) - 1]] = closed
            for _ in word[keep:]:
                path.append(([False], {}))
            if word or words[:1] == [""]:
                path[-1][0][0] = True
            before = word
        self.start = settle(*path.pop())

    def meets(self, p: int, q: int) -> bool:
        """Whether some text is accepted from both states; each pair of states is settled once."""
        known, stack = self.known, [(p, q)]
        while stack:
            pair = stack[-1]
            a, b = self.arcs[pair[0]], self.arcs[pair[1]]
            if pair[0] == pair[1] or self.final[pair[0]] and self.final[pair[1]]:
                known[pair] = True  # every state of a minimal acceptor leads to a word
            elif pair not in known:
                below = [(a[c], b[c]) for c in a if c in b]
                if any(known.get(x) for x in below):
                    known[pair] = True
                elif open_ := next((x for x in below if x not in known), None):
                    stack.append(open_)
                    continue
                else:
                    known[pair] = False
            stack.pop()
        return known[p, q]

    def shared(self, p: int, q: int) -> Iterator[str]:
        """The texts accepted from both states, that is from (p, q, 1)."""
        path: list[str] = []
        stack = [(p, q, 0, "")] if self.meets(p, q) else []
        while stack:
            p, q, depth, c = stack.pop()
            del path[depth:]
            path.append(c)
            if self.final[p] and self.final[q]:
                yield "".join(path)
            b = self.arcs[q]
            stack += [(x, b[c], depth + 1, c) for c, x in self.arcs[p].items() if c in b and self.meets(x, b[c])]

    def edits(self, p: int) -> list[tuple[str, str]]:
        """What both words still read when the edit is the next step from (p, p, 0); of an inserted code point, the longer one first."""
        arcs = self.arcs[p]
        found = [(c + rest, d + rest) for c, x in arcs.items() for d, y in arcs.items() if c < d for rest in self.shared(x, y)]
        # a rest that begins with the code point itself has its edit further down
        return found + [(c + rest, rest) for c, x in arcs.items() for rest in self.shared(x, p) if rest[:1] != c]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs that are one edit apart, each once."""
        made: dict[int, list[tuple[str, str]]] = {}
        path: list[str] = []
        stack = [(self.start, 0, "")]
        while stack:
            p, depth, c = stack.pop()
            del path[depth:]
            path.append(c)
            if p not in made:
                made[p] = self.edits(p)
            if made[p]:
                read = "".join(path)
                yield from ((read + a, read + b) for a, b in made[p])
            stack += [(x, depth + 1, c) for c, x in self.arcs[p].items()]


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the words of each initial state; words arrive in order, so a task holds one state at a time."""
    rows = ((p, w, n) for b in batches for p, w, n in zip(*(b[c].to_pylist() for c in ("prefix", "word", "n")), strict=True))
    for prefix, state in groupby(rows, itemgetter(0)):
        n = {w: k for _, w, k in state}
        found = [(prefix + a, prefix + b) for a, b in Acceptor([w[len(prefix) :] for w in n]).pairs()]
        if found:
            a, b = zip(*found, strict=True)
            columns = [pa.array(a, pa.string()), pa.array([n[x] for x in a], pa.int64()), pa.array(b, pa.string()), pa.array([n[x] for x in b], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "a_n", "b", "b_n"])


def near_pairs(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """a, a_n, b, b_n: all pairs of ``words`` (word, n; distinct, not null) one edit apart, each once.

    Prefixes of 1, 2, 4, 8, … code points are counted; the initial state of a
    word is the first that at most ``state_words`` words share. Words shorter
    than that are in no state: all their edits are above it. A join key stands
    for one place and one rest, so at most the alphabet meets there.
    """
    levels = words.select("word", F.explode(F.expr("transform(sequence(0, char_length(bin(char_length(word))) - 1), i -> shiftleft(1, i))")).alias("level"))
    levels = levels.withColumn("prefix", F.substr("word", F.lit(1), F.col("level")))
    heavy = stored(levels.groupBy("level", "prefix").count().where(F.col("count") > state_words).drop("count"))
    deep = levels.join(heavy, ["level", "prefix"], "left_semi").groupBy("word").agg((2 * F.max("level")).alias("depth"))
    placed = stored(words.join(deep, "word", "left").select("word", "n", F.coalesce("depth", F.lit(1)).alias("depth")))

    states = placed.where("char_length(word) >= depth").withColumn("prefix", F.substr("word", F.lit(1), F.col("depth")))
    tasks = 1 + placed.count() // (4 * state_words)  # by words, as composing takes far longer than their bytes tell
    later = states.select("prefix", "word", "n").repartition(tasks, "prefix").sortWithinPartitions("prefix", "word").mapInArrow(compose, PAIRS)
    cuts = placed.select("word", "n", F.explode(F.expr("sequence(0, least(depth, char_length(word)) - 1)")).alias("i"))
    cuts = cuts.withColumn("rest", F.expr("concat(substr(word, 1, i), substr(word, i + 2))"))
    columns = [F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")]
    x, y = cuts.alias("x"), cuts.alias("y")
    replaced = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.rest") == F.col("y.rest")) & (F.col("x.word") < F.col("y.word"))).select(columns)
    y = placed.alias("y")
    deleted = x.join(y, (F.col("x.rest") == F.col("y.word")) & F.expr("substr(x.word, x.i + 1, 1) != substr(y.word, x.i + 1, 1)")).select(columns)
    return later.unionByName(replaced).unionByName(deleted)


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: the end of every word's chain of forms, by pointer doubling.

    Chains have no circle, as counts grow along them, and are as short as the
    logarithm of the largest count, so a few rounds settle them all.
    """
    links = stored(links.select("word", F.col("form").alias("root")))
    while True:
        a, b = links.alias("a"), links.alias("b")
        jumped = a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        jumped = stored(jumped)
        if jumped.where("moved").isEmpty():
            return jumped.drop("moved")
        links = jumped.drop("moved")


def group_variants(words: DataFrame, ratio: int = 5, state_words: int = STATE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words, not null or empty).

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``ratio`` times (over 1) the word's own; ``root``
    follows forms to the last. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"))
    pairs = near_pairs(words, state_words)
    both = pairs.select(F.col("a").alias("word"), "b", "b_n").unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    wins = F.col("n_near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.form")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")
        )
    )
    roots = last_forms(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spoiled(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one code point if ``every`` divides the crc32 of ``doc_id:run``; a null id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, spoil_every: int = 0) -> DataFrame:
    """word, n: the letter runs of whole texts, A-Z lower-cased; ``spoil_every`` plants typing errors (0: none).

    Only counts are shuffled, summed per task first. Null text: no words.
    """
    runs = docs.select(*only(docs, "doc_id"), F.explode(F.regexp_extract_all(F.translate(docs["text"], ascii_uppercase, ascii_lowercase), F.lit(RUN), F.lit(0))).alias("run"))
    word = spoiled(runs["doc_id"], runs["run"], spoil_every) if spoil_every else runs["run"]
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, spoil_every: int = 0, state_words: int = STATE_WORDS) -> DataFrame:
    """Which words of ``docs`` (doc_id, text) are variants of a more frequent word one edit away.

    Returns word, form, root, n, n_near and form_n for every word of at least
    ``min_length`` code points that occurs ``min_count`` times or more.

    Null and empty texts, and texts without a letter, add nothing; long texts
    are read whole; repeated rows count again. Null doc_id: matters only to
    ``spoil_every``, where it counts as empty text. Ties: the smallest word in
    code-point order. Empty table: no rows. Other columns are ignored.
    """
    counts = word_counts(docs, spoil_every).where((F.char_length("word") >= min_length) & (F.col("n") >= min_count))
    return group_variants(counts, ratio, state_words)
