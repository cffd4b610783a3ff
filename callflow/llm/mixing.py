"""Mix sources to target weights by subset-sum budget fitting.

Per source, documents are counted by exact length in words. The budget left
after whole copies is first spread over the lengths in proportion; what remains
is fitted by a bounded-knapsack dynamic programme over the lengths. The number
of documents taken of each length is then filled with the documents that come
first in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callflow.llm.shared import only, stored

#: Words of the remaining budget that the dynamic programme fits; it bounds its memory.
FIT_WORDS = 1 << 16
#: The part of a budget that the dynamic programme fits, where documents are small beside it.
SPARE = 20
PLAN = "source string, size long, count long, copies long, take long, target double, source_size long"


def water_level(sources: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Add ``target``: shares by weight of ``budget`` times all words, none above ``cap`` times its size.

    A source stops at its cap when ``cap * size / weight`` is below the common
    level of words per unit of weight; the level follows from running sums over
    the sources in order of that ratio. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    numbered = sources.withColumn("no", F.row_number().over(by_name) - 1)
    weighted = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    limited = weighted.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    total = budget * F.sum("source_size").over(Window.partitionBy())
    before = F.sum("limit").over(by_ratio) - F.col("limit")
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = limited.withColumn("level", (total - before) / after)
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * level, F.col("limit"))).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, offset: float = 0.5) -> np.ndarray:
    """How many documents of each size to take so that their words come as close to ``budget`` as found.

    All but a ``SPARE``-th of the budget (three of the longest documents at least)
    is spread over the sizes, which rise, in proportion; ``offset`` (0 to 1) is where rounding
    begins. Exact whenever the remaining budget can be reached by the sizes left over.
    """
    take = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or whole == 0:
        return take
    if budget >= whole:
        return np.where(sizes > 0, counts, 0)
    # Documents are taken in proportion at every length, also where each length has one: rounding runs on over the
    # lengths in order. Its error stays below twice the longest document, so the rest is never negative.
    spare = max(budget // SPARE, 3 * int(sizes.max()))
    share = max(0, budget - spare) / whole
    upto = np.floor(np.cumsum(np.where(sizes > 0, counts, 0)) * share + offset).astype(np.int64)
    take = np.diff(upto, prepend=np.int64(offset))
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        s = int(sizes[i])
        if s and left > FIT_WORDS:
            extra = min(int(counts[i] - take[i]), (left - FIT_WORDS) // s)
            take[i] += extra
            left -= extra * s
    return take + knapsack(sizes, counts - take, left)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the multiset of sizes whose sum is nearest to ``budget``, the lower of two equally near."""
    top = 2 * budget  # a sum beyond it is no nearer than taking nothing
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    first = np.full(top + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in np.random.default_rng(len(sizes)).permutation(len(sizes)):  # no length comes first by its size
        s, c, part = int(sizes[i]), int(counts[i]), 1
        c = min(c, top // s) if s else 0
        while c > 0 and not reach[budget]:
            n = min(part, c)
            new = reach[: top + 1 - n * s] & ~reach[n * s :]
            first[n * s :][new] = len(items)
            reach[n * s :] |= new
            items.append((int(i), n))
            c, part = c - n, part * 2
    take = np.zeros(len(sizes), np.int64)
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(sizes[i])
    return take


def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = int(target // whole) if whole else 0
    rows["copies"] = copies
    rows["take"] = fit_counts(sizes, counts, round(target) - copies * whole)
    return rows[["source", "size", "count", "copies", "take", "target", "source_size"]]


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17, group_rows: int = 1000
) -> DataFrame:
    """Decide how many words of each document a mix takes.

    Returns doc_id, source, size, source_size, target, copies and taken
    (``copies * size``). Size counts ``[^\\x20\\x09-\\x0D]+`` in the text. Sources
    are ordered by code point, null last, and weigh ``weights`` in turn.

    Null text, empty text: size 0, taken 0. Null source: a source of its own.
    Null doc_id: an id like any other. Ties of the seeded order go by doc_id;
    equal rows are interchangeable. Empty table: no rows. Other columns are
    ignored. The histogram of one source has a row per distinct length, and
    sources have a row each; documents never meet in one task, as groups of one
    source and length split into parts of about ``group_rows``.
    """
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stored(docs.select(*only(docs, "doc_id", "source"), F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")))
    lengths = sized.groupBy("source", "size").count()
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    targets = water_level(sources, weights, budget, cap)
    a, b = lengths.alias("a"), targets.alias("b")
    both = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.target", "b.source_size")
    plan = stored(both.groupBy("source").applyInPandas(plan_source, PLAN))

    d, p = sized.alias("d"), plan.alias("p")
    planned = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))).select(
        "d.*", "p.count", "p.copies", "p.take", "p.target", "p.source_size", order.alias("_order")
    )
    part = F.pmod(F.shiftright("_order", 20), F.ceil(F.col("count") / group_rows))
    planned = planned.withColumn("_part", part)
    parts = (
        planned.where(F.col("count") > group_rows)
        .groupBy("source", "size", "_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    )
    ranked = planned.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_order", "doc_id"))).alias("r")
    q = parts.alias("q")
    placed = ranked.join(
        q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.size") == F.col("q.size")) & (F.col("r._part") == F.col("q._part")), "left"
    ).select("r.*", F.coalesce(F.col("q._before"), F.lit(0)).alias("_before"))
    copies = F.col("copies") + (F.col("_before") + F.col("_rank") <= F.col("take")).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
