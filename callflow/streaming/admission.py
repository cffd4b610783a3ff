"""Rate-limited admission: a request counts only if it was admitted.

The decision depends on earlier decisions, so it is a recurrence per key and
not a window. What has to be remembered is small: admitted times of the last
day, at most the daily limit of the key.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callflow.operators import usage
from callflow.operators.sequence import running_max
from callflow.operators.usage import WINDOWS_S
from callflow.session import durable

DAY_US = 86_400_000_000
LIMITS = {"minute": "requests_per_minute", "hour": "requests_per_hour", "day": "requests_per_day"}
INPUT = ["key_id", "request_id", "us", *LIMITS.values()]
OUTPUT = (
    "key_id long, request_id long, us long, allowed boolean, remaining_minute long, remaining_hour long, remaining_day long, "
    "reset_minute long, reset_hour long, reset_day long"
)


def decide(us: int, limits: tuple[int, int, int], admitted: list[int]) -> list:
    """Decide one request; ``admitted`` (sorted micros) is updated in place."""
    del admitted[: bisect_left(admitted, us - DAY_US + 1)]
    counts = [len(admitted) - bisect_left(admitted, us - s * 1_000_000 + 1) for s in WINDOWS_S.values()]
    allowed = all(c < m for c, m in zip(counts, limits))
    if allowed:
        insort(admitted, us)
        counts = [c + 1 for c in counts]
    left = [max(0, m - c) for c, m in zip(counts, limits)]
    resets = [(us // 1_000_000 // s + 1) * s for s in WINDOWS_S.values()]
    return [allowed, *left, *resets]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Requests arrive sorted by (key, piece, time): keep one state, no group.

    Those ``given`` are known to be admitted: they only fill the state.
    """
    current, admitted = None, []
    for batch in batches:
        out = []
        for key, piece, request, us, given, *limits in batch.itertuples(index=False):
            if (key, piece) != current:
                current, admitted = (key, piece), []
            if given:
                admitted.append(us)
            else:
                out.append([key, request, us, *decide(us, tuple(limits), admitted)])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def pieces(requests: DataFrame) -> DataFrame:
    """Per instant of a key: ``known`` (decided by counts alone), ``piece`` and ``next_piece``, and the counts.

    An attempt is safe if even all attempts of its windows, refused ones
    included, leave room below its limits; then it is admitted whatever came
    before. Where no attempt of the last day was unsafe, the admitted times are
    simply the attempts, so the state there needs no replay. A piece begins at
    an unsafe instant a day or more after the last unsafe one, and reaches a
    day beyond its last; it is named by its first instant. Instants outside
    pieces are known; those of the day before a piece begins fill its state.
    """
    limits = [F.min(c).alias(c) for c in LIMITS.values()]
    unsafe = reduce(or_, [F.col(f"last_{w}") > F.col(c) for w, c in LIMITS.items()])
    counts = durable(usage.instant_counts(requests, *limits).withColumn("unsafe_us", F.when(unsafe, F.col("us"))))
    last = durable(running_max(counts, ["key_id"], ["us"], F.col("_dealt"), F.col("unsafe_us"), "unsafe_before", inclusive=False))
    long_ago = F.coalesce(F.col("us") - F.col("unsafe_before") >= DAY_US, F.lit(True))
    marked = last.withColumn("known", F.col("unsafe_us").isNull() & long_ago).withColumn("begins", F.when(F.col("unsafe_us").isNotNull() & long_ago, F.col("us")))
    begun = running_max(marked, ["key_id"], ["us"], F.col("_dealt"), F.col("begins"), "piece")
    back = begun.withColumn("_back", -F.col("us"))
    ahead = running_max(back, ["key_id"], ["_back"], -F.col("_dealt"), -F.col("begins"), "_ahead")
    return ahead.select("key_id", "us", "n", "known", "piece", (-F.col("_ahead")).alias("next_piece"), *[f"last_{w}" for w in LIMITS])


def admit_batch(requests: DataFrame) -> DataFrame:
    """Decisions for logged requests carrying their key's three limits.

    Requests outside pieces (see ``pieces``) are decided by counting. A piece
    streams through its task in Arrow batches with only the admitted times of
    one day in memory; what it needs from before is at most a day's limit.
    """
    columns = [F.col(c).cast("long").alias(c) for c in LIMITS.values()]
    rows = requests.select("key_id", "request_id", "ts", F.unix_micros("ts").alias("us"), *columns)
    found = durable(rows.drop("ts").join(pieces(rows), ["key_id", "us"]))
    # of requests at one known instant there are no more than the limit allows
    place = F.row_number().over(W.partitionBy("key_id", "us").orderBy("request_id"))
    counted = found.where("known").withColumn("_place", place)
    left = [F.greatest(F.lit(0), F.col(c) - (F.col(f"last_{w}") - F.col("n") + F.col("_place"))).alias(f"remaining_{w}") for w, c in LIMITS.items()]
    second = F.floor(F.col("us") / 1_000_000)
    resets = [((F.floor(second / s) + 1) * s).alias(f"reset_{w}") for w, s in WINDOWS_S.items()]
    direct = counted.select("key_id", "request_id", "us", F.lit(True).alias("allowed"), *left, *resets)

    into = found.where("NOT known").withColumn("given", F.lit(False))
    # what came in the day before a piece begins is safe, be it known or the end of another piece
    given = found.where((F.col("next_piece") > F.col("us")) & (F.col("next_piece") - F.col("us") < DAY_US)).withColumn("piece", F.col("next_piece")).withColumn("given", F.lit(True))
    ordered = (
        into.unionByName(given)
        .select("key_id", "piece", "request_id", "us", "given", *LIMITS.values())
        .repartition("key_id", "piece")
        .sortWithinPartitions("key_id", "piece", "us", "request_id")
    )
    return direct.unionByName(ordered.mapInPandas(_walk, OUTPUT))


class AdmissionProcessor(StatefulProcessor):
    """Streaming twin: state is the list of admitted times of the last day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._admitted = handle.getListState("admitted", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        admitted = sorted(int(r[0]) for r in self._admitted.get())
        batch = pd.concat(list(rows)).sort_values(["us", "request_id"])
        out = []
        for r in batch.itertuples(index=False):
            limits = tuple(int(getattr(r, c)) for c in LIMITS.values())
            out.append([r.key_id, r.request_id, r.us, *decide(int(r.us), limits, admitted)])
        self._admitted.put([(us,) for us in admitted])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame) -> DataFrame:
    """Decisions on a stream, in arrival order between micro-batches.

    Needs the RocksDB state store provider.
    """
    rows = requests.select("key_id", "request_id", F.unix_micros("ts").alias("us"), *LIMITS.values())
    return rows.groupBy("key_id").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
