"""All repairs of a call's speaker runs in one pass along the runs.

The steps of ``smoothing`` look at a run, its neighbours and totals of its call.
Here they stand in a row of generators, each a turn or two behind the one before
it: split at silences, renumber, smooth, fix the ends, repair sentences,
renumber. Runs, not words, are dealt by call and arrive in order; a task holds
the turns that the steps have in hand, whatever the length of the call.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.operators import smoothing as s
from callflow.operators.runs import IVR

RUN = ["call_id", "run_idx", "speaker", "first_idx", "last_idx", "n_words", "start_ms", "end_ms", "last_text"]
ENDS = re.compile(s.SENTENCE_END, re.ASCII)


class Turn(NamedTuple):
    """Adjacent runs of one speaker."""

    speaker: str
    runs: list[tuple]
    words: int
    start: int | None
    end: int | None
    last_text: str | None

    def shorter(self, ms: int) -> bool:
        return self.start is not None and self.end is not None and self.end - self.start < ms


def merged(turns: Iterable[Turn]) -> Iterator[Turn]:
    held = None
    for t in turns:
        if held is not None and held.speaker == t.speaker:
            held = Turn(held.speaker, held.runs + t.runs, held.words + t.words, held.start, t.end, t.last_text)
            continue
        if held is not None:
            yield held
        held = t
    if held is not None:
        yield held


def neighbours(turns: Iterable[Turn]) -> Iterator[tuple[Turn | None, Turn, Turn | None]]:
    before = here = None
    for after in turns:
        if here is not None:
            yield before, here, after
        before, here = here, after
    if here is not None:
        yield before, here, None


def inside_one(before: Turn | None, here: Turn, after: Turn | None) -> bool:
    return before is not None and after is not None and IVR not in (before.speaker, here.speaker, after.speaker)


def split_by_silence(turns: Iterable[Turn], call_words: int) -> Iterator[Turn]:
    """Two speakers in turn; a stretch of few words continues the one before it."""
    turn = 0
    for before, here, after in neighbours(turns):
        turn += before is not None and here.words >= s.TURN_MIN_WORDS
        alone = before is None and after is None
        yield here._replace(speaker=f"speaker_{turn % 2}" if call_words >= s.MIN_WORDS_SENTENCE and not alone else "speaker_0")


def renumbered(turns: Iterable[Turn]) -> Iterator[Turn]:
    names: dict[str, str] = {IVR: IVR}
    for t in turns:
        yield t._replace(speaker=names.setdefault(t.speaker, f"speaker_{len(names) - 1}"))


def smoothed(turns: Iterable[Turn], call_words: int, few: bool) -> Iterator[Turn]:
    for before, here, after in neighbours(turns):
        short = here.shorter(s.STANDARD_MS) if few else here.shorter(s.CONSERVATIVE_MS) and here.words <= 1
        fix = inside_one(before, here, after) and short and before.speaker == after.speaker and call_words >= s.MIN_WORDS_SMOOTH
        yield here._replace(speaker=before.speaker) if fix else here


def ends_fixed(turns: Iterable[Turn], call_words: int) -> Iterator[Turn]:
    moved, place = False, 0
    for before, here, after in neighbours(turns):
        stray = here.words <= s.BOUNDARY_WORDS and here.shorter(s.BOUNDARY_MS) and call_words >= s.MIN_WORDS_SMOOTH
        if stray and before is None and after is not None:
            moved = True
            yield here._replace(speaker=after.speaker)
        elif stray and after is None and before is not None and not (moved and place == 1):
            yield here._replace(speaker=before.speaker)
        else:
            yield here
        place += 1


def sentences_repaired(turns: Iterable[Turn], call_words: int) -> Iterator[Turn]:
    for before, here, after in neighbours(turns):
        fix = (
            inside_one(before, here, after)
            and here.words < s.FRAGMENT_WORDS
            and before.last_text is not None
            and not ENDS.search(before.last_text)
            and (before.speaker == after.speaker or here.words <= 2)
            and call_words >= s.MIN_WORDS_SENTENCE
        )
        yield here._replace(speaker=before.speaker) if fix else here


def repaired(runs: Iterable[tuple], call_words: int, call_speakers: int) -> Iterator[Turn]:
    """Final turns of one call; ``runs`` have the columns of ``RUN``."""
    turns: Iterable[Turn] = (Turn(r[2], [r], r[5], r[6], r[7], r[8]) for r in runs)
    if call_speakers <= 1:
        turns = split_by_silence(turns, call_words)
    few = call_speakers <= 2
    turns = merged(smoothed(merged(renumbered(turns)), call_words, few))
    if few:
        turns = merged(ends_fixed(turns, call_words))
    return merged(renumbered(merged(sentences_repaired(turns, call_words))))


def repair_runs(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Runs with their final ``speaker`` and the number of their turn (``turn_idx``).

    ``totals`` (call_id, call_words, call_speakers) are those of the call as it
    was heard. A call heard as one speaker comes with its stretches between
    silences as runs, and is split between two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*RUN, "call_words", "call_speakers"]
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in names), strict=True))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(RUN) + 1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("speaker", "last_text") else pa.int64()) for n, c in zip([*RUN, "turn_idx"], columns, strict=True)], names=[*RUN, "turn_idx"])

        for _, call in groupby(rows, lambda r: r[0]):
            first = next(call)
            for number, turn in enumerate(repaired((r for part in ([first], call) for r in part), first[-2], first[-1])):
                out += [(r[0], r[1], turn.speaker, *r[3:9], number) for r in turn.runs]
                if len(out) >= 8192:
                    yield batch()
        yield batch()

    typed = [F.col(c).cast("string" if c in ("speaker", "last_text") else "long").alias(c) for c in [*RUN, "call_words", "call_speakers"]]
    ordered = runs.join(totals, "call_id").select(typed).repartition("call_id").sortWithinPartitions("call_id", "run_idx")
    schema = ", ".join(f"{c} {'string' if c in ('speaker', 'last_text') else 'long'}" for c in [*RUN, "turn_idx"])
    return ordered.mapInArrow(run, schema)
