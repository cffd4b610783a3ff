"""Chat formatting by token-level assembly.

Role and text of a turn are encoded apart, after control strings occurring in
them are escaped, and the reserved ids of the template are spliced between
them. The loss mask follows from prefix sums of the segment lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callflow.llm.shared import only

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that the vocabulary was built with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks of a turn; they take the ids after the vocabulary, in this order.
MARKS = ("<|turn|>", "<|says|>", "<|done|>")
#: Strings that models of this and other templates read as control; escaped where a text holds them.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
FORBIDDEN = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, turn long, ids array<int>, mask array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def escape(text: str) -> str:
    """Double backslashes, and break every control string by a backslash after its first character."""
    return FORBIDDEN.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> pa.Array:
    """The bytes of each id, null where it has none; the marks, which take the last ids, are empty."""
    enc = encoding(ranks)
    known = {enc.encode_single_token(piece): piece for piece in enc.token_byte_values()}
    return pa.array([*map(known.get, range(enc.max_token_value + 1)), *[b""] * len(MARKS)], pa.binary())


def assemble(enc: tiktoken.Encoding, roles: list[str], texts: list[str], learn: tuple[str, ...]) -> tuple[pa.ListArray, pa.ListArray]:
    """Token ids of each turn, and which of them the loss covers."""
    start, says, done = ([enc.max_token_value + 1 + i] for i in range(len(MARKS)))
    segments = [s for role, text in zip(roles, texts, strict=True) for s in (start, enc.encode_ordinary(escape(role)), says, enc.encode_ordinary(escape(text)), done)]
    ends = np.cumsum([0, *map(len, segments)])
    learnt = np.array([role in learn for role in roles], bool)
    steps = np.zeros(ends[-1] + 1, np.int8)
    steps[ends[3::5][learnt]] += 1
    steps[ends[4::5][learnt]] -= 1
    ids = np.fromiter(chain.from_iterable(segments), np.int32, ends[-1])
    turns = pa.array(ends[::5], pa.int32())
    return pa.ListArray.from_arrays(turns, ids), pa.ListArray.from_arrays(turns, np.cumsum(steps[:-1], dtype=np.int8) > 0)


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, position, first_token, ids, mask.

    ``first_token`` is where the turn begins in its conversation, so pieces of
    any number of turns can be packed or written without gathering a whole
    conversation. The mask covers the texts (not the marks) of the roles in
    ``learn``. Turns go by ``turn`` (null first), then by their tokens.

    Null text and null role: empty. Null conv_id: a conversation of its own.
    Repeated rows are turns of their own. Empty table: no rows. Other columns
    are ignored. A turn is encoded where it is read; only the running position
    needs the turns of a conversation in order. It is a window, so the rows stay
    dealt by ``conv_id`` and ``read_back`` needs no second shuffle.
    """
    with open(tokenizer, "rb") as file:
        ranks = turns.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            ids, mask = assemble(enc, batch["role"].to_pylist(), batch["text"].to_pylist(), learn)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], ids, mask], ["conv_id", "turn", "ids", "mask"])

    conv_id, turn, role, text = only(turns, "conv_id", "turn", "role", "text")
    rows = turns.select(conv_id.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role, text).fillna("", ["role", "text"])
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "ids").rowsBetween(Window.unboundedPreceding, -1)
    position = F.count(F.lit(1)).over(before).alias("position")
    first = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).alias("first_token")
    return rows.mapInArrow(encode, TURNS).select("conv_id", position, first, "ids", "mask")


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Digest of each conversation, read from its ids and mask alone.

    ``turns_sha256`` covers role, line feed, text, line feed of each turn;
    ``loss_chars`` and ``loss_sha256`` the texts under the mask; ``formatted_chars``
    the rendered conversation. Hashing is sequential, so a conversation streams
    through one task with its running digests as the only state.
    """
    with open(tokenizer, "rb") as file:
        ranks = formatted.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks.value)
        start, says, done = (len(words) - len(MARKS) + i for i in range(len(MARKS)))
        marks = sum(map(len, MARKS))
        conv, state = object(), None

        def ended() -> list:
            return [] if state is None else [(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])]

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(schema.types)], schema=schema)

        def strings(ids: np.ndarray, ends: np.ndarray) -> list[str]:
            """What each stretch of ids up to the next end says."""
            cuts = pa.array(np.concatenate([[0], ends]), pa.int32())
            return pc.binary_join(pa.ListArray.from_arrays(cuts, words.take(pa.array(ids))), b"").cast(pa.string()).to_pylist()

        for batch in batches:
            found = []
            ids, mask = batch["ids"].flatten().to_numpy(), batch["mask"].flatten().to_numpy(zero_copy_only=False)
            lengths = batch["ids"].value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            starts, splits, dones = (np.flatnonzero(ids == mark) for mark in (start, says, done))
            if not np.array_equal(starts, ends - lengths) or not np.array_equal(dones, ends - 1):
                raise ValueError("a turn is not enclosed by its marks")
            if not np.array_equal(np.searchsorted(ends, splits, "right"), np.arange(len(ends))):
                raise ValueError("a turn has not one role and one text")
            if not batch["mask"].value_lengths().equals(batch["ids"].value_lengths()) or (ids[mask] >= start).any():
                raise ValueError("a mask is not as long as its turn, or covers a mark")
            said = strings(ids, np.stack([splits, ends], 1).ravel())
            learnt = strings(ids[mask], np.cumsum(mask)[ends - 1])
            for c, role, text, learn, n in zip(batch["conv_id"].to_pylist(), said[::2], said[1::2], map(unescape, learnt), lengths.tolist(), strict=True):
                if state is None or c != conv:
                    found += ended()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(learn)
                state[3].update(learn.encode())
                state[4] += marks + len(role) + len(text)
                state[5] += n
            yield rows(found)
        yield rows(ended())

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "ids", "mask").mapInArrow(digest, DIGEST)
