"""Token counts by trie-shared dynamic programming.

A unigram tokenizer splits a pre-token into the pieces whose log-probabilities
add up highest. The forward scores of a prefix depend on the prefix alone, so
the distinct pre-tokens of a batch are laid out as a trie (sorted, which is its
depth-first order) and each shared prefix is scored once; the terminal of each
pre-token holds its number of pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from callflow.llm.shared import documents

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a word in the vocabulary.
WORD_START = "▁"
#: Pre-tokens a task remembers before it starts anew.
REMEMBERED = 1_000_000
COUNTS = "doc_id long, n_words long, n_tokens long"


class Unigram:
    """Log-probabilities of pieces, laid out as a trie over their reversed characters.

    A vocabulary whose scores are merge ranks has no probabilities; its pieces
    then follow Zipf's law over their rank. A character that no piece holds
    falls back to one piece per byte, each as likely as the last rank.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if all(float(s).is_integer() for _, s in pieces):
            ranked = sorted(pieces, key=lambda x: -x[1])
            norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
            pieces = [(p, -math.log(r + 1) - norm) for r, (p, _) in enumerate(ranked)]
        self.scores = dict(pieces)
        self.byte = min(self.scores.values(), default=0.0) - math.log(2)
        self.ends: dict = {}
        for piece, score in self.scores.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def extend(self, word: str, forward: list[tuple[float, int]]) -> None:
        """Forward state (score, minus pieces) of the prefix one character longer than ``forward`` covers."""
        end = len(forward)
        node, i, best = self.ends, end - 1, None
        while i >= 0 and (node := node.get(word[i])) is not None:
            score = node.get("")
            if score is not None:
                state = (forward[i][0] + score, forward[i][1] - 1)
                if best is None or state > best:
                    best = state
            i -= 1
        if word[end - 1] not in self.scores:
            n = len(word[end - 1].encode())
            state = (forward[end - 1][0] + n * self.byte, forward[end - 1][1] - n)
            if best is None or state > best:
                best = state
        forward.append(best)

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Pieces of each distinct word; prefixes that sorted neighbours share are scored once."""
        out: dict[str, int] = {}
        before, forward = "", [(0.0, 0)]
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del forward[shared + 1 :]
            while len(forward) <= len(word):
                self.extend(word, forward)
            out[word] = -forward[-1][1]
            before = word
        return out


@lru_cache(maxsize=2)
def unigram(model: bytes) -> Unigram:
    return Unigram(model)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    A pre-token is a maximal run of ``[^\\x20\\x09-\\x0D]`` with the word-start
    mark before it; white space itself costs nothing. ``tokenizer`` is the path
    of a sentencepiece model on the driver; its bytes (a vocabulary, so bounded)
    go to the tasks. No rows are shuffled.

    Null text and empty text: 0 and 0. Null doc_id and repeated rows come back
    as they are. Empty table: no rows. Other columns are ignored. Equal scores:
    fewer pieces win.
    """
    with open(tokenizer, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = unigram(model.value), {}
        for batch in batches:
            ids, n_words, n_tokens = batch["doc_id"].to_pylist(), [], []
            texts, fresh = batch["text"].cast(pa.binary()).to_pylist(), set()
            for text in texts:
                fresh.update(text.split())
            marked = {w: WORD_START + w.decode() for w in fresh if w not in known}
            found = vocabulary.counts(marked.values())
            known.update((w, found[x]) for w, x in marked.items())
            for text in texts:  # split again, as only distinct words are held
                words = text.split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    d = documents(docs)
    return d.withColumn("doc_id", d["doc_id"].cast("long")).mapInArrow(count, COUNTS)
