"""Packing of tokenised documents into windows of fixed length by best-fit decreasing.

A document longer than a window is first cut into full windows. The remainders are taken in
descending length; a segment tree over the remaining capacities finds the tightest open
window that holds one. Every task packs its own documents, some million tokens at a time,
so memory is bounded and nothing shuffles. Windows of which much would be padding (a few
per task, at its end) are cut into sequences of powers of two, which need none.

Defined results: null text is the empty text, which is one piece holding the end id alone;
rows with equal or null ids are packed as separate documents; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled

WINDOW = 2048
END_ID = 1
CHUNK_TOKENS = 1 << 22  # tokens that a task packs at once
TAIL_FREE = 64  # windows with more free places than this are cut into powers of two
CACHED_WORDS = 1 << 18
# Fixed value: the split of byte-level BPE before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WordIds(dict):
    """Word -> ids, as little-endian 32-bit numbers, of a space and the word.

    The file is a byte-level BPE of the tokenizers library whose ids are the ranks of its
    merges; words not seen lately are merged by tiktoken over the same ranks, which gives
    the same ids. A text that holds the string of a special token, which is one id wherever
    it stands, is left to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(letters[c] for c in word): k for word, k in vocabulary.items() if word not in self.special}
        self.merges = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():  # a run of white space, which no word boundary may cut
            raise KeyError(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids = array("I", self.merges(" " + word)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        try:
            return array("I", self.merges(first)).tobytes() + b"".join(map(self.__getitem__, words))
        except KeyError:
            return array("I", self.merges(text)).tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Capacities:
    """Open windows by remaining capacity; a segment tree over 0..size tells which capacities occur."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity that is at least ``need``."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: everything under its parent's right side is done
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices of lengths (1..window each) per window, by best-fit decreasing."""
    opened, held = Capacities(window), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = opened.take_tightest(lengths[k])
        capacity, at = found or (window, len(held))
        if found is None:
            held.append([])
        held[at].append(k)
        if capacity > lengths[k]:
            opened.put(capacity - lengths[k], at)
    return held


def _sequences(tokens: list[np.ndarray], window: int, tail_free: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document's place in the list, start, length)."""
    rest = []
    for d, ids in enumerate(tokens):
        full = len(ids) // window
        yield from ([(d, k * window, window)] for k in range(full))
        if len(ids) % window:
            rest.append((d, full * window, len(ids) % window))
    for members in best_fit([r[2] for r in rest], window):
        pieces = [rest[k] for k in members]
        filled_to = sum(p[2] for p in pieces)
        if window - filled_to <= tail_free:
            yield pieces
            continue
        for bit in reversed(range(filled_to.bit_length())):  # the binary digits of the length
            room, part = filled_to & (1 << bit), []
            while room:
                d, start, length = pieces.pop(0)
                cut = min(room, length)
                part.append((d, start, cut))
                if cut < length:
                    pieces.insert(0, (d, start + cut, length - cut))
                room -= cut
            if part:
                yield part


PIECES = "length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, tail_free: int = TAIL_FREE) -> DataFrame:
    """Pieces of documents in sequences: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    end = np.asarray([end_id], "<u4")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer)
        number = TaskContext.get().partitionId() << 40  # a rerun of the task gives the same numbers

        def chunk(ids: list, tokens: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            nonlocal number
            rows = []
            for pieces in _sequences(tokens, window, tail_free):
                offset = 0
                for d, start, length in pieces:
                    rows.append((ids[d], start, length, tokens[d][start : start + length].tobytes(), len(tokens[d]), number, offset))
                    offset += length
                number += 1
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

        ids, tokens, held = [], [], 0
        for batch in batches:
            for key, whole in zip(batch["id"], batch["text"]):
                ids.append(key)
                tokens.append(np.concatenate([np.frombuffer(words.encode(whole), "<u4"), end]))
                held += len(tokens[-1])
                if held >= CHUNK_TOKENS:
                    yield from chunk(ids, tokens)
                    ids, tokens, held = [], [], 0
        yield from chunk(ids, tokens)

    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").cast("string").alias("id"), filled(text).alias("text"))
    pieces = slim.mapInPandas(packed, f"id string, start long, {PIECES}")
    return pieces.select(F.col("id").cast(kind).alias(id), *names[1:])
