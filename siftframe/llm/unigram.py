"""SentencePiece encoding and decoding with a unigram model.

A double-array trie over the bytes of the pieces yields every piece that starts at a place of
a text, and the Viterbi algorithm chooses the segmentation with the greatest sum of log scores.
A character that no piece covers costs less than any piece by ``UNKNOWN_PENALTY`` and is then
written as byte pieces. Spaces are written as the marker U+2581, also before the first word;
decoding joins pieces, turns byte pieces into UTF-8 and markers into spaces.

As no piece holds a marker after another character, the best segmentation of a text is that of
its words one by one; words seen lately are kept in a table of bounded size.

A task holds the ids and texts of one Arrow batch; spark.sql.execution.arrow.maxRecordsPerBatch
bounds it where texts are long.

Defined results: null text has no ids, as has the empty text; a marker in the text itself comes
back as a space; bytes that are not UTF-8 decode to U+FFFD; control ids decode to nothing and the
unknown id to " ⁇ "; rows are treated one by one; other columns are carried.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh, stretches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 1 << 18
LONGEST = 48  # bytes of a word that takes its steps together with others
TOGETHER = 1 << 13  # words that do
_WORD = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


def double_array(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: the child of node n by byte c is base[n] + c + 1 if check there is n.

    value is the place in ``words`` of the word that ends at a node, or -1.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for k, word in enumerate(words):
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = k
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    place, free, dense = {0: 0}, 257, 257  # first slot not taken that every byte can use; where the search for several slots starts
    for node in range(len(children)):
        at = place[node]
        value[at] = ends[node]
        keys = sorted(children[node])
        if not keys:
            continue
        while taken[free]:
            free += 1
        dense = max(dense, free)
        first = b = max((free if len(keys) == 1 else dense) - keys[0] - 1, 0)
        while any(taken[b + c + 1] for c in keys):
            b += 1
        if len(keys) > 1 and b - first > 64:  # the slots passed over are left to single children
            dense = b
        if b + 1024 > size:
            base, check, value = np.append(base, np.zeros(size, np.int32)), np.append(check, np.full(size, -1, np.int32)), np.append(value, np.full(size, -1, np.int32))
            taken.extend(bytes(size))
            size *= 2
        base[at] = b
        for c, child in children[node].items():
            taken[b + c + 1] = 1
            check[b + c + 1] = at
            place[child] = b + c + 1
    return base, check, value


@dataclass
class Unigram:
    """Pieces with log scores; ``kinds``: n normal, b byte, u unknown, c control (and unused)."""

    pieces: list[str]
    scores: list[float]
    kinds: str
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        normal = [k for k, kind in enumerate(self.kinds) if kind == "n" and self.pieces[k]]
        base, check, value = double_array([self.pieces[k].encode() for k in normal])
        self.base, self.check = array("i", base.tobytes()), array("i", check.tobytes())
        self.value = array("i", [normal[v] if v >= 0 else -1 for v in value.tolist()])
        self.byte_ids = {int(self.pieces[k][3:-1], 16): k for k, kind in enumerate(self.kinds) if kind == "b"}
        self.unknown = self.kinds.find("u")
        self.unknown_score = min((self.scores[k] for k in normal), default=0.0) - UNKNOWN_PENALTY
        # words are independent unless a piece reaches over the start of one
        self.by_word = not any(MARK in self.pieces[k].lstrip(MARK) for k in normal)

    def __getstate__(self):
        return self.pieces, self.scores, self.kinds, self.base, self.check, self.value, self.byte_ids, self.unknown, self.unknown_score, self.by_word

    def __setstate__(self, state):
        self.pieces, self.scores, self.kinds, self.base, self.check, self.value, self.byte_ids, self.unknown, self.unknown_score, self.by_word = state
        self.cache = {}

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best segmentation; of equal ones that whose last piece starts earliest."""
        data, base, check, value, scores = word.encode("utf-8", "replace"), self.base, self.check, self.value, self.scores
        n, size = len(data), len(check)
        best, start, ids = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            score, lead = best[at], data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, alone = 0, False
            for end in range(at, n):
                child = base[node] + data[end] + 1
                if child >= size or check[child] != node:
                    break
                node, k = child, value[child]
                if k >= 0:
                    to, total = end + 1, score + scores[k]
                    alone = alone or to - at == width
                    if best[to] is None or total > best[to]:
                        best[to], start[to], ids[to] = total, at, k
            if not alone:
                to, total = at + width, score + self.unknown_score
                if best[to] is None or total > best[to]:
                    best[to], start[to], ids[to] = total, at, -1
            at += width
        out, at = [], n
        while at > 0:
            if ids[at] >= 0:
                out.append(ids[at])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(data[start[at] : at]))
            else:
                out.append(self.unknown)
            at = start[at]
        return out[::-1]

    def viterbi_many(self, words: list[str]) -> list[bytes]:
        """The ids of many words, as 32-bit numbers: all words take each step of the trie together."""
        if not hasattr(self, "tables"):
            self.tables = [np.frombuffer(t, np.int32) for t in (self.base, self.check, self.value)] + [np.array(self.scores)]
        base, check, value, scores = self.tables
        coded = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(words)
        short = sorted((k for k, c in enumerate(coded) if 0 < len(c) <= LONGEST), key=lambda k: len(coded[k]))
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            sizes = np.array([len(coded[k]) for k in part])
            n, longest = len(part), int(sizes.max())
            data = np.frombuffer(b"".join(coded[k].ljust(longest, b"\0") for k in part), np.uint8).reshape(n, longest).astype(np.int32)
            width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
            best = np.full((n, longest + 5), -np.inf)
            best[:, 0] = 0.0
            start, ids = np.zeros((n, longest + 5), np.int32), np.zeros((n, longest + 5), np.int32)
            for s in range(longest):
                here = np.flatnonzero((best[:, s] > -np.inf) & (s < sizes))
                alone = np.zeros(n, bool)
                rows, node = here, np.zeros(len(here), np.int32)
                for end in range(s, longest):
                    child = base[node] + data[rows, end] + 1
                    on = (check[child] == node) & (end < sizes[rows])
                    rows, node = rows[on], child[on]
                    if not len(rows):
                        break
                    found = value[node] >= 0
                    to, piece = rows[found], value[node[found]]
                    alone[to[end + 1 - s == width[to, s]]] = True
                    total = best[to, s] + scores[piece]
                    better = total > best[to, end + 1]
                    to, piece = to[better], piece[better]
                    best[to, end + 1], start[to, end + 1], ids[to, end + 1] = total[better], s, piece
                rest = here[~alone[here]]
                to, total = s + width[rest, s], best[rest, s] + self.unknown_score
                better = total > best[rest, to]
                rest, to = rest[better], to[better]
                best[rest, to], start[rest, to], ids[rest, to] = total[better], s, -1
            chosen, count, place = np.zeros((n, longest + 1), np.int32), np.zeros(n, np.int64), sizes.copy()
            while (left := np.flatnonzero(place > 0)).size:
                count[left] += 1
                chosen[left, longest + 1 - count[left]] = ids[left, place[left]]
                place[left] = start[left, place[left]]
            unknown = (chosen < 0).any(1)
            for row, k in enumerate(part):
                if not unknown[row]:
                    out[k] = chosen[row, longest + 1 - count[row] :].tobytes()
        return [array("i", self.viterbi(w)).tobytes() if ids is None else ids for w, ids in zip(words, out)]

    def _split(self, text: str) -> list[str]:
        """The words of a text; one that follows a single space stands without its marker."""
        if not text:
            return []
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return words
        chunks = _WORD(MARK + text.replace(" ", MARK))
        return [c[1:] if c[0] == MARK and len(c) > 1 and MARK not in c[1:] else c for c in chunks]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(self.viterbi(MARK + t.replace(" ", MARK)) if t else [], np.int32) for t in texts]
        split = [self._split(t) for t in texts]
        unseen = list(set().union(*split).difference(self.cache))
        if len(self.cache) + len(unseen) > CACHED_WORDS:
            self.cache.clear()
            unseen = list(set().union(*split))
        self.cache.update(zip(unseen, self.viterbi_many([w if w[:1] == MARK else MARK + w for w in unseen])))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        kinds, pieces = self.kinds, self.pieces
        if not len(ids):
            return ""
        out, held = [], bytearray()
        for k in ids:
            kind = kinds[k]
            if kind == "n":
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(pieces[k])
            elif kind == "b":
                held.append(int(pieces[k][3:-1], 16))
            elif kind == "u":
                out.append(held.decode("utf-8", "replace") + " ⁇ ")
                held.clear()
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


def load(path: str) -> Unigram:
    """The pieces and scores of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    kind = lambda k: "b" if model.is_byte(k) else "u" if model.is_unknown(k) else "c" if model.is_control(k) or model.is_unused(k) else "n"
    return Unigram([model.id_to_piece(k) for k in every], [model.get_score(k) for k in every], "".join(map(kind, every)))


def round_trip(docs: DataFrame, model: Unigram, text: str = "text") -> DataFrame:
    """The rows with ``ids`` and ``decoded`` added: both ways in one visit to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, back = batch.tolist(), [], []
            for part in stretches(texts):
                ids += shared.value.encode_many(texts[part])
                back += [shared.value.decode(x.tolist()) for x in ids[part]]
            yield pd.DataFrame({"ids": ids, "decoded": back})

    found, *added = fresh(docs, "found", "ids", "decoded")
    rows = docs.withColumn(found, both.asNondeterministic()(filled(text)))
    return rows.withColumns({name: F.col(found)[part] for name, part in zip(added, ("ids", "decoded"))}).drop(found)


def encode(docs: DataFrame, model: Unigram, text: str = "text") -> DataFrame:
    """The rows with ``ids`` added, an array of piece ids; only the text visits Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the model file

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = batch.tolist(), []
            for part in stretches(texts):
                out += shared.value.encode_many(texts[part])
            yield pd.Series(out, dtype=object)

    (ids,) = fresh(docs, "ids")
    return docs.withColumn(ids, encoded.asNondeterministic()(filled(text)))


def decode(rows: DataFrame, model: Unigram, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded`` added; null ids decode to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: "" if x is None else shared.value.decode(x.tolist()))

    (name,) = fresh(rows, "decoded")
    return rows.withColumn(name, decoded.asNondeterministic()(F.col(f"`{ids}`")))
