"""Language identification by error-correcting output codes.

Every language has a codeword of bits, and one binary n-gram classifier predicts each bit:
the log odds of hashed byte 1- to 3-grams between the languages that have the bit and those
that have not. A text goes to the codeword with the least loss, each bit weighted by how well
its classifier does on the sample; a text whose two best codewords are close is ambiguous.

Training counts n-grams on executors over about ``per_language`` documents of each language
(a share of its rows, by hash of the id); everything else reads all rows and whole texts.

Defined results: null text and text without letters are `und` with score 0 (not ambiguous);
rows with null language or id teach nothing; with a single language, or none, in training every text
gets that language, or `und`; an empty table gives an empty table; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh, stretches

BUCKETS = 1 << 15
ORDERS = 3
PER_LANGUAGE = 3000  # training documents of a language
SLICE = 1 << 18  # bytes scored at once
UNKNOWN = "und"
AMBIGUOUS = 0.1  # least difference of the two best scores

# ASCII other than letters separates words; the bytes of other characters stand for themselves
_LETTERS = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each byte but the last ORDERS - 1."""
    n, code = len(data) - ORDERS + 1, np.zeros(max(len(data) - ORDERS + 1, 0), np.uint32)
    for k in range(ORDERS):
        code = (code * np.uint32(257) + data[k : n + k]).astype(np.uint32)
        mixed = (code + np.uint32(k + 1)) * np.uint32(2654435761)
        yield (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each between spaces, and where each text starts."""
    parts = [b" " + t.encode("utf-8", "replace") + b"  " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return _LETTERS[np.frombuffer(b"".join(parts), np.uint8)], starts


def gram_counts(texts: list[str]) -> np.ndarray:
    """Occurrences of each bucket in the texts."""
    counts = np.zeros(BUCKETS)
    for part in stretches(texts):
        data, starts = _joined(texts[part])
        for at in range(0, starts[-1], SLICE):
            for codes in _grams(data[at : at + SLICE + ORDERS - 1]):
                counts += np.bincount(codes, minlength=BUCKETS)
    return counts


def gram_means(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean over its n-grams, per text, of the weight rows of their buckets."""
    if not texts:
        return np.zeros((0, weights.shape[1]))
    return np.concatenate([_gram_means(texts[part], weights) for part in stretches(texts)])


def _gram_means(texts: list[str], weights: np.ndarray) -> np.ndarray:
    data, starts = _joined(texts)
    sums = np.zeros((len(texts), weights.shape[1]))
    for at in range(0, starts[-1], SLICE):
        end = min(at + SLICE, starts[-1] - ORDERS + 1)
        if end <= at:
            break
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, end - 1, "right") - 1
        cuts = np.maximum(starts[first : last + 1], at) - at
        total = sum(weights[codes] for codes in _grams(data[at : end + ORDERS - 1]))
        sums[first : last + 1] += np.add.reduceat(total, cuts, axis=0)
    return sums / np.maximum(ORDERS * np.diff(starts), 1)[:, None]


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language: all splits in two for up to five, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1, *(1 if k >> i & 1 else -1 for i in range(n - 1))] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits).T
    rng, width = np.random.default_rng(0), 2 * int(np.ceil(5 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        distance = (width - code @ code.T) / 2 + width * np.eye(n)
        if distance.min() > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, distance.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # of each bit

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of texts that have letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        margins = gram_means(texts, self.weights) * 8.0
        loss = np.stack([(self.trust * np.logaddexp(0, -row * margins)).sum(1) for row in self.code], axis=1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, axis=1)
        second = ranked[:, -2] if len(self.languages) > 1 else 0.0
        return [self.languages[k] for k in share.argmax(1)], ranked[:, -1], ranked[:, -1] - second < AMBIGUOUS


def fit(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows for which ``train`` holds and whose language is not null."""
    rows = docs.where(train & F.col(f"`{lang}`").isNotNull() & F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = [name for name, _ in found]
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))) for name, n in found))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    sample = sample.select("lang", F.lower(filled("text")).alias("text"), F.pmod(F.xxhash64("id"), F.lit(5)).alias("part"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, group in batch.groupby(["lang", "part"]):
                totals[key] = totals.get(key, 0) + gram_counts(group["text"].tolist())
        for (name, part), counts in totals.items():
            yield pd.DataFrame({"lang": [name], "part": [part], "counts": [counts.astype(np.float32).tobytes()]})

    counts = np.zeros((len(languages), 5, BUCKETS))
    for r in sample.repartition(8).mapInPandas(counted, "lang string, part long, counts binary").collect():
        counts[languages.index(r["lang"]), r["part"]] += np.frombuffer(r["counts"], np.float32)
    code = codewords(len(languages))

    def log_odds(of: np.ndarray) -> np.ndarray:
        p = (of + 0.1) / (of.sum(1, keepdims=True) + 0.1 * BUCKETS)
        return np.stack([np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)) if len(set(bit)) > 1 else np.zeros(BUCKETS) for bit in code.T], axis=1)

    # a bit is trusted as far as its log odds of four fifths agree with the left out fifth
    odds = log_odds(counts[:, :4].sum(1))
    rest = counts[:, 4] / np.maximum(counts[:, 4].sum(1, keepdims=True), 1)
    trust = 1 / (1 + np.exp(-4 * (code * (rest @ odds)).min(0)))
    return Model(languages, code, log_odds(counts.sum(1)).astype(np.float32), trust / trust.max())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score (0 to 1) and ambiguous added."""

    @F.pandas_udf("lang string, score double, close boolean")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            known = batch.notna().to_numpy()
            names, scores, close = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch)), np.zeros(len(batch), bool)
            if known.any():
                names[known], scores[known], close[known] = model.decode(batch[known].tolist())
            yield pd.DataFrame({"lang": names, "score": scores, "close": close})

    found, *added = fresh(docs, "found", "lang_pred", "score", "ambiguous")
    letters = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.lower(F.col(f"`{text}`")))
    # only the text visits Python; not deterministic: so that filters on the result don't run it twice
    rows = docs.withColumn(found, scored.asNondeterministic()(letters))
    return rows.withColumns({name: F.col(found)[part] for name, part in zip(added, ("lang", "score", "close"))}).drop(found)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is known and not ambiguous, with the columns they came with."""
    added = fresh(docs, "lang_pred", "score", "ambiguous")
    return predict(docs, model, text).where((F.col(added[0]) != UNKNOWN) & ~F.col(added[2])).drop(*added)
