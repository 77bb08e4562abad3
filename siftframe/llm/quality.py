"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text give the non-negative unbiased risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])
with the logistic loss l; it is minimised over a linear model of the form of a text
(character classes, single marks, repeated words, phrases and lines). The class prior is
estimated as the share of positives among labelled rows. No negative label enters the risk.

Training collects the features, not the texts, of about ``positives`` and ``unlabelled``
documents (shares of the rows, by hash of the id); everything else reads all rows and whole texts.

Defined results: null text is the empty text and gets a score; rows with a null label or id teach
nothing; without positives every score is the prior 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import filled, fresh

POSITIVES = 4000
UNLABELLED = 12000
STEPS = 600

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = 6 + len(MARKS)
# class of each byte: control, space, digit, upper, lower, beyond ASCII, then one per mark
_CLASS_OF = np.array([6 + MARKS.index(chr(b)) if chr(b) in MARKS else 5 if b > 127 else 4 if chr(b).islower() else 3 if chr(b).isupper() else 2 if chr(b).isdigit() else 1 if chr(b).isspace() else 0 for b in range(256)], np.uint8)


def _repeats(items: list) -> float:
    return 1 - len(set(items)) / len(items) if items else 0.0


def features(text: str) -> np.ndarray:
    """Shares of character classes and of repeated words, pairs, triples and lines; length."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    classes = np.bincount(_CLASS_OF[data], minlength=_CLASSES) / max(len(data), 1)
    words = text.lower().split()
    lines = [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:]))
    twice = sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0
    shares = np.concatenate([classes, [twice, _repeats(words), _repeats(pairs), _repeats(list(zip(words, words[1:], words[2:]))), _repeats(lines)]])
    size = np.log1p(len(words))
    return np.concatenate([shares, np.sqrt(shares), [size, size * shares[_CLASSES + 1], len(data) / 100 / max(len(words), 1)]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative unbiased risk by Adam over all rows at once."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.c_[x, np.ones(len(x))] for x in (p, u))
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        of_positive = -prior * (p.T @ sigmoid(-gp)) / len(p)
        # where the estimated risk of negatives falls below zero, step back from it
        grad = of_positive + of_negative if negative >= 0 else -of_negative
        grad = grad + ridge * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"positive": batch["positive"], "x": [features(t) for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the rows of ``docs`` and ``labels`` for which ``train`` (over the id) holds."""
    width = len(features(""))
    known = labels.where(train & F.col(f"`{label}`").isNotNull()).select(F.col(f"`{id}`").cast("string").alias("id"), (F.col(f"`{label}`") == 1).alias("good"))
    n, good = known.agg(F.count("*"), F.coalesce(F.count_if("good"), F.lit(0))).first()
    if not good:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    trusted = known.where(F.col("good") & (place < positives / good)).select("id").distinct().limit(2 * positives).withColumn("positive", F.lit(True))
    learn = docs.where(train & F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("string").alias("id"), filled(text).alias("text"))
    rows = learn.select("id").count()
    # the trusted ids are a bounded sample, so they may be broadcast
    picked = learn.join(F.broadcast(trusted), "id", "left").withColumn("free", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < unlabelled / max(rows, 1) * (1 << 30))
    picked = picked.where(F.coalesce("positive", F.lit(False)) | F.col("free")).select("text", F.coalesce("positive", F.lit(False)).alias("positive"), "free")
    parts = F.array_compact(F.array(F.when(F.col("positive"), F.lit(True)), F.when(F.col("free"), F.lit(False))))
    sample = picked.select("text", F.explode(parts).alias("positive")).repartition(8)
    got = sample.mapInPandas(_featured, "positive boolean, x array<double>").collect()
    p = np.array([r["x"] for r in got if r["positive"]]).reshape(-1, width)
    u = np.array([r["x"] for r in got if not r["positive"]]).reshape(-1, width)
    if not len(p) or not len(u):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    return nn_pu(p, u, min(max(good / n, 0.01), 0.99))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score (0 to 1, higher: a positive is likelier) and predicted (1 from 0.5) added."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([features(t) for t in batch])) if len(batch) else [], dtype=float)

    added = fresh(docs, "score", "predicted")
    # only the text visits Python; not deterministic: so that filters on the result don't run it twice
    rows = docs.withColumn(added[0], scored.asNondeterministic()(filled(text)))
    return rows.withColumn(added[1], (F.col(added[0]) >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows predicted to be positives, with the columns they came with."""
    added = fresh(docs, "score", "predicted")
    return score(docs, model, text).where(F.col(added[1]) == 1).drop(*added)
