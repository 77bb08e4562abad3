"""Similarity of two texts: share of characters kept by a longest common subsequence."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from siftframe.functions.values import strip

LONG = 256  # longer texts get a character count test before the comparison


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, one big-integer step per character.

    Bit-vector recurrence published by H. Hyyro (2004).
    """
    start = 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return start + end + len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """0-100; 0 when either is missing or empty."""
    if not a or not b:
        return 0.0
    total = len(a) + len(b)
    return (1 - (total - 2 * common_length(a, b)) / total) * 100


def ratio_at_least(a: str, b: str, threshold: float) -> bool:
    """As comparing :func:`ratio`, with a cheap upper bound first for long texts."""
    total = len(a) + len(b)
    if total > 2 * LONG:
        shared = (Counter(a) & Counter(b)).total()
        if (2 * shared / total) * 100 < threshold - 1e-6:
            return False
    return ratio(a, b) >= threshold


@pandas_udf(DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def normal_form(c: Column) -> Column:
    """The form compared: trimmed, lower case."""
    return F.lower(strip(c))


def similarity(a: Column, b: Column) -> Column:
    """Similarity 0-100 of two text columns, ignoring case and surrounding space."""
    return _ratio_udf(normal_form(a), normal_form(b))


def similar_udf(threshold: float):
    @pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio_at_least(x, y, threshold) for x, y in zip(a, b)], dtype="bool")

    return similar
