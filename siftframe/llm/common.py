"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot above 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def filled(column: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def attach(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """Join rows with a table of unique keys in which ``n`` counts the rows of each key.

    Keys with more than total/HOT_SHARE rows - fewer than HOT_SHARE of them, so they
    may be broadcast - are matched where their rows lie; only the others shuffle.
    """
    cut = max(total // HOT_SHARE, 1000)
    hot = F.broadcast(table.where(F.col(n) > cut))
    cold = table.where(F.col(n) <= cut)
    direct = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return direct.unionByName(rest)


def stretches(texts: list[str], size: int = 1 << 21) -> Iterator[slice]:
    """Slices of a list of texts that hold at most ``size`` characters, or one text."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= size):
            held += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end
