"""Exact quantiles without holding a whole column in one task.

The built-in ``percentile`` keeps every distinct value of a group in memory. Here
the pass that finds number and extent of the values also fills a mergeable KLL
sketch per column, whose quantiles a little below and above a wanted one bracket it.
The values below each bracket are counted, which tells the exact ranks
within, and one more pass gathers the values of brackets that hold few enough to sort; larger ones it
counts per bin, and another pass gathers the bins with the wanted ranks. Should a sketch be wrong by
more than its margin, or a bin still hold too many values, brackets are narrowed by
counting per bin until they are small, so the result is exact on any data.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 50_000  # values per column that one task may sort
BINS = 1024
MOST_BINS = 8192  # per bracket that a sketch has found; a task gives out so many rows at most
SKETCH = 4096  # size parameter of the sketches: ranks are right within 0.2 % in all but one of 10,000 cases
MARGIN = 0.003  # taken on both sides of a wanted rank
LOG_SHIFT = 750.0  # makes the logarithm of every positive double positive
LARGEST = 1.7976931348623157e308


@dataclass
class Bracket:
    low: float
    high: float
    below: int  # values smaller than ``low``
    size: int  # values in [low, high]


def _is_wide(low: float, high: float) -> bool:
    """Whether a bracket spans several magnitudes, so that equal-width bins would not part its values."""
    if low <= 0 <= high:
        return True
    a, b = sorted((abs(low), abs(high)))
    return b > BINS * a


def _spot(x: float, wide: bool) -> float:
    """Where a value lies in its bracket: on a signed logarithmic scale if wide. Never decreases with x."""
    if not wide or x == 0:
        return x
    return math.copysign(math.log(abs(x)) + LOG_SHIFT, x)


def interpolate(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else low + (high - low) * share


def _long(df: DataFrame, parts: list[Column]) -> DataFrame:
    """(id, x): the non-null values of each expression, by its position."""
    names = [str(i) for i in range(len(parts))]
    wide = df.select(*[x.alias(n) for n, x in zip(names, parts)])
    long = wide.unpivot([], names, "id", "x").where("x is not null")
    return long.select(F.col("id").cast("int").alias("id"), "x")


def _inside(x: Column, b: Bracket) -> Column:
    return F.when(x.between(b.low, b.high), x)


def _narrow(df: DataFrame, columns: dict[str, Column], targets: dict[tuple[str, int], Bracket], limit: int) -> None:
    """Shrink every bracket to at most ``limit`` values or to a single value."""
    while True:
        open_ = {k: b for k, b in targets.items() if b.size > limit and b.low < b.high}
        if not open_:
            return
        # targets of one column often share a bracket
        shared = sorted({(c, b.low, b.high) for (c, _), b in open_.items()})
        long = _long(df, [_inside(columns[c], Bracket(low, high, 0, 0)) for c, low, high in shared])
        wide = [_is_wide(low, high) for _, low, high in shared]
        ends = [(_spot(low, w), _spot(high, w)) for (_, low, high), w in zip(shared, wide)]
        of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("id"))
        spot = F.when(of(wide), F.signum("x") * (F.log(F.abs("x")) + F.lit(LOG_SHIFT))).otherwise(F.col("x"))
        spot = F.when(F.col("x") == 0, F.lit(0.0)).otherwise(spot)
        # halved, so that the width of a bracket is finite
        place = (spot / 2 - of([a / 2 for a, _ in ends])) / of([b / 2 - a / 2 for a, b in ends])
        bin_ = F.greatest(F.least(F.floor(place * BINS).cast("int"), F.lit(BINS - 1)), F.lit(0))
        bins: dict[int, list] = {}
        for r in (
            long.groupBy("id", bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            .orderBy("id", "bin")
            .collect()
        ):
            bins.setdefault(r["id"], []).append(r)
        for (c, rank), b in open_.items():
            below = b.below
            for r in bins[shared.index((c, b.low, b.high))]:
                if rank < below + r["n"]:
                    targets[c, rank] = Bracket(r["low"], r["high"], below, r["n"])
                    break
                below += r["n"]


def _ranked(df: DataFrame, columns: dict[str, Column], targets: dict[tuple[str, int], Bracket]) -> dict:
    """Value at each rank, from brackets already known to be small."""
    found = {k: b.low for k, b in targets.items() if b.low == b.high}
    rest = {k: b for k, b in targets.items() if k not in found}
    shared = sorted({(c, b.low, b.high) for (c, _), b in rest.items()})
    if not shared:
        return found
    parts = [_inside(columns[c], Bracket(low, high, 0, 0)) for c, low, high in shared]
    wanted: dict[int, list[tuple[tuple[str, int], int]]] = {}
    for (c, rank), b in rest.items():
        wanted.setdefault(shared.index((c, b.low, b.high)), []).append(((c, rank), rank - b.below))
    picks = F.create_map(
        *[e for i, ks in wanted.items() for e in (F.lit(i), F.array(*[F.lit(k) for _, k in ks]))]
    )
    rows = (
        _long(df, parts)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most `limit` values
        .select("id", F.transform(picks[F.col("id")], lambda k: F.get("xs", k)).alias("v"))
        .collect()
    )
    for r in rows:
        for (key, _), v in zip(wanted[r["id"]], r["v"]):
            found[key] = v
    return found


@dataclass(frozen=True)
class Extent:
    """Number of values of a column, the least and greatest of them, and what surrounds the wanted quantiles by a sketch."""

    count: int
    low: float | None
    high: float | None
    marks: tuple[float, ...] = ()


def _ranks(probs: list[float]) -> list[float]:
    return [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]


def bounded(x: Column) -> Column:
    """Infinite values count as the largest finite ones, so that bins stay finite."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)))


def marks(x: Column, probs: list[float]) -> Column:
    """Aggregate: values at the ranks that surround the wanted quantiles, by a KLL sketch; null without values."""
    sketch = F.kll_sketch_agg_double(bounded(x), SKETCH)
    ranks = F.array(*[F.lit(r) for r in _ranks(probs)])
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def counted_quantiles(counts: list[tuple[float, int]], probs: list[float]) -> list[float]:
    """Linearly interpolated quantiles of values that are known with their numbers of rows."""
    values, sizes = zip(*sorted(counts))
    upto = list(accumulate(sizes))  # rows up to each value
    at = lambda rank: values[bisect_right(upto, rank)]
    out = []
    for p in probs:
        rank, share = divmod((upto[-1] - 1) * p, 1)
        out.append(interpolate(at(int(rank)), at(math.ceil((upto[-1] - 1) * p)), share))
    return out


def extents(df: DataFrame, columns: dict[str, Column], probs: list[float] | None = None) -> dict[str, Extent]:
    """One pass over all columns."""
    aggs = [f(x).alias(f"{k}{i}") for i, x in enumerate(columns.values()) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    if probs:
        aggs += [marks(x, probs).alias(f"m{i}") for i, x in enumerate(columns.values())]
    row = df.agg(*aggs).first()
    return {c: Extent(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], tuple(row[f"m{i}"] or ()) if probs else ()) for i, c in enumerate(columns)}


def _placed(df: DataFrame, columns: dict[str, Column], wanted: dict[tuple[str, int], tuple[float, float, float]], limit: int, found: dict) -> dict[tuple[str, int], Bracket]:
    """Brackets (low, high, expected number of values), by a count of what lies below and a pass over what lies within: values found go to
    ``found``, other ranks get a bracket.

    A rank that is not within its bracket is left out.
    """
    shared = sorted({(c, low, high, size) for (c, _), (low, high, size) in wanted.items()})
    small = [size <= limit for *_, size in shared]
    bins = [1 if few else min(MOST_BINS, max(BINS, 4 * int(size / limit))) for few, (*_, size) in zip(small, shared)]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("id"))
    # values below a bracket are only counted; no rows are made of them
    under = df.agg(*[F.count_if(columns[c] < F.lit(float(low))).alias(f"n{i}") for i, (c, low, *_) in enumerate(shared)]).first()
    long = _long(df, [_inside(columns[c], Bracket(low, high, 0, 0)) for c, low, high, _ in shared])
    low = of([float(low) for _, low, _, _ in shared])
    # halved, so that the width of a bracket is finite
    width = of([max(high / 2 - low / 2, 5e-324) for _, low, high, _ in shared])
    place = F.least(F.floor((F.col("x") / 2 - low / 2) / width * of(bins)).cast("int"), of(bins) - 1)
    high = of([float(high) for _, _, high, _ in shared])
    # the ends may be values of many rows and have bins of their own; what lies between is as many rows as expected
    bin_ = F.when(F.col("x") == low, 0).when(F.col("x") == high, of(bins) + 1).otherwise(F.greatest(place, F.lit(0)) + 1)
    kept = F.when(of(small) & (F.col("x") > low) & (F.col("x") < high), F.col("x"))
    rows = long.groupBy("id", bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.sort_array(F.collect_list(kept)).alias("xs")
    )
    got: dict[int, list] = {}
    for r in rows.orderBy("id", "bin").collect():
        got.setdefault(r["id"], []).append(r)
    left = {}
    for (c, rank), (lo, hi, size) in wanted.items():
        at = shared.index((c, lo, hi, size))
        below = under[f"n{at}"]
        for r in got.get(at, []):
            if below <= rank < below + r["n"]:
                if r["xs"]:
                    found[c, rank] = r["xs"][rank - below]
                else:
                    left[c, rank] = Bracket(r["low"], r["high"], below, r["n"])
                break
            below += r["n"]
    return left


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    limit: int = SMALL,
    known: dict[str, Extent] | None = None,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of several double columns (null = not a value).

    ``known`` saves the pass that finds the extent of the columns (with marks for
    the same ``probs``, or none). Columns without values are left out of the result.
    """
    known = known or (extents(df, columns, probs) if columns else {})
    clip = lambda x: max(-LARGEST, min(LARGEST, x))
    finite = {}
    for c, x in columns.items():
        infinite = known[c].count and (math.isinf(known[c].low) or math.isinf(known[c].high))
        finite[c] = bounded(x) if infinite else x
    targets: dict[tuple[str, int], Bracket] = {}
    wanted: dict[tuple[str, int], tuple[float, float, float]] = {}
    places: dict[str, list[tuple[int, int, float]]] = {}
    for c in columns:
        n = known[c].count
        if not n:
            continue
        low, high, around = clip(known[c].low), clip(known[c].high), known[c].marks
        places[c] = []
        for i, p in enumerate(probs):
            at, share = divmod((n - 1) * p, 1)
            places[c].append((int(at), math.ceil((n - 1) * p), share))
            for rank in places[c][-1][:2]:
                targets[c, rank] = Bracket(low, high, 0, n)
                if around and n > limit and low < high:
                    a, b = _ranks([p])
                    # the ends of the column are exact
                    wanted[c, rank] = (low if a == 0 else around[2 * i], high if b == 1 else around[2 * i + 1], (b - a) * n)
    value: dict[tuple[str, int], float] = {}
    if wanted:
        targets |= _placed(df, finite, wanted, limit, value)
        targets = {k: b for k, b in targets.items() if k not in value}
    _narrow(df, finite, targets, limit)
    value |= _ranked(df, finite, targets)
    for (c, rank), v in value.items():
        if abs(v) == LARGEST and finite[c] is not columns[c]:
            value[c, rank] = math.copysign(math.inf, v)
    return {c: [interpolate(value[c, a], value[c, b], s) for a, b, s in ps] for c, ps in places.items()}
