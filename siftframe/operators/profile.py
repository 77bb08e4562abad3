"""Semantic types, completeness, distinct, frequency and distribution statistics."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from siftframe.functions.dates import (
    FORMAT_ORDER,
    FORMATS_BY_SHAPE,
    HINTED_SHAPES,
    LONGEST_DATE,
    column_format,
    looks_like_date,
    parse_date,
    parse_like_first,
    shape,
    text_shape,
)
from siftframe.functions.values import (
    BOOLEAN_WORDS,
    DIGEST,
    col,
    digested,
    dtype_of,
    is_missing,
    is_native_number,
    is_native_time,
    is_text,
    number_of_text,
    present,
    raw_text,
    shown,
    shown_text,
    try_num,
)
from siftframe.operators.quantiles import SMALL, Extent, counted_quantiles, exact_quantiles, marks
from siftframe.operators.rowid import ROW_INDEX, data_columns
from siftframe.work import written

# --- fixed values -----------------------------------------------------------
NUMERIC_SHARE = 0.9  # share of parsable values must exceed this
DATE_SHARE = 0.8
CATEGORY_DISTINCT = 15
CATEGORY_DISTINCT_LARGE = 100
CATEGORY_SHARE = 0.15
SAMPLES = 5
DATE_PROBES = 10
TOP_VALUES = 5
CHART_VALUES = 10
HISTOGRAM_BINS = 20
GOOD_SCORE = 85
WARNING_SCORE = 60
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ----------------------------------------------------------------------------

HEAD_STEP = 1000


def _columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    return data_columns(df) if columns is None else list(columns)


def _text_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    return [raw_text(col(c), dtype_of(df, c)).alias(c) for c in columns]


def _unpivot(df: DataFrame, columns: list[str], row_id: str | None, cells: list[Column]) -> DataFrame:
    """(row, column, value) with missing values left out."""
    row = [col(row_id).alias("_row")] if row_id else []
    wide = df.select(*row, *cells)
    return (
        wide.unpivot(["_row"] if row_id else [], [col(c) for c in columns], "column", "value")
        .where("value is not null")
    )


def _key(c: Column, dtype: T.DataType, utc: bool) -> dict[str, Column]:
    """Grouping key of a cell: a whole number, a double or a text, whichever its type needs."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return {"whole": c.cast("long")}
    if isinstance(dtype, T.DateType):
        return {"whole": F.unix_date(c).cast("long")}
    if isinstance(dtype, T.TimestampType) or (utc and isinstance(dtype, T.TimestampNTZType)):
        return {"whole": F.unix_micros(c.cast("timestamp"))}
    if isinstance(dtype, T.DoubleType):
        return {"real": present(c, dtype) + F.lit(0.0)}
    text = raw_text(c, dtype)
    return {"text": digested(text) if is_text(dtype) else text}


KEY = {"whole": "bigint", "real": "double", "text": "string"}


def _keys(df: DataFrame, columns: list[str], row_id: str | None) -> DataFrame:
    """(_row, ordinal, whole, real, text): one row per non-missing cell, with one of the keys set."""
    utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC")
    cells = []
    used = set()
    for c in columns:
        key = _key(col(c), dtype_of(df, c), utc)
        used |= set(key)
        cells.append((c, key))
    kinds = [k for k in KEY if k in used]
    flat = [F.lit(len(cells))]
    for i, (_, key) in enumerate(cells):
        flat += [F.lit(i), *[key.get(k, F.lit(None).cast(KEY[k])) for k in kinds]]
    row = [col(row_id).alias("_row")] if row_id else []
    long = df.select(*row, F.stack(*flat).alias("ordinal", *kinds))
    return long.where(" or ".join(f"{k} is not null" for k in kinds))


def _key_text(df: DataFrame, columns: list[str], keys: list[str]) -> Column:
    """:func:`raw_text` of a grouping key, by the type of the column it came from."""
    parts = []
    if "text" in keys:
        parts.append(F.col("text"))
    if "real" in keys:
        parts.append(F.col("real").cast("string"))
    if "whole" in keys:
        whole = F.col("whole")
        text = whole.cast("string")
        for kind, form in (
            (T.BooleanType, whole.cast("boolean")),
            (T.DateType, F.date_from_unix_date(whole.cast("int"))),
            ((T.TimestampType, T.TimestampNTZType), F.timestamp_micros(whole)),
        ):
            ordinals = [i for i, c in enumerate(columns) if isinstance(dtype_of(df, c), kind)]
            if ordinals:
                text = F.when(F.col("ordinal").isin(ordinals), form.cast("string")).otherwise(text)
        parts.append(text)
    return F.coalesce(*parts)


def _name(columns: list[str]) -> Column:
    """Name of the column that a cell came from."""
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("ordinal")).alias("column")


def _frequencies(df: DataFrame, row_id: str, columns: list[str]) -> tuple[DataFrame, Column]:
    """((ordinal, keys..., n, first_row), the key as text)."""
    long = _keys(df, columns, row_id)
    keys = [k for k in KEY if k in long.columns]
    freq = long.groupBy("ordinal", *keys).agg(F.count("*").alias("n"), F.min("_row").alias("first_row"))
    return freq, _key_text(df, columns, keys)


def value_frequencies(df: DataFrame, row_id: str = ROW_INDEX, columns: list[str] | None = None) -> DataFrame:
    """(column, key, n, first_row): one row per distinct non-missing value, as text.

    One scan and one shuffle, combined map-side, for all columns. Numbers and times
    are grouped in fixed width. A value longer than ``LONG_TEXT`` is represented by
    its SHA-256 digest; its text is found again at ``first_row``.
    """
    names = _columns(df, columns)
    freq, text = _frequencies(df, row_id, names)
    return freq.select(_name(names), text.alias("key"), "n", "first_row")


def _ranked_keys(df: DataFrame, row_id: str, columns: list[str], k: int) -> DataFrame:
    """(column, rank, key, n, first_row): the k most frequent values per column, ranked from 1.

    A row of rank 0 holds the number of distinct values as ``n`` and that of
    non-missing cells as ``first_row``. Ties go to the value seen first. At most k
    rows per column leave a task.
    """
    freq, text = _frequencies(df, row_id, columns)
    order = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("first_row"))
    top = freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # reads all columns of `freq`, so that both branches share one shuffle
    totals = freq.groupBy("ordinal").agg(
        F.count_if(F.col("first_row").isNotNull()).alias("n"), F.sum("n").alias("first_row")
    )
    return top.select(_name(columns), "rank", text.alias("key"), "n", "first_row").unionByName(
        totals.select(_name(columns), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key"), "n", "first_row")
    )


def _show_by_column(df: DataFrame, columns: list[str], key: Column) -> Column:
    """Python-like text of a raw value, by the type of the column it came from."""
    out = key
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(dtype_of(df, c).simpleString(), []).append(c)
    for names in by_type.values():
        text = shown(key, dtype_of(df, names[0]))
        if text is not key:
            out = F.when(F.col("column").isin(names), text).otherwise(out)
    return out


def top_values(
    df: DataFrame, row_id: str = ROW_INDEX, columns: list[str] | None = None, k: int = TOP_VALUES
) -> DataFrame:
    """(column, rank, value, count): the k most frequent values per column, ties by first appearance."""
    names = _columns(df, columns)
    top = _ranked_keys(df, row_id, names, k).where("rank > 0")
    texts = [c for c in names if is_text(dtype_of(df, c))]
    if texts:
        top = _with_long_text(df, texts, row_id, top)
    return top.select("column", "rank", _show_by_column(df, names, F.col("key")).alias("value"), F.col("n").alias("count"))


def _with_long_text(df: DataFrame, texts: list[str], row_id: str, top: DataFrame) -> DataFrame:
    """Replace digests by the text found at their first row."""
    wanted = top.where(F.col("key").startswith(DIGEST)).select(
        F.col("column").alias("_c"), F.col("key").alias("_k"), F.col("first_row").alias("_row")
    )
    # k rows per column at most, so the lookup side is always small
    rows = df.select(col(row_id).alias("_row"), *_text_columns(df, texts)).join(F.broadcast(wanted), "_row")
    pick = F.coalesce(*[F.when(F.col("_c") == c, col(c)) for c in texts])
    long_text = rows.select("_c", "_k", pick.alias("_text"))
    return top.join(
        F.broadcast(long_text), (F.col("column") == F.col("_c")) & (F.col("key") == F.col("_k")), "left"
    ).withColumn("key", F.coalesce("_text", "key"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_count) of non-missing values; ``approx`` trades exactness for no shuffle of values."""
    names = _columns(df, columns)
    if approx:
        cells = [F.approx_count_distinct(t).alias(c) for c, t in zip(names, _text_columns(df, names))]
        return _one_row_per_column(df.agg(*cells), names, lambda c: [col(c).alias("unique_count")])
    long = _keys(df, names, None)
    return long.distinct().groupBy("ordinal").agg(F.count("*").alias("unique_count")).select(_name(names), "unique_count")


def _one_row_per_column(one: DataFrame, columns: list[str], fields) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), *fields(c)) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*").drop("ordinal")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, total_count, null_count, null_pct); null_pct is a share, 0.0 without rows."""
    names = _columns(df, columns)
    one = df.agg(
        F.count("*").alias("_total"),
        *[F.count_if(is_missing(col(c), dtype_of(df, c))).alias(c) for c in names],
    )
    share = lambda c: F.when(F.col("_total") > 0, col(c) / F.col("_total")).otherwise(F.lit(0.0))
    return _one_row_per_column(
        one, names, lambda c: [F.col("_total").alias("total_count"), col(c).alias("null_count"), share(c).alias("null_pct")]
    )


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, mean, std) over parsable values, one pass for all columns."""
    stats = _number_stats(df, {c: try_num(col(c), dtype_of(df, c)) for c in columns})
    return stats.select("column", "min", "max", "mean", "std")


QUARTILES = [0.25, 0.5, 0.75]


def _number_stats(df: DataFrame, numbers: dict[str, Column], quartiles: bool = False) -> DataFrame:
    """(column, n, min, max, mean, std) of columns with values; one row leaves each task.

    ``quartiles`` adds ``marks``, what a sketch finds around the quartiles.
    """
    kinds = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))}
    if quartiles:
        kinds["marks"] = lambda x: marks(x, QUARTILES)
    one = df.agg(*[f(x).alias(f"{kind}_{i}") for i, x in enumerate(numbers.values()) for kind, f in kinds.items()])
    at = {c: i for i, c in enumerate(numbers)}
    return _one_row_per_column(one, list(numbers), lambda c: [F.col(f"{kind}_{at[c]}").alias(kind) for kind in kinds]).where("n > 0")


def _counted_stats(counts: list[tuple[float, int]]) -> dict:
    """As :func:`_number_stats` from all numbers of a column and how often each occurs; ``counts`` is kept for its quartiles."""
    n = sum(k for _, k in counts)
    mean = sum(x * k for x, k in counts) / n
    spread = sum(k * (x - mean) * (x - mean) for x, k in counts)
    std = math.sqrt(spread / (n - 1)) if n > 1 else 0.0
    return {"n": n, "min": min(counts)[0], "max": max(counts)[0], "mean": mean, "std": std, "counts": counts}


def _stats_of_values(df: DataFrame, numbers: dict[str, Column], ranked: dict[str, tuple[int, int, list[tuple[str, int]]]], quartiles: bool) -> dict[str, dict]:
    """Number statistics per column; where all values of a column are known already, they are not read again."""
    stats, many = {}, {}
    for c, x in numbers.items():
        _, unique, values = ranked[c]
        if unique > CATEGORY_DISTINCT_LARGE:
            many[c] = x
        elif counts := [(x, n) for v, n in values if (x := number_of_text(v)) is not None]:
            stats[c] = _counted_stats(counts)
    if many:
        stats |= {r["column"]: r.asDict() for r in _number_stats(df, many, quartiles).collect()}
    return stats


def _head(
    df: DataFrame, row_id: str, columns: list[str], k: int, low: int | None = None, high: int | None = None
) -> dict[str, list[str]]:
    """First k non-missing values of each column in row order.

    Reads a growing stretch of the lowest row numbers, for columns still short of
    k values only; the row filter reaches the scan. The last stretch is the whole
    table, where a bounded top-k per column is taken.
    """
    if low is None:
        bounds = df.agg(F.min(col(row_id)).alias("lo"), F.max(col(row_id)).alias("hi")).first()
        low, high = bounds["lo"], bounds["hi"]
    if low is None:
        return {c: [] for c in columns}
    found: dict[str, list[str]] = {}
    rest, step = list(columns), HEAD_STEP
    while rest:
        last = low + step > high
        part = df if last else df.where(col(row_id) < F.lit(low + step))
        long = _unpivot(part, rest, row_id, _text_columns(part, rest))
        first = F.row_number().over(Window.partitionBy("column").orderBy("_row"))
        rows = long.withColumn("_n", first).where(F.col("_n") <= k).collect()
        got: dict[str, list[tuple[int, str]]] = {c: [] for c in rest}
        for r in rows:
            got[r["column"]].append((r["_n"], r["value"]))
        for c in rest:
            if last or len(got[c]) >= k:
                found[c] = [shown_text(v, dtype_of(df, c)) for _, v in sorted(got[c])]
        rest = [c for c in rest if c not in found]
        step *= 100
    return found


def sample_values(df: DataFrame, row_id: str = ROW_INDEX, columns: list[str] | None = None, k: int = SAMPLES) -> DataFrame:
    """(column, position, value): the first k non-missing values, repeats included."""
    names = _columns(df, columns)
    head = _head(df, row_id, names, k)
    rows = [(c, i + 1, v) for c in names for i, v in enumerate(head[c])]
    return df.sparkSession.createDataFrame(rows, "column string, position int, value string")


@dataclass
class ColumnProfile:
    column: str
    inferred_type: str
    physical_type: str
    total_count: int
    null_count: int
    null_pct: float
    unique_count: int
    sample_values: list = field(default_factory=list)
    top_values: list = field(default_factory=list)
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    median: float | None = None
    min_ts: str | None = None
    max_ts: str | None = None
    q1: float | None = None
    q3: float | None = None
    date_formats: list = field(default_factory=list)
    frequencies: list | None = None  # raw value and count of every value, where there are few
    values: list = field(default_factory=list)  # these values as printed, most frequent first

    @property
    def unique_pct(self) -> float:
        return self.unique_count / self.total_count if self.total_count else 0.0


PROFILE_SCHEMA = (
    "column string, inferred_type string, physical_type string, total_count bigint, null_count bigint, "
    "null_pct double, unique_count bigint, sample_values array<string>, "
    "top_values array<struct<value:string,count:bigint>>, min double, max double, mean double, std double, "
    "median double, min_ts string, max_ts string"
)


def _semantic_type(dtype, p: ColumnProfile, numeric_count: int) -> str:
    """Ordered decision; dates in text columns are settled afterwards."""
    present_count = p.total_count - p.null_count
    if present_count == 0:
        return "empty"
    if p.unique_count <= 2 and all(t["value"].lower() in BOOLEAN_WORDS for t in p.top_values):
        return "boolean"
    if is_native_number(dtype):
        return "numeric"
    if is_native_time(dtype):
        return "datetime"
    if numeric_count / present_count > NUMERIC_SHARE:
        return "numeric"
    return ""


def _category_or_text(p: ColumnProfile) -> str:
    few = p.unique_count <= CATEGORY_DISTINCT
    small_share = p.unique_count < CATEGORY_DISTINCT_LARGE and p.unique_count / p.total_count < CATEGORY_SHARE
    return "categorical" if few or small_share else "text"


def _collected_values(
    df: DataFrame, row_id: str, columns: list[str]
) -> dict[str, tuple[int, int, list[tuple[str, int]]]]:
    """Per column: non-missing cells, distinct count, most frequent raw values (at most CATEGORY_DISTINCT_LARGE).

    Digests are resolved for the values that are shown; values of a column with
    few distinct ones are all resolved.
    """
    rows = _ranked_keys(df, row_id, columns, CATEGORY_DISTINCT_LARGE).collect() if columns else []
    filled = {r["column"]: r["first_row"] for r in rows if r["rank"] == 0}
    unique = {r["column"]: r["n"] for r in rows if r["rank"] == 0}
    values: dict[str, list] = {c: [] for c in columns}
    digests: set[int] = set()
    for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"]):
        few = unique[r["column"]] <= CATEGORY_DISTINCT_LARGE
        if few or r["rank"] <= TOP_VALUES:
            values[r["column"]].append([r["key"], r["n"], r["first_row"]])
            if r["key"].startswith(DIGEST):
                digests.add(r["first_row"])
    if digests:
        texts = [c for c in columns if any(v[0].startswith(DIGEST) for v in values[c])]
        found = df.where(col(row_id).isin(list(digests))).select(col(row_id).alias("_row"), *_text_columns(df, texts))
        by_row = {r["_row"]: r for r in found.collect()}
        for c in texts:
            for v in values[c]:
                if v[0].startswith(DIGEST):
                    v[0] = by_row[v[2]][c]
    return {c: (filled.get(c, 0), unique.get(c, 0), [(k, n) for k, n, _ in values[c]]) for c in columns}


def _date_shapes(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Per text column the values of each shape that a date may have."""
    known = list(FORMATS_BY_SHAPE)
    wide = df.select(*[F.when(shape(col(c)).isin(known), shape(col(c))).alias(c) for c in columns])
    counts = wide.unpivot([], [col(c) for c in columns], "column", "shape").where("shape is not null").groupBy("column", "shape").count()
    found: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # at most one row per column and known shape
        found.setdefault(r["column"], {})[r["shape"]] = r["count"]
    return found


def _shapes_of_values(df: DataFrame, ranked: dict[str, tuple[int, int, list[tuple[str, int]]]]) -> dict[str, dict[str, int]]:
    """As :func:`_date_shapes`; where all values of a column are known already, they are not read again."""
    found: dict[str, dict[str, int]] = {}
    for c, (_, unique, values) in ranked.items():
        if unique <= CATEGORY_DISTINCT_LARGE:
            for value, n in values:
                s = text_shape(value) if len(value) <= LONGEST_DATE else None
                if s in FORMATS_BY_SHAPE:
                    counts = found.setdefault(c, {})
                    counts[s] = counts.get(s, 0) + n
    many = [c for c, (_, unique, _) in ranked.items() if unique > CATEGORY_DISTINCT_LARGE]
    return found | (_date_shapes(df, many) if many else {})


def _dates_by_shape(df: DataFrame, shapes: dict[str, dict[str, int]], mixed: bool) -> dict[str, tuple[int, str, str, list[str]]]:
    """Per column: values read, earliest and latest moment, formats.

    The column has the one format that reads most of its values; if ``mixed``, each shape has the one that reads most of it.
    """
    tries = [(c, s, f) for c, counts in shapes.items() for s in counts for f in FORMATS_BY_SHAPE[s]]
    aggs = []
    for i, (c, s, f) in enumerate(tries):
        read = F.when(shape(col(c)) == s, parse_date(col(c), [f]))
        aggs += [F.count(read).alias(f"n{i}"), *[F.date_format(g(read), TIMESTAMP_FORMAT).alias(f"{k}{i}") for k, g in (("min", F.min), ("max", F.max))]]
    row = df.agg(*aggs).first()
    out = {}
    for c in shapes:
        # a choice is made among the formats of the column, or of each of its shapes
        choices: dict[str, dict[str, list[int]]] = {}
        for i, (of, s, f) in enumerate(tries):
            if of == c:
                choices.setdefault(s if mixed else "", {}).setdefault(f, []).append(i)
        best = [max(by.items(), key=lambda e: (sum(row[f"n{i}"] for i in e[1]), -FORMAT_ORDER[e[0]])) for by in choices.values()]
        mine = [i for _, tried in best for i in tried if row[f"n{i}"]]
        if mine:
            ends = min(row[f"min{i}"] for i in mine), max(row[f"max{i}"] for i in mine)
            out[c] = (sum(row[f"n{i}"] for i in mine), *ends, sorted({tries[i][2] for i in mine}))
    return out


def _numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Columns that may hold numbers, as such."""
    types = {c: dtype_of(df, c) for c in names}
    return {c: try_num(col(c), types[c]) for c in names if is_native_number(types[c]) or isinstance(types[c], T.StringType)}


def _fact_aggregates(df: DataFrame, row_id: str, names: list[str]) -> list[Column]:
    aggs = [F.count("*").alias("total"), F.min(col(row_id)).alias("low"), F.max(col(row_id)).alias("high")]
    for i, c in enumerate(names):
        if is_native_time(dtype_of(df, c)):
            aggs += [F.date_format(f(col(c)), TIMESTAMP_FORMAT).alias(f"{k}{i}") for k, f in (("min", F.min), ("max", F.max))]
    return aggs


@dataclass
class Facts:
    """What a pass over a table has found already: plain facts, and the number statistics of columns."""

    plain: dict
    stats: dict[str, dict]


def written_with_facts(df: DataFrame, tag: str, row_id: str = ROW_INDEX, columns: list[str] | None = None) -> tuple[DataFrame, Facts]:
    """Write a table and read it back; the facts of its profile are observed on the way, without a pass of their own."""
    names = _columns(df, columns)
    seen, aggs = Observation(), _fact_aggregates(df, row_id, names)
    numbers = _numbers(df, names)
    for i, x in enumerate(numbers.values()):
        found = {"n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "std": F.coalesce(F.stddev_samp(x), F.lit(0.0)), "marks": marks(x, QUARTILES)}
        aggs += [value.alias(f"{kind}_{i}") for kind, value in found.items()]
    table = written(df.observe(seen, *aggs), tag)
    row = seen.get
    stats = {}
    for i, c in enumerate(numbers):
        if row[f"n_{i}"]:
            stats[c] = {kind: row[f"{kind}_{i}"] for kind in ("n", "min", "max", "mean", "std", "marks")}
    return table, Facts(row, stats)


def profile(
    df: DataFrame,
    row_id: str = ROW_INDEX,
    columns: list[str] | None = None,
    limit: int = SMALL,
    quartiles: bool = True,
    dates: str = "all",
    facts: Facts | None = None,
) -> list[ColumnProfile]:
    """Profile every column in a fixed number of passes, whatever the number of columns.

    A text column is one of dates if one format, that which reads most, reads more than DATE_SHARE of all its values.
    With ``dates="mixed"`` values of every shape are read by a format of their own; with ``dates="first"`` only the first
    DATE_PROBES values may make it a column of dates, and the very first one fixes the format. ``facts`` are those of :func:`written_with_facts`, for the same columns.

    Passes: plain aggregates; value frequencies (the one shuffle that grows with the
    data); the first rows; number statistics of columns with many values (of others they are told from the frequencies);
    date parsing for text columns that look like dates; quantiles.
    What reaches the driver is a handful of values per column.
    """
    names = _columns(df, columns)
    types = {c: dtype_of(df, c) for c in names}
    nums = _numbers(df, names)
    with ThreadPoolExecutor(3) as pool:  # independent jobs, submitted together
        wait_plain = pool.submit(df.agg(*_fact_aggregates(df, row_id, names)).first) if facts is None else None
        wait_values = pool.submit(_collected_values, df, row_id, names)
        plain = wait_plain.result() if wait_plain else facts.plain
        total = plain["total"]
        head = _head(df, row_id, names, DATE_PROBES, plain["low"], plain["high"]) if total else {c: [] for c in names}
        ranked = wait_values.result()
        wait_stats = pool.submit(_stats_of_values, df, nums, ranked, quartiles) if facts is None else None
        shapes = _shapes_of_values(df, {c: ranked[c] for c in names if isinstance(types[c], T.StringType)}) if dates != "first" else {}
        stats = wait_stats.result() if wait_stats else facts.stats

    out: list[ColumnProfile] = []
    like_first: dict[str, str] = {}
    mixed: dict[str, dict[str, int]] = {}
    for i, c in enumerate(names):
        filled, unique, values = ranked[c]
        top = [{"value": shown_text(k, types[c]), "count": n} for k, n in values[:TOP_VALUES]]
        nulls = total - filled
        p = ColumnProfile(
            c, "", types[c].simpleString(), total, nulls, nulls / total if total else 0.0,
            unique, head[c][:SAMPLES], top,
        )
        if unique <= CATEGORY_DISTINCT_LARGE:
            p.frequencies = values
            p.values = [shown_text(k, types[c]) for k, _ in values]
        p.inferred_type = _semantic_type(types[c], p, stats[c]["n"] if c in stats else 0)
        if p.inferred_type == "numeric" and c in stats:
            p.min, p.max, p.mean, p.std = (stats[c][k] for k in ("min", "max", "mean", "std"))
        elif p.inferred_type == "datetime":
            p.min_ts, p.max_ts = plain[f"min{i}"], plain[f"max{i}"]
        elif p.inferred_type == "" and dates == "first" and isinstance(types[c], T.StringType) and looks_like_date(head[c]):
            like_first[c] = head[c][0]
        elif p.inferred_type == "" and not HINTED_SHAPES.isdisjoint(shapes.get(c, ())) and sum(shapes[c].values()) > DATE_SHARE * filled:
            mixed[c] = shapes[c]
        out.append(p)

    read: dict[str, tuple[int, str, str, list[str]]] = _dates_by_shape(df, mixed, dates == "mixed") if mixed else {}
    if like_first:
        parsed = {c: parse_like_first(col(c), v) for c, v in like_first.items()}
        row = df.agg(
            *[F.count(x).alias(f"n_{c}") for c, x in parsed.items()],
            *[F.date_format(f(x), TIMESTAMP_FORMAT).alias(f"{k}_{c}") for c, x in parsed.items() for k, f in (("min", F.min), ("max", F.max))],
        ).first()
        for c, v in like_first.items():
            fmt = column_format(v)
            read[c] = (row[f"n_{c}"], row[f"min_{c}"], row[f"max_{c}"], [fmt] if fmt else [])
    for p in out:
        count, low, high, formats = read.get(p.column, (0, None, None, []))
        if count and count > DATE_SHARE * (total - p.null_count):
            p.inferred_type, p.min_ts, p.max_ts, p.date_formats = "datetime", low, high, formats
    for p in out:
        p.inferred_type = p.inferred_type or _category_or_text(p)

    if quartiles:
        wanted = {p.column: nums[p.column] for p in out if p.inferred_type == "numeric"}
        counted = {c: stats[c]["counts"] for c in wanted if c in stats and "counts" in stats[c]}
        many = {c: x for c, x in wanted.items() if c not in counted}
        known = {c: Extent(stats[c]["n"], stats[c]["min"], stats[c]["max"], tuple(stats[c]["marks"])) if c in stats else Extent(0, None, None) for c in many}
        found = exact_quantiles(df, many, QUARTILES, limit, known) if many else {}
        found |= {c: counted_quantiles(counts, QUARTILES) for c, counts in counted.items()}
        for p in out:
            if p.column in found:
                p.q1, p.median, p.q3 = found[p.column]
    return out


def profile_frame(df: DataFrame, columns: list[ColumnProfile]) -> DataFrame:
    """The profile as a table, one row per column of the profiled table."""
    names = [f.name for f in T._parse_datatype_string(PROFILE_SCHEMA).fields]
    rows = [tuple(asdict(p)[n] for n in names) for p in columns]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def summary(df: DataFrame, columns: list[ColumnProfile]) -> dict:
    """Rows, columns, cells, missing cells and their percentage (2 decimals)."""
    rows = columns[0].total_count if columns else 0
    cells = rows * len(columns)
    missing = sum(p.null_count for p in columns)
    return {
        "row_count": rows,
        "column_count": len(columns),
        "total_cells": cells,
        "missing_cells": missing,
        "missing_pct": round(missing / cells * 100, 2) if cells else 0.0,
    }


def upload_metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their percentage with one decimal; one pass."""
    names = data_columns(df)
    missing = sum((F.count_if(is_missing(col(c), dtype_of(df, c))) for c in names), F.lit(0))
    one = df.agg(F.count("*").alias("total_rows"), missing.cast("long").alias("missing_cells"))
    cells = F.col("total_rows") * F.lit(len(names))
    return one.select(
        "total_rows",
        F.lit(len(names)).alias("total_columns"),
        "missing_cells",
        F.when(cells > 0, F.round(F.col("missing_cells") / cells * 100, 1)).otherwise(F.lit(0.0)).alias("missing_pct"),
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score >= GOOD_SCORE, F.lit("good")).when(score >= WARNING_SCORE, F.lit("warning")).otherwise(F.lit("poor"))
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, count): equal-width bins over the parsable values; a single bin when all are equal.

    Equal widths replace the "nice" step widths of a chart library.
    """
    x = try_num(col(column), dtype_of(df, column))
    data = df.select(x.alias("x")).where("x is not null")
    edges = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    low, high = edges["lo"], edges["hi"]
    if low is None or low == high:
        same = data.groupBy(F.col("x").alias("low")).agg(F.count("*").alias("count"))
        return same.select(F.lit(1).cast("long").alias("bin"), "low", F.col("low").alias("high"), "count")
    # the largest value falls one past the last bin
    bin_ = F.least(F.width_bucket("x", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long"))
    width = (high - low) / bins
    return (
        data.groupBy(bin_.alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(
            "bin",
            (F.lit(low) + (F.col("bin") - 1) * width).alias("low"),
            (F.lit(low) + F.col("bin") * width).alias("high"),
            "count",
        )
    )


def value_distribution(df: DataFrame, column: str, row_id: str = ROW_INDEX, k: int = CHART_VALUES) -> DataFrame:
    """(value, count) of the ten most frequent values, for categorical, boolean and text columns."""
    return top_values(df, row_id, [column], k).select("rank", "value", "count")


def schema_summary(prof: DataFrame) -> DataFrame:
    """Upper-case type, null rate, uniqueness and joined samples per column."""
    unique = F.when(F.col("total_count") > 0, F.col("unique_count") / F.col("total_count")).otherwise(F.lit(0.0))
    return prof.select(
        "column",
        F.upper("inferred_type").alias("inferred_type"),
        "physical_type",
        F.format_string("%.1f%%", F.col("null_pct") * 100).alias("null_rate"),
        F.format_string("%.1f%%", unique * 100).alias("uniqueness"),
        F.array_join("sample_values", ", ").alias("sample_values"),
    )


def column_details(prof: DataFrame) -> DataFrame:
    """(column, metric, value) rows as shown on a detail card: 4 decimals, ``N/A`` when absent."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)).otherwise(F.lit("N/A"))
    moment = lambda c: F.coalesce(F.col(c), F.lit("N/A"))
    row = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.alias("value"))
    general = F.array(
        row("Inferred Type", F.upper("inferred_type")),
        row("Null Records", F.format_string("%d (%.1f%%)", F.col("null_count"), F.col("null_pct") * 100)),
        row("Unique Values", F.col("unique_count").cast("string")),
    )
    numeric = F.array(
        row("Minimum", number("min")), row("Maximum", number("max")), row("Mean Average", number("mean")),
        row("Median (P50)", number("median")), row("Std Dev", number("std")),
    )
    times = F.array(row("Earliest Date", moment("min_ts")), row("Latest Date", moment("max_ts")))
    rows = (
        F.when(F.col("inferred_type") == "numeric", F.concat(general, numeric))
        .when(F.col("inferred_type") == "datetime", F.concat(general, times))
        .otherwise(general)
    )
    return prof.select("column", F.explode(rows).alias("r")).select("column", "r.metric", "r.value")
