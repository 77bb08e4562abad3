"""Cleaning steps: headers, trimming, imputation, type conversion, duplicate and null-row removal."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.dates import FORMATS_BY_SHAPE, column_format, parse_date, parse_like_first, readable, shape
from siftframe.functions.values import (
    FALSE_WORDS,
    TRUE_WORDS,
    col,
    dtype_of,
    is_float,
    is_missing,
    is_native_time,
    is_nested,
    present,
    raw_text,
    show_cell,
    strip,
    try_num,
)
from siftframe.operators.quantiles import exact_quantiles
from siftframe.operators.rowid import ROW_INDEX, renumber, with_row_index

IMPUTATIONS = ("drop", "mean", "median", "mode", "constant")
EMPTY_HEADER = "column"  # a header of which a style leaves nothing, as a table needs names


# --- headers ----------------------------------------------------------------


#: Per style the pattern substitutions that turn a trimmed header into it; words are parted by ``_`` and white space.
_PLAIN = ((r" ", "_"), (r"\W", ""))
_CAPITAL = lambda m: m[1].capitalize()
STYLE_STEPS: dict[str, tuple] = {
    "snake_case": (*_PLAIN, (r"_+", "_"), (r"^_|_$", ""), (r".+", lambda m: m[0].lower())),
    "camelCase": ((r"^[_\s]+|[_\s]+$", ""), (r"^[^_\s]+", lambda m: m[0].lower()), (r"[_\s]+([^_\s]+)", _CAPITAL)),
    "uppercase": (*_PLAIN, (r".+", lambda m: m[0].upper())),
    "lowercase": (*_PLAIN, (r".+", lambda m: m[0].lower())),
    "title_case": ((r"[_\s]+", " "), (r"^ | $", ""), (r"(\S+)", _CAPITAL)),
}


def restyled(name: str, style: str | None) -> str:
    """A header in the given style; an unknown style only trims."""
    name = name.strip()
    for pattern, to in STYLE_STEPS.get(style, ()):
        name = re.sub(pattern, to, name)
    return name


def without_collisions(names: list[str]) -> list[str]:
    """Names differing at most in case get ``_2``, ``_3``, ...; Spark cannot tell them apart. An empty one is ``column``."""
    taken: set[str] = set()
    out = []
    for name in names:
        name = name or EMPTY_HEADER
        new, n = name, 1
        while new.lower() in taken:
            n += 1
            new = f"{name}_{n}"
        taken.add(new.lower())
        out.append(new)
    return out


def header_map(columns: list[str], style: str | None) -> dict[str, str]:
    """Old name to new name; the row number keeps its name."""
    data = [c for c in columns if c != ROW_INDEX]
    reserved = [ROW_INDEX] if ROW_INDEX in columns else []
    new = without_collisions(reserved + [restyled(c, style) for c in data])[len(reserved):]
    return dict(zip(data, new))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).alias(names.get(c, c)) for c in df.columns])


def standardize_headers(df: DataFrame, style: str = "snake_case") -> DataFrame:
    return rename(df, header_map(df.columns, style))


# --- cells ------------------------------------------------------------------


def trim_whitespace(df: DataFrame) -> DataFrame:
    """Strip all text columns in one projection."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[strip(col(c)).alias(c) if c in text else col(c) for c in df.columns])


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _as_column_type(value: float, dtype: T.DataType) -> Column:
    """A computed number filled into a column; text columns take its printed form."""
    if isinstance(dtype, T.StringType):
        return F.lit(str(float(value)))
    return F.lit(float(value))


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent non-missing value of each column, the smallest on a tie; None without values.

    One pass for all columns: every column is a grouping set of its own, counts are combined map-side and only
    the best of each task is compared.
    """
    cells = df.select(*[present(col(c), dtype_of(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    sets = [[F.col(name)] for name in cells.columns]
    counts = cells.groupingSets(sets, *cells.columns).agg(F.count("*").alias("n"), F.grouping_id().alias("of"))
    every = (1 << len(columns)) - 1
    best = []
    for i, name in enumerate(cells.columns):
        own = F.col("of") == every - (1 << (len(columns) - 1 - i))
        best.append(F.min(F.when(own & F.col(name).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(name).alias("v")))).alias(name))
    row = counts.agg(*best).first()
    return {c: row[i]["v"] if row[i] is not None else None for i, c in enumerate(columns)}


def _fill(df: DataFrame, column: str, value: Column | None, widen: bool = False) -> Column:
    dtype = dtype_of(df, column)
    c = present(col(column), dtype)
    if value is None:
        return c
    if widen and not isinstance(dtype, (T.StringType, T.DoubleType)):
        c = c.cast("double")
    return F.coalesce(c, value)


def _constant(dtype: T.DataType, value: Any) -> tuple[Column, bool]:
    """(literal, fits): a constant in the column's type when it fits it, else as text."""
    value = "" if value is None else value
    if isinstance(dtype, T.StringType):
        return F.lit(str(value)), True
    if isinstance(dtype, T.BooleanType):
        fits = isinstance(value, bool)
    elif is_float(dtype):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif isinstance(dtype, T.IntegralType):
        fits = isinstance(value, int) and not isinstance(value, bool)
    else:
        fits = False
    return (F.lit(value).cast(dtype), True) if fits else (F.lit(str(value)), False)


def _imputed(df: DataFrame, batch: list[dict]) -> DataFrame:
    """Fill several columns; the means share one aggregate, the medians another and the modes a third."""
    by = {m: [i["column"] for i in batch if i["method"] == m] for m in ("mean", "median", "mode")}
    nums = {c: try_num(col(c), dtype_of(df, c)) for m in ("mean", "median") for c in by[m]}
    values: dict[str, float] = {}
    if by["mean"]:
        row = df.agg(*[F.avg(nums[c]).alias(c) for c in by["mean"]]).first()
        values |= {c: row[c] for c in by["mean"]}
    if by["median"]:
        values |= {c: q[0] for c, q in exact_quantiles(df, {c: nums[c] for c in by["median"]}, [0.5]).items()}
    modes = most_frequent(df, by["mode"]) if by["mode"] else {}
    new: dict[str, Column] = {}
    for i in batch:
        c, dtype = i["column"], dtype_of(df, i["column"])
        if i["method"] in ("mean", "median"):
            v = values.get(c)
            new[c] = _fill(df, c, None if v is None else _as_column_type(v, dtype), widen=v is not None)
        elif i["method"] == "mode":
            v = modes[c]
            new[c] = _fill(df, c, None if v is None else F.lit(v).cast(dtype))
        elif i["method"] == "constant":
            literal, fits = _constant(dtype, i.get("value"))
            new[c] = _fill(df, c, literal) if fits else F.coalesce(show_cell(col(c), dtype), literal)
    return _replace(df, new)


def handle_missing(df: DataFrame, column: str, method: str, value: Any = None) -> DataFrame:
    """``drop`` rows, or fill with ``mean``, ``median``, ``mode`` or ``constant``; unknown columns are left alone."""
    return impute(df, [{"column": column, "method": method, "value": value}])


def impute(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Imputations in list order.

    Steps on different columns do not see each other's fills, so they are filled
    together; a ``drop``, or a second step on a column, starts a new batch.
    """
    batch: list[dict] = []

    def flush(df: DataFrame) -> DataFrame:
        done = _imputed(df, batch) if batch else df
        batch.clear()
        return done

    for step in steps:
        if step["column"] not in df.columns:
            continue
        if step["method"] == "drop":
            df = drop_missing(flush(df), step["column"])
        else:
            if any(b["column"] == step["column"] for b in batch):
                df = flush(df)
            batch.append(step)
    return flush(df)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(~is_missing(col(column), dtype_of(df, column)))


# --- types ------------------------------------------------------------------


def _boolean(c: Column, dtype: T.DataType) -> Column:
    word = F.lower(strip(raw_text(c, dtype)))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def convert(df: DataFrame, column: str, target: str, date_format: str | None = None) -> DataFrame:
    """Cast a column to ``int``, ``float``, ``str``, ``category``, ``datetime`` or ``boolean``.

    What cannot be read becomes null. ``int`` rounds halves to even. ``str`` turns
    every missing value into ``""``. Without a format, ``datetime`` uses the one of
    the first value in row order; unlike a whole-column failure, an infinite value
    in an ``int`` cast is null on its own.
    """
    if column not in df.columns:
        return df
    c, dtype = col(column), dtype_of(df, column)
    if target == "int":
        new = c.cast("long") if isinstance(dtype, T.IntegralType) else F.rint(try_num(c, dtype)).try_cast("long")
    elif target == "float":
        new = try_num(c, dtype)
    elif target == "str":
        text = F.coalesce(show_cell(c, dtype), F.lit(""))
        new = F.when(text == "nan", F.lit("")).otherwise(text)
    elif target == "category":
        new = raw_text(c, dtype)
    elif target == "datetime":
        new = _datetime(df, column, date_format)
    elif target == "boolean":
        new = _boolean(c, dtype)
    else:
        return df
    return _replace(df, {column: new})


def _datetime(df: DataFrame, column: str, date_format: str | None) -> Column:
    c, dtype = col(column), dtype_of(df, column)
    if is_native_time(dtype):
        return c.cast("timestamp")
    if is_nested(dtype):
        return F.lit(None).cast("timestamp")
    text = raw_text(c, dtype)
    if date_format:
        # a format with an unknown directive leaves the column alone
        return parse_date(text, [date_format]) if readable(date_format) else c
    rows = df.where(text.isNotNull())
    if ROW_INDEX in df.columns:
        first = rows.select(F.min_by(text, col(ROW_INDEX)).alias("v")).first()
    else:
        first = rows.select(text.alias("v")).first()
    value = first["v"] if first else None
    occurring = None
    if column_format(value) is None:
        known = rows.select(shape(text).alias("s")).where(F.col("s").isin(list(FORMATS_BY_SHAPE))).distinct()
        occurring = {r["s"]: FORMATS_BY_SHAPE[r["s"]] for r in known.collect()}  # at most the known shapes
    return parse_like_first(text, value, occurring)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes of the distinct values in sorted order, as a category type numbers them.

    For a category column; distinct values only are ordered.
    """
    values = df.select(raw_text(col(column), dtype_of(df, column)).alias("value")).where("value is not null").distinct()
    return with_row_index(values, "value", name="code")


# --- rows -------------------------------------------------------------------


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, row_id: str = ROW_INDEX) -> DataFrame:
    """Keep the first row, by row number, of equal rows (null equals null).

    Repeats of a hot row collapse in every task before the shuffle: whole rows by
    partial aggregation, subset keys by the per-task row limit of the window.
    """
    names = [c for c in df.columns if c != row_id]
    if subset is None:
        if row_id not in df.columns:
            return df.dropDuplicates()
        grouped = df.groupBy(*[col(c) for c in names]).agg(F.min(col(row_id)).alias(row_id))
        return grouped.select(*[col(c) for c in df.columns])
    unknown = [c for c in subset if c not in df.columns]
    if unknown:
        raise KeyError(unknown)
    first = F.row_number().over(Window.partitionBy(*[col(c) for c in subset]).orderBy(col(row_id)))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


# --- the whole sequence -----------------------------------------------------


def clean(df: DataFrame, config: dict, resolve_names: bool = False, row_id: str = ROW_INDEX) -> DataFrame:
    """Headers, trimming, imputations, conversions, duplicates, null rows - in this order.

    The steps name columns as they are *after* the header step; names that no
    longer exist are passed over in silence. ``resolve_names`` follows an original
    name to its new one. A row number, if present, is closed up again at the end.
    """
    names: dict[str, str] = {}
    style = config.get("standardize_headers")
    if style:
        names = header_map(df.columns, style)
        df = rename(df, names)

    def resolved(name: str) -> str:
        return names.get(name, name) if resolve_names and name not in df.columns else name

    if config.get("trim_whitespace"):
        df = trim_whitespace(df)
    df = impute(df, [{**i, "column": resolved(i["column"])} for i in config.get("imputations", [])])
    for c in config.get("conversions", []):
        df = convert(df, resolved(c["column"]), c["type"], c.get("format"))
    removed = False
    if config.get("remove_duplicates"):
        subset = config.get("duplicate_columns")
        df = drop_duplicates(df, [resolved(c) for c in subset] if subset else None, row_id)
        removed = True
    for c in config.get("drop_null_rows", []):
        if resolved(c) in df.columns:
            df = drop_missing(df, resolved(c))
            removed = True
    removed = removed or any(i["method"] == "drop" for i in config.get("imputations", []))
    return renumber(df, row_id) if removed and row_id in df.columns else df


