"""Anomaly log: high missingness, outliers, rare categories, malformed e-mail and phone values.

Bounds and rare values come from the profile (a few numbers per column), so all
row-level checks run as expressions in a single scan of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.values import (
    col,
    dtype_of,
    raw_text,
    shown,
    strip,
    try_num,
)
from siftframe.operators.profile import ColumnProfile, summary
from siftframe.operators.quantiles import exact_quantiles
from siftframe.operators.rowid import ROW_INDEX, with_row_index

# --- fixed values -----------------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+?1?\s*[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"
HIGH_MISSING_SHARE = 0.5
IQR_FACTOR = 1.5
SIGMAS = 3
RARE_SHARE = 0.01
RARE_MINIMUM = 20
OUTLIER_CAP = 50
RARE_CAP = 20
FORMAT_CAP = 20
MISSING_WEIGHT = 40.0
OUTLIER_WEIGHT = 30.0
FORMAT_WEIGHT = 30.0
# messages: what stands before, between and after the column, row and value
MISSING_MESSAGE = "Column '{column}' has a very high missing rate ({share})."
OUTLIER_MESSAGE = ("Numerical outlier detected in row ", ": ")
RARE_MESSAGE = ("Rare categorical value '", "' (occurs < 1%) in row ", ".")
FORMAT_MESSAGE = ("Invalid ", " format in row ", ": '", "'")
MORE_MESSAGE = "Column '{column}' has {n} {kind} (first {cap} shown above)."
# ----------------------------------------------------------------------------

ANOMALY_SCHEMA = "column string, row_index bigint, value string, type string, message string"


@dataclass(frozen=True)
class OutlierBounds:
    """Interval outside of which a value is an outlier; ``center`` set for the three-sigma rule."""

    low: float | None = None
    high: float | None = None
    center: float | None = None
    reach: float | None = None

    def outside(self, x: Column) -> Column:
        if self.center is not None:
            return F.abs(x - F.lit(self.center)) > F.lit(self.reach)
        if self.low is None:
            return F.lit(False)
        return (x < F.lit(self.low)) | (x > F.lit(self.high))


def outlier_bounds(q1: float | None, q3: float | None, mean: float | None, std: float | None) -> OutlierBounds:
    if q1 is None or q3 is None:
        return OutlierBounds()
    iqr = q3 - q1
    if iqr == 0:
        # all middle values equal: three sigmas around the mean instead
        return OutlierBounds(center=mean, reach=SIGMAS * std) if std and std > 0 else OutlierBounds()
    return OutlierBounds(q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)


def column_bounds(df: DataFrame, columns: list[str]) -> dict[str, OutlierBounds]:
    """Bounds of several numeric columns, without a full profile."""
    nums = {c: try_num(col(c), dtype_of(df, c)) for c in columns}
    quarts = exact_quantiles(df, nums, [0.25, 0.75])
    row = df.agg(*[f(x).alias(f"{k}_{c}") for c, x in nums.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {
        c: outlier_bounds(*quarts[c], row[f"m_{c}"], row[f"s_{c}"]) if c in quarts else OutlierBounds() for c in columns
    }


def iqr_outliers(df: DataFrame, column: str, bounds: OutlierBounds | None = None) -> DataFrame:
    """Rows whose value in ``column`` is an outlier; missing values never are."""
    bounds = bounds or column_bounds(df, [column])[column]
    return df.where(bounds.outside(try_num(col(column), dtype_of(df, column))))


def rare_categories(df: DataFrame, column: str, share: float = RARE_SHARE) -> DataFrame:
    """(value, count) of values below ``share`` of the non-missing rows; none if all are, or if under 20 rows."""
    value = raw_text(col(column), dtype_of(df, column))
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("count"))
    # two aggregates over the counts, as one-row subqueries
    total = counts.agg(F.sum("count")).scalar()
    highest = counts.agg(F.max("count")).scalar()
    return counts.where(
        (total >= RARE_MINIMUM) & (F.col("count") / total < share) & (highest / total >= share)
    ).withColumn("value", shown(F.col("value"), dtype_of(df, column)))


def _rare_values(prof: list[ColumnProfile]) -> dict[str, list[str]]:
    """Raw rare values of categorical columns; the profile holds all of their fewer than 100 values."""
    rare: dict[str, list[str]] = {}
    for p in prof:
        rows = p.total_count - p.null_count
        if p.inferred_type == "categorical" and rows >= RARE_MINIMUM:
            found = [v for v, n in p.frequencies if n / rows < RARE_SHARE]
            if found and len(found) < len(p.frequencies):
                rare[p.column] = found
    return rare


def format_pattern(column: str) -> tuple[str, str] | None:
    """(kind, pattern) checked for a column of this name; ``tel`` inside any word counts as phone."""
    name = column.lower()
    if "email" in name:
        return "email", EMAIL_PATTERN
    if "phone" in name or "tel" in name:
        return "phone", PHONE_PATTERN
    return None


def malformed(c: Column, dtype: T.DataType, pattern: str) -> Column:
    """Present, non-empty and not of the pattern (after trimming)."""
    text = raw_text(c, dtype)
    return text.isNotNull() & (text != "") & ~strip(text).rlike(pattern)


@dataclass
class AnomalyChecks:
    """Row predicates per column, ready to be evaluated in one scan."""

    outlier: dict[str, Column]
    rare: dict[str, Column]
    bad_format: dict[str, tuple[str, Column]]


def anomaly_checks(df: DataFrame, prof: list[ColumnProfile]) -> AnomalyChecks:
    outlier, bad = {}, {}
    for p in prof:
        dtype = dtype_of(df, p.column)
        if p.inferred_type == "numeric":
            outlier[p.column] = outlier_bounds(p.q1, p.q3, p.mean, p.std).outside(try_num(col(p.column), dtype))
        kind = format_pattern(p.column)
        if kind:
            bad[p.column] = (kind[0], malformed(col(p.column), dtype, kind[1]))
    rare = {c: raw_text(col(c), dtype_of(df, c)).isin(v) for c, v in _rare_values(prof).items()}
    return AnomalyChecks(outlier, rare, bad)


def high_missingness(df: DataFrame, prof: list[ColumnProfile]) -> DataFrame:
    """One column-level record per column with more than half of its values missing."""
    rows = []
    for i, p in enumerate(prof):
        if p.null_pct > HIGH_MISSING_SHARE:
            share = f"{p.null_pct * 100:.1f}%"
            message = MISSING_MESSAGE.format(column=p.column, share=share)
            rows.append((i, 0, p.column, None, f"{share} missing", "high_missingness", message))
    return df.sparkSession.createDataFrame(rows, "ordinal int, step int, " + ANOMALY_SCHEMA)


def _flagged(df: DataFrame, prof: list[ColumnProfile], checks: AnomalyChecks, row_id: str) -> DataFrame:
    """(ordinal, step, kind, row_index, value): one row per flagged cell, from a single scan."""
    cells, any_test = [], []
    for i, p in enumerate(prof):
        tests = []
        if p.column in checks.outlier:
            tests.append((1, "outlier", checks.outlier[p.column]))
        if p.column in checks.rare:
            tests.append((1, "rare_value", checks.rare[p.column]))
        if p.column in checks.bad_format:
            kind, test = checks.bad_format[p.column]
            tests.append((2, kind, test))
        raw = raw_text(col(p.column), dtype_of(df, p.column))
        for step, kind, test in tests:
            record = F.struct(
                F.lit(i).alias("ordinal"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), raw.alias("raw")
            )
            cells.append(F.when(test, record))
            any_test.append(F.coalesce(test, F.lit(False)))
    if not cells:
        empty = "ordinal int, step int, kind string, raw string, row_index bigint"
        return df.sparkSession.createDataFrame([], empty)
    # records are only made of the few rows that have one
    flagged = df.where(reduce(or_, any_test))
    records = flagged.select(col(row_id).cast("long").alias("row_index"), F.explode(F.array(*cells)).alias("r"))
    return records.where("r is not null").select("r.*", "row_index")


def _describe(df: DataFrame, prof: list[ColumnProfile], flagged: DataFrame) -> DataFrame:
    """Column name, printed value, type and message; done after capping, on few rows."""
    raw = value = F.col("raw")
    name = F.get(F.array(*[F.lit(p.column) for p in prof]), F.col("ordinal"))
    by_type: dict[str, list[int]] = {}
    for i, p in enumerate(prof):
        by_type.setdefault(dtype_of(df, p.column).simpleString(), []).append(i)
    for ordinals in by_type.values():
        text = shown(raw, dtype_of(df, prof[ordinals[0]].column))
        if text is not raw:
            value = F.when(F.col("ordinal").isin(ordinals), text).otherwise(value)
    row = F.col("row_index").cast("string")
    kind = F.col("kind")
    out = flagged.select("ordinal", "step", "kind", name.alias("column"), "row_index", value.alias("value"))
    value = F.col("value")
    outlier, rare, malformed = ([F.lit(t) for t in texts] for texts in (OUTLIER_MESSAGE, RARE_MESSAGE, FORMAT_MESSAGE))
    message = (
        F.when(kind == "outlier", F.concat(outlier[0], row, outlier[1], value))
        .when(kind == "rare_value", F.concat(rare[0], value, rare[1], row, rare[2]))
        .otherwise(F.concat(malformed[0], kind, malformed[1], row, malformed[2], value, malformed[3]))
    )
    type_ = F.when(kind.isin("outlier", "rare_value"), kind).otherwise(F.lit("format_error"))
    return out.select("ordinal", "step", "column", "row_index", "value", type_.alias("type"), message.alias("message"))


def anomaly_counts(df: DataFrame, prof: list[ColumnProfile], checks: AnomalyChecks | None = None) -> dict[str, dict[str, int]]:
    """Uncapped number of flagged rows per kind and column, in one aggregate."""
    checks = checks or anomaly_checks(df, prof)
    tests = {("outlier", c): t for c, t in checks.outlier.items()}
    tests |= {("rare_value", c): t for c, t in checks.rare.items()}
    tests |= {("format_error", c): t for c, (_, t) in checks.bad_format.items()}
    out: dict[str, dict[str, int]] = {"outlier": {}, "rare_value": {}, "format_error": {}}
    if tests:
        row = df.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests.values())]).first()
        for i, (kind, c) in enumerate(tests):
            out[kind][c] = row[f"n{i}"]
    return out


def anomaly_counts_frame(df: DataFrame, prof: list[ColumnProfile]) -> DataFrame:
    counts = anomaly_counts(df, prof)
    rows = [(c, kind, n) for kind, by in counts.items() for c, n in by.items()]
    return df.sparkSession.createDataFrame(rows, "column string, type string, count bigint")


def _capped(flagged: DataFrame) -> DataFrame:
    """First records per column and check in row order; the cut happens in every task, before the shuffle."""
    by_row = Window.partitionBy("ordinal", "step").orderBy("row_index")
    cap = F.when(F.col("kind") == "outlier", F.lit(OUTLIER_CAP)).otherwise(F.lit(RARE_CAP))
    ranked = flagged.withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= OUTLIER_CAP)
    return ranked.where(F.col("_n") <= cap).drop("_n")


def _overflow(df: DataFrame, prof: list[ColumnProfile], counts: dict[str, dict[str, int]]) -> DataFrame:
    """A record for every column and kind of which the capped log leaves some out."""
    limits = {
        "outlier": (1, OUTLIER_CAP, "outliers", "numerical outliers"),
        "rare_value": (1, RARE_CAP, "rare values", "rare categorical values"),
        "format_error": (2, FORMAT_CAP, "format errors", "malformed values"),
    }
    rows = []
    for i, p in enumerate(prof):
        for kind, (step, cap, short, long) in limits.items():
            n = counts[kind].get(p.column, 0)
            if n > cap:
                message = MORE_MESSAGE.format(column=p.column, n=n, kind=long, cap=cap)
                rows.append((i, step, p.column, None, f"{n} {short}", kind, message))
    return df.sparkSession.createDataFrame(rows, "ordinal int, step int, " + ANOMALY_SCHEMA)


def anomaly_log(
    df: DataFrame,
    prof: list[ColumnProfile],
    row_id: str = ROW_INDEX,
    capped: bool = False,
    numbered: bool = False,
    checks: AnomalyChecks | None = None,
    counts: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """All anomalies of a table: missingness, then outliers or rare values, then formats, column by column.

    Every one is logged. ``capped`` keeps the first 50 outliers and the first 20 rare and malformed
    values per column, each plus a record with the number of all.
    """
    checks = checks or anomaly_checks(df, prof)
    flagged = _flagged(df, prof, checks, row_id)
    log = high_missingness(df, prof)
    if capped:
        counts = counts or anomaly_counts(df, prof, checks)
        log = log.unionByName(_describe(df, prof, _capped(flagged)))
        log = log.unionByName(_overflow(df, prof, counts))
    else:
        log = log.unionByName(_describe(df, prof, flagged))
    columns = ["column", "row_index", "value", "type", "message"]
    if not numbered:
        return log.select(*columns)
    if not capped:
        order = ["ordinal", "step", "row_index"]
        indexed = with_row_index(log.select(*order, "value", "type", "message", "column"), order, name="anomaly_id")
        return indexed.select((F.col("anomaly_id") + 1).alias("anomaly_id"), *columns)
    # at most 93 records per column
    order = Window.orderBy("ordinal", "step", F.col("row_index").asc_nulls_last())
    return log.select(F.row_number().over(order).alias("anomaly_id"), *columns)


def logged_counts(counts: dict[str, dict[str, int]], uncapped: bool = True) -> tuple[int, int]:
    """(outliers, format errors) that weigh on the score: all of them, or the records of a capped log."""
    outliers, formats = counts["outlier"].values(), counts["format_error"].values()
    if uncapped:
        return sum(outliers), sum(formats)
    return sum(min(n, OUTLIER_CAP) + (n > OUTLIER_CAP) for n in outliers), sum(min(n, FORMAT_CAP) + (n > FORMAT_CAP) for n in formats)


def score(rows: int, columns: int, missing: int, outliers: int, format_errors: int) -> float:
    """0-100 from missing cells, outliers and malformed values."""
    if rows * columns == 0:
        return 0.0
    lost = (
        MISSING_WEIGHT * missing / (rows * columns)
        + OUTLIER_WEIGHT * min(outliers / rows, 1.0)
        + FORMAT_WEIGHT * min(format_errors / rows, 1.0)
    )
    return max(0.0, min(100.0, round(100.0 - lost, 2)))


def quality_score(df: DataFrame, prof: list[ColumnProfile], uncapped: bool = True, counts=None) -> float:
    s = summary(df, prof)
    counts = counts or anomaly_counts(df, prof)
    return score(s["row_count"], s["column_count"], s["missing_cells"], *logged_counts(counts, uncapped))
