"""Declarative validation rules and their failure log."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.values import col, digested, dtype_of, is_text, raw_text, shown, strip, try_num
from siftframe.operators.anomaly import EMAIL_PATTERN
from siftframe.operators.joins import hot_keys, semi_join
from siftframe.operators.profile import ColumnProfile
from siftframe.operators.rowid import ROW_INDEX, with_row_index

# --- fixed values -----------------------------------------------------------
UNIQUE_SHARE = 0.95
UNIQUE_MINIMUM = 10
IN_SET_DISTINCT = 8
EMAIL_DESCRIPTION = "email format"
DEFAULT_DESCRIPTION = "Regex pattern"
# ----------------------------------------------------------------------------

FAILURE_COLUMNS = ["column", "row_index", "value", "rule", "message"]


@dataclass(frozen=True)
class Check:
    """Outcome of one rule for a cell: failing or not, and the message when failing."""

    fails: Column
    message: Column


@dataclass(frozen=True)
class Rule:
    """A rule on one column.

    ``row_check`` builds the cell test from (column, type, row number); a custom
    rule is a :class:`Rule` with its own ``row_check``. ``unique`` has none, as it
    looks at all rows.
    """

    column: str
    kind: str
    params: dict = field(default_factory=dict)
    row_check: Callable[[Column, T.DataType, Column], Check] | None = None


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _filled(c: Column, dtype: T.DataType) -> Column:
    text = raw_text(c, dtype)
    return text.isNotNull() & (text != "")


def _text(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(shown(raw_text(c, dtype), dtype), F.lit("nan"))


def java_pattern(pattern: str) -> str:
    """Python pattern for a match at the start of the text.

    Unicode classes and newline-only line ends, as in Python.
    """
    # the JVM takes no underscore or non-ASCII letter in a group's name
    numbers: dict[str, str] = {}
    for name in re.findall(r"\(\?P<(\w+)>", pattern):
        numbers.setdefault(name, f"g{len(numbers)}")
    body = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{numbers[m[1]]}>", pattern)
    body = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{numbers[m[1]]}>", body)
    body = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", body)
    return r"\A(?Ud:" + body + ")"


def non_null(column: str) -> Rule:
    def check(c, dtype, row):
        return Check(~_filled(c, dtype), _say("Value is missing (null/empty) in row ", row, "."))

    return Rule(column, "non_null", {}, check)


def unique(column: str) -> Rule:
    return Rule(column, "unique")


def value_range(column: str, min_val=None, max_val=None) -> Rule:
    def check(c, dtype, row):
        x, text = try_num(c, dtype), _text(c, dtype)
        below = (x < F.lit(float(min_val))) if min_val is not None else F.lit(False)
        above = (x > F.lit(float(max_val))) if max_val is not None else F.lit(False)
        message = (
            F.when(x.isNull(), _say("Value '", text, "' is not numeric in row ", row, "."))
            .when(below, _say("Value ", text, f" is below minimum allowed ({min_val}) in row ", row, "."))
            .otherwise(_say("Value ", text, f" is above maximum allowed ({max_val}) in row ", row, "."))
        )
        return Check(_filled(c, dtype) & (x.isNull() | below | above), message)

    return Rule(column, "range", {"min": min_val, "max": max_val}, check)


def regex(column: str, pattern: str, description: str = DEFAULT_DESCRIPTION) -> Rule:
    re.compile(pattern)  # an invalid pattern is reported when the rule is made
    spark = SparkSession.getActiveSession()
    if spark is not None:  # and so is one that the JVM cannot read
        try:
            spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
        except Exception as e:  # noqa: BLE001 - PySpark turns the JVM's exception into one of several
            raise ValueError(f"not a pattern of the JVM: {str(e).splitlines()[0]}") from None

    def check(c, dtype, row):
        text = _text(c, dtype)
        message = _say("Value '", text, f"' does not match pattern '{description}' in row ", row, ".")
        return Check(_filled(c, dtype) & ~text.rlike(java_pattern(pattern)), message)

    return Rule(column, "regex", {"pattern": pattern, "description": description}, check)


def in_set(column: str, allowed: list) -> Rule:
    words = sorted({str(a).strip().lower() for a in allowed})

    def check(c, dtype, row):
        text = _text(c, dtype)
        message = _say("Value '", text, f"' is not in the allowed set {allowed} in row ", row, ".")
        outside = ~F.lower(strip(text)).isin(words) if words else F.lit(True)
        return Check(_filled(c, dtype) & outside, message)

    return Rule(column, "in_set", {"allowed": list(allowed)}, check)


def make_rule(definition: dict) -> Rule:
    """Rule from ``{"column", "type", "params"}``; an unknown type is a ``ValueError``."""
    column, kind, params = definition["column"], definition["type"], definition.get("params", {})
    makers = {
        "non_null": lambda: non_null(column),
        "unique": lambda: unique(column),
        "range": lambda: value_range(column, params.get("min"), params.get("max")),
        "regex": lambda: regex(column, params.get("pattern"), params.get("description", DEFAULT_DESCRIPTION)),
        "in_set": lambda: in_set(column, params.get("allowed", [])),
    }
    if kind not in makers:
        raise ValueError(f"unknown rule type: {kind}")
    return makers[kind]()


def make_rules(definitions: list[dict]) -> tuple[list[Rule], list[tuple[int, str]]]:
    """Usable rules, and (position, reason) of the definitions left out."""
    rules, skipped = [], []
    for i, d in enumerate(definitions):
        try:
            rules.append(make_rule(d))
        except Exception as e:  # noqa: BLE001 - any faulty definition is left out
            skipped.append((i, f"{type(e).__name__}: {e}"))
    return rules, skipped


def _row_failures(df: DataFrame, rules: list[tuple[int, Rule]], row_id: str) -> DataFrame:
    """Failures of all row-level rules from one scan; also runs on a stream."""
    row = col(row_id).cast("long")
    cells = []
    for i, rule in rules:
        dtype = dtype_of(df, rule.column)
        check = rule.row_check(col(rule.column), dtype, row.cast("string"))
        record = F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(rule.column).alias("column"),
            row.alias("row_index"),
            _text(col(rule.column), dtype).alias("value"),
            F.lit(rule.kind).alias("rule"),
            check.message.alias("message"),
        )
        cells.append(F.when(check.fails, record))
    return df.select(F.explode(F.array(*cells)).alias("f")).where("f is not null").select("f.*")


def repeated_rows(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(row_index, value) of every row whose non-missing value occurs more than once."""
    return repeated_cells(df, {0: column}, row_id).select("row_index", "value")


def repeated_cells(df: DataFrame, columns: dict[int, str], row_id: str) -> DataFrame:
    """(number, row_index, value) of the cells, of several numbered columns, whose non-missing value repeats.

    One scan and one count serve all columns. Counts combine map-side, long texts are
    counted by digest, and the rows of a hot value never meet in one task.
    """
    cells = []
    for number, column in columns.items():
        dtype = dtype_of(df, column)
        text = raw_text(col(column), dtype)
        key = digested(text) if is_text(dtype) else text
        cell = F.struct(F.lit(number).alias("number"), _say(f"{number}:", key).alias("key"), text.alias("value"))
        cells.append(F.when(text.isNotNull(), cell))
    rows = df.select(col(row_id).cast("long").alias("row_index"), F.explode(F.array(*cells)).alias("c"))
    rows = rows.where("c is not null").select("row_index", "c.*")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    return semi_join(rows, counts.where(F.col("n") > 1), "key", hot_keys(counts, "key")).select("number", "row_index", "value")


def _unique_failures(df: DataFrame, rules: list[tuple[int, Rule]], row_id: str) -> DataFrame:
    """Failures of all ``unique`` rules together."""
    value = F.col("value")
    for i, rule in rules:
        value = F.when(F.col("number") == i, shown(F.col("value"), dtype_of(df, rule.column))).otherwise(value)
    column = F.coalesce(*[F.when(F.col("number") == i, F.lit(rule.column)) for i, rule in rules])
    row = F.col("row_index").cast("string")
    found = repeated_cells(df, {i: rule.column for i, rule in rules}, row_id)
    return found.select("number", "row_index", value.alias("value"), column.alias("column")).select(
        F.col("number").alias("rule_no"),
        "column",
        "row_index",
        "value",
        F.lit("unique").alias("rule"),
        _say("Duplicate value '", F.col("value"), "' in row ", row, ".").alias("message"),
    )


def in_table(
    df: DataFrame, column: str, allowed: DataFrame, row_id: str = ROW_INDEX, description: str = "allowed table"
) -> DataFrame:
    """``in_set`` against the first column of a table of allowed values, for sets too large for a plan.

    Joins distinct values, so a frequent value is matched once, whatever its row count.
    """
    dtype = dtype_of(df, column)
    text = _text(col(column), dtype)
    cells = df.where(_filled(col(column), dtype)).select(
        col(row_id).cast("long").alias("row_index"), text.alias("value"), digested(F.lower(strip(text))).alias("word")
    )
    name = allowed.columns[0]
    words = allowed.select(digested(F.lower(strip(raw_text(col(name), dtype_of(allowed, name))))).alias("word")).distinct()
    counts = cells.groupBy("word").agg(F.count("*").alias("n"))
    outside = counts.join(words, "word", "left_anti")
    bad = semi_join(cells, outside, "word", hot_keys(counts, "word"))
    return bad.select(
        F.lit(column).alias("column"),
        "row_index",
        "value",
        F.lit("in_set").alias("rule"),
        _say("Value '", F.col("value"), f"' is not in the {description} in row ", F.col("row_index").cast("string"), ".").alias(
            "message"
        ),
    )


def failure_log(df: DataFrame, rules: list[Rule], row_id: str = ROW_INDEX) -> DataFrame:
    """(rule_no, column, row_index, value, rule, message); rules on unknown columns are skipped."""
    known = [(i, r) for i, r in enumerate(rules) if r.column in df.columns]
    parts = []
    row_level = [(i, r) for i, r in known if r.row_check is not None]
    if row_level:
        parts.append(_row_failures(df, row_level, row_id))
    table_level = [(i, r) for i, r in known if r.row_check is None]
    if table_level:
        parts.append(_unique_failures(df, table_level, row_id))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "rule_no int, column string, row_index bigint, value string, rule string, message string"
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate(df: DataFrame, definitions: list[dict], row_id: str = ROW_INDEX) -> DataFrame:
    """Failure log of a list of rule definitions; faulty definitions are left out."""
    rules, _ = make_rules(definitions)
    return failure_log(df, rules, row_id).select(*FAILURE_COLUMNS)


def skipped_rules(df: DataFrame, definitions: list[dict]) -> DataFrame:
    """(position, reason) of the definitions that :func:`validate` leaves out."""
    _, skipped = make_rules(definitions)
    return df.sparkSession.createDataFrame(skipped, "position int, reason string")


def failure_overview(failures: DataFrame) -> DataFrame:
    """Failures per column and rule."""
    return failures.groupBy("column", "rule").agg(F.count("*").alias("failures"))


def numbered_failures(log: DataFrame) -> DataFrame:
    """The log of :func:`failure_log` numbered from 1 in rule order, then row order."""
    numbered = with_row_index(log, ["rule_no", "row_index"], name="failure_id")
    return numbered.select((F.col("failure_id") + 1).alias("failure_id"), *FAILURE_COLUMNS)


#: Kind of rule, and the parameters with which it fits a profiled column (None: it does not); ``most`` bounds allowed sets.
FITTING: tuple[tuple[str, Callable[[ColumnProfile, int | None], dict | None]], ...] = (
    ("non_null", lambda p, most: None if p.null_pct else {}),
    ("unique", lambda p, most: {} if p.total_count > UNIQUE_MINIMUM and p.unique_pct > UNIQUE_SHARE else None),
    ("range", lambda p, most: {"min": float(p.min), "max": float(p.max)} if p.inferred_type == "numeric" and p.min is not None else None),
    ("in_set", lambda p, most: {"allowed": p.values[:most]} if p.inferred_type == "categorical" and p.unique_count <= IN_SET_DISTINCT and p.values[:most] else None),
    ("regex", lambda p, most: {"pattern": EMAIL_PATTERN, "description": EMAIL_DESCRIPTION} if "email" in p.column.lower() else None),
)


def suggest_rules(prof: list[ColumnProfile], most: int | None = None) -> list[dict]:
    """Rule definitions that fit a profile; an allowed set of up to eight values holds them all.

    ``most`` keeps only that many of the most frequent ones.
    """
    fits = ((p.column, kind, fit(p, most)) for p in prof for kind, fit in FITTING)
    return [{"column": column, "type": kind, "params": params} for column, kind, params in fits if params is not None]


def suggested_rules_frame(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(position, column, type, min, max, pattern, allowed) rows of a rule list."""
    rows = [
        (
            i + 1, r["column"], r["type"], r["params"].get("min"), r["params"].get("max"),
            r["params"].get("pattern"), "|".join(r["params"]["allowed"]) if "allowed" in r["params"] else None,
        )
        for i, r in enumerate(rules)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, min double, max double, pattern string, allowed string"
    )


def allowed_from_text(text: str) -> list[str]:
    """Comma separated list to allowed values."""
    return [w.strip() for w in text.split(",") if w.strip()]


def add_rule(rules: list[dict], column: str, kind: str, params: dict | None = None) -> list[dict]:
    return [*rules, {"column": column, "type": kind, "params": params or {}}]


def remove_rule(rules: list[dict], position: int) -> list[dict]:
    """Without the rule at a 1-based position."""
    if not 1 <= position <= len(rules):
        raise IndexError(position)
    return rules[: position - 1] + rules[position:]
