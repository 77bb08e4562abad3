"""Cell-level expressions shared by every operator.

All of them are built-in column expressions, so they stay inside whole-stage
code generation and never raise under ANSI mode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Characters removed by trimming: every character Python's str.strip() treats
# as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Words accepted by the boolean cast (after trimming and lower-casing).
TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "t", "active")
FALSE_WORDS = ("false", "0", "0.0", "no", "n", "f", "inactive")
# Words that make a column boolean (lower-cased, not trimmed).
BOOLEAN_WORDS = (
    "true", "false", "t", "f", "yes", "no", "y", "n",
    "1", "0", "1.0", "0.0", "active", "inactive",
)
# ----------------------------------------------------------------------------

NUMBER_PATTERN = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"


LONG_TEXT = 64  # longer values are grouped by digest
DIGEST = "\u0001"  # first character of a digest


def quoted(name: str) -> str:
    """Backtick a column name so that dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_native_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_native_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating point column."""
    return (c.isNull() | F.isnan(c)) if is_float(dtype) else c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    """The value with NaN turned into null."""
    return F.when(~F.isnan(c), c) if is_float(dtype) else c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def try_num(c: Column, dtype: T.DataType) -> Column:
    """Value as double; null when missing or not a number.

    The pattern guard keeps out the ``12d`` / ``12f`` literals that a plain cast
    accepts, and spares text cells the cost of a failing parse.
    """
    if is_native_number(dtype):
        return present(c, dtype).cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    text = strip(c)
    return F.when(c.rlike(NUMBER_PATTERN), text.try_cast("double")).when(
        c.rlike(INFINITY_PATTERN),
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )


def number_of_text(s: str) -> float | None:
    """:func:`try_num` for the :func:`raw_text` of a number, or for a text, that already is on the driver."""
    # the end of a pattern may stand before a last line break
    body = re.sub(r"(\r\n|[\n\r\x85\u2028\u2029])\Z", "", s)
    if any(re.fullmatch(p.strip("^$"), t, re.ASCII) for p in (NUMBER_PATTERN, INFINITY_PATTERN) for t in (s, body)):
        return float(s.strip(WHITESPACE))
    return None


def raw_text(c: Column, dtype: T.DataType) -> Column:
    """Cheap string form used as a grouping key; null when missing."""
    if is_float(dtype):
        return (present(c, dtype) + F.lit(0.0)).cast("string")
    if is_nested(dtype):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.StringType):
        return c
    return c.cast("string")


def is_text(dtype: T.DataType) -> bool:
    """Whether :func:`raw_text` of the type has no bounded length."""
    return isinstance(dtype, (T.StringType, T.BinaryType)) or is_nested(dtype)


def digested(text: Column) -> Column:
    """The text itself, or its SHA-256 digest if long: a key that keeps whole documents out of shuffles."""
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit(DIGEST), F.sha2(text, 256))).otherwise(text)


def float_text(s: Column) -> Column:
    """Rewrite the JVM text of a double the way Python prints it."""
    negative = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(
        F.regexp_replace(F.substring_index(s, "E", 1), r"[-.]", ""), r"0+$", ""
    )
    exp = F.substring_index(s, "E", -1).try_cast("int")
    width = exp + F.lit(1)
    whole = F.rpad(F.substring(digits, F.lit(1), width), width, F.lit("0"))
    frac = F.substring(digits, exp + F.lit(2), F.lit(400))
    tail = F.substring(digits, F.lit(2), F.lit(400))
    return (
        F.when(s == "NaN", F.lit("nan"))
        .when(s == "Infinity", F.lit("inf"))
        .when(s == "-Infinity", F.lit("-inf"))
        .when(~s.contains("E"), s)
        .when(
            (exp >= 7) & (exp < 16),
            F.concat(negative, whole, F.lit("."), F.when(frac == "", F.lit("0")).otherwise(frac)),
        )
        .when(exp == -4, F.concat(negative, F.lit("0.000"), digits))
        .otherwise(
            F.concat(
                negative,
                F.substring(digits, F.lit(1), F.lit(1)),
                F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)),
                F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
                F.when(F.abs(exp) < 10, F.lit("0")).otherwise(F.lit("")),
                F.abs(exp).cast("string"),
            )
        )
    )


def shown(s: Column, dtype: T.DataType) -> Column:
    """Text of a cell for logs and reports, from its :func:`raw_text`."""
    if is_float(dtype):
        return float_text(s)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(s)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(s.contains("."), F.rpad(s, 26, "0")).otherwise(s)
    return s


def shown_text(s: str, dtype: T.DataType) -> str:
    """:func:`shown` for a value that already is on the driver."""
    if is_float(dtype):
        return repr(float(s))
    if isinstance(dtype, T.BooleanType):
        return s.capitalize()
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return s.ljust(26, "0") if "." in s else s
    return s


def show_cell(c: Column, dtype: T.DataType) -> Column:
    return shown(raw_text(c, dtype), dtype)


def slug(c: Column) -> Column:
    """Lower-case snake form: separators to ``_``, specials dropped, ``_`` collapsed."""
    joined = F.translate(F.lower(c), " -", "__")
    kept = F.regexp_replace(joined, r"[^\p{L}\p{N}_]", "")
    return F.btrim(F.regexp_replace(kept, "_+", "_"), F.lit("_"))
