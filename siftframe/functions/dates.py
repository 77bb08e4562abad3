"""Date format translation, the "format of the first value" rule, and the shapes of dates."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# A text column is tried as a date when one of its first values holds one of
# these anywhere.
DATE_HINTS = (
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"\d{4}\d{2}\d{2}",
    r"[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4}",
)
# strptime directive -> JVM datetime pattern.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m",
    "S": "s", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "j": "D", "z": "[XXX][XX]", "Z": "z", "%": "%",
}
# Formats tried, in this order, on the first value of a column.
DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y",
    "%m/%d/%y", "%m-%d-%y", "%d/%m/%y", "%d-%m-%y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y",
)
TIME_SUFFIXES = ("", " %H:%M:%S", "T%H:%M:%S", " %H:%M", "T%H:%M", " %H:%M:%S.%f", "T%H:%M:%S.%f",
    " %H:%M:%S%z", "T%H:%M:%S%z", " %H:%M:%S.%f%z", "T%H:%M:%S.%f%z")
# ----------------------------------------------------------------------------


def java_format(fmt: str) -> str:
    """Translate a strptime format; month, day and time fields accept one or two digits.

    Where number fields touch, as in ``%Y%m%d``, each has its full width.
    """
    out, literal, i = [], "", 0
    touching = {k for m in re.finditer(r"(?:%[YymdHIMS]){2,}", fmt) for k in range(m.start(), m.end(), 2)}

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z']", literal) else literal)
            literal = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            flush()
            if fmt[i + 1] not in DIRECTIVES:
                raise ValueError(f"unsupported date directive %{fmt[i + 1]}")
            field = DIRECTIVES[fmt[i + 1]]
            out.append(field * 2 if i in touching and len(field) == 1 else field)
            i += 2
        else:
            literal += fmt[i]
            i += 1
    flush()
    return "".join(out)


def looks_like_date(values: list[str]) -> bool:
    return any(re.search(p, v) for p in DATE_HINTS for v in values)


def guess_format(value: str) -> str | None:
    """First known strptime format that reads the value; month-first when ambiguous."""
    for date in DATE_FORMATS:
        for time in TIME_SUFFIXES:
            try:
                datetime.strptime(value, date + time)
                return date + time
            except ValueError:
                continue
    return None


def parse_date(c: Column, formats: list[str]) -> Column:
    """Timestamp by the first format that reads the text, else null."""
    return F.coalesce(*[_read(c, f) for f in formats])


def _read(c: Column, fmt: str) -> Column:
    read = F.try_to_timestamp(c, F.lit(java_format(fmt)))
    if "%y" not in fmt:
        return read
    # two digits mean 1969 to 2068
    return F.when(F.year(read) > 2068, read - F.expr("INTERVAL 100 YEARS")).otherwise(read)


def readable(fmt: str) -> bool:
    """Whether every directive of the format is known."""
    try:
        java_format(fmt)
    except ValueError:
        return False
    return True


def column_format(first_value: str | None) -> str | None:
    """The format fixed by the first value of a column, if it has any."""
    return guess_format(first_value) if first_value is not None else None


# --- shapes -----------------------------------------------------------------

LONGEST_DATE = 48  # no known format writes more


def shape(c: Column) -> Column:
    """Form of a text: runs of letters are ``@``, of digits ``d`` (one or two), ``Y`` (four), ``D`` (eight) or ``n``; other marks stay.

    Null for texts longer than any date, which are not looked at.
    """
    out = F.when(F.length(c) <= LONGEST_DATE, c)
    for pattern, mark in SHAPE_STEPS:
        out = F.regexp_replace(out, pattern, mark)
    return out


SHAPE_STEPS = (
    (r"[A-Za-z]+", "@"),
    (r"(?<![0-9])[0-9]{1,2}(?![0-9])", "d"),
    (r"(?<![0-9])[0-9]{4}(?![0-9])", "Y"),
    (r"(?<![0-9])[0-9]{8}(?![0-9])", "D"),
    (r"[0-9]+", "n"),
)


def text_shape(text: str) -> str:
    """:func:`shape` of a text on the driver."""
    for pattern, mark in SHAPE_STEPS:
        text = re.sub(pattern, mark, text)
    return text


def _shapes_of(fmt: str) -> set[str]:
    """All shapes that a format reads: fractions of one to six digits, zones as ``Z`` or with or without a colon."""
    moment = datetime(2026, 5, 17, 10, 20, 30)
    texts = [fmt]
    for directive, forms in (("%f", ("1", "123", "1234")), ("%z", ("Z", "+0200", "+02:00", "-0200", "-02:00"))):
        texts = [t.replace(directive, form) for t in texts for form in (forms if directive in fmt else ("",))]
    return {text_shape(moment.strftime(t)) for t in texts}


def _formats_by_shape() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for fmt in (d + t for d in DATE_FORMATS for t in TIME_SUFFIXES):
        for s in _shapes_of(fmt):
            found.setdefault(s, []).append(fmt)
    return found


#: Of formats that read as much the earlier one counts, so that the month comes first.
FORMAT_ORDER = {d + t: i for i, (d, t) in enumerate((d, t) for d in DATE_FORMATS for t in TIME_SUFFIXES)}
#: The one or two formats, month first, that may read texts of a shape.
FORMATS_BY_SHAPE = _formats_by_shape()
#: Shapes of which a text may make its column a column of dates.
HINTED_SHAPES = {s for s, formats in FORMATS_BY_SHAPE.items() if any(looks_like_date([datetime(2026, 5, 17).strftime(f.split("%H")[0])]) for f in formats)}


def parse_by_shape(c: Column, formats: dict[str, list[str]] | None = None) -> Column:
    """Timestamp by the first format of a text's shape that reads it, so no text meets more than these few parsers."""
    by_list: dict[tuple[str, ...], list[str]] = {}
    for s, known in (FORMATS_BY_SHAPE if formats is None else formats).items():
        by_list.setdefault(tuple(known), []).append(s)

    def read(form: Column) -> Column:
        branches = [(form.isin(shapes), parse_date(c, list(known))) for known, shapes in by_list.items()]
        out = F.when(*branches[0])
        for branch in branches[1:]:
            out = out.when(*branch)
        return out

    if not by_list:
        return F.lit(None).cast("timestamp")
    # the shape is found once, not for each branch
    return F.get(F.transform(F.array(shape(c)), read), 0)


def parse_like_first(c: Column, first_value: str | None, formats: dict[str, list[str]] | None = None) -> Column:
    """Timestamp by the format of the first value; if that is no date, by those of each text's own shape.

    ``formats`` limits these to shapes known to occur.
    """
    fmt = column_format(first_value)
    return parse_date(c, [fmt]) if fmt else parse_by_shape(c, formats)
