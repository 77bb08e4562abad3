"""Building a cleaning configuration, and the full clean-translate-replace flow."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import DataFrame

from siftframe.operators.clean import clean
from siftframe.operators.enrich import enrich

# --- fixed values: the configuration a new session starts with ---------------
DEFAULT_CONFIG = {
    "standardize_headers": "snake_case",
    "trim_whitespace": True,
    "remove_duplicates": True,
    "duplicate_columns": None,
    "imputations": [],
    "conversions": [],
    "drop_null_rows": [],
}
# ----------------------------------------------------------------------------


def new_config(**changes: Any) -> dict:
    return {**copy.deepcopy(DEFAULT_CONFIG), **changes}


def _last_wins(steps: list[dict], step: dict) -> list[dict]:
    return [s for s in steps if s["column"] != step["column"]] + [step]


def add_imputation(config: dict, column: str, method: str, value: Any = None) -> dict:
    """One imputation per column; the value counts for ``constant`` only."""
    step = {"column": column, "method": method, "value": value if method == "constant" else None}
    return {**config, "imputations": _last_wins(config["imputations"], step)}


def add_conversion(config: dict, column: str, target: str, date_format: str | None = None) -> dict:
    """One conversion per column; an empty format means none."""
    step = {"column": column, "type": target, "format": date_format or None}
    return {**config, "conversions": _last_wins(config["conversions"], step)}


def remove_step(config: dict, kind: str, position: int) -> dict:
    """Without the imputation or conversion at a 0-based position."""
    steps = list(config[kind])
    del steps[position]
    return {**config, kind: steps}


def clean_and_enrich(
    df: DataFrame,
    config: dict,
    header_names: dict[str, str] | None = None,
    replacements: dict[str, DataFrame] | None = None,
    resolve_names: bool = False,
) -> DataFrame:
    """Cleaning, then header translation, then value replacements."""
    return enrich(clean(df, config, resolve_names), header_names, replacements)
