"""Before/after comparison and the quality report document."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.operators.profile import score_band


def _signed(x: float, text: str) -> str:
    return ("+" if x > 0 else "") + text


def comparison(raw: dict, clean: dict) -> dict:
    """Rows, completeness and score of a table before and after cleaning."""
    rows = clean["row_count"] - raw["row_count"]
    delta = clean["quality_score"] - raw["quality_score"]
    return {
        "original_rows": raw["row_count"],
        "cleaned_rows": clean["row_count"],
        "rows_change": _signed(rows, str(rows)),
        "original_missing_cells": raw["missing_cells"],
        "original_missing_pct": raw["missing_pct"],
        "cleaned_missing_cells": clean["missing_cells"],
        "cleaned_missing_pct": clean["missing_pct"],
        "completeness_rate": round(100 - clean["missing_pct"], 1),
        "original_score": raw["quality_score"],
        "cleaned_score": clean["quality_score"],
        "score_delta": _signed(delta, f"{delta:.2f}"),
    }


COMPARISON_SCHEMA = (
    "original_rows bigint, cleaned_rows bigint, rows_change string, original_missing_cells bigint, "
    "original_missing_pct double, cleaned_missing_cells bigint, cleaned_missing_pct double, "
    "completeness_rate double, original_score double, cleaned_score double, score_delta string"
)


def report_document(
    name: str,
    raw: dict,
    clean: dict,
    rules: list[dict],
    failures: list[dict],
    failures_log: str,
    anomalies: list[dict],
    anomalies_log: str,
    industry: str = "General",
    timestamp: str | None = None,
) -> dict:
    """The report as one nested document.

    ``failures`` and ``anomalies`` hold the number per column and kind; the logs, which grow
    with the table, are tables named by their paths.
    """
    gain = clean["quality_score"] - raw["quality_score"]
    return {
        "application": "siftframe",
        "timestamp": timestamp or datetime.now(timezone.utc).isoformat(),
        "original_filename": name,
        "industry_context": industry,
        "metadata": {
            "raw_records": raw["row_count"],
            "cleaned_records": clean["row_count"],
            "cells_evaluated": clean["total_cells"],
            "missing_cells_raw": raw["missing_cells"],
            "missing_cells_cleaned": clean["missing_cells"],
        },
        "scores": {
            "original_quality_score": f"{raw['quality_score']}%",
            "final_cleaned_score": f"{clean['quality_score']}%",
            "score_improvement": f"{gain:.2f}%",
        },
        "validation_checks": {
            "rules_evaluated_count": len(rules),
            "failures_count": sum(f["failures"] for f in failures),
            "failures": failures,
            "failures_log": failures_log,
        },
        "anomalies_remaining": anomalies,
        "anomalies_log": anomalies_log,
    }


def report_frame(spark, document: dict) -> DataFrame:
    """One row, one column ``report`` holding the JSON text."""
    return spark.createDataFrame([(json.dumps(document, indent=2),)], "report string")


def score_row(raw: dict) -> tuple:
    return tuple(raw[k] for k in ("row_count", "column_count", "total_cells", "missing_cells", "missing_pct", "quality_score"))


SUMMARY_SCHEMA = (
    "row_count bigint, column_count int, total_cells bigint, missing_cells bigint, missing_pct double, quality_score double"
)


def summary_frame(spark, report: dict) -> DataFrame:
    return spark.createDataFrame([score_row(report)], SUMMARY_SCHEMA)


def with_band(summary: DataFrame) -> DataFrame:
    return summary.withColumn("band", score_band(F.col("quality_score")))
