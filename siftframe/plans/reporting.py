"""Validation of a cleaned table and the report comparing it with the raw one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.operators.report import (
    COMPARISON_SCHEMA,
    comparison,
    report_document,
    report_frame,
)
from siftframe.operators.rowid import ROW_INDEX
from siftframe.operators.rules import failure_overview, validate
from siftframe.plans.profiling import ProfileReport, profile_reports
from siftframe.work import new_table_path


@dataclass
class QualityReport:
    raw: ProfileReport
    clean: ProfileReport
    failures: DataFrame
    anomalies: DataFrame
    document: dict

    def frame(self) -> DataFrame:
        return report_frame(self.clean.table.sparkSession, self.document)


def comparison_frame(raw: ProfileReport, clean: ProfileReport) -> DataFrame:
    row = comparison(raw.summary, clean.summary)
    return raw.table.sparkSession.createDataFrame([tuple(row.values())], COMPARISON_SCHEMA)


def quality_report(
    name: str,
    raw: DataFrame,
    clean: DataFrame,
    rules: list[dict],
    row_id: str = ROW_INDEX,
    industry: str = "General",
    timestamp: str | None = None,
) -> QualityReport:
    """Profile both tables, validate the cleaned one and gather the document.

    Both logs are written as tables (columns of the failure log and of the numbered
    anomaly log) of any length; the document names them and holds the numbers per column.
    """
    spark = clean.sparkSession
    before, after = profile_reports(raw, clean, row_id)
    clean = after.table

    def stored(log: DataFrame, tag: str) -> tuple[DataFrame, str]:
        path = new_table_path(spark, tag)
        log.write.parquet(path)
        return spark.read.schema(log.schema).parquet(path), path

    failures, failures_path = stored(validate(clean, rules, row_id), "failures")
    anomalies, anomalies_path = stored(after.anomalies(numbered=True), "anomalies")
    # at most one row per column and rule or kind
    counted = [r.asDict() for r in failure_overview(failures).orderBy("column", "rule").collect()]
    kinds = anomalies.groupBy("column", "type").agg(F.count("*").alias("count")).orderBy("column", "type")
    document = report_document(
        name, before.summary, after.summary, rules, counted, failures_path,
        [r.asDict() for r in kinds.collect()], anomalies_path, industry, timestamp,
    )
    return QualityReport(before, after, failures, anomalies, document)
