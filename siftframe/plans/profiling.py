"""The profiling flow: schema, anomalies and score of one table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from siftframe.operators.anomaly import AnomalyChecks, anomaly_checks, anomaly_counts, anomaly_log, quality_score
from siftframe.operators.profile import ColumnProfile, Facts, profile, profile_frame, summary, written_with_facts
from siftframe.operators.quantiles import SMALL
from siftframe.operators.report import summary_frame
from siftframe.operators.rowid import ROW_INDEX


@dataclass
class ProfileReport:
    """Profile of a table; the logs are lazy and read the table again."""

    table: DataFrame
    row_id: str
    columns: list[ColumnProfile]
    checks: AnomalyChecks
    counts: dict[str, dict[str, int]]
    summary: dict

    def column_frame(self) -> DataFrame:
        return profile_frame(self.table, self.columns)

    def summary_frame(self) -> DataFrame:
        return summary_frame(self.table.sparkSession, self.summary)

    def anomalies(self, capped: bool = False, numbered: bool = False) -> DataFrame:
        return anomaly_log(self.table, self.columns, self.row_id, capped, numbered, self.checks, self.counts)


def profile_reports(raw: DataFrame, clean: DataFrame, row_id: str = ROW_INDEX) -> list[ProfileReport]:
    """Reports of a table and of its cleaned form, whose passes run side by side.

    The cleaned table is read by every pass, so it is written once and its cleaning is not repeated; the
    plain facts of its profile are observed during that write.
    """
    with ThreadPoolExecutor(1) as pool:
        before = pool.submit(profile_report, raw, row_id)
        table, facts = written_with_facts(clean, "clean", row_id)
        after = profile_report(table, row_id, facts=facts)
        return [before.result(), after]


def profile_report(
    df: DataFrame,
    row_id: str = ROW_INDEX,
    columns: list[str] | None = None,
    uncapped: bool = True,
    limit: int = SMALL,
    facts: Facts | None = None,
) -> ProfileReport:
    """Profile, anomaly checks and 0-100 score; all zero for a table without rows."""
    prof = profile(df, row_id, columns, limit, facts=facts)
    checks = anomaly_checks(df, prof)
    counts = anomaly_counts(df, prof, checks)
    s = summary(df, prof)
    s["quality_score"] = quality_score(df, prof, uncapped, counts)
    return ProfileReport(df, row_id, prof, checks, counts, s)
