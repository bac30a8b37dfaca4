"""One nightly run: violations stored once, report and tickets read from the store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attestry.operators import report as R
from attestry.operators import tickets as K
from attestry.streaming.runner import scratch


def stored(df: DataFrame, name: str = "stored", path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage for steps that read a result several times, and survives
    lost executors.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_and_tickets(violations: DataFrame, period: dict[str, str], run: dict[str, str], project: str,
                       issue_type: str, labels: list[str], by: list[str] = ("local_date",), path: str | None = None) -> dict[str, DataFrame]:
    """Tables of a run: violations, header, groups, tickets."""
    kept = stored(violations, "violations", path)
    return {
        "violations": kept,
        "header": R.report_header(kept, period, run, list(by)),
        "human_groups": R.human_groups(kept, list(by)),
        "tickets": K.tickets(kept, period, run["generated_at"], project, issue_type, labels, by),
    }
