"""Windowed metrics and consecutive-breach alarms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col


@dataclass(frozen=True)
class Alarm:
    """``statistic`` of a metric above ``threshold`` in ``periods`` windows in a row."""

    statistic: str = "sum"
    threshold: float = 0.0
    periods: int = V.ALARM_PERIODS
    period_seconds: int = V.ALARM_PERIOD_SECONDS


def metric_windows(samples: DataFrame, by: list[str], period_seconds: int = V.ALARM_PERIOD_SECONDS) -> DataFrame:
    """Sum, mean and count per dimension and tumbling window (A14).  ``samples``: ts, value."""
    span = F.window("ts", f"{period_seconds} seconds")
    return samples.groupBy(*by, span).agg(
        F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("*").alias("samples"))


def alarms(samples: DataFrame, by: list[str], rule: Alarm = Alarm()) -> DataFrame:
    """Dimension and end of each run of ``periods`` breaching windows (T5).

    Breaching windows are counted in sliding spans of the whole run length, so the
    same plan serves batches and streams, no dimension is walked in one task, and
    a window without samples breaks the run (missing data is not breaching).
    """
    measured = metric_windows(samples, by, rule.period_seconds)
    value = {"sum": "total", "avg": "mean"}[rule.statistic]
    breaching = measured.where(col(value) > rule.threshold).select(*by, F.window_time("window").alias("at"))
    whole = f"{rule.periods * rule.period_seconds} seconds"
    runs = breaching.groupBy(*by, F.window("at", whole, f"{rule.period_seconds} seconds")).agg(F.count("*").alias("breaches"))
    return runs.where(col("breaches") == rule.periods).select(
        *by, col("window.start").alias("run_start"), col("window.end").alias("run_end"))
