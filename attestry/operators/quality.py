"""Integrity checks of the evidence index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col, filled, strip


def missing_values(index: DataFrame) -> DataFrame:
    """(line_no, column) of each empty required value (Q1)."""
    names = F.array(*[F.when(~filled(c), F.lit(c)) for c in V.REQUIRED_EVIDENCE_COLUMNS])
    return index.select("line_no", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("column"))


def bad_status(index: DataFrame) -> DataFrame:
    """Rows outside the allowed status set (Q2, U4)."""
    return index.where(~F.coalesce(col("status").isin(V.EVIDENCE_STATUSES), F.lit(False)))


def missing_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """Ready local files that are not in the listing ``files(path)``."""
    ready = index.where((col("status") == "ready") & (col("source_type") == "local_file"))
    return ready.join(files.select(col("path").alias("link")), "link", "left_anti")


def unknown_controls(index: DataFrame, requirements: DataFrame) -> DataFrame:
    """Control ids no requirement file of their family lists.

    Blank ids and families without a file are skipped.  ``requirements``: family,
    control.  Families with a file are few next to index rows and one pass tells
    both facts, so no row meets a whole family.
    """
    rows = index.withColumns({"_c": strip(F.coalesce("control", F.lit(""))), "_f": F.upper(strip(F.coalesce("family", F.lit(""))))})
    listed = requirements.select(col("family").alias("_f"), col("control").alias("_c"))
    known_families = listed.select("_f").distinct()
    return (
        rows.where("_c <> ''").join(listed, ["_f", "_c"], "left_anti")
        .join(known_families, "_f", "left_semi").drop("_f", "_c")
    )
