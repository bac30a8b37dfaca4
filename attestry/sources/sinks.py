"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.operators.controls import ordered_lines
from attestry.sources.files import CSV


def write_index(index: DataFrame, path: str, single_file: bool = False) -> None:
    """Evidence index as CSV with the fixed column order."""
    df = index.select(*V.EVIDENCE_COLUMNS)
    (df.coalesce(1) if single_file else df).write.mode("overwrite").options(**CSV).csv(path)


def write_inventory(inventory: DataFrame, csv_path: str, json_path: str | None = None) -> None:
    """Control inventory as CSV, on request also JSON lines."""
    inventory.write.mode("overwrite").options(**CSV).csv(csv_path)
    if json_path:
        inventory.write.mode("overwrite").json(json_path)


def write_skeletons(lines: DataFrame, path: str) -> None:
    """Requirement skeletons as text, one folder per family."""
    ordered_lines(lines).select("family", F.col("line").alias("value")).write.mode("overwrite").partitionBy("family").text(path)


def write_requests(rows: DataFrame, path: str) -> None:
    """Request table, partitioned by local day so a day's scan reads one folder; a large day gets several files."""
    rows.hint("rebalance", "local_date").write.mode("append").partitionBy("local_date").parquet(path)


def write_report(violations: DataFrame, path: str, format: str = "json") -> None:
    """Violations in the chosen report format (S18, S19): json, csv or xml.

    CSV takes no nested columns, so they are flattened with their names joined.
    """
    if format not in ("json", "csv", "xml"):
        raise ValueError(f"unknown report format: {format}")
    df = violations
    if format == "csv":
        flat = []
        for f in df.schema:
            if f.dataType.typeName() == "struct":
                flat += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType]
            else:
                flat.append(F.col(f.name))
        df = df.select(*flat)
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.options(**CSV)
    if format == "xml":
        writer = writer.option("rowTag", "violation")
    writer.save(path)


def with_chunks(records: DataFrame, size: int = V.SINK_CHUNK) -> DataFrame:
    """Number chunks of at most ``size`` records for an API downstream.

    Chunks are cut inside each partition, so no global ordering is needed.
    """
    row = F.monotonically_increasing_id()
    return records.withColumn("chunk", F.concat_ws("-", F.shiftright(row, 33), F.floor(row.bitwiseAND((1 << 33) - 1) / size)))


def write_counted(records: DataFrame, path: str, rejected: Column | None = None, tolerate: bool = False) -> dict[str, int]:
    """Append records and count them in the pass that writes (S17, A11): accepted and rejected.

    A rejected record fails the write, and what its tasks wrote is never committed.  With
    ``tolerate`` rejected records are counted and left out.
    """
    bad = F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))
    seen = Observation()
    rows = records.withColumn("_bad", bad).observe(seen, F.count_if(~F.col("_bad")).alias("accepted"), F.count_if("_bad").alias("rejected"))
    if not tolerate:
        rows = rows.where(F.when(F.col("_bad"), F.raise_error(F.lit("the sink rejected an event of this batch")).cast("boolean")).otherwise(F.lit(True)))
    rows.where("not _bad").drop("_bad").write.mode("append").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def append_events(records: DataFrame, path: str, rejected: DataFrame | None = None) -> None:
    """Append sink records; a rejected record fails the batch before anything is written."""
    if rejected is not None and not rejected.isEmpty():
        raise RuntimeError("the sink rejected events of this batch")
    records.write.mode("append").parquet(path)
