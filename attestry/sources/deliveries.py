"""Log deliveries and archived result pages."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attestry.schemas import DELIVERY_PAYLOAD


#: Bytes of text that a task hands on at once; a delivery stays whole.
HANDED_ON = 4 << 20


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ``raw``, their last column, replaced by ``payload`` and ``problem``; text is handed on in small parts."""
    def text(raw: bytes | None) -> tuple[str | None, str | None]:
        if raw is None:
            return None, "not base64"
        try:
            plain = gzip.decompress(raw)
        except gzip.BadGzipFile:
            plain = raw
        except (EOFError, OSError, zlib.error):
            return None, "broken gzip"
        return plain.decode("utf-8", errors="replace"), None

    for batch in batches:
        names, told, begun, size = [*batch.schema.names[:-1], "payload", "problem"], [], 0, 0
        for k in range(batch.num_rows):
            told.append(text(batch.column(batch.num_columns - 1)[k].as_py()))
            size += len(told[-1][0] or "")
            if size > HANDED_ON or k == batch.num_rows - 1:
                part = batch.slice(begun, len(told))
                texts = [pa.array(t, pa.string()) for t in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *texts], names)
                told, begun, size = [], k + 1, 0


def _opened(deliveries: DataFrame, data: str) -> DataFrame:
    """Deliveries with parsed content ``p``, or a ``problem``; those without data are left out."""
    keep = [f for f in deliveries.schema if f.name != data]
    raw = deliveries.where(F.coalesce(F.col(data), F.lit("")) != "").select(
        *[f.name for f in keep], F.try_to_binary(data, F.lit("base64")).alias("raw"))
    out = StructType([*keep, StructField("payload", StringType()), StructField("problem", StringType())])
    parsed = raw.mapInArrow(_inflate, out).withColumn("p", F.from_json("payload", DELIVERY_PAYLOAD))
    return parsed.withColumn("problem", F.coalesce("problem", F.when(F.col("p.logEvents").isNull(), F.lit("no log events"))))


def rejected_deliveries(deliveries: DataFrame, data: str = "data") -> DataFrame:
    """Deliveries that can't be read, with their ``problem``: for a dead-letter table."""
    return _opened(deliveries, data).where("problem is not null").drop("payload", "p")


def decode_deliveries(deliveries: DataFrame, data: str = "data") -> DataFrame:
    """Base64 gzip deliveries to one row per log message.

    Deliveries that are not gzip count as plain JSON; empty data gives no rows, a
    missing message is an empty line.  Spark has no gunzip function, so only that
    step runs in Python, batch-wise.  What can't be read is in
    :func:`rejected_deliveries`.
    """
    names = [c for c in deliveries.columns if c != data]
    parsed = _opened(deliveries, data).where("problem is null")
    return parsed.select(*names, F.col("p.logGroup").alias("log_group"), F.posexplode("p.logEvents").alias("line_no", "e")).select(
        *names, "log_group", "line_no", F.timestamp_millis("e.timestamp").alias("log_ts"),
        F.coalesce("e.message", F.lit("")).alias("message"))


def flatten_result_rows(pages: DataFrame, columns: list[str], rows: str = "rows") -> DataFrame:
    """Result pages, each a list of rows of one-key cells, to flat rows.

    ``rows`` is ``array<array<map<string,string>>>``.  A column named twice in a
    row takes its last value.
    """
    keep = [c for c in pages.columns if c != rows]
    one = pages.select(*keep, F.posexplode(rows).alias("row_no", "cells"))

    def last_cell(name: str):
        hits = F.filter("cells", lambda m: F.map_contains_key(m, name))
        return F.try_element_at(F.try_element_at(hits, F.lit(-1)), F.lit(name)).alias(name)

    return one.select(*keep, "row_no", *[last_cell(c) for c in columns])
