"""Readers of landed files (S9-S15) and the pluggable source interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attestry import fixed_values as V
from attestry.functions.text import file_suffix
from attestry.operators.evidence import clean_index
from attestry.schemas import LISTING_PAGE, strings


#: Quotes in quoted cells are doubled.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class EvidenceSource(Protocol):
    """What an audit tool has to offer: two tables."""

    def controls(self, framework: str) -> DataFrame: ...

    def documents(self, controls: DataFrame) -> DataFrame: ...


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages, one JSON object per line."""
    return spark.read.schema(LISTING_PAGE).json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Evidence index CSV, quoted as in RFC 4180; an absent file is an empty index."""
    try:
        raw = spark.read.options(**CSV, multiLine=True).csv(path)
    except AnalysisException:
        raw = spark.createDataFrame([], strings(*V.EVIDENCE_COLUMNS))
    return clean_index(raw).select(*V.EVIDENCE_COLUMNS)


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(family, display_name) from a JSON object; absent file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], strings("family", "display_name"))
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    return raw.select(F.explode(pairs).alias("e")).select(F.col("e.key").alias("family"), F.col("e.value").alias("display_name"))


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """Requirement files as ``file, text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Evidence files as ``path, file_name, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", F.substring_index("path", "/", -1).alias("file_name"), "content")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File paths only; contents are not read (Q3)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def no_pdf_text(content: bytes) -> str | None:
    """Default extractor: no PDF reader is installed, so the raw content stays."""
    return None


def files_to_text(files: DataFrame, pdf_text: Callable[[bytes], str | None] = no_pdf_text) -> DataFrame:
    """Evidence files as text (S15); ``files`` has ``file_name`` and ``content``.

    PDFs go through ``pdf_text`` and keep their raw content when it finds
    nothing; Word files become a placeholder line; all else stays as it is.  Only
    PDFs visit Python.
    """
    keep = [f for f in files.schema if f.name != "content"]
    names = [f.name for f in keep]
    suffix = file_suffix("file_name")
    raw = F.col("content").cast("string")
    word = F.concat(F.lit(V.WORD_PLACEHOLDER[0]), "file_name", F.lit(V.WORD_PLACEHOLDER[1]))
    plain = files.where(suffix != ".pdf").select(
        *names, F.when(suffix.isin(".docx", ".doc"), word).otherwise(raw).alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content = pdf.pop("content")
            pdf["text"] = [pdf_text(bytes(b)) or bytes(b).decode("utf-8", errors="replace") for b in content]
            yield pdf

    out = StructType([*keep, StructField("text", StringType())])
    pdfs = files.where(suffix == ".pdf").select(*names, "content").mapInPandas(extract, out)
    return plain.unionByName(pdfs)
