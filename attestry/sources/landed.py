"""Landed listings as a Python data source, and the evidence source on top of it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from attestry.operators.controls import as_controls, as_documents

ITEM = ("id", "externalId", "name", "title", "url", "fileName")


@dataclass
class Listings(InputPartition):
    """Folders of listings that one task reads."""

    folders: list[str]


class LandedPages(DataSource):
    """``spark.read.format("landed_pages").load(folder)``: the items of listings up to the first error page of each.

    ``folder`` holds a folder for each listing, named by it or by ``column=name`` as Spark writes them; its files in
    the order of their names hold the pages, one JSON object a line. Each listing is a partition, or so many together
    as the option ``together`` says. A listing that ended with an error has a last row with ``error`` and no item.
    Lines are read one at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return f"listing string, page_no bigint, item_no int, item struct<{', '.join(f'{n}: string' for n in ITEM)}>, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("together", 1)))


class ListingReader(DataSourceReader):
    def __init__(self, path: str, together: int):
        self.path, self.together = path, together

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Listings]:
        system, folder = self._system()
        found = system.get_file_info(fs.FileSelector(folder))
        names = sorted(f.path for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))
        return [Listings(names[a : a + self.together]) for a in range(0, len(names), self.together)]

    def read(self, partition: Listings | None) -> Iterator[tuple]:
        system, _ = self._system()
        for folder in partition.folders if partition else ():
            listing = unquote(folder.rsplit("/", 1)[-1].split("=", 1)[-1])
            yield from self._listing(system, folder, listing)

    def _listing(self, system: fs.FileSystem, folder: str, listing: str) -> Iterator[tuple]:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", ".")))
        number = 0
        for path in files:
            with system.open_input_stream(path) as stream:
                for line in _lines(stream):
                    page = json.loads(line)
                    number = page.get("page_no", number)
                    if page.get("error"):
                        yield listing, number, None, None, page["error"]
                        return
                    results = page.get("results") or {}
                    for k, item in enumerate(results.get("data") or []):
                        yield listing, number, k, tuple((item or {}).get(n) for n in ITEM), None
                    if not (results.get("pageInfo") or {}).get("hasNextPage"):
                        return
                    number += 1


def _lines(stream) -> Iterator[bytes]:
    """Lines that aren't empty, of a stream read in parts."""
    rest = b""
    while part := stream.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        yield from (line for line in whole if line.strip())
    if rest.strip():
        yield rest


def read_listings(spark: SparkSession, path: str, together: int = 1) -> DataFrame:
    """Items of all listings under a folder, see :class:`LandedPages`."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("together", together).load(path)


def failed_listings(items: DataFrame) -> DataFrame:
    """Listings that an error ended: ``listing, page_no, error``."""
    return items.where("error is not null").select("listing", "page_no", "error")


@dataclass(frozen=True)
class LandedEvidence:
    """An :class:`attestry.sources.files.EvidenceSource` over landed pages: controls by framework, documents by control."""

    spark: SparkSession
    path: str
    #: Document listings read by one task; there is one for each control.
    together: int = 100

    def controls(self, framework: str) -> DataFrame:
        items = read_listings(self.spark, f"{self.path}/controls").where((F.col("listing") == framework) & F.col("error").isNull())
        return as_controls(items).drop("listing", "error")

    def documents(self, controls: DataFrame) -> DataFrame:
        items = read_listings(self.spark, f"{self.path}/documents", self.together).where("error is null")
        found = as_documents(items).drop("error").withColumnRenamed("listing", "control_id")
        return found.join(controls.select(F.col("id").alias("control_id")).distinct(), "control_id", "left_semi")
