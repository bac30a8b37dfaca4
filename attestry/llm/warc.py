"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Every response gives two records that refer to it by its identifier and keep its target,
date, HTTP header and digests. Identifiers are made from the source identifier, so a
repeated run gives the same records. A response without payload (null or empty) gives
records too: the conversion then holds no text. Without a target the target line is left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from attestry.llm.shared import apart

VERSION = "WARC/1.1"
OUT_BYTES = 1 << 23
RECORDS = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, source_header string, block string"
)

HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)")
BREAKS = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|td|th|title|ul)\b[^<>]*>")
TAGS = re.compile(r"<[A-Za-z/!?][^<>]*>")
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"(?is)<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)")
LANGUAGE = re.compile(r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)")
LINKS = re.compile(r"(?is)<a\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s<>]+)")


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    """An identifier that is the same in each run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {source}'.encode()).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """Text of a page: hidden parts out, block tags as line breaks, entities resolved, blanks folded."""
    text = TAGS.sub("", BREAKS.sub("\n", HIDDEN.sub(" ", page)))
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape(text).replace("\r", "\n"))).strip()


def _first(pattern: re.Pattern, page: str) -> str:
    found = pattern.search(page)
    return " ".join(html.unescape(TAGS.sub("", found[1])).split()) if found else ""


def metadata_block(page: str, header: str) -> str:
    """warc-fields on the page, with the source's HTTP header lines, each on its own line."""
    shown = HIDDEN.sub(" ", page)
    fields = [("title", _first(TITLE, shown)), ("language", _first(LANGUAGE, shown))]
    fields += [("source-header", line) for line in header.splitlines() if line.strip()]
    fields += [("outlink", html.unescape(link)) for link in dict.fromkeys(LINKS.findall(shown))]
    return "".join(f"{name}: {value}\r\n" for name, value in fields if value)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response rows of a table of pages: record_id, target_uri, warc_date, http_header, payload."""
    named = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(F.coalesce("html", F.lit(""))))
    hexed = F.md5(named)
    parts = F.concat_ws("-", *(F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), parts, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"), header.alias("http_header"), F.coalesce("html", F.lit("")).alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Metadata and conversion record of every response; columns beside those of ``responses`` stay in front.

    Those named like a column of the records come back with ``_input`` behind them.
    """
    used = ["record_id", "target_uri", "warc_date", "http_header", "payload"]
    made = [x.split(" ")[0] for x in RECORDS.split(", ")]
    return apart(source, made, lambda frame: _derived(frame, used, made), used)


def _derived(source: DataFrame, used: list[str], made: list[str]) -> DataFrame:
    kept = [c for c in source.columns if c not in used and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, size = [], [], 0
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in used}
            for k in range(batch.num_rows):
                record, target, date, header, payload = (column[c][k].as_py() for c in used)
                header, payload = header or "", payload or ""
                raw, whole = payload.encode(), (header + payload).encode()
                payload_digest, block_digest = digest(raw), digest(whole)
                for kind, content_type, block in (
                    ("metadata", "application/warc-fields", metadata_block(payload, header)), ("conversion", "text/plain; charset=utf-8", plain_text(payload)),
                ):
                    content = block.encode()
                    rows.append((derived_id(record or "", kind), kind, record, target, date, content_type, len(content), digest(content), block_digest, payload_digest, header, block))
                    index.append(k)
                    size += len(content) + len(header)
                if size >= OUT_BYTES or k == batch.num_rows - 1:
                    front = batch.select(kept).take(pa.array(index, pa.int64())) if kept else None
                    kinds = [pa.int64() if name == "content_length" else pa.string() for name in made]
                    arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(front.columns if kept else ()), *arrays], [*kept, *made])
                    rows, index, size = [], [], 0

    front = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept]
    return source.select(*kept, *used).mapInArrow(run, ", ".join([*front, RECORDS]))


def as_warc(records: DataFrame) -> DataFrame:
    """One column ``value`` with whole records without their closing blank lines."""
    line = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
            ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    return records.select(F.concat(F.lit(f"{VERSION}\r\n"), *(line(*x) for x in head), F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, folder: str) -> None:
    """WARC files, one for each partition, gzipped; Spark's committer takes care of lost tasks."""
    as_warc(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a file, one at a time, by the lengths that the headers give."""
    while version := stream.readline():
        if not version.strip():
            continue
        header = {}
        while line := stream.readline().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name] = value.strip()
        yield header, stream.read(int(header["Content-Length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC files as rows: header map and block.

    Files may be gzipped whole or record by record. A file comes as it is stored, so below 2 GB, and is unpacked
    record by record; records are handed on in parts of about ``OUT_BYTES``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                stream, headers, blocks, size = io.BytesIO(raw), [], [], 0
                for header, block in parse_records(gzip.GzipFile(fileobj=stream) if raw[:2] == b"\x1f\x8b" else stream):
                    headers.append(list(header.items()))
                    blocks.append(block)
                    size += len(block)
                    if size >= OUT_BYTES:
                        yield _read_batch(headers, blocks)
                        headers, blocks, size = [], [], 0
                if headers:
                    yield _read_batch(headers, blocks)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, "header map<string,string>, block binary")


def _read_batch(headers: list[list[tuple[str, str]]], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["header", "block"])


def responses_of(records: DataFrame) -> DataFrame:
    """The responses among records read by ``read_warc``, as ``derive`` takes them.

    The block is cut behind the HTTP header; bytes that are no UTF-8 become replacement characters, and bodies
    that were sent compressed or in chunks stay as they are. A block without an HTTP header is all payload.
    """
    field = lambda name: F.try_element_at("header", F.lit(name))
    text = F.make_valid_utf8(F.col("block").cast("string"))
    end = F.when(F.startswith(text, F.lit("HTTP/")), F.instr(text, "\r\n\r\n")).otherwise(0)
    return records.where(field("WARC-Type") == "response").select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("warc_date"),
        F.when(end > 0, F.substring(text, F.lit(1), end + 3)).otherwise("").alias("http_header"),
        F.when(end > 0, F.substring(text, end + 4, F.length(text))).otherwise(text).alias("payload"),
    )


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Both records of every page, with its page_id."""
    return derive(responses(pages, date))
