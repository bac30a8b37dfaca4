"""Evidence index: rows from documents, merge, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import col, file_stem, filled, safe_filename
from attestry.operators.joins import SALTS, first_per_key, salted_left_join


def source_type(url: Column | str, base_url: str = "") -> Column:
    """``confluence`` or ``external_url``."""
    u = F.coalesce(col(url), F.lit(""))
    wiki = F.contains(u, F.lit(V.WIKI_MARKS[0])) | F.contains(F.lower(u), F.lit(V.WIKI_MARKS[1]))
    if base_url:
        wiki = wiki | F.startswith(u, F.lit(base_url))
    return F.when(wiki, "confluence").otherwise("external_url")


def upload_links(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """Stored path of each (control, upload) link; links without a file go.

    ``links``: ord, family, control, doc_id, upload_id, file_name, readable.  An
    upload is stored once, under the family and name of its first link, and every
    later link of it points there.  An unreadable upload still counts when an
    earlier one already stored a file of that name.
    """
    df = links.withColumn("path", F.concat(F.lit("docs/"), "family", F.lit("/"), safe_filename(file_stem("file_name")), F.lit(".txt")))
    upload = ["doc_id", "upload_id"]
    stored = first_per_key(df.where("readable"), upload, [F.asc("ord")]).select(
        *upload, col("path").alias("stored_path"), col("ord").alias("stored_ord"))
    on_disk = stored.groupBy(col("stored_path").alias("path")).agg(F.min("stored_ord").alias("disk_ord"))
    broken = salted_left_join(df.where("not readable"), on_disk, ["path"], "ord", salts).where("ord > disk_ord")
    borrowed = first_per_key(broken, upload, [F.asc("ord")]).select(
        *upload, col("path").alias("stored_path"), col("ord").alias("stored_ord"))
    known = salted_left_join(df, stored.unionByName(borrowed), upload, "ord", salts)
    return known.where("ord >= stored_ord").drop("path", "stored_ord").withColumnRenamed("stored_path", "link")


def evidence_rows(documents: DataFrame, links: DataFrame, base_url: str = "") -> DataFrame:
    """Index rows of all controls (F36): files are ready, bare urls wait for a person.

    ``documents``: ord, control, family, doc_id, url, has_uploads.  A document
    with uploads gives file rows only, one without uploads its url, else nothing.
    """
    files = links.select("ord", "family", "control", F.lit("local_file").alias("source_type"), "link", F.lit("ready").alias("status"))
    urls = documents.where(~col("has_uploads") & filled("url")).select(
        "ord", "family", "control", source_type("url", base_url).alias("source_type"), col("url").alias("link"),
        F.lit("needs_manual_fetch").alias("status"))
    return files.unionByName(urls).withColumn("doc_type", F.lit("none"))


def link_uploads(documents: DataFrame, uploads: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every linked document with each of its uploads, or once without any.

    ``documents``: ord, doc_id and more; ``uploads``: doc_id, upload_id, file_name.
    """
    return salted_left_join(documents, uploads, ["doc_id"], "ord", salts).withColumn("has_uploads", col("upload_id").isNotNull())


def clean_index(rows: DataFrame) -> DataFrame:
    """Index rows as read: missing columns and nulls empty, unknown types ``none``."""
    have = {c: F.coalesce(col(c), F.lit("")) if c in rows.columns else F.lit("") for c in V.EVIDENCE_COLUMNS}
    have["doc_type"] = F.when(have["doc_type"].isin(V.DOC_TYPES), have["doc_type"]).otherwise("none")
    return rows.select(*[c for c in rows.columns if c not in V.EVIDENCE_COLUMNS], *[c.alias(n) for n, c in have.items()])


def merge_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-only merge on (family, control, link).

    Existing rows stay as they are and come first; of equal new rows the first
    by ``ord`` is added.
    """
    keys = ["family", "control", "link"]
    added = first_per_key(new, keys, [F.asc("ord")]).join(existing.select(*keys), keys, "left_anti")
    cols = ["ord", *V.EVIDENCE_COLUMNS]
    return existing.select(*cols).withColumn("batch", F.lit(0)).unionByName(added.select(*cols).withColumn("batch", F.lit(1)))


def missing_count(index: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows a person still has to fetch (A10)."""
    return index.groupBy(*by).agg(F.count_if(col("status") == "needs_manual_fetch").alias("missing"))


