"""Control listings and requirement skeletons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import blank_to_null, col, filled, first_filled, strip
from attestry.operators.joins import salted_left_join
from attestry.operators.positions import laid_out, positions


def rows_before_error(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of landed listing pages up to the first error page of each listing.

    ``pages`` follows :data:`attestry.schemas.LISTING_PAGE` plus ``keys``; a page
    after one without ``hasNextPage`` is not reached either.
    """
    stop = F.when(filled("error"), col("page_no") - 1).when(
        ~F.coalesce(col("results.pageInfo.hasNextPage"), F.lit(False)), col("page_no"))
    stops = pages.groupBy(*keys).agg(F.min(stop).alias("_last"))
    kept = salted_left_join(pages, stops, keys, "page_no").where(col("_last").isNull() | (col("page_no") <= col("_last")))
    return kept.select(*keys, "page_no", F.posexplode("results.data").alias("item_no", "item"))


def as_controls(items: DataFrame) -> DataFrame:
    empty = F.lit("")
    return items.select(
        *[c for c in items.columns if c not in ("item",)],
        F.coalesce("item.id", empty).alias("id"), F.coalesce("item.externalId", empty).alias("external_id"),
        F.coalesce("item.name", empty).alias("name"))


def as_documents(items: DataFrame) -> DataFrame:
    empty = F.lit("")
    return items.select(
        *[c for c in items.columns if c not in ("item",)],
        F.coalesce("item.id", empty).alias("doc_id"), F.coalesce("item.title", empty).alias("title"),
        F.coalesce("item.url", empty).alias("url"))


def as_uploads(items: DataFrame) -> DataFrame:
    return items.select(
        *[c for c in items.columns if c not in ("item",)],
        F.coalesce("item.id", F.lit("")).alias("upload_id"),
        F.coalesce("item.fileName", "item.name", F.lit("")).alias("file_name"))


def with_prefix(controls: DataFrame, prefixes: list[str]) -> DataFrame:
    """Controls whose name starts with a prefix; no prefixes keep all."""
    if not prefixes:
        return controls
    return controls.where(reduce(lambda a, b: a | b, [F.startswith(col("name"), F.lit(p)) for p in prefixes]))


def family_of(external_id: Column | str = "external_id", name: Column | str = "name") -> Column:
    """Text before the first dash of the id, else of the name, else ``UNKNOWN``."""

    def head(c: Column | str) -> Column:
        return F.when(F.contains(col(c), F.lit("-")), strip(F.substring_index(col(c), "-", 1)))

    return F.coalesce(head(external_id), head(name), F.lit("UNKNOWN"))


def resolved_family(family_codes: list[str], external_id: Column | str = "external_id", name: Column | str = "name") -> Column:
    """Family code; dotted code sets read it off the control name."""
    if not any("." in c for c in family_codes):
        return family_of(external_id, name)
    dotted = blank_to_null(F.regexp_extract(col(name), V.DOTTED_FAMILY, 1))
    fallback = F.when(F.contains(col(external_id), F.lit("-")), F.substring_index(col(external_id), "-", 1))
    return F.coalesce(dotted, fallback, F.lit("UNKNOWN"))


def control_url(app_url: str, control_id: Column | str = "id") -> Column:
    return F.concat(F.lit(app_url), F.lit("/controls/"), col(control_id))


def control_title(external_id: Column | str = "external_id", name: Column | str = "name") -> Column:
    """Name without its leading id."""
    eid, nm = F.coalesce(col(external_id), F.lit("")), col(name)
    rest = F.when(F.startswith(nm, eid), F.substring(nm, F.length(eid) + 1, F.length(nm))).otherwise(nm)
    return F.when(eid == "", nm).otherwise(strip(rest))


def control_inventory(controls: DataFrame, app_url: str, documents: DataFrame | None = None) -> DataFrame:
    """Inventory rows; with documents also their joined titles and urls.

    The joined texts are one cell per control by definition.  Lists are built in
    order from a map-side partial aggregate and joined back by control id.
    """
    base = controls.select("id", "external_id", "name", family_of().alias("family"), control_url(app_url).alias("control_url"))
    if documents is None:
        return base.drop("id")
    titles = documents.groupBy(col("control_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "title", "url"))).alias("docs"))
    joined = base.join(titles, "id", "left")
    docs = F.coalesce("docs", F.array().cast(titles.schema["docs"].dataType))
    urls = F.filter(F.transform(docs, lambda d: d["url"]), lambda u: F.coalesce(u != "", F.lit(False)))
    return joined.select(
        "external_id", "name", "family", "control_url",
        F.array_join(F.transform(docs, lambda d: F.coalesce(d["title"], F.lit(""))), "; ").alias("document_titles"),
        F.array_join(urls, "; ").alias("document_urls"))


def families(controls: DataFrame, family_codes: list[str]) -> DataFrame:
    """Controls with their resolved family and sort key."""
    return controls.withColumns({
        "family": resolved_family(family_codes), "sort_key": first_filled("external_id", "name"),
    })


def control_order(controls: DataFrame) -> DataFrame:
    """Controls of ``families`` with ``position`` in their family and ``family_no``, both from 0."""
    return positions(laid_out(controls, ["family", "sort_key", "id"]), within=["family"], number="family_no")


def skeleton_lines(controls: DataFrame, family_names: DataFrame, existing: DataFrame | None = None,
                   overwrite: bool = False) -> DataFrame:
    """Lines of the requirement files: (family, sort_key, id, line_no, line).

    ``family_names`` holds (family, display_name); families in ``existing`` are
    left out unless ``overwrite``.  Lines stay rows: a family's file is written
    from rows sorted by (family, sort_key, id, line_no), never gathered.
    """
    df = controls if overwrite or existing is None else controls.join(existing.select("family"), "family", "left_anti")
    named = df.select("family").distinct().join(family_names, "family", "left")
    heads = named.select(
        "family", F.lit("").alias("sort_key"), F.lit("").alias("id"),
        F.posexplode(F.array(
            F.concat(F.lit("# "), "family", F.lit(" - "), F.coalesce("display_name", "family")), F.lit(""))).alias("line_no", "line"))
    eid = F.coalesce("external_id", F.lit(""))
    body = df.select(
        "family", "sort_key", "id",
        F.posexplode(F.array(
            strip(F.concat(F.lit("## "), eid, F.lit(" "), control_title())), F.lit(V.REQUIREMENT_PLACEHOLDER), F.lit(""),
        )).alias("line_no", "line"))
    return heads.unionByName(body)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Range-partitioned by file and position, so large families are split over tasks."""
    order = ["family", "sort_key", "id", "line_no"]
    return lines.repartitionByRange(*order).sortWithinPartitions(*order)


