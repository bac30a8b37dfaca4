"""Merkle manifest of a dataset: a content-addressed store of digests, and proofs by descent through it.

Each row is a leaf, the digest of its encoded columns. The leaves of a source stand in the
order of their ids; every 16 consecutive nodes become the digest of their digests until one
is left, the subroot; subroots in the order of sources give the root in the same way. Equal
subtrees have equal digests, so the store holds each of them once, as ``digest -> children``.

A proof starts at the root. The place of a leaf, written in digits of 16, says which child to
take at each level; the children not taken are its siblings there. Requests that go the same
way go together: one row per node asked for, never one per leaf and level, so the root is read
once whatever the number of requests. Segments are collected from the root down and reversed
at the end.

Rules for odd input: a null column is encoded as ``-``, also a null id. Rows without id come
first in their source, rows without source are the first source. Rows of one id stand in the
order of their digests; equal rows are leaves of their own, and as many of them come back. An
empty table has no root and no rows. Only the columns named are read, so extra columns and
their names do not matter.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.crc_sql import CRC_TABLE_SQL, crc_sql
from attestry.llm.shared import shared_folder, stored
from attestry.operators.positions import laid_out, positions

FAN_BITS = 4
FAN = 1 << FAN_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The digest of a row's columns; ``instead`` replaces a column by an expression."""
    return sha(*(encoded(instead.get(f, F.col(f))) for f in fields))


@dataclass
class Manifest:
    """``low`` and ``high``: store records digest -> children by height, inside sources and above them.

    ``subroots``: tree (place of the source), n (leaves), depth, digest. ``root``: null for an empty table.
    """

    low: list[DataFrame]
    high: list[DataFrame]
    subroots: DataFrame
    root: str | None


def levels_above(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _raise(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Store records of every height over ``nodes`` (tree, place, n, digest), and the last node of each tree."""
    store, last = [], nodes.where("n = 1")
    for height in range(1, levels_above(most) + 1):
        runs = nodes.where("n > 1").groupBy("tree", F.shiftright("place", FAN_BITS).alias("place")).agg(
            F.ceil(F.max("n") / FAN).cast("long").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest")))["digest"].alias("children"))
        nodes = stored(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"manifest-{height}")
        store.append(nodes.groupBy("digest").agg(F.first("children").alias("children")))
        last = last.select("tree", "digest", "n").unionByName(nodes.where("n = 1").select("tree", "digest", "n"))
    return store, last.select("tree", "digest")


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves (source, doc_id, leaf, ...) with ``tree``, the place of their source, ``place`` in it and ``n``, its leaves; stored."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    return stored(positions(laid_out(leaves, order), "place", ["source"], size="n", number="tree"), "placed")


def build(placed: DataFrame) -> Manifest:
    """The manifest of placed leaves."""
    sizes = placed.groupBy("tree").agg(F.max("n").alias("n"))
    most, trees = sizes.agg(F.max("n"), F.count("*")).first()
    low, last = _raise(placed.select("tree", "place", "n", F.col("leaf").alias("digest")), most or 0)
    depth = sum(((F.col("n") > FAN**d).cast("int") for d in range(levels_above(most or 0))), F.lit(0))
    subroots = stored(last.join(sizes, "tree").select("tree", "n", depth.alias("depth"), "digest"), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "digest")
    high, top = _raise(tops, trees)
    return Manifest(low, high, subroots, top.first()["digest"] if trees else None)


def _segment(children: Column, digit: Column) -> Column:
    """The siblings left and right of the child taken."""
    left = F.array_join(F.slice(children, F.lit(1), digit), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("right"))


def _step(state: DataFrame, level: DataFrame, asked: DataFrame) -> DataFrame:
    """One level down: look up the children of each node, take those asked for, collect the others."""
    met = state.join(level, "digest").select("tree", "place", "subroot", "path", "children", F.posexplode("children").alias("digit", "child"))
    down = met.select(
        "tree", (F.col("place") * FAN + F.col("digit")).alias("place"), "subroot", F.col("child").alias("digest"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
    return down.join(asked, ["tree", "place"], "left_semi")


def _asked(requests: DataFrame, heights: int) -> list[DataFrame]:
    """The nodes on the way of some request, by height from 1 on."""
    out = []
    for height in range(1, heights + 1):
        requests = requests.select("tree", F.shiftright("place", FAN_BITS).alias("place")).distinct()
        requests = stored(requests, "asked") if height == 1 else requests
        out.append(requests)
    return out


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Each request with ``subroot``, ``root`` and ``path``: its siblings from its own level up to the root.

    ``requests`` are rows with ``tree`` and ``place``, of any part of the leaves, with other columns at will.
    """
    spark, root, low, high = requests.sparkSession, manifest.root, manifest.low, manifest.high
    none = F.array().cast("array<struct<left:string,right:string>>")
    if root is None:
        return requests.withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "path": none})
    asked = _asked(requests, len(low))
    trees = (asked[0] if asked else requests).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place")).distinct()
    ways = [trees, *_asked(trees, len(high))]
    state = spark.createDataFrame([(0, 0, root)], "tree bigint, place bigint, digest string")
    state = state.withColumns({"subroot": F.lit(None).cast("string"), "path": none})
    for height in range(len(high), 0, -1):
        state = _step(state, high[height - 1], ways[height - 1])
    state = state.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot"), "digest", "path")
    roots = stored(state.join(manifest.subroots.select("tree", "depth"), "tree"), "at-subroots")
    state = None
    for height in range(len(low), 0, -1):  # shallow sources join in at their height
        starts = roots.where(F.col("depth") == height).drop("depth")
        state = state.unionByName(starts) if state else starts
        if height > 1:
            state = stored(_step(state, low[height - 1], asked[height - 2]), f"descent-{height}")
    # A source with one leaf has no levels. Elsewhere a request meets its parent, and its path is unfolded only where it is used.
    found = requests.where("place = 0").join(roots.where("depth = 0").select("tree", "subroot", "path"), "tree").select(*requests.columns, "subroot", "path")
    if state:
        parents = state.join(low[0], "digest").select("tree", F.col("place").alias("__parent"), "subroot", "path", "children")
        met = requests.withColumn("__parent", F.shiftright("place", FAN_BITS)).join(parents, ["tree", "__parent"])
        digit = (F.col("place") % FAN).cast("int")
        found = met.select(*requests.columns, "subroot", F.concat("path", F.array(_segment(F.col("children"), digit))).alias("path")).unionByName(found)
    return found.withColumns({"root": F.lit(root), "path": F.reverse("path")})


def proof_text(path: str = "path") -> Column:
    """The siblings, left to right and level by level from the leaf up."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda low, s: F.sha2(F.concat(s["left"], low, s["right"]), 256))


def verified_documents(documents: DataFrame) -> DataFrame:
    """Every document with its proof, checked against the root after some texts were tampered with."""
    shared_folder(documents.sparkSession)  # sets a folder where none is named, as in tests
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = documents.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(touched, leaf_digest(text=lowered)).alias("tampered"))
    placed = placed_leaves(stored(leaves, "leaves"))
    proofs = prove(build(placed), placed.select("tree", "place", "doc_id", "leaf", "tampered"))
    out = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _digest_sql(text: str = "text") -> str:
    """The leaf digest in SQL."""
    fields = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _sides_sql(keys: str) -> str:
    """Siblings before and after a node in its run."""
    run = f"OVER (PARTITION BY {keys}, lvl, place // 16 ORDER BY place ROWS BETWEEN"
    return (f"coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
            f"coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after")


PROOFS_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (
  SELECT doc_id, source, {_digest_sql()} AS leaf,
    CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_digest_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
low AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, lvl, place // 16),
subroots AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, tree AS place, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY lvl, place // 16),
steps AS (
  SELECT id, lvl, before, after FROM placed JOIN (SELECT tree AS t, lvl, place AS p, n AS m, {_sides_sql("tree")} FROM low) ON t = tree AND p = place >> (4 * lvl) WHERE m > 1
  UNION ALL
  SELECT id, 100 + lvl, before, after FROM placed JOIN (SELECT lvl, place AS p, n AS m, {_sides_sql("1")} FROM high) ON p = tree >> (4 * lvl) WHERE m > 1),
way AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY lvl) AS k, before, after FROM steps),
fold AS (
  SELECT id, 0 AS k, coalesce(tampered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.id, w.k, sha256(w.before || f.digest || w.after) FROM fold f JOIN way w ON w.id = f.id AND w.k = f.k + 1),
last AS (SELECT id, arg_max(digest, k) AS folded_root FROM fold GROUP BY id),
proof AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY k)) AS h FROM way GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, coalesce(h, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM placed JOIN last USING (id) LEFT JOIN proof USING (id) JOIN subroots s USING (tree), (SELECT digest FROM high WHERE n = 1) r
"""
