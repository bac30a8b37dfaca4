"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are rounded to integers. In each shard every component has a list of the shard's
rows by value, cut into segments. A query multiplies a segment's best value by its own
component: the segment's impact. Segments are taken by descending impact, whatever their
component, and add their impact to the rows they list. What a row can still gain is bounded
by the best impacts still waiting, so rows that can't reach the k-th best exact score are out
on proof; the others are scored exactly. A few queries share one pass over the segments. Queries meet shards in blocks of bounded size.

Vectors that are null or hold null or non-finite components take no part. Vectors of
different lengths aren't compared. Rows that share a query's id count as its own. A repeated
id asks once, with the smallest of its vectors, and is a candidate as often as it occurs;
a null id is a candidate, after equal scores with ids, and asks nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS, BLOCK_QUERIES, TOGETHER = 16_384, 4_096, 64
SEGMENTS, CHECKS = 8, 4
#: A proof is good enough once at most this share of a shard is left to score exactly.
LEFT_SHARE = 4
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def number_kind(largest: float, dims: int) -> type:
    """The fastest type in which sums of products of such integers are exact."""
    most = 2 * dims * largest**2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class ImpactIndex:
    """Rows of a shard by value in each component, in segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, self.dims = vectors.shape
        order = np.argsort(-vectors, axis=0, kind="stable")
        edges = np.unique(np.linspace(0, n, min(SEGMENTS, n) + 1).astype(int))
        self.rows = [order[a:b, d] for d in range(self.dims) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        ranked = np.take_along_axis(vectors, order, axis=0)
        self.high, self.low = ranked[edges[:-1]].T, ranked[edges[1:] - 1].T  # dims x segments

    def top(self, queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and exact scores of the k best, ties to the smaller id.

        The queries go through the segments together, by the highest impact that a segment has for any of them.
        """
        kind = number_kind(float(max(np.abs(self.vectors).max(), np.abs(queries).max())), self.dims)
        n, exact, wanted = len(self.vectors), self.vectors.astype(kind), queries.astype(kind).T
        segments = self.high.shape[1]
        impact = np.maximum(self.high[:, :, None] * queries.T[:, None, :], self.low[:, :, None] * queries.T[:, None, :]).astype(kind)
        order = np.argsort(-impact.max(axis=2), axis=None, kind="stable")
        gained = np.zeros((n, len(queries)), dtype=kind)
        unseen = np.ones((n, self.dims), dtype=kind)
        waiting = np.ones((self.dims, segments), dtype=bool)
        least = kind(-(2**24)) if kind is np.float32 else kind(-(2**60))
        own = [np.flatnonzero(ids == q) for q in query_ids]
        some = min(n, 4 * k + max((len(o) for o in own), default=0))
        for step in np.array_split(order, CHECKS):
            for at in step.tolist():
                d, segment = divmod(at, segments)
                rows = self.rows[at]
                gained[rows] += impact[d, segment]
                unseen[rows, d] = 0
                waiting[d, segment] = False
            # no row gains more from a component that it waits for than the best impact still waiting there
            ahead = np.where(waiting[:, :, None], impact, least).max(axis=1)
            bound = gained + unseen @ np.where(ahead == least, 0, ahead)
            left = []
            for j, mine in enumerate(own):
                column = bound[:, j]
                column[mine] = least
                best = np.argpartition(-column, some - 1)[:some]
                best = best[column[best] > least]
                reach = np.sort(exact[best] @ wanted[:, j])[-k] if len(best) >= k else least + 1
                left.append(np.flatnonzero((column >= reach) & (column > least)))
            if not waiting.any() or max(map(len, left)) * LEFT_SHARE <= n:
                break
        found = []
        for j, rows in enumerate(left):
            scores = (exact[rows] @ wanted[:, j]).astype(np.int64)
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((rows[best], scores[best]))
        return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every query; both tables have vec_id and embedding."""
    rounded = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", rounded.alias("values"))
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", rounded.alias("values")).groupBy("vec_id").agg(F.min("values").alias("values"))
    n_rows, n_asked = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_asked // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.size("values").alias("dims"), F.pmod(F.xxhash64("vec_id", "values"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "values")
    right = asked.select(F.size("values").alias("dims"), every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), F.col("values").alias("wanted"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index, ids = ImpactIndex(np.array(left["values"].to_list(), dtype=np.int64)), left["vec_id"].to_numpy(np.int64)
            asked, wanted = right["query_id"].to_numpy(np.int64), np.array(right["wanted"].to_list(), dtype=np.int64)
            # like queries together: by the component that counts most for them
            order = np.argsort(np.abs(wanted).argmax(axis=1), kind="stable")
            for part in np.array_split(order, -(-len(order) // TOGETHER)):
                for query_id, (at, scores) in zip(asked[part], index.top(wanted[part], ids, asked[part], k), strict=True):
                    out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dims", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


def top_vectors(embeddings: DataFrame) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"), 5)
