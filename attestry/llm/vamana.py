"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Every distinct vector is a node. Nodes join in growing batches: a greedy beam search over the
graph so far proposes neighbours, relaxed distance pruning keeps diverse ones among them, and
edges back are pruned alike. A query walks every shard's graph by beam search; what it finds
is scored in double precision and merged. Inner product becomes distance by one more
component that gives all vectors the same length. Graphs are built by what that component
falls short of the largest length, which rounding spares however large that is; queries go by
the inner product itself and start also at the longest vectors, which few edges may reach.

Equal vectors are one node that carries the smallest ids of its class, as many as a query can
ask for, so copies neither fill neighbour lists nor hide each other.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of
different lengths aren't compared. Rows that share a query's id count as its own; a repeated id
asks once, with the smallest of its vectors. A null id neither asks nor is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from attestry.llm.impacts import usable
from attestry.llm.shared import stored

SHARD_NODES, BLOCK_QUERIES, SALTS = 8_192, 4_096, 16
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, AT_ONCE = 32, 64, 96, 1.2, 4
FIRST_BATCH, LARGEST_BATCH, LONGEST = 128, 512, 31


def _distances(points: np.ndarray, norms: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own norm, of listed points (rows x list) to their row's query; -1 is far away."""
    far = norms[at] - 2 * np.einsum("qrd,qd->qr", points[at], wanted)
    return np.where(at < 0, np.float32(np.inf), far)


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, entries: np.ndarray, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest points found, nearest first (-1 pads), and their distances. With norms of 0 the largest inner products."""
    q, entries = len(wanted), entries[:width]
    beam = np.full((q, width), -1, dtype=np.int64)
    far = np.full((q, width), np.inf, dtype=np.float32)
    begin = norms[entries] - 2 * wanted @ points[entries].T
    order = np.argsort(begin, axis=1, kind="stable")
    beam[:, : len(entries)], far[:, : len(entries)] = entries[order], np.take_along_axis(begin, order, axis=1)
    done = np.zeros((q, width), dtype=bool)
    rows = np.arange(q)
    while len(rows):
        todo = (beam[rows] >= 0) & ~done[rows]
        active = todo.any(axis=1)
        rows, todo = rows[active], todo[active]
        if not len(rows):
            break
        turn = np.argsort(~todo, axis=1, kind="stable")[:, :AT_ONCE]
        real = np.take_along_axis(todo, turn, axis=1)
        done[rows[:, None], turn] |= real
        nodes = np.where(real, np.take_along_axis(beam[rows], turn, axis=1), -1)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        own = np.sort(beam[rows], axis=1)
        # what the beam holds already, by a search in one flat ascending array
        shift = np.arange(len(rows))[:, None] * (len(points) + 1)
        flat = (own + 1 + shift).ravel()
        key = near + 1 + shift
        near[flat[np.minimum(np.searchsorted(flat, key), len(flat) - 1)] == key] = -1
        fresh = _distances(points, norms, near, wanted[rows])
        every, dist = np.concatenate((beam[rows], near), axis=1), np.concatenate((far[rows], fresh), axis=1)
        flags = np.concatenate((done[rows], np.zeros(near.shape, dtype=bool)), axis=1)
        best = np.argsort(dist, axis=1, kind="stable")[:, :width]
        beam[rows], far[rows], done[rows] = (np.take_along_axis(x, best, axis=1) for x in (every, dist, flags))
        beam[rows] = np.where(np.isinf(far[rows]), -1, beam[rows])
    return beam, far


def longest(norms: np.ndarray) -> np.ndarray:
    return np.argsort(-norms, kind="stable")[:LONGEST]


def robust_prune(points: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Diverse neighbours of each node from its list: a candidate goes once a kept one is nearer to it, times ``RELAX``, than the node."""
    near = np.where(near == nodes[:, None], -1, near)
    # as seen from the node, so that a kept one is no farther than what it is compared with and rounding is small against that
    vectors = points[near] - points[nodes][:, None]
    size = np.einsum("qrd,qrd->qr", vectors, vectors)
    dist = np.where(near < 0, np.float32(np.inf), size)
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist, size = (np.take_along_axis(x, order, axis=1) for x in (near, dist, size))
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    alive, rows = near >= 0, np.arange(len(nodes))
    out = np.full((len(nodes), DEGREE), -1, dtype=np.int64)
    for k in range(DEGREE):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, k] = near[rows, pick][some]
        apart = size + size[rows, pick][:, None] - 2 * np.einsum("qrd,qd->qr", vectors, vectors[rows, pick])
        alive &= ~((RELAX**2 * apart <= dist) & some[:, None])
        alive[rows, pick] = False
    return out


class PrunedGraph:
    """A graph over the points of one shard. ``first`` are points that searches start at besides the entry."""

    def __init__(self, points: np.ndarray, first: np.ndarray):
        n = len(points)
        self.points = points.astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.points, self.points)
        self.edges = np.full((n, DEGREE), -1, dtype=np.int64)
        center = self.points.mean(axis=0)
        self.entry = int((self.norms - 2 * self.points @ center).argmin()) if n else 0
        order = np.random.default_rng(7).permutation(n)
        self.entries = np.unique(np.append(first, self.entry)) if n else np.zeros(0, np.int64)
        order = np.concatenate((self.entries, order[~np.isin(order, self.entries)]))
        first = order[:FIRST_BATCH]
        if len(first):
            self._add(first, np.broadcast_to(first, (len(first), len(first))))
        at = len(first)
        while at < n:
            batch = order[at : at + min(at, LARGEST_BATCH)]
            found, _ = beam_search(self.points, self.norms, self.edges, self.entries, self.points[batch], BUILD_BEAM)
            self._add(batch, found)
            at += len(batch)

    def _add(self, nodes: np.ndarray, near: np.ndarray) -> None:
        kept = robust_prune(self.points, nodes, near)
        self.edges[nodes] = kept
        source, target = np.repeat(nodes, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        into, first, number = np.unique(target, return_index=True, return_counts=True)
        # targets with few and with many new edges apart, so that padding stays small
        for few in (number <= DEGREE, number > DEGREE):
            for part in np.array_split(np.flatnonzero(few), max(1, int(few.sum()) // LARGEST_BATCH)):
                if len(part):
                    wide = np.full((len(part), int(number[part].max())), -1, dtype=np.int64)
                    lane = np.concatenate([np.arange(c) for c in number[part]])
                    wide[np.repeat(np.arange(len(part)), number[part]), lane] = source[np.repeat(first[part], number[part]) + lane]
                    self._back(into[part], np.concatenate((self.edges[into[part]], wide), axis=1))

    def _back(self, nodes: np.ndarray, near: np.ndarray) -> None:
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        full = (near >= 0).sum(axis=1) > DEGREE
        self.edges[nodes[~full]] = near[~full][:, :DEGREE]
        if full.any():
            self.edges[nodes[full]] = robust_prune(self.points, nodes[full], near[full])


def _valid(frame: DataFrame) -> DataFrame:
    zero = ~F.exists("embedding", lambda x: x != 0)
    return frame.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).where(~zero).select("vec_id", "embedding")


def build(vectors: DataFrame, k: int) -> DataFrame:
    """The stored index: a row for each distinct vector with its shard, place, ids and edges."""
    rows = _valid(vectors)
    share = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("__place", F.row_number().over(share)).where(F.col("__place") <= k + 1)
    nodes = few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    nodes = nodes.withColumn("norm", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    nodes = stored(nodes, "nodes")
    n, largest = nodes.agg(F.count("*"), F.max("norm")).first()
    shards = max(1, -(-n // SHARD_NODES))
    placed = nodes.select(F.size("embedding").alias("dims"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "embedding", "ids", "norm")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        points = np.array(part["embedding"].to_list(), dtype=np.float64)
        norm = part["norm"].to_numpy()
        short = norm / (np.sqrt(largest) + np.sqrt(np.maximum(largest - norm, 0)))
        graph = PrunedGraph(np.column_stack([points, short]), longest(norm))
        return part[["dims", "shard", "embedding", "ids"]].assign(place=np.arange(len(part)), entry=graph.entry, edges=[e[e >= 0].tolist() for e in graph.edges])

    return stored(placed.groupBy("dims", "shard").applyInPandas(run, "dims int, shard int, embedding array<float>, ids array<bigint>, place bigint, entry bigint, edges array<bigint>"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for every query."""
    asked = _valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("wanted"))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", every(blocks))
    right = asked.select(F.size("wanted").alias("dims"), every(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), "wanted")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("place")
            exact = np.array(left["embedding"].to_list(), dtype=np.float64)
            points = exact.astype(np.float32)
            entries = np.unique(np.append(longest(np.einsum("nd,nd->n", exact, exact)), left["entry"].iloc[0]))
            norms, edges = np.zeros(len(points), dtype=np.float32), np.full((len(left), DEGREE), -1, dtype=np.int64)
            for k_, e in enumerate(left["edges"]):
                edges[k_, : len(e)] = e
            ids, asked_ids = left["ids"].to_list(), right["query_id"].to_numpy()
            wanted = np.array(right["wanted"].to_list(), dtype=np.float64)
            for a in range(0, len(wanted), LARGEST_BATCH):
                part = wanted[a : a + LARGEST_BATCH]
                found, _ = beam_search(points, norms, edges, entries, part.astype(np.float32), beam)
                for j, nodes in enumerate(found):
                    nodes, own = nodes[nodes >= 0], asked_ids[a + j]
                    scores = (exact[nodes] * part[j]).sum(axis=1)
                    rows = [(s, v) for s, at in zip(scores.tolist(), nodes.tolist(), strict=True) for v in ids[at] if v != own]
                    rows.sort(key=lambda r: (-r[0], r[1]))
                    out += [(own, v, s) for s, v in rows[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dims", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score double").dropDuplicates(["query_id", "vec_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The twenty nearest found for every row whose id is divisible by 20."""
    return search(build(embeddings, 20), embeddings.where("vec_id % 20 = 0"), 20)
