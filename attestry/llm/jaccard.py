"""N-gram Jaccard join by prefixes under several global token orders.

Two sets that reach the threshold share a token among the first few of each, under any
order that holds for all sets. Candidates come from an order that puts tokens seen often
last; those that share no prefix token under one of two hashed orders go, before any whole
set is fetched. Only what is left under all three is verified exactly. Equal sets are one
node from the start.

Prefixes are taken a little longer than that, so that linked sets share several tokens
there; documents that share only a passage with others drop out by this alone.

Links only matter up to connection, so a bucket of nodes that share a token first meets its
smallest node. What that connects needs no more comparison inside the bucket. Small buckets
then compare the nodes of different components; large ones compare, in blocks, the nodes
outside the bucket's main component with all others, by their prefixes under all three orders
first. So every pair that could link two components is verified, and no group is expanded into
all its pairs.

A node is named by a hash of its set. Sets with the name of another set are told apart by a second
hash and named anew, so no two sets of 10^10 are taken for one.

Words are runs of bytes other than space and tab to carriage return, A to Z lower-cased. A
text with fewer words than a shingle is one shingle; one without words, or null, has none and
is linked with nothing. Rows equal in doc_id and text count as one document. A null doc_id
takes part but never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.graph import components
from attestry.llm.shared import discard, lean, stored
from attestry.llm.words import Words, groups, mix, ngram_hashes, text_bytes

#: Tokens counted together, the count from which a token is told of, and how many such tokens (the most frequent) the order knows.
#: By twos, a token of d sets is told of some d * d / 2 / stretches times, so what stays unknown grows with the root of the table only.
COUNTED_TOGETHER, OFTEN, KNOWN_TOKENS = 2_000_000, 2, 1_000_000
HANDED_ON = 1_000_000
SMALL_BUCKET, BLOCK_NODES = 32, 256
#: Blocks on a side up to which a block holds BLOCK_NODES, and the tokens that one of more blocks holds.
FEW_BLOCKS, BLOCK_TOKENS = 8, 1_000_000
#: Prefixes are longer by this share of the set, so that linked sets have to share as many tokens there.
EXTRA_PERCENT = 7
#: Rows up to which a list of documents is sent to all executors instead of shuffling the texts.
SENT_ROWS = 1_000_000
_ORDERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93))
#: Columns of prefixes: the order of the candidates, then the hashed orders.
HEADS = ("head_often", "head_hashed", "head_again")
NODE_BITS = 63


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    grams = ngram_hashes(hashes, n)
    for first, count in zip(words.first[:-1], words.count, strict=True):
        if count >= n:
            yield np.unique(grams[first : first + count - n + 1])
        elif count:
            yield mix(ngram_hashes(hashes[first : first + count], int(count)) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)


def _text_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for a, b in groups(offsets):
        yield from shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def needed(n: int, percent: int) -> int:
    """Common tokens that a link needs of a set of ``n``."""
    return (percent * n + 99) // 100


def prefix_size(n: int, percent: int, shared: int = 1) -> int:
    """So many first tokens hold ``shared`` common ones with any linked set whose prefix is taken so too."""
    return n - needed(n, percent) + shared


def shared_in_prefix(n: int) -> int:
    """Common tokens that the prefix of a set of ``n`` is made long enough for."""
    return max(1, EXTRA_PERCENT * n // 100)


class Order:
    """The global order of the candidates: tokens seen often last, else by hash."""

    def __init__(self, tokens: np.ndarray, seen: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.seen = tokens[at], seen[at]

    def prefix(self, found: np.ndarray, percent: int) -> np.ndarray:
        """The first tokens of a set, some more than a link needs."""
        size = prefix_size(len(found), percent, shared_in_prefix(len(found))) if len(found) else 0
        if not len(self.tokens):
            return found[:size]
        at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
        seen = np.where(self.tokens[at] == found, self.seen[at], 0)
        return found[np.argsort(seen, kind="stable")[:size]] if seen.any() else found[:size]


def often_seen(documents: DataFrame, n: int) -> Order:
    """Tokens that stand in several sets of some stretch of the input, with their counts there; whatever it finds, results are the same.

    Equal sets of a stretch count once, as they are one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens, number = np.unique(np.concatenate(held), return_counts=True)
            kept = number >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(tokens[kept].view(np.int64)), pa.array(number[kept])], ["token", "seen"])

        for batch in batches:
            for found in _text_sets(batch.column(0), n):
                name = set_hash(found)
                if name in known:
                    continue
                known.add(name)
                held.append(found)
                size += len(found)
                if size >= COUNTED_TOGETHER:
                    yield counted()
                    held, size, known = [], 0, set()
        if held:
            yield counted()

    counts = documents.select("text").mapInArrow(lean(run), "token bigint, seen bigint").groupBy("token").agg(F.sum("seen").alias("seen"))
    rows = counts.where(F.col("seen") > OFTEN).orderBy(F.desc("seen"), "token").limit(KNOWN_TOKENS).toPandas()
    return Order(rows["token"].to_numpy(np.int64).view(np.uint64), rows["seen"].to_numpy(np.int64))


def set_hash(found: np.ndarray, bits: int = NODE_BITS) -> int:
    return int(mix(found).sum(dtype=np.uint64)) & (1 << bits) - 1


def set_check(found: np.ndarray) -> int:
    """A second hash of a set."""
    return int(np.bitwise_xor.reduce(mix(found * _ORDERS[0]))) >> 1 if len(found) else 0


@dataclass(frozen=True)
class Names:
    """Names of sets: the hash, or a number below zero where another set has that hash."""

    bits: int
    moved: dict[tuple[int, int], int] = field(default_factory=dict)

    @cached_property
    def shared(self) -> set[int]:
        return {node for node, _ in self.moved}

    def of(self, found: np.ndarray) -> int:
        node = set_hash(found, self.bits)
        return self.moved.get((node, set_check(found)), node) if node in self.shared else node


def _named(described: DataFrame, bits: int) -> tuple[DataFrame, Names]:
    """Nodes under names that differ for different sets.

    All sets of one hash but one are listed to be named anew: about N * N / 2^64 of N sets, five of 10^10.
    """
    sets = described.where("n_shingles > 0")
    clash = sets.groupBy("node").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first < last").drop("last")
    rows = sets.join(clash, "node").where("check > first").select("node", "check").distinct().collect()
    moved = {(r["node"], r["check"]): -k for k, r in enumerate(sorted(rows), 1)}
    if moved:
        new = described.sparkSession.createDataFrame([(*key, name) for key, name in moved.items()], "node bigint, check bigint, name bigint")
        described = described.join(new, ["node", "check"], "left").withColumn("node", F.coalesce("name", "node")).drop("name")
        described = stored(described, "named")
    return described, Names(bits, moved)


def _described(documents: DataFrame, n: int, bits: int) -> DataFrame:
    """doc_id, row (a key of doc_id and text), n_shingles, node and check (two hashes of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, checks = [], [], []
            for found in _text_sets(batch.column(2), n):
                sizes.append(len(found))
                nodes.append(set_hash(found, bits))
                checks.append(set_check(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.int64()) for x in (sizes, nodes, checks))], ["doc_id", "row", "n_shingles", "node", "check"])

    return documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(lean(run), "doc_id bigint, row bigint, n_shingles bigint, node bigint, check bigint")


def _prefix_tokens(documents: DataFrame, names: Names, order: Order, n: int, percent: int) -> DataFrame:
    """token and node for every token in the prefix of a document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes, size = [], [], 0
            for found in _text_sets(batch.column(0), n):
                tokens.append(order.prefix(found, percent).view(np.int64))
                nodes.append(np.full(len(tokens[-1]), names.of(found)))
                size += len(tokens[-1])
                if size > HANDED_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], ["token", "node"])
                    tokens, nodes, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return documents.select("text").mapInArrow(lean(run), "token bigint, node bigint")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """token and node, once each, of tokens that two nodes or more have; a few tokens of one node may stay.

    Rows are sorted by token and node over the whole table, so a frequent token spreads over partitions. A
    partition drops tokens that only one node has, but for its first and last, which may go on elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_token = held_node = np.zeros(0, np.int64)
        first, held_kept = None, False
        for batch in batches:
            token = np.concatenate((held_token, batch.column(0).to_numpy(zero_copy_only=False)))
            node = np.concatenate((held_node, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(token):
                continue
            first = token[0] if first is None else first
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
            token, node = token[fresh], node[fresh]
            same = token[1:] == token[:-1]
            kept = np.concatenate(([held_kept], same)) | np.concatenate((same, [False])) | (token == first)
            if len(token) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(token[:-1][kept[:-1]]), pa.array(node[:-1][kept[:-1]])], ["token", "node"])
            held_token, held_node, held_kept = token[-1:], node[-1:], bool(kept[-1])
        if len(held_token):
            yield pa.RecordBatch.from_arrays([pa.array(held_token), pa.array(held_node)], ["token", "node"])

    return rows.repartitionByRange("token", "node").sortWithinPartitions("token", "node").mapInArrow(lean(run), "token bigint, node bigint")


def _reserve(n: Column) -> Column:
    """``shared_in_prefix`` as a column."""
    return F.greatest(F.lit(1), F.floor(F.lit(EXTRA_PERCENT) * n / 100))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets are near enough in size."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _buckets(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """token, node, n, size and lead of the tokens that still connect nodes; n is the set's size, lead the smallest node with its n.

    A node with a link shares at least as many prefix tokens with one other node as the smallest set that it
    can be linked with has in reserve. Nodes that share fewer with all others together have no link and go;
    this is done twice, since their going leaves other tokens alone.
    """
    turns = []
    for turn in ("first", "second"):
        wide = rows.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
        rows = rows.select("token", "node").join(wide, "token")
        good = rows.groupBy("node").agg(F.count("*").alias("shared")).join(sizes, "node")
        good = good.where(F.col("shared") >= _reserve(F.floor((F.lit(percent) * F.col("n") + 99) / 100))).select("node", "n")
        rows = stored(rows.join(good, "node"), f"buckets-{turn}")
        turns.append(rows)
    wide = rows.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("lead")).where("size > 1")
    buckets = stored(rows.join(wide, "token"), "buckets")
    discard(*turns)
    return buckets


def _star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Nodes with the smallest node of their buckets, where they share enough of them; the other pairs come later."""
    pairs = buckets.where("node <> lead.node").groupBy(F.col("lead.node").alias("x"), F.col("node").alias("y"))
    pairs = pairs.agg(F.count("*").alias("shared"), F.min("lead.n").alias("n_x"), F.min("n").alias("n_y"))
    return pairs.where((F.col("shared") >= F.least(_reserve(F.col("n_x")), _reserve(F.col("n_y")))) & _may_link("n_x", "n_y", percent)).select("x", "y")


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that share a small bucket and, with what large ones may add, enough buckets."""
    large = rows.where(F.col("size") > SMALL_BUCKET).groupBy("node").agg(F.count("*").alias("more"))
    small = rows.where(F.col("size") <= SMALL_BUCKET).join(large, "node", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    small = small.groupBy("token").agg(F.collect_list(F.struct("node", "component", "n", "more")).alias("all"))
    pairs = small.select(F.explode("all").alias("p"), "all").select("p", F.explode(F.filter("all", lambda q: (q["node"] > F.col("p.node")) & (q["component"] != F.col("p.component")))).alias("q"))
    pairs = pairs.where(_may_link("p.n", "q.n", percent)).groupBy(F.col("p.node").alias("x"), F.col("q.node").alias("y")).agg(
        F.count("*").alias("shared"), F.min(F.least("p.more", "q.more")).alias("more"), F.min(F.least(_reserve(F.col("p.n")), _reserve(F.col("q.n")))).alias("least"))
    return pairs.where(F.col("shared") + F.col("more") >= F.col("least")).select("x", "y")


def _heads(found: np.ndarray, order: Order, percent: int) -> list[np.ndarray]:
    """32 bits of each prefix token of a set, under the order of the candidates and the hashed orders."""
    size = prefix_size(len(found), percent)
    firsts = [order.prefix(found, percent), *(np.partition(mix(found ^ o), size - 1)[:size] for o in _ORDERS)]
    return [np.unique(f.astype(np.uint32).view(np.int32)) for f in firsts]


def _node_sets(documents: DataFrame, described: DataFrame, nodes: DataFrame, names: Names, order: Order, n: int, percent: int) -> DataFrame:
    """node, its prefixes under all orders (``HEADS``) and set (its hashes as bytes) of the given nodes, from one document of each."""
    known = described.where("n_shingles > 0")
    rows = known.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    chosen = stored(rows, "nodes")
    repeated = known.groupBy("row").count().where("count > 1").join(chosen, "row", "left_semi").limit(1).count()
    rows = F.broadcast(chosen) if chosen.count() <= SENT_ROWS else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            heads = [pa.array([f[k] for f in firsts], pa.list_(pa.int32())) for k in range(len(HEADS))]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), *heads, pa.array(sets, pa.binary())], ["node", *HEADS, "set"])

        for batch in batches:
            kept, sets, firsts, size = [], [], [], 0
            for node, found in zip(batch.column(0).to_pylist(), _text_sets(batch.column(1), n), strict=True):
                if len(found) and names.of(found) == node:  # another text of the same row hash is not that node
                    kept.append(node)
                    sets.append(found.tobytes())
                    firsts.append(_heads(found, order, percent))
                    size += len(found)
                if size > HANDED_ON:
                    yield told()
                    kept, sets, firsts, size = [], [], [], 0
            yield told()

    found = documents.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(rows, "row")
    types = ", ".join(["node bigint", *(f"{h} array<int>" for h in HEADS), "set binary"])
    sets = found.select("node", "text").mapInArrow(lean(run), types)
    sets = stored(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    discard(chosen)
    return sets


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the threshold, counted exactly."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _under_all_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates x, y (found under the first order) whose prefixes share a token under each hashed order too."""
    for side in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), *(F.col(h).alias(f"{side}_{h}") for h in HEADS[1:])), side)
    for h in HEADS[1:]:
        pairs = pairs.where(F.arrays_overlap(f"x_{h}", f"y_{h}"))
    return pairs.select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs x, y whose sets are linked: prefixes first, whole sets of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k) for k in (2, 3))
            good = [linked(np.frombuffer(x[k].as_py(), np.uint64), np.frombuffer(y[k].as_py(), np.uint64), percent) for k in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = _under_all_orders(pairs, sets)
    for side in ("y", "x"):
        both = both.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    return both.select("x", "y", "set_x", "set_y").mapInArrow(lean(run), "x bigint, y bigint")


def _labelled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with the component of their node, of buckets that hold more than one."""
    found = stored(components(links), "components")
    told = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = told.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    rows = stored(told.join(split, "token"), "open-buckets")
    discard(found)
    return rows


def _blocks(nodes: Column, tokens: Column) -> Column:
    """How many blocks nodes with so many tokens are dealt to.

    Each node goes to every block of the other side, so their number is what a crowd is copied by: past the first
    few, there are only as many as keep a block in bounds.
    """
    return F.greatest(F.least(F.ceil(nodes / BLOCK_NODES), F.lit(FEW_BLOCKS)), F.ceil(tokens / BLOCK_TOKENS))


def _across_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes outside the main component of a large bucket and all its nodes, in blocks of bounded size.

    Large buckets that share nodes are taken together, since near copies meet under many tokens. A bucket
    is told by its smallest node there: buckets of one group mostly have the same few, so that a node is
    linked with these and not with each of its tokens.
    """
    joined = components(rows.select(F.col("lead").alias("x"), F.col("node").alias("y")).distinct())
    member = rows.select("node", "component", "n").distinct().join(joined.select("node", F.col("component").alias("crowd")), "node")
    member = stored(member, "crowds")
    sizes = member.groupBy("crowd", "component").agg(F.count("*").alias("count"), F.sum("n").alias("tokens"))
    main = sizes.groupBy("crowd").agg(F.max(F.struct("count", "component", "tokens")).alias("m"), F.sum("count").alias("size"), F.sum("tokens").alias("tokens"))
    main = main.select("crowd", F.col("m.component").alias("main"), "size", "tokens", (F.col("size") - F.col("m.count")).alias("outside"), (F.col("tokens") - F.col("m.tokens")).alias("outside_tokens"))
    member = member.join(main, "crowd").join(sets, "node")
    member = member.withColumns({
        "blocks": _blocks(F.col("size"), F.col("tokens")), "outside_blocks": _blocks(F.col("outside"), F.col("outside_tokens")),
        "hash": F.xxhash64("node", F.lit(3)),
    })
    left = member.where("component <> main").withColumns({"a": F.pmod("hash", "outside_blocks"), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    right = member.withColumns({"b": F.pmod("hash", "blocks"), "a": F.explode(F.sequence(F.lit(0).cast("long"), F.col("outside_blocks") - 1))})
    columns = ["crowd", "a", "b", "node", "component", *HEADS, "set"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        sets_ = [np.frombuffer(s, np.uint64) for s in right["set"]]
        nodes, parts, own_parts = right["node"].to_numpy(), right["component"].to_numpy(copy=True), left["component"].to_numpy(copy=True)
        if not len(nodes):
            return pd.DataFrame({"x": [], "y": []}).astype("int64")
        size = np.array([len(s) for s in sets_])
        everything, of_node = np.concatenate(sets_), np.repeat(np.arange(len(nodes)), size)
        heads = [(np.concatenate(list(right[h])), np.repeat(np.arange(len(nodes)), [len(f) for f in right[h]])) for h in HEADS]
        for k, (node, raw) in enumerate(zip(left["node"], left["set"], strict=True)):
            own, part = np.frombuffer(raw, np.uint64), own_parts[k]
            may = (parts != part) & (100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own)))
            for h, (tokens, of) in zip(HEADS, heads, strict=True):
                mine = left[h].iloc[k]
                at = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
                may &= np.bincount(of[mine[at] == tokens], minlength=len(nodes)) > 0
            if not may.any():
                continue
            left_over = may[of_node]
            tokens, of = everything[left_over], of_node[left_over]
            at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
            both = np.bincount(of[own[at] == tokens], minlength=len(nodes))
            good = np.flatnonzero(may & (100 * both >= percent * (size + len(own) - both)))
            # one link to each other component is enough to connect them; from then on they are one in this block
            met, once = np.unique(parts[good], return_index=True)
            out += [(node, y) for y in nodes[good][once]]
            for known in (parts, own_parts):
                known[np.isin(known, met)] = part
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    right = right.select(*(F.col(c).alias(c) for c in columns))  # columns of their own, as both sides come from one table
    return left.select(columns).groupBy("crowd", "a", "b").cogroup(right.groupBy("crowd", "a", "b")).applyInPandas(run, "x bigint, y bigint")


def join_components(documents: DataFrame, n: int = 4, percent: int = 85, bits: int = NODE_BITS) -> DataFrame:
    """doc_id, row, n_shingles and component_id of every row; see ``similar_documents``. Nodes are named by hashes of ``bits`` bits."""
    order = often_seen(documents, n)
    described, names = _named(stored(_described(documents, n, bits), "described"), bits)
    near = stored(_shared_tokens(_prefix_tokens(documents, names, order, n, percent)), "shared-tokens")
    sizes = described.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"))
    buckets = _buckets(near, sizes, percent)
    discard(near)
    sets = _node_sets(documents, described, buckets.select("node").distinct(), names, order, n, percent)

    stars = _star_pairs(buckets, percent)
    links = [stored(_verified(stars, sets, percent), "star-links")]
    rows = _labelled(buckets, links[0])
    discard(buckets)
    pairs = _small_pairs(rows, percent)
    links.append(stored(_verified(pairs, sets, percent), "small-links"))
    large = rows.where(F.col("size") > SMALL_BUCKET)
    if large.limit(1).count():
        links.append(stored(_across_blocks(large.select("node", "component", "n", F.col("lead.node").alias("lead")), sets, percent), "block-links"))
    discard(rows, sets)

    found = components(reduce(DataFrame.unionByName, links))
    discard(*links)
    nodes = described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(named, "component").select("node", "component", "component_id")
    return described.join(named, "node", "left").select(
        "doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def similar_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: distinct 4-word shingles, linked from 85 percent on.

    The component is what counts: how many links a document has isn't told, since near copies would need all their pairs.
    """
    return join_components(documents).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component: the one with the smallest id, or one without id if none has any; no words: all stay."""
    joined = told = stored(join_components(documents, n, percent).withColumn("__place", F.struct(F.col("doc_id").isNull(), "doc_id", "row")), "joined")
    first = told.where("component is not null").groupBy("component").agg(F.min("__place").alias("__first"))
    told = told.select("component", "row", "__place", F.col("doc_id").alias("__id"))
    gone = stored(told.join(first, "component").where("not (__place <=> __first)").select("row", "__id").distinct(), "gone")
    again = told.where("component is not null").groupBy("row", "__id").count().where("count > 1").select("row", "__id")
    same = lambda a, b: (a["row"] == b["row"]) & a["__id"].eqNullSafe(b["__id"])
    again = stored(again.join(gone, same(again, gone), "left_anti"), "again")
    discard(joined)
    # A hash alone would drop another row of the same hash: the id must agree too, and of repeated rows the text.
    keyed = documents.select(F.struct(*documents.columns).alias("__all"), F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").alias("__id"))
    sent = lambda frame: F.broadcast(frame) if frame.count() <= SENT_ROWS else frame
    out = gone.unionByName(again)
    kept = keyed.join(sent(out), same(keyed, out), "left_anti")
    once = keyed.join(sent(again), same(keyed, again), "left_semi").withColumn("__text", F.col("__all.text")).dropDuplicates(["__id", "__text"]).drop("__text")
    return kept.unionByName(once).select("__all.*")
