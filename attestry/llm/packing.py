"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are counted first: at most one row for each length up to the largest permitted
sequence, whatever the number of documents. On these counts best fit runs exactly, longest
pieces first: a piece goes to the open bin with the least room that still holds it; if none
does, a bin of the size with the least cost for each token it can come to hold is opened.
At the end every bin takes the smallest permitted size that holds its contents. Bins that
are filled alike are one entry with a number, so the plan stays small too. Then each piece
gets its place from its rank among the pieces of its length, which Spark counts in shares.

Documents longer than the largest size are cut into full pieces and a remainder. Documents
of length zero or null take no room: one row, with no bin. Equal rows are packed as often
as they occur.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestry.llm.shared import apart, lean

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of one length that are ranked together.
RANKED_TOGETHER = 1024
PLACED = "bin_id bigint, bin_offset bigint, bin_size bigint, bin_used bigint"


def attention_cost(capacity: int) -> float:
    """Work on a sequence: a part in proportion and a part with the square of its length."""
    return capacity * (1 + capacity / 32768)


@dataclass
class Plan:
    """Places by length and rank, and sizes by bin; both as ranges."""

    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)  # length -> (first rank, first bin, pieces a bin, offset)
    bins: list[tuple[int, int, int]] = field(default_factory=list)  # (first bin, size, used)
    n_bins: int = 0


def plan_bins(counts: dict[int, int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> Plan:
    """Best fit, longest first, on numbers of pieces by length."""
    capacities = tuple(sorted(set(capacities)))
    plan, top = Plan(), capacities[-1]
    below = np.zeros(top + 1, dtype=np.int64)  # the longest present length of at most so much
    for n in counts:
        below[n] = n
    below = np.maximum.accumulate(below)
    rooms: list[int] = []  # rooms of which there are open bins, ascending
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, number, used)

    def put(room: int, first: int, number: int, used: int) -> None:
        if number and room not in open_bins:
            insort(rooms, room)
        if number:
            open_bins.setdefault(room, []).append((first, number, used))

    def take(room: int) -> tuple[int, int, int]:
        group = open_bins[room].pop()
        if not open_bins[room]:
            del open_bins[room], rooms[bisect_left(rooms, room)]
        return group

    def least_cost(length: int, left: int) -> int:
        """The size with the least cost for each token, if it is filled with the longest pieces that fit."""
        best = None
        for size in capacities:
            if size < length:
                continue
            room, n, have = size, length, left
            while n:
                k = min(room // n, have)
                room -= k * n
                n = int(below[min(room, n - 1)])
                have = counts.get(n, 0)
            rate = (cost(size) / (size - room), size)
            best = min(best, rate) if best else rate
        return best[1]

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number, used = take(room)
            else:
                room = least_cost(length, left)
                first, number, used = plan.n_bins, -(-left // (room // length)), 0
                if left % (room // length) and number > 1:
                    number -= 1  # what is left decides anew on its size
                plan.n_bins += number
            each = room // length
            full = min(number, left // each)
            if full:
                plan.places.setdefault(length, []).append((rank, first, each, used))
                put(room - each * length, first, full, used + each * length)
                rank, left = rank + full * each, left - full * each
            if full < number and left:
                plan.places.setdefault(length, []).append((rank, first + full, left, used))
                put(room - left * length, first + full, 1, used + left * length)
                rank, full, left = rank + left, full + 1, 0
            put(room, first + full, number - full, used)
    ends = []
    for groups in open_bins.values():
        for first, _, used in groups:
            ends.append((first, capacities[bisect_left(capacities, used)], used))
    plan.bins = sorted(ends)
    return plan


def pieces(frame: DataFrame, length: str, largest: int) -> DataFrame:
    """Rows cut to pieces of at most ``largest``: adds piece, piece_start, piece_length."""
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    number = F.greatest(F.lit(1), F.ceil(size / F.lit(largest))).cast("long")
    return frame.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).withColumns({
        "piece_start": F.col("piece") * largest, "piece_length": F.least(size - F.col("piece") * largest, F.lit(largest).cast("long")),
    })


def _ranked(cut: DataFrame, counts: dict[int, int], keys: list[str]) -> DataFrame:
    """Add ``__rank``, a number from 0 among the rows of a length; a frequent length is counted in shares."""
    spark = cut.sparkSession
    shares = F.broadcast(spark.createDataFrame([(n, -(-c // RANKED_TOGETHER)) for n, c in sorted(counts.items())], "piece_length bigint, __shares bigint"))
    order = [F.xxhash64(*keys, "piece"), *keys, "piece"]
    dealt = cut.join(shares, "piece_length").withColumn("__share", F.pmod(F.xxhash64(*keys, "piece", F.lit(7)), F.col("__shares")))
    sizes = dealt.groupBy("piece_length", "__share").count()
    before = Window.partitionBy("piece_length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("piece_length", "__share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("piece_length", "__share").orderBy(*order)
    return dealt.withColumn("__inner", F.row_number().over(inner)).join(sizes, ["piece_length", "__share"]).withColumn("__rank", F.col("__before") + F.col("__inner") - 1)


def pack(frame: DataFrame, length: str, keys: list[str], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """The rows of ``frame``, cut to pieces, with bin, offset in the bin, and the bin's size and contents.

    ``keys`` tell rows apart; rows that agree in them are interchangeable. Columns named like a result come back
    with ``_input`` behind them.
    """
    made = [*(x.split(" ")[0] for x in PLACED.split(", ")), "piece", "piece_start", "piece_length", "__shares", "__share", "__before", "__inner", "__rank"]
    return apart(frame, made, lambda f: _packed(f, length, keys, capacities, cost), [length, *keys])


def _packed(frame: DataFrame, length: str, keys: list[str], capacities: tuple[int, ...], cost: Callable[[int], float]) -> DataFrame:
    cut = pieces(frame, length, max(capacities))
    counts = {r["piece_length"]: r["count"] for r in cut.where("piece_length > 0").groupBy("piece_length").count().collect()}
    plan = plan_bins(counts, capacities, cost)
    starts = {n: np.array(p, dtype=np.int64) for n, p in plan.places.items()}
    bins = np.array(plan.bins, dtype=np.int64).reshape(-1, 3)
    columns = [*frame.columns, "piece", "piece_start", "piece_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("piece_length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False)
            bin_id, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                table = starts[int(n)]
                at = table[np.searchsorted(table[:, 0], ranks[own], side="right") - 1]
                inner = ranks[own] - at[:, 0]
                bin_id[own] = at[:, 1] + inner // at[:, 2]
                offset[own] = at[:, 3] + inner % at[:, 2] * n
            end = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, *map(pa.array, (bin_id, offset, end[:, 1], end[:, 2]))], [*columns, "bin_id", "bin_offset", "bin_size", "bin_used"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(columns).schema)
    placed = _ranked(cut.where("piece_length > 0"), counts, keys).select(*columns, "__rank").mapInArrow(lean(run), f"{types}, {PLACED}")
    empty = cut.where("piece_length <= 0").select(*columns, *(F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_offset", "bin_size", "bin_used")))
    return placed.unionByName(empty)


def word_count(text: str):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def packed_documents(documents: DataFrame) -> DataFrame:
    """Every piece of every document with its bin; lengths in words."""
    return pack(documents.select("doc_id", word_count("text").alias("n_words")), "n_words", ["doc_id", "n_words"])
