"""Global positions: the place of every row in a total order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.streaming.runner import scratch

SLOT = "__slot"
#: monotonically_increasing_id holds the partition above this bit and the row in the partition below.
ROW_BITS = 33
#: Counts per range are sent to all tasks up to this number of rows, joined by a shuffle beyond.
SENT_COUNTS = 100_000


def _kept(frame: DataFrame, name: str) -> DataFrame:
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def laid_out(frame: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows in ranges of ``order``, each range sorted, stored once with ``__slot``.

    ``__slot`` ascends along the order: range above, row in the range below. Equal rows
    are cut apart by their own number, so a key that repeats for much of the table is
    spread over ranges as well.
    """
    numbered = frame.withColumn(SLOT, F.monotonically_increasing_id())
    rows = numbered.repartitionByRange(*order, SLOT).sortWithinPartitions(*order, SLOT)
    return _kept(rows.select(*frame.columns, F.monotonically_increasing_id().alias(SLOT)), "layout")


def positions(laid: DataFrame, name: str = "position", within: list[str] = (), size: str | None = None, number: str | None = None) -> DataFrame:
    """Replace ``__slot`` by the position from 0 on, counted anew in each group of ``within``.

    ``within`` must lead the order of the layout, so that a range holds each group in one
    piece. ``size`` adds the number of rows of the group, ``number`` the position of the
    group among the groups. Only counts per range (and group) meet in a window: as many
    rows as there are ranges, however many rows they stand for.
    """
    marks = [f"__{k}{i}" for i in range(len(within)) for k in "vn"]
    own = laid.withColumn("__range", F.shiftright(SLOT, ROW_BITS)).select(
        "*", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__v{i}") for i, c in enumerate(within)),
        *(F.col(c).isNull().alias(f"__n{i}") for i, c in enumerate(within)))
    group = Window.partitionBy(*marks)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("__range", *marks).agg(F.count("*").alias("__rows"), F.min(SLOT).alias("__first"))
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)), "__all": F.sum("__rows").over(group)})
    if number and not marks:
        counts = counts.withColumn("__number", F.lit(0).cast("long"))
    elif number:
        groups = counts.groupBy(*marks).agg(F.min("__first").alias("__opened"))
        groups = positions(laid_out(groups, ["__opened"]), "__number").drop("__opened")
        counts = counts.join(groups, marks)
    counts = _kept(counts.drop("__rows"), "counts")
    if counts.count() <= SENT_COUNTS:
        counts = F.broadcast(counts)
    placed = own.join(counts, ["__range", *marks])
    extra = {size: F.col("__all")} if size else {}
    extra |= {number: F.col("__number")} if number else {}
    columns = [c for c in laid.columns if c != SLOT]
    return placed.withColumns({name: (F.col("__before") + F.col(SLOT) - F.col("__first")).cast("long"), **extra}).select(*columns, name, *extra)
