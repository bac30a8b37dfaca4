"""Union of time intervals as disjoint spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Starts are taken together by the day, so that a busy key is spread over its days.
BUCKET_SECONDS = 86_400


def bucket_of(ts: Column | str, seconds: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts.cast("double") / seconds).cast("long")


def interval_union(df: DataFrame, keys: list[str], lo: str, hi: str, daily: bool = False) -> DataFrame:
    """Per key the disjoint spans ``lo, hi`` (both inclusive) that its intervals cover together.

    A span begins where no earlier interval reaches: where the start lies beyond the running
    maximum of the ends.  Both running values, the maximum of the ends and the last beginning,
    are taken inside the days of a key and carried from day to day over one row for each day,
    so no task walks all intervals of a key.  Intervals with a null bound or an end before
    their start cover nothing; key columns may be null, and nulls are one key.  ``daily`` says
    that the keys hold the day: a key then has at most one start for each instant of a day,
    and its running values need no carrying.
    """
    if daily:
        own = df.where(F.col(lo) <= F.col(hi)).groupBy(*keys, F.col(lo).alias("_lo")).agg(F.max(hi).alias("_hi"))
        walk = Window.partitionBy(*keys).orderBy("_lo")
        own = own.withColumn("_reach", F.max("_hi").over(walk.rowsBetween(Window.unboundedPreceding, -1)))
        own = own.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach")), F.col("_lo")))
        own = own.withColumn("_begun", F.max("_new").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return own.groupBy(*keys, F.col("_begun").alias(lo)).agg(F.max("_hi").alias(hi))
    marks = [f"_k{i}" for i in range(2 * len(keys))]
    named = [x for i, k in enumerate(keys) for x in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(marks[2 * i]), F.col(k).isNull().alias(marks[2 * i + 1]))]
    starts = df.where(F.col(lo) <= F.col(hi)).groupBy(*keys, F.col(lo).alias("_lo")).agg(F.max(hi).alias("_hi"))
    starts = starts.select(*keys, *named, "_lo", "_hi", bucket_of("_lo", BUCKET_SECONDS).alias("_b"))
    inside = Window.partitionBy(*marks, "_b").orderBy("_lo")
    earlier = Window.partitionBy(*marks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(value: Column) -> DataFrame:
        """The maximum of ``value`` over all earlier days of the key."""
        days = starts.groupBy(*marks, "_b").agg(F.max(value).alias("_top"))
        return days.withColumn("_carry", F.max("_top").over(earlier)).drop("_top")

    reach = F.max("_hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_reach", reach).join(carried(F.col("_hi")), [*marks, "_b"])
    reached = F.greatest("_reach", "_carry")
    starts = starts.withColumn("_new", F.when(reached.isNull() | (F.col("_lo") > reached), F.col("_lo"))).drop("_reach", "_carry")
    begun = F.max("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = starts.withColumn("_begun", begun).join(carried(F.col("_new")), [*marks, "_b"])
    return starts.groupBy(*keys, F.coalesce("_begun", "_carry").alias(lo)).agg(F.max("_hi").alias(hi))
