"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestry.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each linked node: columns ``node`` and ``component``.

    ``links`` has two bigint columns, ``x`` and ``y``. Stars are formed in turns from the larger and the
    smaller neighbours until nothing changes; each turn is a few joins and grouped minima, written to the shared folder
    in place of the turn before.
    """
    now = stored(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(20)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        center = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(center, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(center.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(before)
