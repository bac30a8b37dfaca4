"""Join and keep-first steps that stay even when one key holds a third of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
#: Rows of one key and bucket that an as-of join leaves together.
ROWS_PER_SHARE = 100_000


def with_columns_or_null(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    """Add each missing column as a null of ``kind``."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n.lower() not in have})


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Keep the first row per key (nulls equal).

    The rank filter is pushed below the shuffle as a window group limit, so each
    map task sends at most one row per key however hot the key is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list, order: list, n: int, rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank; same map-side limit as above."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, rank).where(F.col(rank_name) <= n)


def salted_left_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: Column | str, salts: int = SALTS
) -> DataFrame:
    """Left join many-to-few where one key may hold much of ``big``.

    ``big`` rows of a key are spread over ``salts`` sub-keys and ``small`` is
    repeated for each.  Rows with a null key cannot match: they get a wide
    spread instead of meeting in one task.  Below the broadcast size limit the
    planner (or adaptive execution, at run time) drops the shuffle altogether.
    With one salt ``small`` is not repeated: for keys that hold the day, where
    adaptive execution splits the rare task that is still too large.
    """
    spread = F.col(spread) if isinstance(spread, str) else spread
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(no_key, F.xxhash64(spread)).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)))
    left = big.withColumn("_salt", salt)
    # Not a plain 0: the planner folds a literal out of the join key, and rows without a key would meet after all.
    only = F.pmod(F.xxhash64(*keys), F.lit(1))
    copies = only if salts == 1 else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    right = small.withColumn("_salt", copies)
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def dealt_facts(facts: DataFrame, hot: DataFrame) -> DataFrame:
    """Facts with ``_share``: those of a hot (key, bucket) once for each share, all others once."""
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1).cast("long")) - 1)
    return facts.join(hot, ["_k", "_b"], "left").withColumn("_share", F.explode(copies)).drop("_shares")


def last_before(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    ts: str,
    payload: list[str],
    fact_order: list[str],
    bucket_seconds: int = 3600,
    salts: int = SALTS,
    rows_per_share: int = ROWS_PER_SHARE,
) -> DataFrame:
    """As-of join: per row, the payload of the latest fact of its key at or before ``ts``.

    Time is cut into buckets.  The last fact of each (key, bucket) is carried to
    the later buckets over the short bucket list; inside a bucket an ordered
    window fills forward.  No (row, fact) pair is formed.  A hot key is split by
    its buckets.  Buckets are counted first: one with more than ``rows_per_share``
    rows is dealt out in shares, and only its facts (one per instant at most) go
    to each share; all other facts are shuffled once.  Among facts of one instant
    the highest ``fact_order`` wins.
    """
    bucket = F.floor(F.col(ts).cast("double") / bucket_seconds)
    packed = F.struct(*[F.col(c) for c in payload])
    facts = facts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_k"), F.col(ts).alias("_t"), bucket.alias("_b"),
        packed.alias("_p"), F.struct(*[F.col(c) for c in fact_order]).alias("_o"),
    )
    facts = first_per_key(facts, ["_k", "_t"], [F.desc("_o")])
    keyed = rows.withColumns({"_k": F.col(key), "_t": F.col(ts), "_b": bucket})
    joinable = F.col("_k").isNotNull() & F.col("_t").isNotNull()

    last_of_bucket = first_per_key(facts, ["_k", "_b"], [F.desc("_t"), F.desc("_o")])
    wanted = keyed.where(joinable).groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    hot = wanted.where(F.col("_n") > rows_per_share).select("_k", "_b", F.ceil(F.col("_n") / rows_per_share).cast("long").alias("_shares"))
    marks = last_of_bucket.select("_k", "_b", F.col("_p").alias("_in")).unionByName(
        wanted.select("_k", "_b", F.lit(None).cast(facts.schema["_p"].dataType).alias("_in"))
    )
    earlier = Window.partitionBy("_k").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.groupBy("_k", "_b").agg(F.first("_in", ignorenulls=True).alias("_in"))
        .withColumn("_carry", F.last("_in", ignorenulls=True).over(earlier))
        .where("_carry is not null")
        .select("_k", "_b", "_carry")
    )

    whole = F.struct(*[F.col(c) for c in rows.columns])
    events = keyed.where(joinable).select("_k", "_b", "_t", whole.alias("_row"))
    shares = F.coalesce("_shares", F.lit(1).cast("long"))
    events = events.join(hot, ["_k", "_b"], "left").withColumn("_share", F.pmod(F.xxhash64("_row"), shares)).drop("_shares")
    facts = dealt_facts(facts, hot)
    mixed = events.withColumns({
        "_p": F.lit(None).cast(facts.schema["_p"].dataType),
        "_o": F.lit(None).cast(facts.schema["_o"].dataType),
        "_side": F.lit(1),
    }).unionByName(
        facts.withColumns({"_row": F.lit(None).cast(events.schema["_row"].dataType), "_side": F.lit(0)})
    )
    so_far = (
        Window.partitionBy("_k", "_b", "_share").orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = (
        mixed.withColumn("_seen", F.last("_p", ignorenulls=True).over(so_far))
        .where("_side = 1").select("_k", "_b", "_row", "_seen")
    )
    found = salted_left_join(filled, carried, ["_k", "_b"], "_row", salts).select(
        "_row.*", F.coalesce("_seen", "_carry").alias("_p")
    )
    rest = keyed.where(~F.coalesce(joinable, F.lit(False))).select(
        *rows.columns, F.lit(None).cast(facts.schema["_p"].dataType).alias("_p")
    )
    return found.unionByName(rest).select(*rows.columns, *[F.col(f"_p.{c}").alias(c) for c in payload])
