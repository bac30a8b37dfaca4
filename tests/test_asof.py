"""As-of join: hot buckets in shares, others shuffled once."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators.joins import dealt_facts, last_before


@pytest.mark.parametrize("rows_per_share", [7, 1000])
def test_every_row_finds_the_last_fact_however_buckets_are_dealt(spark, rows_per_share):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([rng.randrange(0, 5 * 3600), 1800, None])) for i in range(1500)]
    facts = [(j, rng.choice(["hot", "a", "c", None]), rng.randrange(0, 5 * 3600), f"p{j}") for j in range(200)]
    stamped = lambda df: df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    left = stamped(spark.createDataFrame(rows, "i bigint, k string, s bigint"))
    right = stamped(spark.createDataFrame(facts, "j bigint, k string, s bigint, p string"))
    got = {r["i"]: r["p"] for r in last_before(left, right, "k", "ts", ["p"], ["j"], rows_per_share=rows_per_share).collect()}

    def last(k, s):
        seen = [f for f in facts if k is not None and s is not None and f[1] == k and f[2] <= s]
        return max(seen, key=lambda f: (f[2], f[0]))[3] if seen else None

    assert got == {i: last(k, s) for i, k, s in rows}


def test_only_facts_of_hot_buckets_are_copied(spark):
    facts = spark.range(1000).selectExpr("concat('k', id % 100) AS _k", "id % 10 AS _b")
    hot = spark.createDataFrame([("k7", 7, 5)], "_k string, _b bigint, _shares bigint")
    assert dealt_facts(facts, hot).count() == 1000 + 10 * 4
    assert dealt_facts(facts, hot.limit(0)).count() == 1000
