"""Counted writes, positions, stores that are pruned or brought up to date in part."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import governance as V
from attestry.operators.positions import laid_out, positions
from attestry.sources import files, sinks
from attestry.streaming.runner import scratch
from attestry_queries import stores as Q
from attestry_queries.fixtures import Inputs

SF = "/root/testdata/sf0.001"


def test_a_rejected_record_fails_the_write_and_leaves_the_store_as_it_was(spark):
    Inputs(spark, SF)
    path = scratch(spark, "counted")
    rows = spark.range(1000).repartition(4)
    assert sinks.write_counted(rows, path) == {"accepted": 1000, "rejected": 0}
    with pytest.raises(Exception, match="rejected an event"):
        sinks.write_counted(rows, path, F.col("id") == 999)
    assert spark.read.parquet(path).count() == 1000
    assert sinks.write_counted(rows, path, F.when(F.col("id") < 10, F.lit(None)).otherwise(F.col("id") % 2 == 0), tolerate=True) == {"accepted": 505, "rejected": 495}
    assert spark.read.parquet(path).count() == 1505


@pytest.mark.parametrize("within", [[], ["g"]])
def test_positions_equal_a_sort(spark, within):
    Inputs(spark, SF)
    rng = random.Random(4)
    rows = [(rng.choice([None, "", "a", "hot", "hot", "hot"]), rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, v int, i bigint").repartition(7)
    order = [*(F.asc_nulls_first(c) for c in within), F.desc_nulls_last("v"), "i"]
    out = positions(laid_out(frame, order), within=within, size="n", number="no")
    place = {r["i"]: (r["position"], r["n"], r["no"]) for r in out.collect()}
    groups = {}
    for g, v, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        groups.setdefault(g if within else 0, []).append(i)
    names = sorted(groups, key=lambda g: (g is not None, g or "")) if within else [0]
    assert place == {i: (k, len(groups[g]), names.index(g)) for g in names for k, i in enumerate(groups[g])}


def test_equal_rows_get_positions_of_their_own(spark):
    Inputs(spark, SF)
    out = positions(laid_out(spark.range(5000).select(F.lit("x").alias("k")), ["k"]))
    assert sorted(r["position"] for r in out.collect()) == list(range(5000))
    assert positions(laid_out(spark.range(0).select(F.lit("x").alias("k")), ["k"])).collect() == []


def test_unchanged_groups_keep_their_files(spark):
    t = Inputs(spark, SF)
    store = scratch(spark, "incremental")
    before, after = Q.two_cycles(t)
    files = lambda: {r["day"]: r["files"] for r in spark.read.parquet(store).withColumn("f", F.input_file_name()).groupBy(F.col("day").cast("string").alias("day")).agg(F.sort_array(F.collect_set("f")).alias("files")).collect()}
    passed = V.rewrite_changed(before, ["day"], Q.CONTENT, store)
    passed.count()
    first = files()
    V.rewrite_changed(after, ["day"], Q.CONTENT, store, passed)
    second = files()
    differs = {r["day"] for r in before.exceptAll(after).select("day").distinct().collect()}
    assert differs and differs != set(first)
    assert {d for d in first if first[d] != second[d]} == differs


def test_files_of_other_days_are_not_read(spark):
    plan = Q.pruned_requests(Inputs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_index_cells_come_back_as_written(spark, tmp_path):
    cells = [" a ", "\tb\n", "x\r\ny", 'say "hi"', "back\\", 'a\\"b, c', "", "\n", "é 漢"]
    rows = [(str(k), "c", "local_file", cell, "ready", "none") for k, cell in enumerate(cells)]
    index = spark.createDataFrame(rows, "family string, control string, source_type string, link string, status string, doc_type string")
    sinks.write_index(index, str(tmp_path / "index"))
    assert sorted(tuple(r) for r in files.read_index(spark, str(tmp_path / "index")).collect()) == rows
