"""Expressions that run on every event: what they cost and that short cuts change nothing."""

from pyspark.sql import functions as F

from attestry.functions import resources
from attestry.functions.text import strip, tidy_sql
from attestry.functions.times import day_bounds, parse_time
from attestry.schemas import EVENT_COLUMNS
from attestry_queries.fixtures import Inputs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(table, rows):
    schema = ", ".join(["ord bigint", "user_id string", "local_date string", "src_rank int", *[f"{c} string" for c in EVENT_COLUMNS]])
    return table(rows, schema)


def test_object_location_strips_few_times(table):
    df = events(table, [{"ord": 1}])
    assert optimized(df.select(resources.resource_details())).count("trim(") <= 32  # 96 before


def test_sessions_compile_long_methods(spark, tmp_path):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    Inputs(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_strip_at_odd_edges(table):
    texts = ["", " ", "a", " a", "a ", "a b", "é", " é ", " a　", "a\n", "\x7fa\x7f", "\x1ca", "~", "!", " ", None]
    df = table([{"ord": i, "s": s} for i, s in enumerate(texts)], "ord bigint, s string")
    got = df.select(strip("s").alias("a"), strip(F.col("s")).alias("b"), F.expr(tidy_sql("s")).alias("c")).orderBy("ord").collect()
    want = [None if s is None else s.strip() for s in texts]
    assert [r.a for r in got] == want and [r.b for r in got] == want and [r.c for r in got] == [w or None for w in want]


def test_object_location_of_odd_arns(table):
    p = "arn:aws:s3:::"
    arns = [p + "b/k/l", p + "b", p + "b/", p + "/k", p, f" {p}b/k\nl\n ", "arn:other", "", None]
    rows = [{"ord": i, "resourceArn": a, "eventSource": "s3.amazonaws.com", "eventName": "GetObject", "reqBucketName": " rb ", "reqObjectKey": "rk"} for i, a in enumerate(arns)]
    got = events(table, rows).select(resources.resource_details().alias("d"), resources.resource_arn().alias("arn")).orderBy("ord").collect()
    assert [(r.d.s3_bucket, r.d.s3_key) for r in got] == [
        ("b", "k/l"), ("b", None), ("b", ""), (None, "k"), (None, None), ("b", "k\nl"), (None, None), ("rb", "rk"), ("rb", "rk")]
    assert [r.arn for r in got] == [p + "b", p + "b", p + "b", p + "/k", p, p + "b", "arn:other", p + "rb", p + "rb"]


def test_times_at_odd_edges(table):
    stamps = ["2024-01-02 03:04:05", "2024-01-02 03:04:05\n", "2024-01-02 03:04:05.9", "2024-02-30 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02", None]
    df = table([{"ord": i, "s": s} for i, s in enumerate(stamps)], "ord bigint, s string").orderBy("ord")
    assert [r[0] for r in df.select(F.unix_seconds(parse_time("s"))).collect()] == [1704164645] * 3 + [None, 1704164645, None, None]
    days = table([{"d": d} for d in ["2024-02-29", "2023-02-29", "2024-1-5", "0000-01-01", ""]], "d string")
    assert [r[0] for r in days.select(F.unix_seconds(day_bounds("d", "UTC")[1])).collect()] == [1709251200, None, None, -62167132800, None]
