"""Interval union against a walk, coverage with windows of any length."""

import datetime as dt
import random

from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators.intervals import interval_union

START = dt.datetime(2024, 1, 1)


def walked(rows):
    out = {}
    for key, lo, hi in sorted((r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]), key=lambda r: (str(r[0]), r[1])):
        spans = out.setdefault(key, [])
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return sorted(((k, *s) for k, spans in out.items() for s in spans), key=str)


def test_union_equals_a_walk_through_the_sorted_intervals(spark):
    rng = random.Random(2)
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = []
    for _ in range(3000):
        lo = rng.randrange(0, 40 * 86_400)
        rows.append((rng.choice(["hot"] * 5 + ["a", "b", "", None]), at(lo), at(lo + rng.choice([0, 60, 3600, 86_400 * 3]) - rng.choice([0, 0, 0, 1]))))
    rows += [("a", None, at(5)), ("b", at(5), None), ("edge", at(0), at(10)), ("edge", at(10), at(20)), ("edge", at(21), at(22)), ("edge", at(0), at(4))]
    found = interval_union(spark.createDataFrame(rows, "ident string, lo timestamp, hi timestamp"), ["ident"], "lo", "hi")
    assert sorted((tuple(r) for r in found.select("ident", "lo", "hi").collect()), key=str) == walked(rows)
    daily = interval_union(spark.createDataFrame(rows, "ident string, lo timestamp, hi timestamp"), ["ident"], "lo", "hi", daily=True)
    assert sorted((tuple(r) for r in daily.select("ident", "lo", "hi").collect()), key=str) == walked(rows)


def test_union_of_nothing(spark):
    assert interval_union(spark.createDataFrame([], "ident string, lo timestamp, hi timestamp"), ["ident"], "lo", "hi").collect() == []


def test_an_endless_window_costs_one_row_not_one_for_each_hour(spark):
    asked = spark.createDataFrame([
        ("1", "2024-01-01 10:00:00", "2024-01-01", "a@x.com", 2_000_000_000), ("2", "2024-01-02 10:00:00", "2024-01-02", "a@x.com", 30),
        ("3", "2024-01-01 10:00:00", "2024-01-01", "b@x.com", 30)], "request_id string, timestamp string, local_date string, user_email string, duration_minutes bigint")
    asked = asked.withColumns({"user_id": F.lit(None).cast("string"), "user_name": F.lit(None).cast("string")})
    spans = C.access_spans(C.requests_by_identifier(asked), ["ident"], None)
    assert spans.count() == 2 and C.hourly_spans(spans, ["ident"]).count() == 1 and C.long_spans(spans).count() == 1
    times = ["2024-01-01 09:59:59", "2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 10:30:01", "2500-06-01 00:00:00", None]
    events = spark.createDataFrame([(i, u, t) for i, t in enumerate(times) for u in ("a@x.com", "b@x.com", None)], "ord bigint, user_id string, time string")
    events = events.withColumns({"event_ts": F.col("time").cast("timestamp"), "local_date": F.substring("time", 1, 10)})
    got = {(r["ord"], r["user_id"]): r["covered"] for r in C.with_coverage(events, asked, "UTC", carry_over=True).collect()}
    assert [got[i, "a@x.com"] for i in range(6)] == [False, True, True, True, True, False]
    assert [got[i, "b@x.com"] for i in range(6)] == [False, True, True, False, False, False] and not any(got[i, None] for i in range(6))
    one_day = {(r["ord"], r["user_id"]): r["covered"] for r in C.with_coverage(events, asked, "UTC").collect()}
    assert one_day[3, "a@x.com"] and not one_day[4, "a@x.com"]
