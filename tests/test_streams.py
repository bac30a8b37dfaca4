"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators.alarms import Alarm, alarms
from attestry.streaming import jobs as J
from attestry.streaming.runner import run_available, scratch
from attestry_queries import access
from attestry_queries.fixtures import Inputs, StreamInputs

SF = "/root/testdata/sf0.001"


def run(spark, stream, name):
    base = scratch(spark, name)
    return run_available(stream, f"{base}/out", f"{base}/state")


def test_reconcile_stream_below_the_watermark(spark):
    s, b = StreamInputs(spark, SF), Inputs(spark, SF)
    stream = J.reconcile_stream(C.resolve_actors(C.conform(access.named_objects(s), "UTC")), access.requests(s), "UTC")
    got = {r.ord: r.covered for r in run(spark, stream, "t8").groupBy("ord").agg(F.max("covered").alias("covered")).collect()}
    batch = C.match_requests(C.resolve_actors(C.conform(access.named_objects(b), "UTC")), access.requests(b), "UTC")
    rows = batch.select("ord", "covered", "event_ts").collect()
    want = {r.ord: r.covered for r in rows}
    assert all(want[o] == c for o, c in got.items())
    assert {o for o, c in want.items() if c} == {o for o, c in got.items() if c}
    last = max(r.event_ts for r in rows)
    settled = {r.ord for r in rows if (last - r.event_ts).total_seconds() > 4 * 3600 * 6}
    assert settled <= set(got)


def test_alarm_stream(spark):
    def samples(t):
        return t["events"].select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")

    got = {tuple(r) for r in run(spark, J.alarm_stream(samples(StreamInputs(spark, SF)), ["event_type"], Alarm("sum", 0, 2, 7200)), "t5").collect()}
    want = {tuple(r) for r in alarms(samples(Inputs(spark, SF)), ["event_type"], Alarm("sum", 0, 2, 7200)).collect()}
    assert got <= want and len(want) - len(got) <= 10 and got


def test_shared_scratch_folder(tmp_path):
    class Session:
        conf = {"spark.checkpoint.dir": f"{tmp_path}/"}

    assert scratch(Session(), "x").startswith(f"{tmp_path}/x-")
