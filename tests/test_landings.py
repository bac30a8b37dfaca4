"""Restarts over landing folders, copies, retention kept in state."""

from pyspark.sql import functions as F

from attestry.streaming import stateful as S
from attestry.streaming.runner import run_available
from attestry_queries import landings as Q
from attestry_queries.fixtures import Inputs

SF = "/root/testdata/sf0.001"


def test_a_restart_reads_new_files_only_and_late_lines_count(spark):
    t = Inputs(spark, SF)
    out, read = Q.two_landings(t)
    early = Q.delivered(t, Q.EARLY).count()
    late = Q.delivered(t, f"NOT ({Q.EARLY})").count()
    again = Q.delivered(t, f"e.ts >= {Q.CUT} - INTERVAL 12 HOUR AND ({Q.EARLY})").count()
    assert early and late and again and read == [early, late + again, 1]
    assert out.where(F.col("ord") >= Q.COPY).count() == 0 and out.count() == out.select("type", "who", "event_time").distinct().count()


def test_first_copy_wins_in_any_order_and_late_copies_are_dropped(spark):
    t = Inputs(spark, SF)
    row = lambda ord, lease, arrival, at="2024-01-01 00:00:00": (
        "VaultCredsIssued", f"{at}Z", "p", "u", ord, lease, arrival, at)
    frame = lambda rows: spark.createDataFrame(rows, "type string, event_time_norm string, key_place string, key_user string, ord bigint, lease_id string, ingest_ts string, at string").withColumn(
        "event_ts", F.col("at").cast("timestamp")).drop("at")
    landing = Q.Landing(t, "copies").add(frame([row(2, "late", "b"), row(3, "late too", "b")])).add(frame([row(9, "first", "a"), row(1, "tie", "c")]))
    landing.add(frame([row(5, "x", "a", "2030-01-01 00:00:00")]))
    run = lambda: run_available(S.first_copies(landing.stream()), landing.out, landing.state)
    assert [(r["ord"], r["lease_id"]) for r in run().collect()] == [(9, "first")]
    landing.add(frame([row(0, "after the watermark", "0")]))
    assert run().count() == 1


def test_state_forgets_at_the_end_of_retention_and_not_before(spark):
    t = Inputs(spark, SF)
    frame = lambda rows: spark.createDataFrame(rows, "request_id string, ttl bigint, at bigint").select("request_id", "ttl", F.timestamp_seconds("at").alias("event_ts"))
    landing = Q.Landing(t, "retention").add(frame([("ends", 100, 1), ("at", 200, 1), ("after", 201, 1), ("again", 100, 1), ("never", None, 1)]))
    run = lambda: sorted(r["request_id"] for r in run_available(S.forgotten_requests(landing.stream()), landing.out, landing.state).collect())
    kept = lambda: sorted(r["request_id"] for r in S.remembered_requests(spark, landing.state).collect())
    assert run() == [] and kept() == ["after", "again", "at", "ends"]
    landing.add(frame([("again", 500, 50)]))
    assert run() == []
    landing.add(frame([("clock", 10_000, 200)]))
    assert run() == ["at", "ends"] and kept() == ["after", "again", "clock"]


def test_retention_runs_without_python_and_ends_before_its_beginning_are_given_back(spark):
    t = Inputs(spark, SF)
    frame = lambda rows: spark.createDataFrame(rows, "request_id string, ttl bigint, at bigint").select("request_id", "ttl", F.timestamp_seconds("at").alias("event_ts"))
    landing = Q.Landing(t, "retention-ends").add(frame([("over", 50, 60), ("same", 60, 60), ("twice", 100, 60), ("twice", 900, 70), ("kept", 501, 60)]))
    gone = S.forgotten_requests(landing.stream())
    assert "python" not in gone._jdf.queryExecution().analyzed().toString().lower()
    run_available(gone, landing.out, landing.state)
    landing.add(frame([("clock", 10_000, 500)]))
    got = run_available(S.forgotten_requests(landing.stream()), landing.out, landing.state).collect()
    assert sorted((r["request_id"], r["ttl"]) for r in got) == [("over", 50), ("same", 60)]
    kept = S.remembered_requests(spark, landing.state).collect()
    assert sorted((r["request_id"], r["ttl"]) for r in kept) == [("clock", 10_000), ("kept", 501), ("twice", 900)]


def test_both_states_occur_in_the_registered_query(spark):
    got = {r["state"]: r["count"] for r in Q.QUERIES["t7_request_ttl"](spark, SF).groupBy("state").count().collect()}
    assert got["remembered"] and got["forgotten"]


def test_uncovered_events_come_out_whole(spark):
    got = {r["covered"]: r["count"] for r in Q.QUERIES["t8_whole_reconcile"](spark, SF).groupBy("covered").count().collect()}
    assert got[False]
