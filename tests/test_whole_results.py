"""Nothing is lost to caps, spellings of stamps, quoting or broken deliveries."""

import base64
import gzip
import json
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.times import parse_time
from attestry.operators import requests as Q
from attestry.operators import scans as S
from attestry.operators import tickets as K
from attestry.operators import whitelist as W
from attestry.sources import deliveries as D
from attestry.sources import files, sinks
from attestry.streaming import runner


def test_all_requests_of_a_group_are_kept(spark):
    rows = spark.range(400).select(
        F.lit("a@x").alias("who"), F.lit(0).alias("src_rank"), F.lit("2024-01-01 00:00:00").alias("event_time"), F.col("id").alias("ord"),
        F.struct(F.concat(F.lit("t"), F.col("id")).alias("request_timestamp")).alias("matched_request"))
    found = K.matched_requests(rows, []).agg(F.count("*"), F.max("i")).first()
    assert tuple(found) == (400, 400) and K.matched_requests(rows, [], 7).count() == 7


def test_requests_in_any_spelling(table):
    rows = table([{"local_date": "2024-01-10", "timestamp": t} for t in ("2024-01-10T10:00:00Z", "2024-01-10 10:00:00", "2024-01-10T23:59:59.123456789Z", "2024-01-11T00:00:01Z", "2024-01-09T23:59:59Z")])
    bounds = ("2024-01-10 00:00:00", "2024-01-10 23:59:59")
    assert S.requests_for_day(rows, "2024-01-10", *bounds).count() == 3 and S.requests_for_range(rows, *bounds).count() == 3
    assert S.requests_for_range(rows, "2024-01-10T00:00:00Z", "2024-01-10T23:59:59Z").count() == 3


def test_nanoseconds_are_cut(table):
    row = table([{"t": "2024-01-01T00:00:00.123456789Z"}]).select(parse_time("t").alias("t")).first()
    assert row.t.microsecond == 123456


def test_database_user_list_spares_object_events(table):
    rows = table([{"eventSource": V.OBJECT_SOURCE, "userName": "listed", "db_username": None}, {"eventSource": None, "userName": "listed", "db_username": None}, {"eventSource": None, "userName": None, "db_username": "listed"}])
    assert [bool(r[0]) for r in rows.select(W.db_user_listed(["listed"])).collect()] == [False, True, True]


def test_typed_requests_have_no_chat_user(table):
    rows = table([{"received_epoch": 1_700_000_000, "user_id": "U1", "user_name": "n", "jira_issue_id": "A-1", "justification": "j", "duration_minutes": 30, "mail": "m@x"}])
    typed, dialog = Q.request_rows(rows, "UTC", 1).first(), Q.request_rows(rows, "UTC", 1, "mail").first()
    assert (typed.user_id, typed.user_name, typed.user_email) == (None, None, "n")
    assert (dialog.user_id, dialog.user_name, dialog.user_email) == ("U1", "n", "m@x") and typed.request_id == dialog.request_id


def test_broken_deliveries_are_told(table):
    good = json.dumps({"logGroup": "g", "logEvents": [{"timestamp": 0, "message": "m"}]}).encode()
    data = {"ok": gzip.compress(good), "plain": good, "cut": gzip.compress(good)[:-9], "json": b"{broken", "other": b'{"a": 1}'}
    rows = [{"id": k, "data": base64.b64encode(v).decode()} for k, v in data.items()] + [{"id": "text", "data": "%%%"}, {"id": "empty", "data": ""}, {"id": "none", "data": None}]
    frame = table(rows)
    assert sorted(r.id for r in D.decode_deliveries(frame).collect()) == ["ok", "plain"]
    assert {r.id: r.problem for r in D.rejected_deliveries(frame).collect()} == {"cut": "broken gzip", "json": "no log events", "other": "no log events", "text": "not base64"}


def test_index_round_trip(spark, table, tmp_path):
    row = {c: f"{c} \"a, b\"\nsecond ü" for c in V.EVIDENCE_COLUMNS} | {"doc_type": "none", "link": 'https://x/?q="a, b"'}
    sinks.write_index(table([row], strings=V.EVIDENCE_COLUMNS), str(tmp_path / "i"), single_file=True)
    back = files.read_index(spark, str(tmp_path / "i")).collect()
    assert [r.asDict() for r in back] == [row]


def test_no_folder_of_one_machine():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        runner.scratch(unset, "x")


def test_inflated_text_is_handed_on_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(D, "HANDED_ON", 50_000)
    raw = [gzip.compress(bytes([65 + k % 26]) * 10_000) if k % 7 else None for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(raw, pa.binary())], ["id", "raw"])
    parts = list(D._inflate(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) < 10 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))
    told = [t for p in parts for t in zip(p.column(1).to_pylist(), p.column(2).to_pylist())]
    assert told == [(chr(65 + k % 26) * 10_000, None) if k % 7 else (None, "not base64") for k in range(200)]
