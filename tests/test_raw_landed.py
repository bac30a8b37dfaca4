"""From declared stores to violations, and landed listings as a data source."""

import json

from pyspark.sql import functions as F

from attestry import schemas
from attestry.operators.scans import scan_object_events, with_event_number
from attestry.plans.reconcile import Settings, reconcile_raw
from attestry.sources import landed


def object_event(at, who="alice@example.com", name="GetObject", request="r1"):
    identity = ("AssumedRole", f"AROA:{who}", None, None, (("Reader",),))
    return (at, name, "s3.amazonaws.com", "Data", "eu", "10.0.0.1", "sdk", "1", request, identity, {"bucketName": "b", "key": "k"})


def test_declared_stores_reach_violations(spark):
    objects = spark.createDataFrame([
        object_event("2024-01-02 10:00:00"), object_event("2024-01-02 10:00:00"), object_event("2024-01-02T12:00:00Z"),
        object_event("2024-01-02 23:30:00", "bob@example.com"), object_event(None, "eve@example.com")], schemas.RAW_OBJECT_EVENT)
    extra = {"username": "v-carol", "auth_display_name": "oidc-carol@example.com", "lease_id": "L", "path": "database/creds/prod-ro"}
    curated = spark.createDataFrame([
        ("2024-01-02 08:00:00", ("VaultCredsIssued", extra)),
        ("2024-01-02 09:00:00", ("DbSessionConnect", {"db_username": "v-carol", "database": "d"}))], schemas.RAW_CURATED_EVENT)
    asked = spark.createDataFrame([("q", "2024-01-02 09:50:00", "2024-01-02", None, None, "alice@example.com", "P-1", "work", 30, None, None, None)], schemas.ACCESS_REQUEST)
    found = reconcile_raw(objects, curated, asked, settings=Settings(zone="Europe/Berlin"), start="2024-01-02 00:00:00", end="2024-01-02 23:59:59")
    rows = {(r.user_id, r.type, r.local_date) for r in found.collect()}
    assert rows == {("alice@example.com", "ACCESS_OUTSIDE_WINDOW", "2024-01-02"), ("bob@example.com", "UNAUTHORIZED_ACCESS", "2024-01-03"),
                    ("carol@example.com", "UNAUTHORIZED_ACCESS", "2024-01-02")}
    assert found.count() == 3 and reconcile_raw(objects.limit(0), None, asked).count() == 0


def test_numbers_follow_from_the_event_alone(spark):
    raw = spark.createDataFrame([object_event(f"2024-01-02 10:00:{k % 60:02d}", request=f"r{k}") for k in range(200)] + [object_event(None)], schemas.RAW_OBJECT_EVENT)
    once, again = (with_event_number(scan_object_events(raw.repartition(n)), "UTC").select("requestID", "eventTime", "ord", "local_date").collect() for n in (1, 7))
    number = {r.requestID: r.ord for r in once if r.eventTime}
    assert number == {r.requestID: r.ord for r in again if r.eventTime} and len(set(number.values())) == 200
    ordered = sorted((r for r in once if r.eventTime), key=lambda r: r.ord)
    assert [r.eventTime for r in ordered] == sorted(r.eventTime for r in ordered) and {r.local_date for r in ordered} == {"2024-01-02"}
    unread = [r for r in once if r.eventTime is None]
    assert all(r.local_date is None and 0 <= r.ord < 1 << 30 for r in unread)
    given = raw.withColumn("ord", F.lit(5)).withColumn("local_date", F.lit("d"))
    assert {(r.ord, r.local_date) for r in with_event_number(given, "UTC").collect()} == {(5, "d")}


def write(folder, name, *pages):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(p) if isinstance(p, dict) else p for p in pages))


def page(number, *ids, more=True, error=None):
    return {"page_no": number, "error": error, "results": {"data": [{"id": i, "name": f"C {i}"} for i in ids], "pageInfo": {"hasNextPage": more}}}


def test_listings_end_at_the_first_error_page(spark, tmp_path):
    controls = tmp_path / "controls"
    write(controls / "framework=A B%2FC", "p1.json", page(0, "1", "2"), "", page(1, "3"))
    write(controls / "framework=A B%2FC", "p2.json", page(2, error="boom"), page(3, "4", more=False))
    write(controls / "plain", "p1.json", page(0, "5", more=False), page(1, "6"))
    write(controls / "plain", "_SUCCESS", "")
    write(controls / "empty", "p1.json", "")
    write(controls / "_temporary", "p.json", page(0, "7"))
    write(controls / "nothing", "p.json", {"page_no": 0}, page(1, "8"))
    for together in (1, 3):
        items = landed.read_listings(spark, str(controls), together)
        rows = [(r.listing, r.page_no, r.item_no, r.item and r.item.id, r.error) for r in items.collect()]
        assert sorted(rows, key=str) == sorted([("A B/C", 0, 0, "1", None), ("A B/C", 0, 1, "2", None), ("A B/C", 1, 0, "3", None),
                                                ("A B/C", 2, None, None, "boom"), ("plain", 0, 0, "5", None)], key=str)
        assert items.rdd.getNumPartitions() == (4 if together == 1 else 2)
    assert [tuple(r) for r in landed.failed_listings(items).collect()] == [("A B/C", 2, "boom")]

    write(tmp_path / "documents" / "5", "p.json", page(0, "d1", "d2", more=False))
    write(tmp_path / "documents" / "9", "p.json", page(0, "d3", more=False))
    source = landed.LandedEvidence(spark, str(tmp_path))
    own = source.controls("plain")
    assert [(r.id, r.external_id, r.name) for r in own.collect()] == [("5", "", "C 5")]
    assert sorted((r.control_id, r.doc_id) for r in source.documents(own).collect()) == [("5", "d1"), ("5", "d2")]
