"""What tickets and the violations below them shuffle and compute, and that sparing it changes nothing."""

from pyspark.sql import functions as F

from attestry.operators import correlate as C
from attestry.operators import tickets as K
from attestry.operators.joins import salted_left_join
from attestry.plans.reconcile import Settings, reconcile
from attestry_queries import access as A
from attestry_queries import reports as Q
from attestry_queries.fixtures import Inputs
from attestry_queries.reports import PERIOD

DATA = "/root/testdata/sf0.001"


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_log_makes_no_attachment(spark):
    records = K.tickets(A.violations(Inputs(spark, DATA)), PERIOD, "run", "SEC", "Task", ["audit"], by=[])
    plan = optimized(K.ticket_log(records, PERIOD, {"generated_at": "run"}))
    assert "base64(" not in plan and "json_bytes" not in plan and "collect_list(struct(src_rank" not in plan


def test_log_counts_attachments(spark):
    kind = "project_key string, issue_type string, summary string, assignee string, labels array<string>, description string, attachments array<struct<filename:string,content:string>>"
    rows = [("P", "T", "s", "a", ["l"], "text", [("f", "c"), (None, None)]), ("P", "T", "s", None, [], "é", [])]
    log = K.ticket_log(spark.createDataFrame(rows, kind), PERIOD, {"generated_at": "run"})
    got = log.select(*[F.get_json_object("record", f"$.{c}") for c in ("ticket_type", "description_length", "attachments_count")]).collect()
    assert [tuple(r) for r in got] == [("Human Violation Ticket", "4", "2"), ("Non-Human Violation Ticket", "1", "0")]


def test_day_keys_are_not_repeated(spark):
    t = Inputs(spark, DATA)
    plan = optimized(reconcile(A.named_objects(t), A.curated(t), A.requests(t), None, A.SETTINGS))
    assert plan.count("false, [_salt") == 0  # issuances and requests, eight times each, before
    carried = optimized(reconcile(A.named_objects(t), A.curated(t), A.requests(t), None, Settings(carry_over=True)))
    assert "false, [_salt" in carried  # a person's key of all days may be hot


def test_rows_without_key_stay_spread(table):
    big = table([{"ord": i, "k": "a" if i < 3 else None} for i in range(2000)])
    joined = salted_left_join(big, table([{"k": "a", "v": "x"}]), ["k"], "ord", salts=1)
    assert {r["v"]: r["n"] for r in joined.groupBy("v").agg(F.count("*").alias("n")).collect()} == {"x": 3, None: 1997}
    plan = optimized(joined)
    assert "_salt" in plan.split("Join LeftOuter")[1].split("\n")[0].split("AND")[-1] and "= 0)" not in plan.split("\n")[1]


def test_stamps_of_requests_are_read_few_times(spark):
    known = C.requests_by_identifier(A.requests(Inputs(spark, DATA)))
    assert optimized(C.access_spans(known, ["ident", "local_date"], "UTC")).count("RLIKE(") <= 8  # 16 before


def test_spans_of_stamps_spelled_differently(table):
    rows = [("2024-01-02 03:00:00", 10), ("2024-01-02 03:00:00", None), ("2024-01-02T03:00:00Z", 30), ("2024-01-02 03:40:00", -5), ("", 5), ("junk", 5), (None, 5)]
    asked = table([{"ident": "a", "local_date": "2024-01-02", "timestamp": s, "duration_minutes": d} for s, d in rows],
                  "ident string, local_date string, timestamp string, duration_minutes int")
    for keys, zone in ((["ident", "local_date"], "UTC"), (["ident"], None)):
        spans = C.access_spans(asked, keys, zone)
        assert [tuple(r) for r in spans.select(F.unix_seconds("lo"), F.unix_seconds("hi")).collect()] == [(1704164400, 1704166200)]


def test_columns_of_neither_source_stay_out(spark):
    t = Inputs(spark, DATA)
    found = reconcile(A.named_objects(t), A.curated(t), A.requests(t), t["fx_owner_tags"], A.SETTINGS)
    plan = optimized(found)
    assert "errorCode#" not in plan and "accessKeyId#" not in plan
    told = reconcile(A.named_objects(t).withColumn("errorCode", F.lit(" E1 ")), A.curated(t), A.requests(t), t["fx_owner_tags"], A.SETTINGS)
    assert told.schema == found.schema
    codes = {tuple(r) for r in told.select("src_rank", "evidence.s3_error_code", "evidence.access_key_id").distinct().collect()}
    assert codes == {(0, "E1", None), (1, None, None)}


def test_attachments_keep_every_row_of_a_busy_group(table):
    """A group that holds nearly all rows, and one without a person: each row once, in list order."""
    rows = [{"ord": i, "who": "" if i % 50 else "a@b.c", "src_rank": i % 2, "event_time": f"2024-01-02 03:{i % 60:02d}:00", "json": f'{{"ord":{i}}}',
             "actor_type": "UNKNOWN", "type": "T", "resource_arn": "r", "description": "d"} for i in range(1000)]
    frame = table(rows)
    full = K.attachments(frame, K.group_totals(frame, []), [])
    items = F.from_json(F.get_json_object("content", "$.violations"), "array<struct<ord:bigint>>")
    got = {r["who"]: [x["ord"] for x in r["v"]] for r in full.select("who", items.alias("v")).collect()}
    for who in ("", "a@b.c"):
        mine = [r for r in rows if r["who"] == who]
        mine.sort(key=lambda r: r["ord"])
        mine.sort(key=lambda r: r["event_time"], reverse=True)
        mine.sort(key=lambda r: r["src_rank"])
        assert got[who] == [r["ord"] for r in mine]


def test_requests_of_a_day_are_met_once(spark):
    t = Inputs(spark, DATA)
    plan = optimized(reconcile(A.named_objects(t), A.curated(t), A.requests(t), None, A.SETTINGS))
    met = [line for line in plan.split("\n") if "Join LeftOuter" in line and "ident#" in line and "_salt#" in line]
    assert len(met) == 1 and "hour#" not in met[0]  # windows by person, day and hour, then requests, before


def test_day_lookup_agrees_with_two_joins(table):
    asked = table([dict(zip(("request_id", "user_email", "local_date", "timestamp", "duration_minutes"), r)) for r in [
        ("1", " A@b.c", "2024-01-02", "2024-01-02 03:50:00", 30), ("2", "a@b.c", "2024-01-02", "2024-01-02 04:10:00", 120),
        ("3", "a@b.c", "2024-01-02", "2024-01-02 23:50:00", 60), ("4", "a@b.c", "2024-01-03", "2024-01-03 00:20:00", None),
        ("5", "d@b.c", "2024-01-02", None, 5), ("6", "d@b.c", "2024-01-02", "junk", 5), ("7", "e@b.c", None, "2024-01-02 05:00:00", 5),
        ("8", "f@b.c", "2024-01-02", "2024-01-02 05:00:00", -5), ("9", "", "2024-01-02", "2024-01-02 05:00:00", 900)]],
        "request_id string, user_email string, local_date string, timestamp string, duration_minutes int").withColumns(
        {"jira_issue_id": F.concat(F.lit("P-"), "request_id"), "justification": F.lit("w")})
    times = [f"2024-01-0{d} {h:02d}:{m:02d}:00" for d in (2, 3) for h in (0, 3, 4, 5, 6, 23) for m in (0, 10, 20, 50, 59)] + [None]
    rows = [{"user_id": u, "event_ts": s, "local_date": s[:10] if s else day} for u in ("a@b.c", "d@b.c", "e@b.c", "f@b.c", "x@b.c", "", None)
            for s in times for day in ("2024-01-02", None)]
    events = table([{"ord": i, **r} for i, r in enumerate(rows)], "ord bigint, user_id string, event_ts string, local_date string").withColumn(
        "event_ts", F.col("event_ts").cast("timestamp"))
    found = lambda df: {r["ord"]: (r["covered"], r["matched_request"]) for r in df.select("ord", "covered", "matched_request").collect()}
    got = found(C.with_day_lookup(events, asked, "UTC"))
    assert got == found(C.match_requests(events, asked, "UTC")) and len(got) == len(rows)
    assert sum(c for c, _ in got.values()) > 10


def test_only_what_a_query_shows_is_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(Q, "stored", lambda df, name: kept.append(df.columns) or df)
    for name in ("f26_ticket_body", "f29_ticket_log", "f27_attachment_rows", "f28_tickets"):
        Q.QUERIES[name](spark, DATA)
    assert ["evidence" in c for c in kept] == [False, False, False, True]
    assert ["matched_request" in c for c in kept] == [True, True, False, True]


def test_rows_meet_only_groups_over_the_limit(table):
    """Rows are shuffled once, to be gathered: no sub-keys, no list of all groups."""
    rows = [{"ord": i, "who": w, "src_rank": 0, "event_time": f"2024-01-02 03:{59 - i % 60:02d}:00", "json": f'{{"ord":{i}}}', "actor_type": "UNKNOWN",
             "type": "T", "resource_arn": "r", "description": str(i)} for w, n in (("", 40), ("a@b.c", 3)) for i in range(n)]
    frame = table(rows)
    files = K.attachments(frame, K.group_totals(frame, []), [], limit=200)
    assert "_salt" not in optimized(files) and "strategy=broadcast" in optimized(files)
    got = {r["who"]: r for r in files.select("who", "fits", F.get_json_object("content", "$.violations").alias("all"),
                                             F.get_json_object("content", "$.violation_summary[*].description").alias("brief")).collect()}
    assert got["a@b.c"]["fits"] and got["a@b.c"]["all"] == '[{"ord":0},{"ord":1},{"ord":2}]'
    assert not got[""]["fits"] and got[""]["all"] is None and got[""]["brief"] == str([str(i) for i in range(10)]).replace("'", '"').replace(" ", "")
