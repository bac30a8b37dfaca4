"""Streaming forms of ingest, alarms and reconciliation.

They reuse the batch expressions; only watermarks and state are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import blank_to_null, col
from attestry.functions.times import parse_time
from attestry.operators import correlate as C
from attestry.operators import logs as L
from attestry.operators.alarms import Alarm, alarms
from attestry.operators.joins import SALTS
from attestry.operators.whitelist import monitored_databases


def parsed_stream(lines: DataFrame, databases: str = "") -> DataFrame:
    """Log lines to keyed events (T1, T2).  ``lines``: message, ingest_ts and more."""
    parsed = monitored_databases(L.parse_lines(lines), databases)
    return L.with_dedup_key(parsed).withColumn("event_ts", parse_time("event_time_norm"))


def deduplicated_stream(events: DataFrame, delay: str = "1 hour", spread: str | None = None, salts: int = SALTS) -> DataFrame:
    """One event per key across deliveries while the watermark remembers it.

    The key holds the event's own time, so copies share their time and meet in
    the remembered span, and state is bounded by ``delay``.  With a ``spread``
    column, copies are first thinned out in ``salts`` shares per key, so a key
    delivered a great many times does not meet in one task.
    """
    df = events.withWatermark("event_ts", delay)
    if spread:
        share = F.pmod(F.xxhash64(spread), F.lit(salts))
        df = df.withColumn("_share", share).dropDuplicatesWithinWatermark([*L.DEDUP_KEY, "_share"]).drop("_share")
    return df.dropDuplicatesWithinWatermark(L.DEDUP_KEY)


def sink_stream(events: DataFrame, channel_arn: str) -> DataFrame:
    return L.sink_records(events, channel_arn)


def alarm_stream(samples: DataFrame, by: list[str], rule: Alarm = Alarm(), delay: str = "10 minutes") -> DataFrame:
    """Consecutive-breach alarms on a stream (T5): the batch plan behind a watermark."""
    return alarms(samples.withWatermark("ts", delay), by, rule)


def request_windows_stream(requests: DataFrame, zone: str, delay: str) -> DataFrame:
    """Access windows cut at hours, so each piece lives an hour at most."""
    known = C._windows(C.requests_by_identifier(requests)).where("win_start is not null")
    first, following = C.day_bounds("local_date", zone)
    known = known.withColumns({"win_start": F.greatest("win_start", first), "win_end": F.least("win_end", following)})
    pieces = known.where("win_start <= win_end").select(
        "ident", "local_date", "win_start", "win_end",
        F.explode(F.sequence(C._hour("win_start"), C._hour("win_end"))).alias("hour"))
    return pieces.select(
        col("ident").alias("w_ident"), col("local_date").alias("w_date"), col("hour").alias("w_hour"),
        F.greatest("win_start", F.timestamp_seconds(col("hour") * C.HOUR)).alias("lo"),
        F.least("win_end", F.timestamp_seconds((col("hour") + 1) * C.HOUR)).alias("hi"),
    ).withWatermark("lo", delay)


def reconcile_stream(events: DataFrame, requests: DataFrame, zone: str, delay: str = "1 hour") -> DataFrame:
    """Events with the window piece that covers them, or nulls once none can come.

    A left outer interval join on (person, day, hour): an event waits until the
    watermarks rule out a covering window.  The window test is on event time, so
    a late request never excuses an earlier access.  An event in two overlapping
    windows comes out once for each.  Events without a person match nothing and
    pass by the join, so they are neither buffered nor gathered under one null
    key.  ``events``: ord, user_id, event_ts, local_date.
    """
    named = events.select(
        "ord", "user_id", "event_ts", blank_to_null("user_id").alias("ident"), "local_date", C._hour("event_ts").alias("hour"))
    nobody = named.where("ident is null").select("ord", "user_id", "event_ts", F.lit(False).alias("covered"))
    left = named.where("ident is not null").withWatermark("event_ts", delay)
    right = request_windows_stream(requests, zone, delay)
    inside = (
        (col("ident") == col("w_ident")) & (col("local_date") == col("w_date")) & (col("hour") == col("w_hour"))
        & (col("event_ts") >= col("lo")) & (col("event_ts") <= col("hi"))
        & (col("event_ts") <= col("lo") + F.expr("interval 1 hour"))
    )
    joined = left.join(right, inside, "left_outer")
    return joined.select("ord", "user_id", "event_ts", col("lo").isNotNull().alias("covered")).unionByName(nobody)
