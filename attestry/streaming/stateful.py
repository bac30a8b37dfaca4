"""Streams that remember: the first copy of an event, requests until their retention ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import logs as L

#: State of sessions is kept there, outside the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_copies(events: DataFrame, delay: str = "1 hour", order: tuple[str, ...] = ("ingest_ts", "ord")) -> DataFrame:
    """Of all copies of an event the first by ``order``, once no more can come.

    A copy has the event's own time, so all copies of a key leave together when the watermark
    passes that time; which delivery brought them, and in which order a batch read them, does
    not matter.  Copies are reduced before the shuffle and in the state to one row for each
    key, so a key delivered very often stays one row for each map task.  A copy that comes
    after its key has left is late and is dropped by the watermark.
    """
    keys = [*L.DEDUP_KEY, "event_ts"]
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return events.withWatermark("event_ts", delay).groupBy(*keys).agg(first).select(*keys, "_first.*")


def forgotten_requests(requests: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Requests whose retention has run out by the watermark; state holds the others.

    ``requests``: request_id, ttl (epoch seconds), event_ts.  Event time decides, as in the
    batch form, so a replay forgets the same requests.  A request's retention is a session
    from its time to its end: one seen again before its end is kept until the later end, one
    seen again after it is remembered anew and given back once more.  An end that is not
    after the request's own time counts as reached once the watermark passes that time.
    Requests without an end are never remembered.  Sessions are merged and ended by Spark's
    own state, so no row passes through Python.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = requests.where("ttl is not null").withWatermark("event_ts", delay)
    left = F.greatest(F.col("ttl") - F.col("event_ts").cast("double"), F.lit(1e-6)).cast("decimal(18,6)")
    session = F.session_window("event_ts", F.make_interval(secs=left))
    return known.groupBy("request_id", session).agg(F.max("ttl").alias("ttl")).select("request_id", "ttl")


def remembered_requests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Requests that the stream of a checkpoint still holds, read from its state, each with its latest end."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.groupBy(F.col("key.request_id").alias("request_id")).agg(F.max("value.max").alias("ttl"))
