"""Where streams keep their state and results, and how they run to the end of their input."""

from __future__ import annotations

import threading
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    There is no fallback: a folder of one machine can't be read by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir, or the context's checkpoint folder, to a place that all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that has landed, write Parquet exactly once, read it back (T4).

    The file sink's commit log makes retried batches harmless.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_sink(stream: DataFrame, path: str, checkpoint: str, write=None) -> None:
    """Run a stream into ``foreachBatch`` batches kept in folders by batch number.

    A retried batch overwrites its own folder, so nothing is written twice.
    """

    def default(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write or default).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


class ObservedTotals(StreamingQueryListener):
    """Sums of what the observed metrics of a stream's batches counted."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter[str]] = {}
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            self.totals.setdefault(name, Counter()).update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.set()

    def wait(self, seconds: float = 60) -> dict[str, dict[str, int]]:
        """The totals after the stream has ended; progress is told a little later than it happens."""
        if not self._ended.wait(seconds):
            raise TimeoutError("the end of the stream was not told")
        return {name: dict(counts) for name, counts in self.totals.items()}


def run_observed(stream: DataFrame, path: str, checkpoint: str) -> dict[str, dict[str, int]]:
    """Process everything that has landed and return the totals of the metrics that the stream observes."""
    told = ObservedTotals()
    stream.sparkSession.streams.addListener(told)
    try:
        run_available(stream, path, checkpoint)
        return told.wait()
    finally:
        stream.sparkSession.streams.removeListener(told)


def run_counted(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """As ``run_available``, with the number of rows that this run read: after a restart only those of new files (T4)."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), read
