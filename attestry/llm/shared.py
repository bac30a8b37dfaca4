"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession


#: Spark removes the shuffle files of a query at its end, instead of when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only where no checkpoint folder is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='llm-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from its files: lineage ends here and lost executors cost no recomputation.

    What the write shuffled goes with it, as nothing else reads it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` returned, once nothing reads them any more."""
    for frame in tables:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives back the memory that it no longer uses.

    Spark keeps Python workers for later tasks; what the allocators hold of a stage would stay theirs through all stages that follow.
    """

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return trimmed


def apart(frame: DataFrame, made: Iterable[str], run: Callable[[DataFrame], DataFrame], used: Iterable[str] = ()) -> DataFrame:
    """``run`` on a frame whose columns with names that it makes (but for those it uses) are set aside meanwhile.

    They come back under their own name, or with ``_input`` behind it where the result has a column of that name.
    """
    names, used = {n.lower() for n in made}, {n.lower() for n in used}
    prefix = "__aside"
    while any(c.lower().startswith(prefix) for c in frame.columns):
        prefix += "_"
    hidden = {c: f"{prefix}{k}" for k, c in enumerate(frame.columns) if c.lower() in names and c.lower() not in used}
    if not hidden:
        return run(frame)
    out = run(frame.withColumnsRenamed(hidden))
    taken, back = {c.lower() for c in out.columns}, {}
    for name, aside in hidden.items():
        while name.lower() in taken:
            name += "_input"
        taken.add(name.lower())
        back[aside] = name
    return out.withColumnsRenamed(back)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
