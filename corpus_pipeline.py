"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result
is written as Parquet and read again, in place of that of the stage before. Labels come from the labels table of ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestry.llm import jaccard, packing, quality, suffixes, toxicity
from attestry.llm.shared import discard, stored, table

TOXIC_FROM, GOOD_FROM = 0.3, 0.5
#: Bytes that a task hands to its Python worker at once; they stand in both, and Spark's own limit is 64 MB.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches by bytes where the session sets no limit of its own; the setting goes again afterwards."""
    own = spark.conf.get(BATCH_LIMIT, None) is None
    if own:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH_LIMIT)


def _row() -> Column:
    """256 bits, so that no document goes for the hash of another."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat_ws(":", part("doc_id"), part("text")), 256))


def _kept(docs: DataFrame, scored: DataFrame, rejected) -> DataFrame:
    """Documents without those that a score rejects, by a digest of id and text."""
    out = stored(scored.where(rejected).select("__row").distinct(), "rejected")
    out = F.broadcast(out) if out.count() <= jaccard.SENT_ROWS else out
    return docs.withColumn("__row", _row()).join(out, "__row", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    keyed = docs.select(_row().alias("__row"), "text")
    return _kept(docs, toxicity.score(keyed, model), F.col("score") >= TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    keyed = docs.select(_row().alias("__row"), "text")
    return _kept(docs, quality.score(keyed, rules), F.col("score") < GOOD_FROM)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more)."""
    return jaccard.keep_one(docs, n=5, percent=80)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier; documents of which nothing is left go."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, measured in words, in sequences of several lengths."""
    return packing.pack(docs.select("doc_id", "lang", "source", packing.word_count("text").alias("n_words")), "n_words", ["doc_id", "n_words"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each),
    ("repeated passages", cut_passages),
    ("packing", pack_documents),
]

#: No SQL: learned scores, connected groups, passages and best fit are compared with brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, last = table(spark, sf_dir, "documents"), []
    with _small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            discard(*last)
            last = [docs]
    return docs
