"""Features, weights, noise and ranks against plain Python."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import resampling as R

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = ["Hello World é-x", None, "", "a" * 30 + " bb " + "c" * 100 + " D", "漢字 x y z", "one", "  ", "q w " * 2000, "é" * 3000 + " tail " + "z" * 40]


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("most", [5, 64, 1 << 21])
def test_buckets_of_words_and_pairs(most):
    found = [[] for _ in TEXTS]
    for single, pair, word_of, pair_of in R.hashed_features(pa.array(TEXTS), most):
        for codes, texts in ((single, word_of), (pair, pair_of)):
            for code, text in zip(codes, texts):
                found[text].append(int(code))
    assert [sorted(f) for f in found] == [sorted(zlib.crc32(f.encode()) % R.BUCKETS for f in features(t)[1]) for t in TEXTS]


def brute(documents, target):
    def counts(texts):
        out = [0] * R.BUCKETS
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % R.BUCKETS] += 1
        return out

    s, t = counts(x for _, x in documents), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + R.BUCKETS) / ((a + 1) * (sum(t) + R.BUCKETS)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in documents:
        words, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % R.BUCKETS] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    long = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(long[: 25 * len(long) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def documents():
    out = [(k, " ".join(f"w{(k * 7 + j * j) % 50}" for j in range(k % 60))) for k in range(400)]
    return out + [(None, "a b " * 30)] * 3 + [(5, "same words " * 20)] * 200 + [(k, t) for k, t in enumerate(TEXTS, 1000)]


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_every_row_equals_brute_force(spark, partitions):
    rows, target = documents(), ["w1 w2 w3", "w4 w5", None, ""]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, score string, rank int").repartition(5)
        out = R.resampled(frame, spark.createDataFrame([(x,) for x in target], "text string"))
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows, target)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_segments_stay_even_when_scores_and_ids_are_one(spark):
    """Ties of equal rows are cut by their place, so that no segment grows with them."""
    frame = spark.range(20_000).select(F.lit(3).cast("long").alias("score"), F.lit(1).cast("long").alias("doc_id")).repartition(8)
    runs = R.stored(frame.withColumn("__at", F.monotonically_increasing_id()), "runs")
    ranks = [r["rank"] for r in R.ranked(runs, 20_000, 5_000).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 5_001)) and len(ranks) == 20_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.resampled(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [r["rank"] for r in R.resampled(some, none).collect()] == [None]
