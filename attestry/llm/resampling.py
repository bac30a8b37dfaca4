"""Importance resampling towards a target: array-scored weights, ranks by parallel sorting with regular samples.

Hashed runs of one and two words are counted over all documents and over all target texts.
The gain of each bucket is an array of fixed length that every task gets; a document's weight
is the floored mean of the gains of its features. Weight plus Gumbel noise, which depends only
on the id, makes the highest scores a draw without replacement.

Ranks come from parallel sorting by regular sampling. Every partition is sorted where it is and
stored: a run. Every so many rows of each run are a sample; each ``OVERSAMPLE``-th of the
sorted samples is a splitter. The rows between two splitters, one segment from each run, meet in one task and
are merged there, and the counts before a segment give the exact rank of its rows. Segments
past the last rank drawn are never exchanged. Between two splitters lie at most
(OVERSAMPLE + runs) * stride rows, whatever the scores are: ties, also of equal rows, are
ordered by id and place in the run.

Rules for odd input: a null text has no words; a document without words has weight 0. A null
id is drawn with the noise of an empty id and stands last among equal scores. Equal rows are
documents of their own. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestry.llm.crc_sql import CRC_TABLE_SQL, crc_sql
from attestry.llm.shared import stored
from attestry.llm.words import GROUP_BYTES, groups, text_bytes

BUCKETS = 10_000
SEED = 7
SHARE = 25
LEAST_WORDS = 20
#: Samples for each splitter; the driver sees so many for each shuffle partition.
OVERSAMPLE = 32
#: Words of more bytes are hashed one by one.
SHORT = 24

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_START = np.uint32(0xFFFFFFFF)


def _remainders() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out.astype(np.uint32)


_CRC = _remainders()


def _extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, order: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """CRC states continued by the bytes of the words from ``start``; ``longer[k]`` words of ``order`` have more than k bytes."""
    own, at = state[order], start[order]
    for k, n in enumerate(longer):
        own[:n] = _CRC[(own[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (own[:n] >> np.uint32(8))
    out = np.empty_like(own)
    out[order] = own
    return out


def _codes(data: np.ndarray, offsets: np.ndarray, carry: np.uint32 | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint32 | None]:
    """Hashes of the words and of the pairs of words of some texts, with the text of each, and the state after the last word.

    ``carry`` is that state for a text that goes on, else none.
    """
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), text, carry
    size = ends - starts
    short = np.where(size <= SHORT, size, 0)
    order = np.argsort(-short, kind="stable")
    longer = np.searchsorted(-short[order], -np.arange(int(short.max())), side="left")
    single = _extend(np.full(len(starts), _START), data, starts, order, longer)
    long = np.flatnonzero(size > SHORT)
    for i in long:
        single[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
    before = np.concatenate(([_START if carry is None else carry], single[:-1])).astype(np.uint32)
    spaced = _CRC[(before ^ np.uint32(0x20)) & np.uint32(255)] ^ (before >> np.uint32(8))
    pair = _extend(spaced, data, starts, order, longer)
    for i in long:
        pair[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(spaced[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    goes_on = np.concatenate(([carry is not None], text[1:] == text[:-1]))
    return single ^ _START, np.where(goes_on, pair, 0) ^ _START, np.where(goes_on, text, ~text), single[-1]


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts that end between words."""
    a = 0
    while a < len(data):
        b = a + most
        while b < len(data) and _WORD[data[b]]:
            rest = np.flatnonzero(~_WORD[data[b : b + most]])
            b = b + int(rest[0]) if len(rest) else b + most
        yield data[a:b]
        a = b


def hashed_features(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of words, of pairs, and the text of each word and of each pair, in parts of bounded size."""
    data, offsets = text_bytes(texts)
    for first, last in groups(offsets, most):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        carry = None
        for piece in _pieces(part, most) if last == first + 1 else [part]:
            edges = np.array([0, len(piece)]) if last == first + 1 else offsets[first : last + 1] - offsets[first]
            single, pair, text, carry = _codes(piece, edges, carry if last == first + 1 else None)
            two = text >= 0
            text = np.where(two, text, ~text) + first
            yield single % BUCKETS, pair[two] % BUCKETS, text, text[two]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in a table's texts; one row per task and bucket meets in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for single, pair, _, _ in hashed_features(batch.column(0)):
                total += np.bincount(single, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths."""
    raw_all, target_all = int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (float(raw_all) + BUCKETS) / ((float(s) + 1) * (float(target_all) + BUCKETS))))
        for s, t in zip(raw, target)], dtype=np.int64)


def weighed(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            words, pairs, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for single, pair, word_of, pair_of in hashed_features(batch.column(1)):
                words += np.bincount(word_of, minlength=n)
                pairs += np.bincount(pair_of, minlength=n)
                for code, text in ((single, word_of), (pair, pair_of)):
                    total += np.bincount(text, weights=gain[code], minlength=n).astype(np.int64)
            features = words + pairs
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Noise of the id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    part = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(part))).cast("long")


def ranked(runs: DataFrame, n: int, most: int) -> DataFrame:
    """Rows of sorted, stored runs with ``rank`` for the ``most`` first, null for the others.

    Columns: score, doc_id, ``__at`` (run above, place in the run below) and more.
    """
    spark = runs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stride = max(1, n // (parts * OVERSAMPLE))
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    sampled = runs.where(place % stride == stride - 1).select("score", "doc_id", "__at").collect()
    keys = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["__at"]) for r in sampled)
    splitters = keys[OVERSAMPLE - 1 :: OVERSAMPLE]
    heads = np.array([s[0] for s in splitters], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = -batch.column("score").to_numpy(zero_copy_only=False)
            segment, after = np.searchsorted(heads, score, side="left"), np.searchsorted(heads, score, side="right")
            tied = np.flatnonzero(segment < after)
            some = batch.take(pa.array(tied))
            for i, doc, at in zip(tied, some.column("doc_id").to_pylist(), some.column("__at").to_pylist()):
                segment[i] = bisect_left(splitters, (int(score[i]), doc is None, doc or 0, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "__segment"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = runs.mapInArrow(run, f"{kinds}, __segment bigint")
    sizes = {r["__segment"]: r["count"] for r in dealt.groupBy("__segment").count().collect()}
    before, starts = 0, []
    for s in range(len(splitters) + 1):  # as many as there are splitters
        starts.append((s, before))
        before += sizes.get(s, 0)
    drawn = [x for x in starts if x[1] < most]
    if not drawn:
        return runs.withColumn("rank", F.lit(None).cast("long")).drop("__at")
    first = F.broadcast(spark.createDataFrame(drawn, "__segment bigint, __before bigint"))
    inner = F.row_number().over(Window.partitionBy("__segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "__at"))
    met = dealt.where(F.col("__segment") <= drawn[-1][0]).withColumn("__inner", inner).join(first, "__segment")
    rank = F.col("__before") + F.col("__inner")
    met = met.withColumn("rank", F.when(rank <= most, rank).cast("long"))
    rest = dealt.where(F.col("__segment") > drawn[-1][0]).withColumn("rank", F.lit(None).cast("long"))
    columns = [c for c in runs.columns if c != "__at"] + ["rank"]
    return met.select(columns).unionByName(rest.select(columns))


def resampled(documents: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with features, weight, score and, if drawn, its rank: ``share`` percent of those with ``least_words`` words."""
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scores = weighed(documents, gain).withColumn("score", F.col("weight") + gumbel(seed=seed))
    runs = scores.sortWithinPartitions(F.col("n_words") >= least_words, F.desc("score"), F.asc_nulls_last("doc_id"))
    runs = stored(runs.withColumn("__at", F.monotonically_increasing_id()), "runs")
    long = runs.where(F.col("n_words") >= least_words)
    n = long.count()
    out = ranked(long, n, share * n // 100)
    short = runs.where(F.col("n_words") < least_words).drop("__at").withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


_FEATURES = """{name}_words AS (SELECT {id} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {name}),
{name}_features AS (
  SELECT id, unnest(w) AS feature FROM {name}_words
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_words)"""

DRAWN_SQL = f"""
WITH {CRC_TABLE_SQL},
{_FEATURES.format(name="documents", id="doc_id")},
{_FEATURES.format(name="benchmark", id="item_id")},
hashed AS (SELECT feature, {crc_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT feature FROM documents_features UNION SELECT feature FROM benchmark_features), crc_table),
s AS (SELECT bucket, count(*) AS n FROM documents_features JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM benchmark_features JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((s.n::DOUBLE + 1) * (t_all + {BUCKETS})))) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM documents_features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN (SELECT id AS doc_id, w FROM documents_words) USING (doc_id) LEFT JOIN (SELECT id AS doc_id, n_features, weight FROM sums) USING (doc_id)),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""
