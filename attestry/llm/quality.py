"""Quality scores from a sparse rule ensemble.

Small boosted trees on text statistics are grown on a bounded sample of labelled rows;
every path to a node is a conjunctive rule; a lasso-penalised logistic regression keeps
few of them; these compile to one Spark column expression over the statistics.

Null texts count as empty; empty texts have zero statistics and a score like any other.
Without labelled rows of both kinds the score is the share of good rows, or one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.shared import apart, lean

from attestry.llm.words import Words, groups, text_bytes

#: At most so many labelled rows are learned from, the first by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 20, 3, 48, 20, 0.3
PENALTY, STEPS = 2e-3, 600

STATISTICS = (
    "n_bytes", "n_words", "mean_word", "longest_word", "upper", "digits", "blanks", "other_bytes", "periods", "commas", "exclaims", "bars", "symbols",
    "marks", "lines", "words_a_line", "short_words", "long_words", "distinct_words", "repeats_before", "marked_ends",
)

_KIND = np.zeros(256, dtype=np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", bytes(range(128, 256)), b".", b",", b"!", b"|", b"#$%&*@^~+=<>\\`", b"?:;\"'()[]{}-_/"), 1):
    _KIND[list(_chars)] = _k
_KINDS = 11


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; shares are of bytes or of words."""
    words = Words(data, offsets)
    n, size = len(offsets) - 1, np.diff(offsets)
    doc_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    lines = np.bincount(doc_of[data == 10], minlength=n) + 1.0
    count, bytes_ = words.count.astype(float), size.astype(float)
    some, any_ = np.maximum(count, 1), np.maximum(bytes_, 1)
    long = (words.end - words.start).astype(float)
    by_doc = lambda x: np.bincount(words.doc, weights=x, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, words.doc, long)
    hashes = words.hashes()
    keys = np.sort((words.doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    distinct = np.bincount((keys[fresh] >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]))) if len(keys) else np.zeros(0, bool)
    last = _KIND[data[words.end - 1]] if len(keys) else np.zeros(0, np.uint8)
    share = kinds / any_[:, None]
    return np.column_stack([
        bytes_, count, by_doc(long) / some, longest, share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], kinds[:, 7] / some, kinds[:, 8] / some,
        kinds[:, 9] / some, share[:, 10], lines, count / lines, by_doc(long <= 2) / some, by_doc(long >= 15) / some, distinct / some, by_doc(again) / some, by_doc(last >= 7) / some,
    ])


def with_statistics(frame: DataFrame, text: str) -> DataFrame:
    """Replace ``text`` by the statistics of its whole content."""
    kept = [c for c in frame.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in groups(offsets)]
            table = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            arrays = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *arrays], [*kept, *STATISTICS])

    types = ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept), *(f"{s} double" for s in STATISTICS)])
    return frame.select(*kept, text).mapInArrow(lean(run), types)


Condition = tuple[int, bool, float]  # statistic, whether at most, threshold


@dataclass
class Rules:
    """Weighted conjunctions of conditions, and the constant."""

    rules: list[tuple[tuple[Condition, ...], float]]
    constant: float

    def score(self) -> Column:
        """The probability of a good text as a column over the statistics."""
        total = F.lit(self.constant)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, at_most, threshold in conditions:
                value = F.col(STATISTICS[k])
                holds = holds & ((value <= threshold) if at_most else (value > threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree_paths(x: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Grow one tree on gradients; the paths to all its nodes and its outputs."""
    paths, outputs = [], np.zeros(len(x))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        g, h = slope[rows].sum(), curve[rows].sum()
        best = (1e-6, -1, -1)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for k, edge in enumerate(edges):
                if not len(edge):
                    continue
                b = binned[rows, k]
                number = np.bincount(b, minlength=len(edge) + 1).cumsum()[:-1]
                gl = np.bincount(b, weights=slope[rows], minlength=len(edge) + 1).cumsum()[:-1]
                hl = np.bincount(b, weights=curve[rows], minlength=len(edge) + 1).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(number < LEAST_ROWS) | (len(rows) - number < LEAST_ROWS)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, at)
        if best[1] < 0:
            outputs[rows] = g / (h + 1)
            return
        _, k, at = best
        threshold = float(edges[k][at])
        left = binned[rows, k] <= at
        grow(rows[left], (*path, (k, True, threshold)))
        grow(rows[~left], (*path, (k, False, threshold)))

    grow(np.arange(len(x)), ())
    return paths, outputs


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _lasso(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights under an absolute penalty, by accelerated proximal steps."""
    full = np.column_stack([rows, np.ones(len(rows))])
    step = 4 * len(y) / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = ahead = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(STEPS):
        moved = ahead - step * (full.T @ (_sigmoid(full @ ahead) - y)) / len(y)
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * PENALTY, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = moved + (t - 1) / after * (moved - w), moved, after
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules of boosted trees with lasso weights, from statistics and labels 0 or 1."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 0.01), 0.99)
        return Rules([], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    edges = [e[e < x[:, k].max()] for k, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    total, found = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(TREES):
        p = _sigmoid(total)
        paths, outputs = _tree_paths(x, edges, binned, y - p, p * (1 - p))
        found |= dict.fromkeys(paths)
        total = total + RATE * outputs
    rules = list(found)
    if not rules:
        return Rules([], float(np.log(share / (1 - share))))
    holds = np.ones((len(y), len(rules)))
    for j, conditions in enumerate(rules):
        for k, at_most, threshold in conditions:
            holds[:, j] *= (x[:, k] <= threshold) if at_most else (x[:, k] > threshold)
    weights, constant = _lasso(holds, y)
    return Rules([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], constant)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text and label of at most ``most`` labelled rows that aren't held out, chosen by a hash of the id.

    A document with differing labels counts with the larger one. Of rows that share an id the text with the
    smallest hash stands for all, so the bound holds for rows too.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % parts != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("__label").alias("__label"))


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Rules:
    """Learn rules from labels.quality of rows whose crc32(doc_id as text) mod 3 is not 1."""
    rows = with_statistics(labelled_sample(documents, labels, "quality", 3, 1, most), "text").orderBy("doc_id").toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["__label"].to_numpy(float))


def score(documents: DataFrame, rules: Rules, text: str = "text", column: str = "score") -> DataFrame:
    """Add a score to every row; the other columns but the text stay, one named like the score with ``_input`` behind it."""
    run = lambda frame: with_statistics(frame, text).withColumn(column, rules.score()).drop(*STATISTICS)
    return apart(documents, [*STATISTICS, column], run, [text])


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
