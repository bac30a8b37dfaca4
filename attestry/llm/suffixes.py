"""Repeated passages by sparse suffix arrays.

Of all suffixes only those at minimiser positions are kept: in every stretch of ``PASSAGE``
words, the start of the ``CORE`` words with the least hash. Equal passages keep the same
suffixes, whatever surrounds them, so a passage of ``PASSAGE`` words or more that stands
twice shares at least one. The kept suffixes are sorted over the whole table by their first
``CORE`` words and then by all the words that the stretches around them span; neighbours
are compared. A suffix that equals its neighbour over the whole span is a copy of it. One
that shares only the core is extended left and right, stretch by stretch, and these are
sorted and compared in the same way.

A stretch counts as repeated if it stands earlier: in a document with a smaller id, or
further left in the same one without overlapping. Repeated stretches that touch are one
passage. So the first copy of every passage stays, and passages are found to the word.

Words are runs of bytes other than space and tab to carriage return. Null, empty and short
texts hold no passage. Rows equal in doc_id and text count as one document; a null doc_id
comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestry.llm.shared import apart, lean, stored
from attestry.llm.words import Words, _power_tables, groups, mix, text_bytes

PASSAGE, CORE = 50, 25
STARTS = PASSAGE - CORE + 1
#: Rows up to which a list of documents is sent to all executors instead of shuffling the texts.
SENT_ROWS = 200_000
LAST = (1 << 63) - 1
_PLACE_BITS = np.uint64(26)


class Ranges:
    """Hashes of word ranges from sums over powers."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _power_tables(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def suffix_starts(words: Words, ranges: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept suffixes: the word where each starts, and the first and last stretch start that chose it."""
    n = len(words.start)
    if n < PASSAGE:
        return (np.zeros(0, np.int64),) * 3
    if n >= 1 << int(_PLACE_BITS):
        raise ValueError("a text of more than 64 million words has to be split first")
    at = np.arange(n - CORE + 1)
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    # ties fall to the leftmost, which depends on the stretch alone
    keys = (ranges.of(at, at + CORE) & ~low) | at.astype(np.uint64)
    size, span = 1, keys
    while 2 * size <= STARTS:
        span = np.minimum(span[:-size], span[size:])
        size *= 2
    if size < STARTS:
        rest = STARTS - size
        span = np.minimum(span[:-rest], span[rest:])
    # stretches that don't run into the next document
    starts = np.arange(n - PASSAGE + 1)
    starts = starts[starts + PASSAGE <= words.first[words.doc[starts] + 1]]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    chosen = (span[starts] & low).astype(np.int64)
    fresh = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (words.doc[starts[1:]] != words.doc[starts[:-1]])))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return chosen[first], starts[first], starts[last]


def _keyed(documents: DataFrame) -> DataFrame:
    """``doc`` and ``mark`` tell documents apart: the id, and a 64-bit hash of the text for repeated ids and rows without id."""
    return documents.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "mark": F.xxhash64("text")})


def _word_parts(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """First row, words and text offsets of each group of texts."""
    data, offsets = text_bytes(column)
    for a, b in groups(offsets):
        own = offsets[a : b + 1] - offsets[a]
        yield a, Words(data[offsets[a] : offsets[b]], own), own


def _parts(column: pa.Array) -> Iterator[tuple[int, Words, Ranges]]:
    for a, words, _ in _word_parts(column):
        yield a, words, Ranges(words.hashes())


def own_repeats(doc: np.ndarray, begin: np.ndarray, words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of suffixes with equal keys in one document, those to compare with others, and the passages repeated within.

    The first stays and so do all that overlap it: each has stretches of its own, and others may share only some of
    them. All that don't overlap the first repeat it, whatever other documents hold; they come back merged, as
    document, start and end.
    """
    keep = np.ones(len(key), dtype=bool)
    order = np.lexsort((begin, key))
    same = key[order][1:] == key[order][:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = order[twice]
    if not len(at):
        return keep, (np.zeros(0, np.int64),) * 3
    head = np.concatenate(([True], key[at][1:] != key[at][:-1]))
    first = begin[at][head][np.cumsum(head) - 1]
    overlaps = begin[at] - first < words[at]
    keep[at] = overlaps
    own = at[~overlaps]
    own = own[np.lexsort((begin[own], doc[own]))]
    if not len(own):
        return keep, (np.zeros(0, np.int64),) * 3
    far = np.int64(1) << 40
    ends = np.maximum.accumulate(doc[own] * far + begin[own] + words[own])
    fresh = np.concatenate(([True], doc[own][1:] * far + begin[own][1:] > ends[:-1]))
    return keep, (doc[own][fresh], begin[own][fresh], ends[np.concatenate((np.flatnonzero(fresh)[1:], [len(own)])) - 1] - doc[own][fresh] * far)


def _suffixes(documents: DataFrame) -> DataFrame:
    """core, span, doc, mark and place of kept suffixes; place packs start, words to the left and stretches.

    Rows with ``own_end`` are passages that repeat within their document, from place to there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0), batch.column(1)
            for a, words, ranges in _parts(batch.column(2)):
                start, first, last = suffix_starts(words, ranges)
                if not len(start):
                    continue
                own = words.doc[first]
                left, begin = start - first, first - words.first[own]
                core = ranges.of(start, start + CORE)
                span = mix(ranges.of(first, last + PASSAGE) + left.astype(np.uint64))
                keep, (own_doc, own_begin, own_end) = own_repeats(own, begin, last - first + PASSAGE, mix(core ^ mix(span + mix(own.astype(np.uint64)))))
                place = (begin + left) << 16 | left << 8 | (last - first)
                rows = pa.array(np.concatenate((own[keep], own_doc)) + a)
                none = np.zeros(len(own_doc), np.int64)
                ends = pa.array(np.concatenate((np.zeros(int(keep.sum()), np.int64), own_end)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((core.view(np.int64)[keep], none))), pa.array(np.concatenate((span.view(np.int64)[keep], none))), doc.take(rows), mark.take(rows),
                     pa.array(np.concatenate((place[keep], own_begin))), ends], [*ROW, "own_end"])

    return _keyed(documents).select("doc", "mark", "text").mapInArrow(lean(run), "core bigint, span bigint, doc bigint, mark bigint, place bigint, own_end bigint")


ROW = ("core", "span", "doc", "mark", "place")
FOUND = "core bigint, span bigint, doc bigint, mark bigint, place bigint, first_doc bigint, first_mark bigint, first_place bigint, shared boolean, edge boolean"


def _neighbours(rows: DataFrame, name: str) -> DataFrame:
    """Sort suffixes over the whole table and compare neighbours.

    Adds the first suffix with the same span, and whether others with the same core differ. Suffixes whose
    core stands alone are dropped. Rows of one core may lie on both sides of a partition's edge; of the cores
    at edges, the first row of every span in each partition is grouped once more.
    """

    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def told(part: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
        """Whole runs of equal cores, or parts of a run that counts as one at an edge.

        At edges only first rows, and those that overlap them, wait for the rows of other partitions.
        """
        core, span, doc, mark, place = part
        same_core = core[1:] == core[:-1]
        same = same_core & (span[1:] == span[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        source = np.repeat(head, np.diff(np.concatenate((head, [len(core)]))))
        runs = np.flatnonzero(np.concatenate(([True], ~same_core)))
        length = np.diff(np.concatenate((runs, [len(core)])))
        mixed = np.add.reduceat(np.concatenate(([0], (same_core & ~same).astype(np.int64))), runs) > 0
        kept = np.repeat(length > 1, length) | edge
        begin = (place >> 16) - (place >> 8 & 255)
        near = (doc == doc[source]) & (mark == mark[source]) & (begin - begin[source] < (place & 255) + PASSAGE)
        columns = [*part, doc[source], mark[source], place[source], np.repeat(mixed, length), edge & near]
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the run of the last core so far
        at_edge: set[int] = set()
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            fresh = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in part], axis=0)))
            part = [x[fresh] for x in part]
            at_edge = at_edge or {int(part[0][0])}
            cut = int(np.argmax(part[0] == part[0][-1]))
            if len(part[0]) - cut > LONG_RUN:
                at_edge.add(int(part[0][-1]))
                cut = len(part[0])
            if cut:
                yield told([x[:cut] for x in part], np.isin(part[0][:cut], list(at_edge)))
            held = [x[cut:] for x in part]
        if held is not None and len(held[0]):
            yield told(held, np.ones(len(held[0]), bool))

    ordered = rows.repartitionByRange(*ROW).sortWithinPartitions(*ROW)
    found = stored(ordered.mapInArrow(lean(run), FOUND), name)
    inner = found.where("not edge").drop("edge")
    edges = found.where("edge").select(*ROW)
    firsts = edges.groupBy("core", "span").agg(F.min(F.struct("doc", "mark", "place")).alias("first"))
    several = firsts.groupBy("core").agg(F.count("*").alias("n"))
    firsts = firsts.join(several, "core").select("core", "span", "first", (F.col("n") > 1).alias("shared"))
    outer = edges.join(firsts, ["core", "span"]).select(
        *ROW, F.col("first.doc").alias("first_doc"), F.col("first.mark").alias("first_mark"), F.col("first.place").alias("first_place"), "shared")
    return inner.unionByName(outer)


#: Rows of one core that a task holds before it leaves them to the grouping of edges.
LONG_RUN = 50_000


def _stretches(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """All stretches around the chosen suffixes, as suffixes of one stretch each: core is its hash."""
    listed = chosen.groupBy("doc", "mark").agg(F.collect_list("place").alias("places"))
    keyed = _with_list(documents, listed, "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, places = batch.column(0), batch.column(1), batch.column(3)
            for a, words, ranges in _parts(batch.column(2)):
                for k in range(len(words.count)):
                    place = np.array(places[a + k].as_py(), dtype=np.int64)
                    first = (place >> 16) - (place >> 8 & 255)
                    number = (place & 255) + 1
                    starts = np.unique(np.repeat(first - np.concatenate(([0], np.cumsum(number)[:-1])), number) + np.arange(number.sum()))
                    at = starts + words.first[k]
                    rows = pa.array(np.full(len(at), a + k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ranges.of(at, at + PASSAGE).view(np.int64)), pa.array(np.zeros(len(at), np.int64)), doc.take(rows), mark.take(rows), pa.array(starts << 16)], list(ROW))

    return keyed.select("doc", "mark", "text", "places").mapInArrow(lean(run), "core bigint, span bigint, doc bigint, mark bigint, place bigint")


def _with_list(documents: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """Documents with what is listed for them by doc and mark."""
    listed = stored(listed, name)
    listed = F.broadcast(listed) if listed.count() <= SENT_ROWS else listed
    return _keyed(documents).join(listed, ["doc", "mark"])


def repeated(documents: DataFrame) -> DataFrame:
    """doc, mark and the merged repeated passages of each document that holds any: start, end, sources."""
    kept = stored(_suffixes(documents), "kept-suffixes")
    within = kept.where("own_end > 0").select("doc", "mark", F.col("place").alias("begin"), F.col("own_end").alias("end"), F.col("doc").alias("first_doc"))
    found = _neighbours(kept.where("own_end = 0").select(*ROW), "suffixes")
    start = lambda place: F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(F.lit(255))

    def placed(rows: DataFrame) -> DataFrame:
        own = (F.col("doc") == F.col("first_doc")) & (F.col("mark") == F.col("first_mark"))
        words = F.col("place").bitwiseAND(F.lit(255)) + PASSAGE
        return rows.withColumns({"begin": start(F.col("place")), "end": start(F.col("place")) + words, "overlaps": own & (start(F.col("place")) - start(F.col("first_place")) < words)})

    found = placed(found)
    # the first of a class overlaps itself; so do later ones that no other document explains
    chosen = found.where(F.col("shared") & F.col("overlaps")).select("doc", "mark", "place")
    near = placed(_neighbours(_stretches(documents, chosen), "stretches"))
    copies = found.unionByName(near).where("not overlaps").select("doc", "mark", "begin", "end", "first_doc")
    pieces = copies.unionByName(within).groupBy("doc", "mark").agg(F.collect_list(F.struct("begin", "end", "first_doc")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(2).to_pylist():
                merged: list[list] = []
                for r in sorted(rows, key=lambda r: (r["begin"], r["end"])):
                    if merged and r["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["end"])
                        merged[-1][2].add(r["first_doc"])
                    else:
                        merged.append([r["begin"], r["end"], {r["first_doc"]}])
                out.append([{"start": a, "end": b, "sources": sorted(s)} for a, b, s in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sources", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], ["doc", "mark", "passages"])

    return pieces.select("doc", "mark", "pieces").mapInArrow(lean(run), "doc bigint, mark bigint, passages array<struct<start:bigint,end:bigint,sources:array<bigint>>>")


def passages(documents: DataFrame) -> DataFrame:
    """One row for each repeated passage of each row: where it stands, by word and byte, and the documents where its words stand earlier.

    ``source_ids`` holds the ids of these documents (without null ids); the first copy of a passage has no row.
    """
    found = _with_list(documents.select("doc_id", "text"), repeated(documents), "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for a, words, offsets in _word_parts(batch.column(1)):
                for k, base in enumerate(words.first[:-1]):
                    for p in batch.column(2)[a + k].as_py():
                        s, e = base + p["start"], base + p["end"]
                        rows.append((a + k, p["start"], p["end"] - p["start"], int(words.start[s] - offsets[k]), int(words.end[e - 1] - offsets[k]), [x for x in p["sources"] if x != LAST]))
            if rows:
                at, start, number, first, last, sources = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(start, pa.int64()), pa.array(number, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(sources, pa.list_(pa.int64()))],
                    ["doc_id", "start_word", "n_words", "start_byte", "end_byte", "source_ids"])

    return found.select("doc_id", "text", "passages").mapInArrow(lean(run), "doc_id bigint, start_word bigint, n_words bigint, start_byte bigint, end_byte bigint, source_ids array<bigint>")


def without_repeats(documents: DataFrame) -> DataFrame:
    """Documents with repeated passages cut out of their texts; a document of which no word is left goes.

    Of rows equal in doc_id and text one stays, if they hold a passage. All columns of the input come back.
    """
    return apart(documents, ["doc", "mark", "passages"], _cut)


def _cut(documents: DataFrame) -> DataFrame:
    listed = stored(repeated(documents), "passages")
    listed = F.broadcast(listed) if listed.count() <= SENT_ROWS else listed
    keyed = _keyed(documents)
    untouched = keyed.join(listed, ["doc", "mark"], "left_anti").select(documents.columns)
    touched = keyed.join(listed, ["doc", "mark"])
    again = stored(touched.groupBy("doc", "mark").count().where("count > 1").select("doc", "mark"), "again")
    again = F.broadcast(again) if again.count() <= SENT_ROWS else again
    touched = touched.join(again, ["doc", "mark"], "left_anti").unionByName(touched.join(again, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "text"]))
    columns = documents.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left = [], []
            at = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index("passages"))
            for k, text in enumerate(batch.column(at)):
                raw = text.as_py().encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                out, done = [], 0
                for p in spans[k].as_py():
                    out.append(raw[done : words.start[p["start"]]])
                    done = words.end[p["end"] - 1]
                rest = b"".join([*out, raw[done:]])
                texts.append(rest.decode())
                left.append(bool(rest.strip(b" \t\n\v\f\r")))
            kept = batch.select(columns)
            kept = kept.set_column(kept.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            yield kept.filter(pa.array(left, pa.bool_()))

    return untouched.unionByName(touched.select(*columns, "passages").mapInArrow(lean(run), types))
