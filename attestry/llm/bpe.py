"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a text is the only token sequence whose neighbouring tokens are all
compatible: merging the bytes of the two gives back just these two. So every prefix
has one last token. A suffix automaton of the vocabulary lists the tokens that end
at a position; the first that is compatible with the last token of the prefix before
it is stored, and back-pointers give the ids.

Ids travel as little-endian unsigned 32-bit integers in a binary column. Null texts
count as empty and give no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attestry.llm.shared import apart

#: Pieces in each of two generations that a worker keeps, the longest that is kept, and tested pairs; they bound memory, not results.
KEPT_PIECES, KEPT_LENGTH, KEPT_PAIRS = 150_000, 48, 400_000
OUT_BYTES = 1 << 24

# The split of the vocabulary's published pattern. The first spelling holds for texts of
# ASCII, Latin letters and common punctuation only, where both agree and the standard library is faster.
PLAIN = re.compile("[^\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿-ɏ‐-‧]")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
FULL_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_letters() -> dict[str, int]:
    """The published spelling of bytes in the vocabulary file: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of the vocabulary; ``ending`` lists the tokens that end a match."""

    def __init__(self, tokens: list[tuple[bytes, int]]):
        self.step: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]
        step, link, length = self.step, self.link, self.length

        def new(size: int, to: int, letters: list[int]) -> int:
            link.append(to)
            length.append(size)
            out.append(letters)
            return len(link) - 1

        def cloned(p: int, c: int, q: int) -> int:
            copy = new(length[p] + 1, link[q], list(out[q]))
            for x in out[q]:
                step[copy << 8 | x] = step[q << 8 | x]
            while p >= 0 and step.get(p << 8 | c) == q:
                step[p << 8 | c] = copy
                p = link[p]
            link[q] = copy
            return copy

        def extended(last: int, c: int) -> int:
            q = step.get(last << 8 | c)
            if q is not None:
                return q if length[q] == length[last] + 1 else cloned(last, c, q)
            at, p = new(length[last] + 1, 0, []), last
            while p >= 0 and (p << 8 | c) not in step:
                step[p << 8 | c] = at
                out[p].append(c)
                p = link[p]
            if p >= 0:
                q = step[p << 8 | c]
                link[at] = q if length[q] == length[p] + 1 else cloned(p, c, q)
            return at

        for text, _ in tokens:
            last = 0
            for c in text:
                last = extended(last, c)
        ends: dict[int, list[tuple[int, int]]] = {}
        for text, token in tokens:
            state = 0
            for c in text:
                state = step[state << 8 | c]
            ends.setdefault(state, []).append((len(text), token))
        self.ends = {s: sorted(x, reverse=True) for s, x in ends.items()}
        # the nearest state on the chain of suffix links, itself included, where a token ends
        near = [0] * len(link)
        for s in sorted(range(1, len(link)), key=length.__getitem__):
            near[s] = s if s in self.ends else near[link[s]]
        self.near = near
        self.listed: dict[int, tuple[tuple[int, int], ...]] = {}

    def ending(self, state: int, size: int) -> tuple[tuple[int, int], ...]:
        """Length and id of the tokens that end a match of ``size`` bytes in ``state``, longest first."""
        found = self.listed.get(state)
        if found is None:
            all_here, s = [], self.near[state]
            while s:
                all_here += self.ends[s]
                s = self.near[self.link[s]]
            found = self.listed[state] = tuple(all_here)
        return found if size == self.length[state] else tuple(x for x in found if x[0] <= size)


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _ids(spec: dict) -> dict[bytes, int]:
    letters = _byte_letters()
    return {bytes(letters[c] for c in text): i for text, i in spec["model"]["vocab"].items()}


class Decoder:
    """The bytes of each id of a vocabulary file."""

    def __init__(self, path: str):
        spec = _spec(path)
        found = {i: b for b, i in _ids(spec).items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.pieces = [found.get(i, b"") for i in range(max(found) + 1)]

    def decode(self, ids: bytes) -> str:
        found = self.pieces
        return b"".join([found[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


class Vocabulary:
    """Tokens, merges and splits of one vocabulary file, to encode with."""

    def __init__(self, path: str):
        spec = _spec(path)
        letters = _byte_letters()
        model = spec["model"]
        self.ids = _ids(spec)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.ids[bytes(letters[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merged.setdefault((a, b), (rank, token))
            self.made_by.setdefault(token, (rank, a, b))
        self.fits: dict[int, bool] = {}
        # a longer token whose two parts would not stand side by side can't arise from merges
        self.whole = {b: i for b, i in self.ids.items() if len(b) == 1 or self._arises(i)}
        self.automaton = SuffixAutomaton(list(self.whole.items()))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept = _Pieces(self)

    def _arises(self, token: int) -> bool:
        if token not in self.made_by:
            return False
        rank, a, b = self.made_by[token]
        return self._compatible_below(a, b, rank)

    def _compatible_below(self, a: int, b: int, limit: int) -> bool:
        """No merge of a rank below ``limit`` crosses the border between the tokens ``a`` and ``b``.

        Undo the merges on both sides of the border, the latest first. While the tokens ``x`` and ``y``
        meet at the border, a merge of these two would be taken if it came before the merge that
        replaced one of them.
        """
        x, y = a, b
        x_until = y_until = limit
        while True:
            hit = self.merged.get((x, y))
            # at equal ranks the leftmost place merges first: before the merge that made y, after the one that made x
            if hit is not None and hit[0] < x_until and hit[0] <= y_until:
                return False
            rx, ry = self.made_by.get(x, (-1,))[0], self.made_by.get(y, (-1,))[0]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x_until, x = rx, self.made_by[x][2]
            else:
                y_until, y = ry, self.made_by[y][1]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible_below(a, b, 1 << 60)
        return known

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece of the split."""
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        automaton, fits, compatible = self.automaton, self.fits, self.compatible
        step, link, length, listed = automaton.step, automaton.link, automaton.length, automaton.listed
        last, back = [0], [0]
        state = size = i = 0
        for c in text:
            i += 1
            to = step.get(state << 8 | c)
            while to is None:
                state = link[state]
                size = length[state]
                to = step.get(state << 8 | c)
            state, size = to, size + 1
            for n, token in listed[state] if size == length[state] and state in listed else automaton.ending(state, size):
                if n == i:
                    break
                before = last[i - n]
                fit = fits.get(before << 32 | token)
                if fit or (fit is None and compatible(before, token)):
                    break
            last.append(token)
            back.append(n)
        ids, i = [], len(text)
        while i:
            ids.append(last[i])
            i -= back[i]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,)
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                split = FULL_SPLIT if PLAIN.search(part) else PLAIN_SPLIT
                out.append(b"".join(map(self.kept.__getitem__, split.findall(part))))
        return b"".join(out)


class _Pieces(dict):
    """Encoded pieces of a worker, bounded in number and length."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = np.array(self.vocabulary.piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[tuple[type, str], Vocabulary | Decoder] = {}


def loaded(kind: type, path: str) -> Vocabulary | Decoder:
    """The vocabulary or decoder of a file, built once in each worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def _by_size(batch: pa.RecordBatch, column: str, made, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """The batch with a made column, handed on in parts of about ``OUT_BYTES``."""
    values, first, size = [], 0, 0
    source = batch.column(batch.schema.get_field_index(column))
    for k in range(len(source)):
        value = made(source[k].as_py())
        values.append(value)
        size += len(value)
        if size >= OUT_BYTES or k == len(source) - 1:
            part = batch.slice(first, len(values))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, kind)], [*batch.schema.names, name])
            values, first, size = [], k + 1, 0


def encode(frame: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as little-endian unsigned 32-bit integers; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(Vocabulary, path)
        for batch in batches:
            yield from _by_size(batch, text, lambda t: known.encode(t or ""), pa.binary(), ids)

    return apart(frame, [ids], lambda f: f.mapInArrow(run, f"{_ddl(f)}, `{ids}` binary"), [text])


def decode(frame: DataFrame, ids: str, path: str, text: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(Decoder, path)
        for batch in batches:
            yield from _by_size(batch, ids, lambda b: known.decode(b or b""), pa.string(), text)

    return apart(frame, [text], lambda f: f.mapInArrow(run, f"{_ddl(f)}, `{text}` string"), [ids])


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Encoded and decoded in one worker, so that neither ids nor texts travel to the JVM and back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(Vocabulary, path), loaded(Decoder, path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoder.decode(ids).encode()).hexdigest()))
            number, coded, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
