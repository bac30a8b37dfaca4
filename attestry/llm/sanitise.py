"""Personal data: patterns, and terms that disclose them, found by corpus co-occurrence.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers; each distinct
value is a protected entity. A term that stands near an entity discloses it as far as its
pointwise mutual information reaches the entity's own information. With documents counted,

    information(c) = log2(N / n_c)        pmi(c; t) = log2(N * n_ct / (n_c * n_t))

and information - pmi = log2(n_t / n_ct) is what stays uncertain about the entity for a reader
of the term: at most ``RESIDUAL_BITS``, with a pmi of at least ``LEAST_BITS``, is disclosure.
A pair counts only if it was seen in ``LEAST_CONTEXTS`` different surroundings, so copies of
one text are no evidence. A disclosing term is sanitised wherever it stands, also where the
entity does not. It is generalised to the beginning of the word if that, counted in the same
way, discloses nothing to which the term leads; else it is removed.

Counting is linear in the text: a mention meets only the words within ``REACH`` code points.
Pairs are counted before they are shuffled; how often a term occurs at all is counted over all
words of all documents. The disclosing terms go to every task while there are at most
``SENT_TERMS``; beyond that the distinct words of the texts are joined with them.

Rules for odd input: a null text is empty and has no spans. Rows with the same id are judged
each by its own text; equal rows count as often as they occur. An empty table gives no rows.
Terms inside of a pattern's span are not marked again. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REMOVED = "[REMOVED]"

REACH = 80
LEAST_CONTEXTS = 3
RESIDUAL_BITS = 1.0
LEAST_BITS = 4.0
#: Code points that a generalised word keeps.
GENERAL = 3
SENT_TERMS = 200_000
#: Entries of a task's counter before they are passed on.
COUNTED = 200_000
SLICE = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")
Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: no character is looked at twice, however long a run without one is."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        if 14 <= run.end() - run.start() <= 37:
            digits = _only_digits(run.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 10 <= len(_only_digits(run.group())) <= 15:
            yield run.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind."""
    return sorted(((s, e, kind) for kind in KINDS for s, e in _FINDERS[kind](text)), key=lambda x: (x[0], KINDS.index(x[2])))


def entity(text: str, span: Span) -> str:
    """The protected value of a span, with spellings of one value brought together."""
    start, end, kind = span
    value = text[start:end]
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _only_digits(value)}"


def general(term: str) -> str:
    """The beginning of a word."""
    return term[:GENERAL] + "*"


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a long text that end between words."""
    a = 0
    while a < len(text):
        b = min(a + SLICE, len(text))
        while b < len(text) and (text[b].isalnum()):
            b += 1
        yield a, text[a:b] if a or b < len(text) else text
        a = b


def distinct_terms(text: str) -> set[str]:
    """The words of a text, lower case."""
    words: set[str] = set()
    for _, part in _slices(text):
        words.update(_WORD.findall(part))
    return {w.lower() for w in words}


def _outside(spans: list[Span]):
    """Whether a range overlaps none of some ranges."""
    ends, top = [], 0
    for _, e, _ in spans:
        top = max(top, e)
        ends.append(top)
    starts = [s for s, _, _ in spans]

    def test(start: int, end: int) -> bool:
        k = bisect_right(starts, end - 1)
        return k == 0 or ends[k - 1] <= start

    return test


def mentions(text: str) -> Iterator[tuple[str, str, int]]:
    """(entity, term, surroundings) once for each entity and term of a text, and once with an empty term for each entity."""
    spans = base_spans(text)
    outside, seen = _outside(spans), set()
    for span in spans:
        low, high = max(0, span[0] - REACH), min(len(text), span[1] + REACH)
        near = []
        for m in _WORD.finditer(text, low, high):
            cut = m.start() == low > 0 and text[low - 1].isalnum() or m.end() == high < len(text) and text[high].isalnum()
            if not cut and outside(*m.span()):
                near.append(m.group().lower())
        around = int.from_bytes(blake2b(" ".join(near).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        name = entity(text, span)
        for term in {"", *near, *map(general, near)}:
            if (name, term) not in seen:
                seen.add((name, term))
                yield name, term, around


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def pairs(documents: DataFrame) -> DataFrame:
    """entity, term, n_near (documents where the term stands near the entity), contexts (different surroundings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, int]] = []
            for text in _texts(batch.column(0)):
                rows.extend(mentions(text))
                if len(rows) > COUNTED:
                    yield _batch(rows, ["entity", "term", "around"])
                    rows = []
            yield _batch(rows, ["entity", "term", "around"])

    found = documents.select("text").mapInArrow(run, "entity string, term string, around bigint")
    once = found.groupBy("entity", "term", "around").agg(F.count("*").alias("n"))
    return once.groupBy("entity", "term").agg(F.sum("n").alias("n_near"), F.count("*").alias("contexts"))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"around": pa.int64(), "n": pa.int64()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for c, n in zip(columns, names)], names)


def document_frequency(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: in how many documents each of ``terms`` occurs, as a word or as the beginning of one."""
    known = _sent(terms.select("term", F.lit(None).cast("string").alias("general")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for batch in batches:
            for text in _texts(batch.column(0)):
                own = distinct_terms(text)
                own |= {general(w) for w in own}
                counted.update(own if known is None else own & known.keys())
                if len(counted) > COUNTED:
                    yield _batch(list(counted.items()), ["term", "n"])
                    counted.clear()
        yield _batch(list(counted.items()), ["term", "n"])

    counts = documents.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.join(terms, "term", "left_semi")


def _sent(terms: DataFrame) -> dict[str, str | None] | None:
    """The terms as a dictionary, if they are few enough to be sent to every task."""
    rows = terms.limit(SENT_TERMS + 1).collect()
    return {r["term"]: r["general"] for r in rows} if len(rows) <= SENT_TERMS else None


def disclosing_terms(documents: DataFrame) -> DataFrame:
    """term, general (null: remove), pmi and information of the entity that the term discloses most; stored."""
    counted = stored(pairs(documents), "pairs")
    evident = counted.where(F.col("contexts") >= LEAST_CONTEXTS)
    entities = evident.where("term = ''").select("entity", F.col("n_near").alias("n_entity"))
    near = evident.where("term <> ''")
    frequency = document_frequency(documents, stored(near.select("term").distinct(), "terms"))
    total = float(documents.count())
    met = near.join(entities, "entity").join(frequency, "term").select(
        "entity", "term", F.log2(F.lit(total) * F.col("n_near") / (F.col("n_entity") * F.col("n"))).alias("pmi"),
        F.log2(F.lit(total) / F.col("n_entity")).alias("information"))
    told = (F.col("information") - F.col("pmi") <= RESIDUAL_BITS) & (F.col("pmi") >= LEAST_BITS)
    met = stored(met.where(told), "disclosed")
    # A beginning that is told of an entity is stored as a pair of its own: joined back, it bars the generalisation.
    short = F.concat(F.substring("term", 1, GENERAL), F.lit("*"))
    words = met.where("not endswith(term, '*')").withColumn("general", short)
    barred = met.where("endswith(term, '*')").select("entity", F.col("term").alias("general"), F.lit(True).alias("bar"))
    judged = words.join(barred, ["entity", "general"], "left")
    return stored(judged.groupBy("term").agg(
        F.when(~F.max(F.coalesce("bar", F.lit(False))), F.first("general")).alias("general"),
        F.max("pmi").alias("pmi"), F.max_by("information", "pmi").alias("information")), "disclosing")


SPANS = "array<struct<kind:string,start:int,end:int,replacement:string>>"


def _found(text: str, terms: dict[str, str | None]) -> list[tuple[int, int, str, str]]:
    spans = base_spans(text)
    out = [(s, e, kind, LABELS[kind]) for s, e, kind in spans]
    if terms and not terms.keys().isdisjoint(distinct_terms(text)):
        outside = _outside(spans)
        for at, part in _slices(text):
            for m in _WORD.finditer(part):
                word = m.group().lower()
                if word in terms and outside(at + m.start(), at + m.end()):
                    out.append((at + m.start(), at + m.end(), TERM, terms[word] or REMOVED))
        order = (*KINDS, TERM)
        out.sort(key=lambda x: (x[0], order.index(x[2])))
    return out


def cleaned(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with its spans replaced; of overlapping ones the first one counts, and what the others add goes."""
    parts, at = [], 0
    for start, end, _, instead in spans:
        if start >= at:
            parts += [text[at:start], instead]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitised(documents: DataFrame, terms: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """doc_id, spans and, unless left out, clean_text of every document. ``terms``: those to sanitise, by default the disclosing ones."""
    terms = disclosing_terms(documents) if terms is None else terms
    known = _sent(terms.select("term", "general"))
    rows = documents.select("doc_id", "text")
    if known is None:
        rows = _with_own_terms(rows, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for k, text in enumerate(_texts(batch.column(1))):
                own = known if known is not None else {x["term"]: x["general"] for x in batch.column(2)[k].as_py() or []}
                found = _found(text, own)
                spans.append([{"kind": x[2], "start": x[0], "end": x[1], "replacement": x[3]} for x in found])
                if texts:
                    clean.append(cleaned(text, found))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
            columns = [batch.column(0), pa.array(spans, kind)] + ([pa.array(clean, pa.string())] if texts else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "clean_text"][: len(columns)])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, spans {SPANS}" + (", clean_text string" if texts else ""))


def _with_own_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Each row with those terms that it holds: texts by their digest, so that copies are looked up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for key, text in zip(batch.column(0), _texts(batch.column(1))):
                out += [(key.as_py(), w) for w in distinct_terms(text)]
                if len(out) > COUNTED:
                    yield _batch(out, ["__text", "term"])
                    out = []
            yield _batch(out, ["__text", "term"])

    keyed = rows.withColumn("__text", F.sha2("text", 256))
    words = keyed.where("text is not null").select("__text", "text").mapInArrow(run, "__text string, term string").distinct()
    own = words.join(terms.select("term", "general"), "term").groupBy("__text").agg(F.collect_list(F.struct("term", "general")).alias("own"))
    return keyed.join(own, "__text", "left").select("doc_id", "text", "own")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def private_documents(documents: DataFrame) -> DataFrame:
    """Every document with its numbers of spans and their digest."""
    found = sanitised(documents, texts=False)
    counts = {f"n_{kind}": _number(kind) for kind in (*KINDS, TERM)}
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.withColumns({**counts, "base_sha256": F.sha2(_listed(base), 256), "spans": _listed(F.col("spans"))}).select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", f"n_{TERM}")
