"""Patterns against the regular expressions they stand for; disclosing terms against plain counts."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from attestry.llm import sanitise as S

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in p.finditer(text) if passes(k, m.group())]
    return sorted(found, key=lambda x: (x[0], S.KINDS.index(x[2])))


def test_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for alphabet in ("ab@.1 ", "@.-a%1", "0123456789 -.+()", "1.2 +", "@@a.b1", "4 -0", "é@a.1 漢"):
        for _ in range(2000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert S.base_spans(text) == plain(text), text
    assert S.base_spans("4111 1111 1111 1111, +1 (377) 555-0271 and 10.0.0.255 or 10.0.0.256") == [(0, 19, "card"), (21, 38, "phone"), (43, 53, "ip")]


def test_long_runs_take_linear_time():
    found = S.base_spans("a" * 400_000 + "1" * 400_000 + " " + "1." * 100_000 + "+1" + "." * 100_000 + "@" * 1000)
    assert len(found) == 25_000 and {k for _, _, k in found} == {"ip"}


def corpus():
    rng = random.Random(5)
    filler = [f"word{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, say(60)) for k in range(200)]
    # A name that stands near one address in different surroundings, and alone in one more text.
    rows += [(300 + k, f"{say(20)} Zebulon wrote from zeb@mail.example.com {say(20)}") for k in range(4)]
    rows += [(310, f"{say(10)} zebulon {say(10)}")]
    # The same beginning elsewhere: the name can be generalised.
    rows += [(320 + k, f"{say(5)} Zebra Zebrawood {say(5)}") for k in range(30)]
    # Another name without such company, so it is removed.
    rows += [(400 + k, f"{say(20)} QuxtoniaLee +1 (377) 555-0271 {say(20)}") for k in range(5)]
    # Copies are one surrounding and no evidence.
    rows += [(500, f"{say(20)} Onlycopied copy@mail.example.com {say(20)}")] * 50
    return rows + [(None, None), (1, ""), (1, "x" * 3_000), (2, "a@b.cd " * 500)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, spans string, term int").repartition(6).select("doc_id", "text", "spans", "term")


def plain_terms(rows):
    near, around, entity_docs, frequency = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    for _, text in rows:
        text = text or ""
        words = {w.lower() for w in re.findall(r"[^\W_]{3,}", text)}
        for t in words | {S.general(w) for w in words}:
            frequency[t] += 1
        for name, term, context in S.mentions(text):
            near[name, term] += 1
            around[name, term].add(context)
            if not term:
                entity_docs[name] += 1
    told = {}
    for (name, term), n in near.items():
        if term and len(around[name, term]) >= S.LEAST_CONTEXTS and len(around[name, ""]) >= S.LEAST_CONTEXTS:
            pmi, own = math.log2(len(rows) * n / (entity_docs[name] * frequency[term])), math.log2(len(rows) / entity_docs[name])
            if own - pmi <= S.RESIDUAL_BITS and pmi >= S.LEAST_BITS:
                told[name, term] = pmi
    words = {t for _, t in told if not t.endswith("*")}
    return {w: None if any((n, S.general(w)) in told for n, t in told if t == w) else S.general(w) for w in words}


def test_disclosing_terms_are_those_of_plain_counts(documents, rows):
    found = {r["term"]: r["general"] for r in S.disclosing_terms(documents).collect()}
    assert found == plain_terms(rows)
    assert found["zebulon"] == "zeb*" and found["quxtonialee"] is None and "onlycopied" not in found


def plain_result(rows, terms):
    for doc_id, text in rows:
        text = text or ""
        base = plain(text)
        spans = list(base)
        for m in re.finditer(r"[^\W_]{3,}", text):
            if m.group().lower() in terms and not any(s < m.end() and m.start() < e for s, e, _ in base):
                spans.append((m.start(), m.end(), "term"))
        spans.sort(key=lambda x: (x[0], [*S.KINDS, "term"].index(x[2])))
        listed = [f"{k}:{s}:{e}" for s, e, k in spans]
        patterns = [x for x in listed if not x.startswith("term")]
        counts = [sum(x.startswith(k + ":") for x in listed) for k in S.KINDS]
        yield (doc_id, *counts, hashlib.sha256(",".join(patterns).encode()).hexdigest(), ",".join(listed), len(listed) - len(patterns))


@pytest.mark.parametrize("sent", [200_000, 1])
def test_every_row_equals_brute_force_whether_terms_are_sent_or_joined(documents, rows, sent, monkeypatch):
    monkeypatch.setattr(S, "SENT_TERMS", sent)
    got = sorted(map(tuple, S.private_documents(documents).collect()), key=str)
    assert got == sorted(plain_result(rows, plain_terms(rows)), key=str)


def test_texts_lose_what_was_found(documents):
    texts = {r["doc_id"]: r["clean_text"] for r in S.sanitised(documents).collect()}
    assert "[EMAIL]" in texts[300] and "zeb* " in texts[300] and "zeb*" in texts[310] and "Zebulon" not in texts[300]
    assert "[REMOVED] [PHONE]" in texts[400] and "Onlycopied [EMAIL]" in texts[500] and texts[None] == ""


def test_slices_do_not_cut_words(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    text = "alpha beta_gamma deltaepsilon, zeta" * 3
    assert S.distinct_terms(text) == {w.lower() for w in re.findall(r"[^\W_]{3,}", text)}
    assert S._found(text, {"gamma": None})[0][:3] == (text.index("gamma"), text.index("gamma") + 5, "term")


def test_empty_table(spark):
    assert S.private_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
