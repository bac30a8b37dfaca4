"""Toxicity by weighted finite-state transducers over clauses.

A learned lexicon maps words to classes (insult, threat, target, negation, report, quote).
Three transducers rewrite the class string of a clause: negation marks what it covers,
reported speech marks what is quoted or told of others, targets mark what is aimed at
someone. They are composed into one machine once; the machine reads each clause that holds
an insult or a threat and counts what it matched. A text's score is a logistic function of
the matched clauses; words outside a match add nothing.

Insults are learned from labelled rows as whole words or stems, so any language in the
labels is covered. Null and empty texts match nothing and get the lowest score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestry.llm.quality import labelled_sample
from attestry.llm.shared import apart, lean, stored

#: Bound on labelled rows that are learned from.
SAMPLE = 20_000
STEMS = range(3, 9)
#: A stem may count only from so many words of a text on that begin with it; ``stem*3`` on the list.
TIMES = (2, 3)
#: Features that a task counts before it hands them on.
COUNTED_TOGETHER = 100_000
LEAST_TOXIC, LEAST_RATIO = 3, 100.0
#: Accepted number of entries, among all words and stems seen, that are on the list by chance.
CHANCE = 0.01
WORD = re.compile(r"\w+(?:['’]\w+)*|[\"“”„«»]")
CLAUSE_END, NEXT_END = ".!?;\n", re.compile(r"[.!?;\n]")

# The function words and verbs of the grammar, in the four languages of the tables.
INSULTS = "idiot moron loser scum clown pathetic worthless disgusting stupid trash idioten dumm blöd idiota estúpido imbécile stupide".split()
THREATS = "kill hurt destroy murder stab shoot strangle töten umbringen verletzen erschießen tuer tuerai frapper matar mataré golpear".split()
TARGETS = "you your yours u he she him her they them these those du dich dir dein ihr euch er sie tu te toi vous il elle ils tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't cannot without nicht kein keine nie ne pas jamais non nunca ni sin".split()
REPORTS = "said says wrote writes called calls claimed quoted reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

# Classes: insult, threat, target (u), negation, report, quote mark, anything else.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = "itunrqo"
#: Events are an insult or threat, negated, reported or aimed at someone; later marks win in this order.
EVENTS = ("i", "t", "i-", "t-", "i>", "t>", "i!", "t!")
PRIOR_WEIGHTS = np.array([4.0, 2.0, 0.5, 0.3, 0.7, 0.5, 5.0, 5.0])
PRIOR_CONSTANT, PRIOR_STRENGTH = -3.0, 1.0
#: An aimed match weighs at least this much more than one that stands alone; a negated or reported one weighs at most this share of it.
AIMED_LEAD, TAKEN_BACK_SHARE = 1.0, 0.25


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter transducer: (state, letter) to (state, letter); state 0 is the start."""

    steps: dict[tuple[int, str], tuple[int, str]]

    def then(self, other: Transducer) -> Transducer:
        """Composition: the second reads what the first writes."""
        inputs = {letter for _, letter in self.steps}
        number, steps, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            at = a, b = todo.pop()
            for letter in inputs:
                if (a, letter) not in self.steps:
                    continue
                a2, middle = self.steps[a, letter]
                b2, out = other.steps[b, middle]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                steps[number[at], letter] = (number[a2, b2], out)
        return Transducer(steps)

    def write(self, letters: list[str]) -> list[str]:
        state, out = 0, []
        for letter in letters:
            state, mark = self.steps[state, letter]
            out.append(mark)
        return out


def negation_machine(reach: int = 3) -> Transducer:
    """An insult or threat up to ``reach`` words after a negation is negated."""
    steps = {}
    for left in range(reach + 1):
        for letter in (TARGET, REPORT, QUOTE, OTHER):
            steps[left, letter] = (max(left - 1, 0), letter)
        steps[left, NEGATION] = (reach, OTHER)
        for letter in (INSULT, THREAT):
            steps[left, letter] = (max(left - 1, 0), letter + "-" if left else letter)
    return Transducer(steps)


def report_machine() -> Transducer:
    """After a verb of saying, or between quotation marks, an insult or threat is reported."""
    steps = {}
    for told in (0, 1):
        for quoted in (0, 1):
            state = 2 * told + quoted
            steps[state, REPORT] = (2 + quoted, OTHER)
            steps[state, QUOTE] = (2 * told + 1 - quoted, OTHER)
            for letter in (TARGET, OTHER, "i-", "t-"):
                steps[state, letter] = (state, letter)
            for letter in (INSULT, THREAT):
                steps[state, letter] = (state, letter + ">" if state else letter)
    return Transducer(steps)


def target_machine(reach: int = 4) -> Transducer:
    """An insult or threat up to ``reach`` words after a target is aimed at someone, and so is one with a target after it."""
    # states 0..reach: words since a target; beyond: an open insult (then threat), with words still allowed before the target
    steps = {}
    insult_open, threat_open = reach + 1, reach + 1 + 2
    for state in range(reach + 1 + 4):
        near = state if state <= reach else 0
        for letter in ("i-", "t-", "i>", "t>", OTHER):
            if state <= reach:
                to = max(near - 1, 0)
            else:
                to = 0 if (state - reach - 1) % 2 else state + 1
            steps[state, letter] = (to, letter)
        if state <= reach:
            steps[state, TARGET] = (reach, OTHER)
        else:
            steps[state, TARGET] = (reach, "i+" if state < threat_open else "t+")
        steps[state, INSULT] = (max(near - 1, 0), "i!") if near else (insult_open, INSULT)
        steps[state, THREAT] = (max(near - 1, 0), "t!") if near else (threat_open, THREAT)
    return Transducer(steps)


GRAMMAR = negation_machine().then(report_machine()).then(target_machine())


class Lexicon:
    """Word classes: fixed function words, and insults with a strength: whole words (ending in ``$``), stems, and
    stems that count only from a number of words of the text on (``stem*3``)."""

    def __init__(self, insults: dict[str, float]):
        insults = {f"{w}$": 1.0 for w in INSULTS} | insults
        self.whole = {k[:-1]: v for k, v in insults.items() if k.endswith("$")}
        self.stems: dict[str, list[tuple[int, float]]] = {}
        for key, strength in insults.items():
            if not key.endswith("$"):
                stem, _, times = key.partition("*")
                self.stems.setdefault(stem, []).append((int(times or 1), strength))
        self.fixed = dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
        self.fixed |= dict.fromkeys("\"“”„«»", QUOTE)
        self.lengths = sorted({len(k) for k in self.stems})
        self.found = ahocorasick.Automaton()
        for key in [*self.whole, *self.stems, *THREATS]:
            self.found.add_word(key, len(key))
        self.found.make_automaton()

    def letter(self, word: str, seen: Counter[str]) -> tuple[str, float]:
        """Class and strength of a word; ``seen`` counts the stems of its text."""
        kind = self.fixed.get(word)
        if kind:
            return kind, 1.0
        strength = self.whole.get(word)
        for n in self.lengths:
            if n <= len(word) and (of_stem := self.stems.get(word[:n])):
                seen[word[:n]] += 1
                strength = max([strength or 0.0, *(s for times, s in of_stem if times <= seen[word[:n]])])
        return (OTHER, 0.0) if strength is None else (INSULT, strength)

    def events(self, text: str) -> np.ndarray:
        """Strength of the matches of each kind over all clauses of a text."""
        total, text, done, seen = np.zeros(len(EVENTS)), text.lower(), 0, Counter()
        for last, size in self.found.iter(text):
            first = last - size + 1
            if first < done or (first and (text[first - 1].isalnum() or text[first - 1] == "_")):
                continue
            begin = max(text.rfind(c, done, first) for c in CLAUSE_END) + 1 or done
            end = at.start() if (at := NEXT_END.search(text, last + 1)) else len(text)
            self._clause(text[max(begin, done) : end], total, seen)
            done = end
        return total

    def _clause(self, clause: str, total: np.ndarray, seen: Counter[str]) -> None:
        read = [self.letter(w, seen) for w in WORD.findall(clause)]
        open_at = -1
        for (_, strength), mark in zip(read, GRAMMAR.write([r[0] for r in read]), strict=True):
            if mark in ("i+", "t+"):  # the target stood after the match: count it as aimed
                kind, strength = open_at
                total[EVENTS.index(kind)] -= strength
                total[EVENTS.index(kind + "!")] += strength
            elif mark in EVENTS:
                total[EVENTS.index(mark)] += strength
                if mark in (INSULT, THREAT):
                    open_at = (mark, strength)


@dataclass
class Model:
    """A learned lexicon and the weights of the events."""

    insults: dict[str, float]
    weights: np.ndarray
    constant: float

    def probability(self, events: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.constant + np.log1p(events) / np.log(2) @ self.weights, -40, 40)))


def _features(text: str | None) -> list[str]:
    """Words (ending in ``$``), stems and repeated stems of a text."""
    seen: Counter[str] = Counter()
    for word, times in Counter(WORD.findall((text or "").lower())).items():
        seen[word + "$"] = 1
        for n in STEMS:
            if n <= len(word):
                seen[word[:n]] += times
    return [*seen, *(f"{f}*{n}" for f, times in seen.items() for n in TIMES if times >= n)]


def learned_insults(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic rows have far more often than others, with a strength up to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = (Counter(), Counter()), [0, 0]

        def counted() -> pa.RecordBatch:
            clean, toxic = seen
            clean[""], toxic[""] = number
            keys = list(toxic | clean)
            arrays = [pa.array(keys), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["feature", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                number[label] += 1
                seen[label].update(_features(text.as_py()))
                if len(seen[0]) + len(seen[1]) > COUNTED_TOGETHER:
                    yield counted()
                    seen, number = (Counter(), Counter()), [0, 0]
        yield counted()

    counts = sample.select("text", "__label").mapInArrow(lean(run), "feature string, toxic bigint, clean bigint")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    of_rows = lambda c: F.coalesce(F.max(F.when(F.col("feature") == "", F.col(c))), F.lit(0)).alias(c)
    top = counts.agg(F.count("*").alias("tried"), of_rows("toxic"), of_rows("clean")).first()
    n_toxic, n_clean, tried = top["toxic"], top["clean"], top["tried"]
    if not n_toxic:
        return {}
    share = n_toxic / (n_toxic + n_clean)
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / (n_clean + 1))
    chance = _log_factorial(F.col("toxic") + F.col("clean")) - _log_factorial(F.col("toxic")) - _log_factorial(F.col("clean")) + F.col("toxic") * float(np.log(share))
    likely = counts.where("feature <> ''").where((F.col("toxic") >= LEAST_TOXIC) & (ratio >= LEAST_RATIO))
    rows = likely.where(chance + float(np.log(tried)) <= float(np.log(CHANCE)) + 0.01).orderBy(F.desc("toxic"), "feature").collect()
    entries = [r["feature"] for r in rows]
    toxic, clean = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("toxic", "clean"))
    if not entries:
        return {}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {e: k for k, e in enumerate(entries)}
        for batch in batches:
            found = [sorted(number[f] for f in _features(t.as_py()) if f in number) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["found"])

    told = sample.where("__label = 1").select("text").mapInArrow(lean(present), "found array<bigint>").groupBy("found").count().orderBy("found").collect()
    texts, copies = [np.array(r["found"], dtype=np.int64) for r in told], np.array([r["count"] for r in told], dtype=np.int64)
    return _chosen(entries, toxic, clean, texts, copies, share, tried, n_toxic / max(n_clean, 1))


def _log_factorial(n: Column) -> Column:
    """Logarithm of a factorial by Stirling's series, within 0.003."""
    return F.when(n < 1, 0.0).otherwise(n * F.log(n) - n + 0.5 * F.log(2 * float(np.pi) * n) + 1 / (12 * n))


def _chosen(entries: list[str], toxic: np.ndarray, clean: np.ndarray, texts: list[np.ndarray], copies: np.ndarray, share: float, tried: int, odds: float) -> dict[str, float]:
    """Entries in turn, the one least explained by chance first, as judged by toxic texts without an earlier entry.

    So words that merely stand in copies of texts that an entry explains are left out.
    """
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, (toxic + clean).max() + 2)))))
    of_entry: list[list[int]] = [[] for _ in entries]
    left = np.zeros(len(entries), dtype=np.int64)
    for t, found in enumerate(texts):
        left[found] += copies[t]
        for e in found.tolist():
            of_entry[e].append(t)
    length = np.array([len(e) for e in entries])
    covered, kept = np.zeros(len(texts), dtype=bool), {}
    while True:
        chance = log_factorial[left + clean] - log_factorial[left] - log_factorial[clean] + left * np.log(share) + np.log(tried)
        best = np.flatnonzero(chance == chance.min())
        at = best[np.argmax(length[best])]
        if left[at] < LEAST_TOXIC or chance[at] > np.log(CHANCE):
            return kept
        kept[entries[at]] = float((toxic[at] + 1) / (toxic[at] + clean[at] * odds + 2))
        for t in of_entry[at]:
            if not covered[t]:
                covered[t] = True
                left[texts[t]] -= copies[t]


def _in_order(weights: np.ndarray) -> np.ndarray:
    """Weights under which a clause decides what a match counts: aimed most, then alone, negated and reported least."""
    weights = np.maximum(weights, 0)
    for letter in (INSULT, THREAT):
        alone, negated, reported, aimed = (EVENTS.index(letter + mark) for mark in ("", "-", ">", "!"))
        weights[aimed] = max(weights[aimed], weights[alone] + AIMED_LEAD)
        for taken_back in (negated, reported):
            weights[taken_back] = min(weights[taken_back], TAKEN_BACK_SHARE * weights[alone])
    return weights


def fit(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learn lexicon and weights from labels.toxic of rows whose crc32(doc_id as text) mod 4 is not 2."""
    sample = stored(labelled_sample(documents, labels, "toxic", 4, 2, most), "labelled")
    insults = learned_insults(sample)
    seen = with_events(sample, insults).groupBy("__events", "__label").count().orderBy("__events", "__label").collect()
    x = np.array([r["__events"] for r in seen], dtype=float).reshape(-1, len(EVENTS))
    y, n = np.array([r["__label"] for r in seen], dtype=float), np.array([r["count"] for r in seen], dtype=float)
    model = Model(insults, PRIOR_WEIGHTS.copy(), PRIOR_CONSTANT)
    w = prior = np.append(PRIOR_WEIGHTS, PRIOR_CONSTANT)
    full = np.column_stack([np.log1p(x) / np.log(2), np.ones(len(x))])
    for _ in range(25):  # Newton steps on the likelihood with a normal prior
        p = 1 / (1 + np.exp(-np.clip(full @ w, -40, 40)))
        slope = full.T @ (n * (y - p)) - PRIOR_STRENGTH * (w - prior)
        curve = (full * (n * p * (1 - p))[:, None]).T @ full + PRIOR_STRENGTH * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
        w[:-1] = _in_order(w[:-1])
    model.weights, model.constant = w[:-1], float(w[-1])
    return model


def with_events(frame: DataFrame, insults: dict[str, float]) -> DataFrame:
    """Replace text by ``__events``, the strengths of its matches."""
    kept = [c for c in frame.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(insults)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            events = pa.array([own.events(t.as_py() or "").tolist() for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, events], [*kept, "__events"])

    types = ", ".join([*(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept), "__events array<double>"])
    return frame.select(*kept, "text").mapInArrow(lean(run), types)


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add a score to every row and drop its text; the matches stay as columns like ``aimed_insults``.

    Columns of such names in the input come back with ``_input`` behind them.
    """
    names = {"i": "insults", "t": "threats"}
    total = F.lit(model.constant)
    for k, weight in enumerate(model.weights):
        total = total + F.lit(float(weight)) * F.log1p(F.col("__events")[k]) / F.lit(float(np.log(2)))
    marks = {"": "plain", "-": "negated", ">": "reported", "!": "aimed"}
    matched = {f"{marks[e[1:]]}_{names[e[0]]}": F.col("__events")[k] for k, e in enumerate(EVENTS)}
    run = lambda frame: with_events(frame, model.insults).withColumn(column, 1 / (1 + F.exp(-total))).withColumns(matched).drop("__events")
    return apart(documents, [*matched, column, "__events"], run, ["text"])


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the matches of every document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rest = [c for c in scored.columns if c not in ("doc_id", "score")]
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), *rest)
