"""Toxicity: a learned lexicon, matched with typing errors, and the context of each match."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.plans.files import staged

#: the lexicon is fitted on at most so many labelled rows, and holds at most so many terms
FIT_ROWS, MOST_TERMS = 10_000, 4096
#: stems are beginnings of words of these lengths
STEMS = range(3, 9)
#: terms shorter than this are matched without errors
LEAST_FUZZY = 5
#: how surely a term must tell toxic texts from others (log-likelihood ratio), and how much more often it must stand in them
LEAST_EVIDENCE, LEAST_RATIO = 20.0, 8.0
#: words on either side of a match that are its context
CONTEXT = 8
#: what is left of a match's weight inside quotation marks, and after a word that reports speech
QUOTED, REPORTED = 0.45, 0.8
_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»]")
_MARKS = frozenset("\"“”„«»")
# Words that report what others say, in English, German, French and Spanish
_REPORTS = frozenset(
    "said says wrote called quote quoted term word sagte schrieb nannte zitat wort dit écrit appelé mot terme dijo escribió llamó cita palabra".split()
)
_CACHED_WORDS = 300_000


class Term(NamedTuple):
    """A word, or the stem of one; log-ratios of its rates in toxic and in clean texts, whole and with one error."""

    text: str
    stem: bool
    exact: float
    fuzzy: float = 0.0


class Lexicon(NamedTuple):
    """Terms, and the weights that turn what is found in a text into a score: one for each feature, and a constant."""

    terms: list[Term]
    weights: list[float]


class LexiconAutomaton:
    """The trie of all terms met with Levenshtein automata of distance 1.

    A state is the set of (trie node, errors so far) that can be reached; states
    and their steps are made when first needed and kept.
    """

    def __init__(self, terms: list[tuple[str, bool]], fuzzy: bool = True) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}, {}]  # roots: of all terms, and of those that may hold an error
        self.ends: list[list[int]] = [[], []]
        for i, (text, _) in enumerate(terms):
            self._add(0, text, i)
            if fuzzy and len(text) >= LEAST_FUZZY:
                self._add(1, text, i)
        self.loose = self._reached(1)
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.met: list[tuple[dict[int, int], dict[int, int]]] = []
        self.dead = self._state(frozenset())
        self.first = self._state(self._closed({(0, 0), (1, 0)}))

    def _add(self, node: int, text: str, term: int) -> None:
        for c in text:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.ends.append([])
            node = self.children[node][c]
        self.ends[node].append(term)

    def _reached(self, root: int) -> set[int]:
        out, todo = set(), [root]
        while todo:
            node = todo.pop()
            out.add(node)
            todo += self.children[node].values()
        return out

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the nodes reached when the word lacks a letter of the term."""
        more = {(child, 1) for node, errors in pairs if not errors and node in self.loose for child in self.children[node].values()}
        return frozenset(pairs | more)

    def _state(self, pairs: frozenset[tuple[int, int]]) -> int:
        if pairs not in self.number:
            self.number[pairs] = len(self.states)
            self.states.append(pairs)
            self.steps.append({})
            stems: dict[int, int] = {}
            whole: dict[int, int] = {}
            for node, errors in pairs:
                for term in self.ends[node]:
                    into = stems if self.terms[term][1] else whole
                    into[term] = min(errors, into.get(term, 1))
            self.met.append((stems, whole))
        return self.number[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, errors in self.states[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, errors))
            if not errors and node in self.loose:
                out.add((node, 1))  # a letter too many
                out.update((other, 1) for other in self.children[node].values())  # another letter
        self.steps[state][c] = found = self._state(self._closed(out))
        return found

    def match(self, word: str) -> dict[int, int]:
        """The terms that are this word, or of which it begins with the stem: term to errors (0 or 1)."""
        found: dict[int, int] = {}
        state = self.first
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state == self.dead:
                return found
            for term, errors in self.met[state][0].items():
                found[term] = min(errors, found.get(term, 1))
        for term, errors in self.met[state][1].items():
            found[term] = min(errors, found.get(term, 1))
        return found


#: sum and largest of exact matches, the same of matches with an error, matches per 100 words
FEATURES = 5


class Scorer:
    """Texts to scores; words seen before are kept, up to a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.terms, self.weights = lexicon
        self.automaton = LexiconAutomaton([(t.text, t.stem) for t in self.terms])
        self.cache: dict[str, tuple[float, float] | None] = {}

    def _weigh(self, word: str) -> tuple[float, float] | None:
        """The surest term that the word spells: its weight as an exact match or else as one with an error."""
        found = self.automaton.match(word)
        exact = max((self.terms[i].exact for i, errors in found.items() if not errors), default=0.0)
        fuzzy = max((self.terms[i].fuzzy for i, errors in found.items() if errors), default=0.0)
        return (exact, 0.0) if exact > 0 else (0.0, fuzzy) if fuzzy > 0 else None

    def features(self, text: str | None) -> list[float]:
        """Each distinct word counts once, with the context that weighs most."""
        if not text or not self.terms:
            return [0.0] * FEATURES
        tokens = _TOKEN.findall(text.lower())
        cache, hits = self.cache, {}
        for word in set(tokens):
            if word not in cache:
                if len(cache) > _CACHED_WORDS:
                    cache.clear()
                cache[word] = self._weigh(word)
            if cache[word]:
                hits[word] = cache[word]
        if not hits:
            return [0.0] * FEATURES
        context: dict[str, float] = {}
        rate = 0.0
        for i, word in enumerate(tokens):
            if word in hits:
                factor = self._context(tokens, i)
                context[word] = max(factor, context.get(word, 0.0))
                rate += factor * (hits[word][0] > 0)
        exact = [hits[w][0] * f for w, f in context.items()]
        fuzzy = [hits[w][1] * f for w, f in context.items()]
        return [sum(exact), max(exact), sum(fuzzy), max(fuzzy), min(100.0 * rate / len(tokens), 10.0)]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))

    @staticmethod
    def _context(tokens: list[str], i: int) -> float:
        """Less than 1 where the words around a match make it a quotation."""
        before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
        if any(t in _MARKS for t in before) and any(t in _MARKS for t in after):
            return QUOTED
        return REPORTED if any(t in _REPORTS for t in before[-3:]) else 1.0


def _entries(text: str) -> set[str]:
    """The words of a text, each after a blank, and their stems."""
    out = set()
    for word in set(_TOKEN.findall(text.lower())) - _MARKS:
        out.add(" " + word)
        out.update(word[:n] for n in STEMS if n < len(word))
    return out


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        out = pa.record_batch({"entry": names, "toxic": pa.array([toxic[n] for n in names], pa.int64()), "clean": pa.array([clean[n] for n in names], pa.int64())})
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
            (toxic if label else clean).update(_entries(text))
        if len(toxic) + len(clean) > 2_000_000:
            yield flushed()
    yield flushed()


def _evidence(a: Column, b: Column, n_toxic: int, n_clean: int) -> Column:
    """Dunning's log-likelihood ratio of a of n_toxic against b of n_clean."""
    both = (a + b) / F.lit(float(n_toxic + n_clean))

    def part(k: Column, n: int) -> Column:
        rate = k / F.lit(float(n))
        rest = F.when(rate < 1, (F.lit(float(n)) - k) * F.log((1 - rate) / (1 - both))).otherwise(0.0)
        return F.when(k > 0, k * F.log(rate / both)).otherwise(0.0) + rest

    return F.when(both < 1, 2 * (part(a, n_toxic) + part(b, n_clean))).otherwise(0.0)


def choose(rows: list[tuple[str, int, int]]) -> list[tuple[str, bool, int, int]]:
    """(text, stem?, toxic, clean) of the entries that no other one makes idle.

    A stem goes if one longer entry stands for nine tenths of it: that one is
    more exact.  An entry goes if a shorter stem left is as sure.
    """
    found = {entry: (toxic, clean) for entry, toxic, clean in rows}

    def spelled(entry: str) -> str:
        return entry.strip()

    stems = {e for e in found if not e.startswith(" ")}
    for entry, (toxic, _) in found.items():
        text = spelled(entry)
        for n in STEMS:
            shorter = text[:n]
            if shorter in stems and shorter != entry and (n < len(text) or entry.startswith(" ")) and toxic >= 0.9 * found[shorter][0]:
                stems.discard(shorter)

    def sure(entry: str) -> float:
        toxic, clean = found[entry]
        return (toxic + 0.5) / (toxic + clean + 1)

    out = []
    for entry in sorted(found):
        word = entry.startswith(" ")
        if not word and entry not in stems:
            continue
        text = spelled(entry)
        covers = [text[:n] for n in STEMS if text[:n] in stems and text[:n] != entry]
        if not any(sure(c) >= sure(entry) - 0.02 for c in covers):
            out.append((text, not word, *found[entry]))
    return out


def weights(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression with a small ridge, by Newton steps; the constant comes last."""
    scale = np.maximum(features.std(axis=0), 1e-9)
    x = np.column_stack((features / scale, np.ones(len(features))))
    ridge = np.diag([1.0] * features.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[:-1] / scale).tolist(), float(w[-1])]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """The lexicon of the texts labelled in ``labels``, from at most ``fit_rows`` of them in the order of a hash.

    Terms are words and stems that stand far more often in toxic texts.  Two
    thirds of the texts give the terms, with log-ratios of the shares of toxic
    and of clean texts with the term or with a word one error away from it; the
    rest gives the weights of what is found in a text.  A text with several
    labels is toxic if one of them says so; null ids, labels and texts teach
    nothing.  Without toxic or without clean texts nothing is learned.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.max(F.col(label) > 0).alias("label"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # at most fit_rows short rows
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    taught, path = staged(texts.join(F.broadcast(some), "_id").withColumn("tune", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) == 0), "taught")
    first, second = taught.where("NOT tune").select("label", "text"), taught.where("tune").select("label", "text")
    n_toxic, n_clean = (n or 0 for n in first.agg(F.sum(F.col("label").cast("long")), F.sum((~F.col("label")).cast("long"))).first())
    if not n_toxic or not n_clean:
        return Lexicon([], [])
    counts = first.mapInArrow(_entry_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    more = (F.col("toxic") + 0.5) / (n_toxic + 1) >= LEAST_RATIO * (F.col("clean") + 0.5) / (n_clean + 1)
    told = counts.where(more).withColumn("evidence", _evidence(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    best = told.where(F.col("evidence") >= LEAST_EVIDENCE).orderBy(F.desc("evidence"), "entry").limit(MOST_TERMS)
    chosen = choose([(r.entry, r.toxic, r.clean) for r in best.collect()])
    missed = first.mapInArrow(_error_counts(chosen), "term int, toxic long, clean long").groupBy("term").agg(F.sum("toxic"), F.sum("clean"))
    errors = {r[0]: (r[1], r[2]) for r in missed.collect()}  # one row for each term at most

    def ratio(toxic: float, clean: float) -> float:
        return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))

    # one clean text in the prior: errors never met are a weak sign, not none
    terms = [Term(entry, stem, ratio(toxic, clean), max(0.0, ratio(*errors.get(i, (1, 0))))) for i, (entry, stem, toxic, clean) in enumerate(chosen)]
    found = second.mapInArrow(_feature_rows(terms), "label boolean, features array<double>").collect()  # at most fit_rows rows
    rows = [(float(r.label), r.features) for r in found]
    if len({y for y, _ in rows}) < 2:  # too few texts to tune with: one sure match decides
        return Lexicon(terms, [0.0, 1.0, 0.0, 0.5, 0.0, -2.0])
    return Lexicon(terms, weights(np.array([x for _, x in rows]), np.array([y for y, _ in rows])))


def _feature_rows(terms: list[Term]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(terms, []))
        for batch in batches:
            features = [scorer.features(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch({"label": batch["label"], "features": pa.array(features, pa.list_(pa.float64()))})

    return rows


def _error_counts(chosen: list[tuple[str, bool, int, int]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton([(text, stem) for text, stem, _, _ in chosen])
        sums = {True: Counter(), False: Counter()}
        cache: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist()):
                met = set()
                for word in set(_TOKEN.findall(text.lower())):
                    if word not in cache:
                        if len(cache) > _CACHED_WORDS:
                            cache.clear()
                        cache[word] = [term for term, errors in automaton.match(word).items() if errors]
                    met.update(cache[word])
                sums[label].update(met)
        terms = sorted(sums[True].keys() | sums[False].keys())
        yield pa.record_batch({"term": pa.array(terms, pa.int32()), "toxic": pa.array([sums[True][t] for t in terms], pa.int64()), "clean": pa.array([sums[False][t] for t in terms], pa.int64())})

    return count


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Words are runs of letters and digits of the lower-cased text.  A word that
    spells a term, with at most one letter wrong, missing or too many for terms
    of five letters and more, counts with the term's weight, less in quotation
    marks or after a word that reports speech; the fitted weights make a
    probability of the sums.

    Null and empty texts have no match and the score of a text without one; when
    nothing was learned, all scores are 0.  Rows are judged one by one: repeated
    rows get equal results, an empty table none.  Columns named ``score`` or
    ``predicted`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
