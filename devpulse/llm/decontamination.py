"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.llm import words
from devpulse.llm.automaton import SuffixAutomaton
from devpulse.llm.columns import set_aside
from devpulse.llm.spans import Span, united, without

WINDOW = 10
#: An automaton holds the items of so many bytes of text (about 100 MB of memory); more items take more passes.
SHARD_BYTES = 1 << 20
FOUND = "n_words long, n_hit long, spans array<struct<start:long, end:long>>, items array<long>"
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


class ItemAutomaton:
    """The automaton of test items, with the states that spell windows and the items that hold them."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.token_of: dict[bytes, int] = {}
        sequences = [(item, [self.token_of.setdefault(w, len(self.token_of)) for w in ws]) for item, ws in items if ws]
        automaton = SuffixAutomaton()
        for _, tokens in sequences:
            automaton.add(tokens)
        self.arcs, self.link, self.length = automaton.arcs, automaton.link, automaton.length
        #: a window as (state that spells it, its length): its items
        self.items_of: dict[tuple[int, int], list[int]] = {}
        for item, tokens in sequences:
            size = min(window, len(tokens))
            for end, state in self._ends(tokens, size):
                self.items_of.setdefault((state, size), []).append(item)
        self.sizes_at: dict[int, list[int]] = {}
        for state, size in self.items_of:
            self.sizes_at.setdefault(state, []).append(size)
        self.sizes_at = {s: sorted(v) for s, v in self.sizes_at.items()}
        self.windows_below = self._inherited()

    def _ends(self, tokens: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(end, state of the window that ends there)."""
        state = 0
        for end, token in enumerate(tokens, 1):
            state = self.arcs[state][token]
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
            if end >= size:
                yield end, state

    def _inherited(self) -> list[tuple[tuple[int, int], ...]]:
        """For each state the windows that are suffixes of what it spells, longest first."""
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in order[1:]:
            own = tuple((s, size) for size in reversed(self.sizes_at.get(s, ())))
            out[s] = own + out[self.link[s]] if own else out[self.link[s]]
        return out

    def find(self, tokens: list[int]) -> tuple[list[Span], set[int]]:
        """Spans [start, end) covered by windows, in order and apart, and the items met.

        One pass from left to right: the state is the longest suffix read that
        occurs in an item, ``matched`` its length.
        """
        arcs, link, length, below = self.arcs, self.link, self.length, self.windows_below
        spans: list[Span] = []
        met: set[tuple[int, int]] = set()
        state = matched = 0
        for i, token in enumerate(tokens):
            if token < 0:
                state = matched = 0
                continue
            nxt = arcs[state].get(token)
            while nxt is None and state:
                state = link[state]
                matched = length[state]
                nxt = arcs[state].get(token)
            if nxt is None:
                continue
            state = nxt
            matched += 1
            hits = below[state]
            if hits:
                longest = 0
                for hit in hits:
                    if hit[1] <= matched:
                        longest = longest or hit[1]
                        met.add(hit)
                if longest:
                    start = i + 1 - longest
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, {item for hit in met for item in self.items_of[hit]}


def _shards(items: DataFrame, window: int, shard_bytes: int) -> Iterator[ItemAutomaton]:
    """Automata over the distinct items, each of a bounded size, built one after the other."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id")
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        found = words.split(pa.array([row.text]), words.LOWER_ALPHANUMERIC)
        held.append((row.item_id, [found.vocab[i] for i in found.ids]))
        size += len(row.text)
        if size >= shard_bytes:
            yield ItemAutomaton(held, window)
            held, size = [], 0
    yield ItemAutomaton(held, window)


def _scan(batch_words: words.Words, automaton: ItemAutomaton) -> Iterator[tuple[list[Span], set[int]]]:
    known = np.array([automaton.token_of.get(w, -1) for w in batch_words.vocab], dtype=np.int32)
    tokens = known[batch_words.ids] if len(known) else batch_words.ids
    bounds = batch_words.offsets.tolist()
    inside = np.concatenate(([0], np.cumsum(tokens >= 0)))
    for a, b in zip(bounds, bounds[1:]):
        yield automaton.find(tokens[a:b].tolist()) if inside[b] > inside[a] else ([], set())


def find_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns of ``docs`` plus ``found``, a struct of n_words, n_hit, spans and items.

    Words are runs of ASCII letters (lower-cased), ASCII digits and non-ASCII
    characters.  A window is ``window`` consecutive words of an item, or the whole
    of a shorter item.  ``spans`` are the ranges [start, end) of words inside any
    occurrence of a window, ``items`` the ids of the items whose windows occur.

    The items are broadcast as suffix automata of at most ``shard_bytes`` of item
    text each; a larger item table takes one pass over the texts for each shard,
    and the findings are united.  No document leaves its partition.

    Null and empty texts have no words and no hits.  Items with a null id or
    text, or without words, hit nothing; a repeated item counts once.  Each row
    of ``docs``, repeated or not, gives one row with all its columns (a column
    named ``found`` is replaced); an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    out = docs
    for i, automaton in enumerate(_shards(items, window, shard_bytes)):
        before = [F.col("found.spans"), F.col("found.items")] if i else []
        out = out.withColumn("found", _search(sc.broadcast(automaton))(F.col(text), *before))
    return out


def _search(automaton: Broadcast):
    def search(texts: pd.Series, *before: pd.Series) -> pd.DataFrame:
        found = words.split(pa.array(texts, type=pa.large_string(), from_pandas=True), words.LOWER_ALPHANUMERIC)
        rows = []
        for i, (spans, items) in enumerate(_scan(found, automaton.value)):
            if before:
                spans = united([*spans, *((s["start"], s["end"]) for s in before[0][i])])
                items = items.union(map(int, before[1][i]))
            rows.append((sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(items)))
        out = pd.DataFrame(rows, columns=["n_hit", "spans", "items"])
        out.insert(0, "n_words", np.diff(found.offsets))
        words.release()
        return out

    return F.pandas_udf(search, FOUND)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    most_coverage: float = 0.5,
    text: str = "text",
) -> DataFrame:
    """``docs`` without the passages they share with test items.

    Words inside a window's occurrence go, with what stands between them.  A
    document of which more than the share ``most_coverage`` of its words is hit
    goes as a whole.  Documents without hits stay as they are.  A column
    ``n_chars`` is brought up to date.  Other cases: see ``find_spans``.
    """
    return set_aside(docs, ("found",), lambda docs: _cleaned(docs, items, window, most_coverage, text))


def _cleaned(docs: DataFrame, items: DataFrame, window: int, most_coverage: float, text: str) -> DataFrame:
    found = find_spans(docs, items, window, text)
    kept = found.where(F.col("found.n_hit") <= F.lit(most_coverage) * F.col("found.n_words"))
    cut = F.pandas_udf(_without_spans, "string")
    out = kept.withColumn(text, F.when(F.col("found.n_hit") == 0, F.col(text)).otherwise(cut(F.col(text), F.col("found.spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("found.n_hit") == 0, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if not len(s) else without(t, [(x["start"], x["end"]) for x in s], WORD) for t, s in zip(texts, spans)], dtype=object)
