"""The automata against plain search."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from devpulse.llm.automaton import SuffixAutomaton
from devpulse.llm.decontamination import ItemAutomaton
from devpulse.llm.lm_scoring import BackoffAutomaton
from devpulse.llm.spans import united, without
from devpulse.llm.substring_dedup import WORD
from devpulse.llm.toxicity import LEAST_FUZZY, LexiconAutomaton, choose, weights

sequences = st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=4)


@given(sequences)
@settings(max_examples=300, deadline=None)
def test_matches_are_the_longest_earlier_runs(added):
    automaton, past = SuffixAutomaton(), []
    for seq in added:
        for end, got in enumerate(automaton.add(seq), 1):
            best = 0
            for size in range(1, end + 1):
                run = seq[end - size : end]
                there = any(p[j : j + size] == run for p in past for j in range(len(p) - size + 1))
                if there or any(seq[j : j + size] == run for j in range(end - size)):
                    best = size
            assert got == best
        past.append(seq)


@given(sequences, st.lists(st.integers(-1, 2), max_size=25), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_items_are_found_as_by_plain_search(items, text, window):
    spelled = [(i, [b"%d" % t for t in item]) for i, item in enumerate(items)]
    automaton = ItemAutomaton(spelled, window)
    tokens = [automaton.token_of.get(b"%d" % t, -1) for t in text]
    hit, met = set(), set()
    for i, item in enumerate(items):
        size = min(window, len(item))
        for a in range(len(item) - size + 1) if size else ():
            for b in range(len(text) - size + 1):
                if text[b : b + size] == item[a : a + size]:
                    hit.update(range(b, b + size))
                    met.add(i)
    spans, found = automaton.find(tokens)
    assert {k for a, b in spans for k in range(a, b)} == hit
    assert found == met
    assert spans == united(spans)


def _near(word: str, term: str) -> int:
    """Edit distance, 2 for all above 1."""
    if word == term:
        return 0
    if len(word) == len(term):
        return 1 if sum(a != b for a, b in zip(word, term)) == 1 else 2
    long, short = (word, term) if len(word) > len(term) else (term, word)
    return 1 if len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else 2


def test_lexicon_matches_are_within_one_edit():
    rng = random.Random(5)
    spell = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [(spell(rng.randrange(3, 8)), rng.random() < 0.4) for _ in range(12)]
    automaton = LexiconAutomaton(terms)
    for _ in range(3000):
        word = spell(rng.randrange(0, 10))
        expected = {}
        for i, (text, stem) in enumerate(terms):
            begins = [word[:n] for n in range(len(word) + 1)] if stem else [word]
            errors = min(_near(b, text) for b in begins)
            if errors == 0 or (errors == 1 and len(text) >= LEAST_FUZZY):
                expected[i] = errors
        assert automaton.match(word) == expected, word


def test_choice_of_entries():
    rows = [("idi", 50, 0), ("idio", 50, 0), (" idiot", 50, 0), ("vequ", 90, 0), ("vequa", 40, 0), (" vequai", 30, 0), ("ven", 60, 50), (" venir", 20, 0)]
    assert choose(rows) == [("idiot", False, 50, 0), ("venir", False, 20, 0), ("ven", True, 60, 50), ("vequ", True, 90, 0)]


def test_weights_separate():
    import numpy as np

    x = np.array([[0.0], [0.1], [3.0], [4.0]] * 20)
    w = weights(x, np.array([0, 0, 1, 1] * 20))
    assert w[-1] < 0 < w[-1] + 3.0 * w[0]


def test_backoff_takes_the_failure_arc():
    import numpy as np

    automaton = BackoffAutomaton(4, 3, np.array([-1.0, -2.0, -3.0, 0.0]), np.array([-0.5, 0.0, 0.0, -0.25]), {3 * 4 + 0: -0.1, 0 * 4 + 1: -0.2})
    assert automaton.score([0, 1, 2]) == -0.1 - 0.2 - 3.0
    assert automaton.score([1, 0, 0]) == (-0.25 - 2.0) + (0.0 - 1.0) + (-0.5 - 1.0)


@given(st.text("ab \n", max_size=30), st.sets(st.integers(0, 9), max_size=6))
def test_words_are_cut_out(text, gone):
    words = WORD.findall(text)
    spans = united((i, i + 1) for i in gone if i < len(words))
    assert WORD.findall(without(text, spans, WORD)) == [w for i, w in enumerate(words) if i not in gone] or spans
    if not spans:
        assert without(text, spans, WORD) == text
