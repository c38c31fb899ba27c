"""The divergence audit against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from devpulse.llm import divergence

from odd_documents import ODD_TEXTS, no_docs, odd_docs, rows  # noqa: F401

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, most):
    count, found_in, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        count[lang, source].update(terms)
        found_in[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in found_in[lang].items() if n >= least]
        whole = sum((count[g] for g in groups if g[0] == lang), Counter())

        def shares(counted):
            total = sum(counted[t] for t in kept)
            return {t: 1 + 10**9 * (counted[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        by_source = {s: shares(count[lang, s]) for x, s in groups if x == lang}
        for source, p in by_source.items():
            pairs = [(sum(abs(p[t] - o[t]) for t in kept), s) for s, o in by_source.items() if s != source]
            terms = [(p[t] - q[t], t) for t in kept if count[lang, source][t] and p[t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out, key=lambda r: [str(v) for v in r])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    sizes = [1, 2, 7, 8, 9, 15, 16, 17, 31, 33, 70, 200]
    vocabulary = ["".join(rng.choice("abcdexyzABC") for _ in range(rng.choice(sizes))) for _ in range(60)]
    vocabulary += ["é", "ÉÉ", "漢字漢字漢字", "naïve", "ñandú" * 8, " ", "😀😀😀"]
    docs = []
    for _ in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(0, 30))
        docs.append(("".join(w + rng.choice([" ", "1", "_", "\x00", "--", "\n"]) for w in words), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}"))
    docs += [("Edge", "en", "s1"), ("edge", "en", "s1"), (None, "fr", "only"), ("", "fr", None), ("12 34", "xx", "numbers")]
    return docs, spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)


@pytest.mark.parametrize("terms, sources", [(128, 256), (5, 4), (3, 1)])
def test_equals_plain_counting(made, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "TILE_SOURCES", sources)
    docs, table = made
    assert rows(divergence.audit(table, least_docs=12, most_terms=7)) == plain(docs, 12, 7)


def test_nothing_kept_gives_pairs_of_zero(made):
    docs, table = made
    found = rows(divergence.audit(table, least_docs=10**6))
    assert found == plain(docs, 10**6, 50)
    assert found and all(r[2] == "pair" and r[4] == 0 for r in found)


def test_odd_documents(odd_docs, no_docs):
    texts = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert len(texts) == len(ODD_TEXTS)
    assert rows(divergence.audit(odd_docs, least_docs=2, most_terms=5)) == plain(texts, 2, 5)
    assert rows(divergence.audit(no_docs)) == []
    assert divergence.audit(no_docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_share_is_exact_beyond_a_long(spark):
    n, total, terms = 10**13 + 7, 10**15 + 1, 10**6
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long").select(divergence._share("n", "total", "terms").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * terms)
