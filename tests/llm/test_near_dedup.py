from __future__ import annotations

import random

import numpy as np

from devpulse.llm import near_dedup


def _components(docs):
    """The smallest id that links reach, by comparing all pairs."""
    code: dict = {}
    sets = [{code.setdefault(tuple(w[i : i + 5]), len(code)) for i in range(len(w) - 4)} for w in (text.split() for _, text in docs)]
    holds = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        holds[i, list(s)] = 1
    n = holds.sum(axis=1)
    shared = holds @ holds.T
    linked = 100 * shared >= 75 * (n[:, None] + n - shared)
    least = np.arange(len(sets))
    while (new := np.where(linked, least, len(sets)).min(axis=1)).tolist() != least.tolist():
        least = new
    return {docs[i][0]: docs[k][0] for i, k in enumerate(least.tolist())}


def test_links_among_documents_with_a_long_boilerplate(spark):
    rng = random.Random(8)
    boilerplate = " ".join(f"b{i}" for i in range(200))

    def own(n):
        return " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))

    docs = []
    for k in range(600):  # pairs are similar to 0.76, other documents to 0.71 at most
        common = own(16)
        docs += [(2 * k + i, f"{boilerplate} {common} {own(rng.randrange(28, 32) if k % 3 else 45)}") for i in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    want = _components(docs)
    assert len(set(want.values())) < len(docs) - 300
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_pairs_across_groups():
    groups = np.array([3, 1, 3, 3, 2, 1])
    i, j = near_dedup._across(groups)
    want = [(a, b) for a in range(6) for b in range(a + 1, 6) if groups[a] != groups[b]]
    assert sorted(zip(i.tolist(), j.tolist())) == want
    assert near_dedup._partners(groups) == len(want)


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 300, 5000):
        for changed in (0, 1, 7, 60):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = np.unique(np.concatenate((rng.permutation(a)[min(changed, len(a)) :], rng.integers(0, 2**64, changed, dtype=np.uint64))))
            bits = sum(int(x).bit_count() for x in (near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).view(np.uint64))
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and (bits - apart) % 2 == 0
            assert size < 300 or changed == 0 or bits > 0
            assert apart > 120 or bits >= 0.7 * apart


def test_pairs_are_made_for_links_and_not_for_a_common_part(spark, monkeypatch):
    """Texts of 200 words that differ in six words of their own each: none are linked."""
    made = {}
    real = near_dedup.prefix_pairs

    def counted(*args):
        pairs = real(*args)
        made[n] = pairs.count()
        return pairs

    monkeypatch.setattr(near_dedup, "prefix_pairs", counted)
    for n in (400, 800):
        rng, docs = random.Random(n), []
        for i in range(n):
            words = [f"b{k}" for k in range(200)]
            for k in rng.sample(range(200), 6):
                words[k] = f"own{rng.randrange(10**9)}"
            docs.append((i, " ".join(words)))
        got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {r.doc_id: r.component_id for r in got.collect()} == _components(docs)
    assert made[400] <= 400 and made[800] <= 800
