"""Every operator on odd rows and on an empty table."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from devpulse.llm import decontamination, embedding_dedup, html_text, language_id, lm_scoring, mixing, near_dedup, substring_dedup, toxicity, url_filter

from odd_documents import COPY, ODD_TEXTS, no_docs, odd_docs, rows  # noqa: F401


def test_embeddings(spark):
    big, nan, inf = 1e30, float("nan"), float("inf")
    vectors = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]),
        (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [1.0]), (12, [big, 0.0]), (13, [-0.0, 1e-30]),
    ]
    table = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, digest string, n_links int")
    got = rows(embedding_dedup.near_duplicates(table))
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 11)]
    linked = [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)]
    other = [(3, 1, 3, True), (13, 1, 3, False), (None, 0, None, True)]
    assert got == sorted(alone + linked + other, key=lambda r: [str(v) for v in r])
    assert rows(embedding_dedup.near_duplicates(table.limit(0))) == []


def test_embedding_recall_and_hot_cell(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16))
    tight = base[0] + 0.05 * rng.normal(size=(350, 16))  # a third of all rows in one cluster
    near = base[:200] + 0.2 * rng.normal(size=(200, 16))
    x = np.concatenate((base, tight, near)).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "CELL", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(true))
    assert sum(got.values()) >= 0.999 * true.sum()


def test_substring_dedup(odd_docs, no_docs):
    found = substring_dedup.kept_digests(odd_docs, substring_dedup.repeated_passages(odd_docs))
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()))
    sha = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    n = len(COPY.split())
    expected = []
    for i, t in ODD_TEXTS:
        size = len((t or "").encode().split())
        if i == 2:
            expected.append((2, n, n, sha("")))
        elif i == 3:
            expected.append((3, n + 1, n, sha("today")))
        elif i == 11:
            expected.append((11, 500, 499, sha("a")))
        else:
            expected.append((i or 0, size, 0, sha(t)))
    long = next(e for e in got if e[0] == 7)
    assert long[1] == 60_000 and 0 < long[2] < 60_000
    assert [g for g in got if g[0] != 7] == sorted(e for e in expected if e[0] != 7)
    assert rows(substring_dedup.repeated_passages(no_docs)) == []

    out = substring_dedup.remove_repeated(odd_docs)
    assert out.columns == odd_docs.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, COPY) in texts and (3, " today") in texts and (None, COPY) in texts and (4, None) in texts and (5, "") in texts
    assert not any(i == 2 for i, _ in texts)


def test_passage_windows_by_plain_search(spark):
    import random

    rng = random.Random(9)
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(15, 60))] for k in range(6)]
    docs = []
    for i in range(60):
        ws = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            ws += [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(12))] + p[a : a + rng.randrange(10, 50)]
        docs.append((i, " ".join(ws)))
    seen, expected = set(), {}
    for i, t in docs:
        ws, gone = t.split(), set()
        for a in range(len(ws) - 19):
            w = tuple(ws[a : a + 20])
            if w in seen:
                gone.update(range(a, a + 20))
            seen.add(w)
        expected[i] = gone
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for hot in (2000, 3):  # with few and with all passages dealt out window by window
        old, substring_dedup.HOT = substring_dedup.HOT, hot
        try:
            found = substring_dedup.repeated_passages(table).collect()
        finally:
            substring_dedup.HOT = old
        assert {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in found} == expected


def test_url_filter(spark):
    rules = [url_filter.rule("block", "net/"), url_filter.rule("allow", "example.net/en/")]
    urls = [
        (1, None), (2, ""), (3, "no scheme xxx"), (4, "http://A.Example.NET/en/x"), (5, "http://net"), (6, "https://x.net/?q#f"),
        (7, "http://bet.free.org/"), (8, "http://betfree.org/win"), (9, "http://a.org/" + "x" * 100_000), (10, "HTTP://x://y/z"),
        (11, "http://a.org/xxxy"), (12, "http://free.free.org/"), (12, "http://free.free.org/"),
    ]
    table = spark.createDataFrame([(*u, "old") for u in urls], "page_id long, url string, verdict string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge(table, rules).orderBy("page_id").collect()]
    assert got == [
        (1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "block"), (4, "a.example.net", "example.net/en/", "allow"),
        (5, "net", None, "allow"), (6, "x.net", "net/", "block"), (7, "bet.free.org", None, "block"), (8, "betfree.org", None, "allow"),
        (9, "a.org", None, "allow"), (10, "x:", None, "allow"), (11, "a.org", None, "allow"), (12, "free.free.org", None, "allow"), (12, "free.free.org", None, "allow"),
    ]
    assert rows(url_filter.judge(table.limit(0), rules)) == []
    with pytest.raises(ValueError):
        url_filter.judge(table, [url_filter.rule("block", "net/"), url_filter.rule("allow", "net/")])


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, COPY), (1, COPY), (2, "One"), (3, None), (4, ""), (None, "ONE"), (5, "--"), (6, "été")], "item_id long, text string")
    found = decontamination.find_spans(odd_docs, items)
    got = {(r.doc_id, r.text): (r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in found.collect()}
    n = len(COPY.split())
    assert got[(1, COPY)] == (n, n, [1]) and got[(None, COPY)] == (n, n, [1]) and got[(12, COPY.upper())] == (n, n, [1])
    assert got[(8, "one")] == (1, 1, [2]) and got[(4, None)] == (0, 0, []) and got[(6, " \t\n\x0b ")] == (0, 0, [])
    assert got[(10, ODD_TEXTS[13][1])][1:] == (1, [6])  # only A-Z is lower-cased
    assert found.count() == len(ODD_TEXTS)
    pieces = decontamination.find_spans(odd_docs, items, shard_bytes=1)  # one automaton for each item
    assert rows(pieces.select("doc_id", "text", "found.n_hit", "found.items")) == rows(found.select("doc_id", "text", "found.n_hit", "found.items"))
    assert rows(decontamination.find_spans(no_docs, items)) == []
    assert decontamination.find_spans(odd_docs, items.limit(0)).where("found.n_hit > 0").count() == 0

    out = decontamination.decontaminate(odd_docs, items)
    assert out.columns == odd_docs.columns
    texts = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert not any(t and COPY in t.lower() for _, t, _ in texts)
    assert (11, "a " * 500, 1000) in texts and (4, None, None) in texts
    half = decontamination.decontaminate(odd_docs, items, most_coverage=1.0)
    assert (3, " today", 6) in {(r.doc_id, r.text, r.n_chars) for r in half.collect()}


def test_html(spark):
    pages = [(1, None), (2, ""), (3, "<"), (4, "<p>a<p>b"), (4, "<p>a<p>b"), (5, "<div>" * 5000 + "deep"), (6, "a" * 200_000)]
    table = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract(table).orderBy("page_id").collect()]
    assert got == [(1, None), (2, ""), (3, "<"), (4, "a\n\nb"), (4, "a\n\nb"), (5, "deep"), (6, "a" * 200_000)]
    assert rows(html_text.extract(table.limit(0))) == []


def test_language_model(odd_docs, no_docs):
    train = ~language_id.held_out("doc_id", 5, 1)
    got = lm_scoring.score(odd_docs, train).collect()
    assert len(got) == len(ODD_TEXTS)
    for r in got:
        assert r.n_tokens >= 1 and r.score <= 0 and math.isfinite(r.score) and r.n_known <= r.n_tokens
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    assert rows(lm_scoring.score(no_docs, train)) == []
    nothing = lm_scoring.score(odd_docs, F.lit(False)).collect()
    assert {(r.held_out, r.train_tokens, r.score, r.base_score) for r in nothing} == {(True, 0, 0.0, 0.0)}


def test_language(odd_docs, no_docs):
    learned = language_id.profiles(odd_docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(odd_docs, learned).collect()}
    assert got[(4, None)] == got[(5, "")] == got[(6, " \t\n\x0b ")] == ("und", 0.0)
    assert got[(1, COPY)][0] == "en" and got[(1, COPY)] == got[(12, COPY.upper())]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {p for p, _ in ((r.lang_pred, 0) for r in language_id.identify(odd_docs, learned.limit(0)).collect())} == {"und"}
    assert rows(language_id.identify(no_docs, learned)) == [] and rows(language_id.profiles(no_docs)) == []
    kept = language_id.drop_unknown(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD_TEXTS) - 4


def test_mixing(odd_docs, no_docs):
    told = odd_docs.withColumns({"topic": mixing.topic(), "n_tokens": mixing.n_tokens()})
    out = mixing.mixed(told, {"source": 0.0, "lang": 0.5, "topic": 1.0})
    got = out.collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.probability <= 1 for r in got)
    assert {r.topic for r in got if r.text is None or not r.text.strip()} <= {"empty", "prose", "lines"}
    assert rows(mixing.mixed(told.limit(0), {"source": 0.0})) == []


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (None, 1), (4, 1), (5, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, lexicon).collect()
    assert len(got) == len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert none == toxicity.Lexicon([], [])
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    assert rows(toxicity.score(no_docs, lexicon)) == []


def test_near_duplicates(odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd_docs).collect() if r.doc_id != 7)
    n = len(COPY.split()) - 4
    assert got == sorted(
        [
            (1, n, 1, True), (2, n, 1, False), (2, n, 1, False), (3, n + 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (0, n, None, True),
            (0, 0, None, True), (8, 1, 8, True), (9, 1, 8, False), (9, 2, 9, True), (10, 4, 10, True), (11, 1, 11, True), (12, n, 1, False),
        ],
        key=lambda r: (r[0], r[1]),
    )
    assert rows(near_dedup.near_duplicates(no_docs)) == []
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id or 0, r.text or "") for r in kept.collect() if r.doc_id in (1, 2, 3, 8, 9, 12) or r.doc_id is None)
    assert ids == sorted([(1, COPY), (8, "one"), (9, "another text under the same id"), (0, COPY), (0, "")])
