"""Learned and iterative operators against brute force and held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from devpulse.llm import language_id, lm_scoring, mixing, toxicity
from devpulse.llm.graph import Forest, components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


@pytest.mark.parametrize("sizes", [None, (200_000, 50_000)])
def test_scores_are_those_of_the_whole_model(spark, docs, monkeypatch, sizes):
    """With one block, and with many blocks and shards and frequent words spread over shards."""
    if sizes:
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", sizes[0])
        monkeypatch.setattr(lm_scoring, "SHARD_BYTES", sizes[1])
    got = {r.doc_id: r for r in lm_scoring.score(docs, ~language_id.held_out("doc_id", 5, 1)).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.select("doc_id", "text").collect()}
    unigrams, bigrams = Counter(), defaultdict(Counter)
    for i, tokens in texts.items():
        if not held_out(i, 5, 1):
            unigrams.update(tokens)
            for before, token in zip(["start", *tokens], tokens):
                bigrams[before][token] += 1
    n, v = sum(unigrams.values()), len(unigrams)
    better = 0.0
    for i, tokens in texts.items():
        base = score = 0.0
        for before, token in zip(["start", *tokens], tokens):
            p = (unigrams[token] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            followers = bigrams.get(before, {})
            kept = [c for c in followers.values() if c >= 2]
            seen = max(1, sum(followers.values()))
            left = 1 - (sum(kept) - 0.75 * len(kept)) / seen
            c = followers.get(token, 0)
            score += math.log10((c - 0.75 if c >= 2 else 0) / seen + left * p)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i, 5, 1), len(tokens), sum(unigrams[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
        better += (score - base) * r.held_out
    assert better > 0


@pytest.mark.parametrize("values", [[], [0], [255], [256, 1], [2**40, 3]])
def test_packed_numbers(values):
    a = np.array(values, dtype=np.int64)
    assert lm_scoring.unpacked(lm_scoring.packed(a)).tolist() == values


def _grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return out


def test_grams_by_plain_counting():
    rng = random.Random(1)
    texts = ["", "a", "  ", " ab  Cd1e,é", "12 34", *("".join(rng.choice("abÉ ñ.,1\n") for _ in range(rng.randrange(40))) for _ in range(200))]
    grams = language_id.Grams(pa.array(texts))
    for i, text in enumerate(texts):
        found, n = language_id.counted(grams.of(i))
        assert {language_id.gram_text(int(g)): int(k) for g, k in zip(found, n)} == dict(_grams(text))


def test_distance_by_plain_ranks(spark):
    rows = [("en", "the cat sat on the mat the end"), ("fr", "le chat est sur le tapis le fin"), ("de", "die katze sitzt auf der matte")]
    taught = spark.createDataFrame(rows, "lang string, text string")
    learned = language_id.profiles(taught)
    ranks = defaultdict(dict)
    for r in learned.collect():
        ranks[r.lang][r.gram] = r.rank
    text = "the chat sat sur der matte"
    top = language_id.ranked(language_id.Grams(pa.array([text])).of(0), language_id.PROFILE_SIZE).view(np.int64).tolist()
    size = language_id.PROFILE_SIZE
    away = {g: sum(abs(ranks[g][x] - k) if x in ranks[g] else size for k, x in enumerate(top)) for g in ranks}
    (got,) = language_id.identify(spark.createDataFrame([(text,)], "text string"), learned).collect()
    best = min(sorted(away), key=away.get)
    assert got.lang_pred == best and got.score == pytest.approx(1 - away[best] / (size * len(top)))


def test_language_of_held_out_documents(docs):
    learned = language_id.profiles(docs.where(~language_id.held_out("doc_id", 3, 1)))
    found = language_id.identify(docs.where(language_id.held_out("doc_id", 3, 1)), learned)
    right, n = found.where("lang IS NOT NULL AND length(text) > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_toxicity_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = language_id.held_out("doc_id", 5, 0)
    lexicon = toxicity.fit(docs, labels.where(~out))
    scored = toxicity.score(docs, lexicon).join(labels, "doc_id").where(out).select("toxic", "score", "predicted").collect()
    assert sum(r.predicted for r in scored if not r.toxic) <= 0.02 * len(scored)
    assert sum(r.predicted == r.toxic for r in scored) > 0.95 * len(scored)


def test_errors_and_quotations():
    terms = [toxicity.Term("idiot", False, 4.0, 3.0), toxicity.Term("vequ", True, 4.0, 0.0)]
    scorer = toxicity.Scorer(toxicity.Lexicon(terms, [0.0, 1.0, 0.0, 0.8, 0.0, -2.0]))
    plain, typo, stem = scorer.score("you idiot there"), scorer.score("you idi0t there"), scorer.score("un vequaire ici")
    quoted, said = scorer.score('they wrote "an idiot" there'), scorer.score("the word idiot is old")
    assert plain > 0.5 and stem > 0.5 and 0.5 < typo < plain and quoted < 0.5 and quoted < said < plain
    assert scorer.score("a fine day") == scorer.score(None) < 0.5


def test_raking_against_plain_loops(spark):
    rng = random.Random(4)
    cells = [(s, g, rng.randrange(1, 2000)) for s in ("a", "b", None, "c") for g in ("en", "fr", None)]
    cells[0] = ("a", "en", 400_000)  # a hot source
    table = spark.createDataFrame(cells, "source string, lang string, n long")
    powers = {"source": 0.0, "lang": 0.5}
    targets = {d: mixing.tempered(table, d, p) for d, p in powers.items()}
    got = {(r.source, r.lang): r.weight for r in mixing.rake(table, targets, rounds=200, close=1e-9).collect()}
    n = {(s, g): k for s, g, k in cells}
    want = {}
    for i, p in enumerate(powers.values()):
        sums = Counter()
        for key, k in n.items():
            sums[key[i]] += k
        want[i] = {v: k**p / sum(x**p for x in sums.values()) for v, k in sums.items()}
    w = {key: 1.0 for key in n}
    for _ in range(500):
        for i in (0, 1):
            sums = Counter()
            for key, k in n.items():
                sums[key[i]] += k * w[key]
            w = {key: x * want[i][key[i]] / sums[key[i]] for key, x in w.items()}
    assert all(got[key] == pytest.approx(x, rel=1e-6) for key, x in w.items())


def test_a_mix_meets_its_targets(spark, docs):
    told = docs.select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.n_tokens().alias("n_tokens"))
    out = mixing.mixed(told, {"source": 0.0, "lang": 0.7, "topic": 0.7}, kept_share=0.4).persist()
    whole = told.agg(F.sum("n_tokens")).first()[0]
    weighted = F.sum(F.col("n_tokens") * F.col("weight")).alias("w")
    shares = [r.w for r in out.groupBy("source").agg(weighted).collect()]
    assert max(shares) - min(shares) < 1e-3 and sum(shares) == pytest.approx(1)
    p, n = F.col("probability"), F.col("n_tokens")
    expected, spread, kept = out.agg(F.sum(n * p), F.sqrt(F.sum(n * n * p * (1 - p))), F.sum(F.when(F.col("sampled"), n))).first()
    assert expected == pytest.approx(0.4 * whole, rel=1e-3) and abs(kept - expected) < 4 * spread
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000, 1000 + i) for i in range(400)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (7, None)]
    forest = Forest()
    for a, b in links:
        if a is not None and b is not None and a != b:
            forest.join(a, b)
    expected = {x: forest.root(x) for x in list(forest.parent) if forest.root(x) != x}
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components(table).collect()} == expected
    assert components(table.limit(0)).collect() == []
