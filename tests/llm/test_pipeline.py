"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from odd_documents import no_docs, odd_docs  # noqa: F401

WORDS = {
    "en": "the of and to in is that for it was on are with they be at this have from or one had by word but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("corpus")
    item = " ".join(rng.choice(WORDS["en"]) + str(i) for i in range(14))
    passage = " ".join(f"passage{i} {rng.choice(WORDS['en'])}" for i in range(30))

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", f"x{rng.randrange(500)}"]) for _ in range(n))

    docs = []
    for i in range(60):
        lang = "de" if i % 4 == 0 else "en"
        text = prose(lang, 80)
        if i % 10 == 3:
            text = docs[0][1] if i == 3 else docs[0][1] + f" changed{i}"  # copies of the first
        elif i % 10 == 5:
            text = f"{prose(lang, 40)} {passage} {prose(lang, 30)}"
        elif i % 10 == 7:
            text = f"{prose(lang, 60)} {item.upper()} {prose(lang, 20)}"
        elif i % 10 == 9:
            text = "1234 !!"
        docs.append((i, text, lang, f"src{0 if i < 30 else i % 5}", len(text)))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _near(a, b):
    x, y = _shingles(a), _shingles(b)
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def test_stages_against_brute_force(spark, corpus):
    path, docs = corpus
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    given = spark.read.parquet(f"{path}/documents.parquet")

    known = [d for d in docs if re.search(r"[^\W\d_]", d[1])]
    out = stage["language_id"](spark, given, path)
    assert out.columns == given.columns and sorted(tuple(r) for r in out.collect()) == known

    kept = []
    for d in known:  # documents come in the order of their ids, so the first of a group is its smallest
        if not any(_near(d[1], k[1]) for k in kept):
            kept.append(d)
    out = stage["near_dedup"](spark, out, path)
    assert out.columns == given.columns and sorted(tuple(r) for r in out.collect()) == kept

    seen, cut = set(), []
    for d in kept:
        w = d[1].split()
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        cut.append((d[0], [x for i, x in enumerate(w) if i not in gone]))
    out = stage["substring_dedup"](spark, out, path)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == given.columns and {i: r.text.split() for i, r in rows.items()} == {i: w for i, w in cut if w}
    assert all(r.n_chars == len(r.text) for r in rows.values())

    item = re.findall(r"[0-9a-z]+", spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first().text.lower())
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = {}
    for i, r in rows.items():
        w = r.text.split()
        low = [x.lower() for x in w]
        hit = {k for a in range(len(w) - 9) if tuple(low[a : a + 10]) in windows for k in range(a, a + 10)}
        if len(hit) <= 0.5 * len(w):
            clean[i] = [x for k, x in enumerate(w) if k not in hit]
    out = stage["decontamination"](spark, out, path)
    assert {r.doc_id: r.text.split() for r in out.collect()} == clean and out.columns == given.columns

    mixed = stage["mixing"](spark, out, path)
    assert mixed.columns == [*given.columns, "weight", "probability"]
    whole = {r.doc_id: tuple(r) for r in out.collect()}
    assert all(whole[r.doc_id] == tuple(r)[: len(given.columns)] and 0 < r.probability <= 1 for r in mixed.collect())
    assert 0 < mixed.count() < len(whole)
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, mixed.collect()))


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs, corpus):  # noqa: F811
    path, _ = corpus
    for docs in (odd_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, path).persist()
            out.count()
            wanted = docs.columns if name != "mixing" else [*(c for c in docs.columns if c != "weight"), "weight", "probability"]
            assert out.columns == wanted, name
    assert out.count() == 0


CLASHING_NAMES = ["found", "score", "lang_pred", "_found", "_doc_id", "_of", "_cut", "_text_hash", "_topic", "_n_tokens", "sampled", "kept", "Score_"]


def test_columns_with_the_names_of_helpers_keep_their_values(spark, corpus):
    path, _ = corpus
    out = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in CLASHING_NAMES])
    for name, stage in corpus_pipeline.STAGES:
        given, out = out.columns, stage(spark, out, path).persist()
        assert out.columns[: len(given)] == given, name
        found = out.select("doc_id", *[f"`{n}`" for n in CLASHING_NAMES]).collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in CLASHING_NAMES), name
