"""Documents of no known language are told from those of a known one."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from devpulse.llm import language_id

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "sch ein ich der und gen ung ver zu ä ö ü tz pf kei lich auf ach mit nen st ck ß hei".split(),
    "fi": "kaa yy ää öi kki ihm set val tuu ksi jär ett hen kin pau lla stä mme nka vuo".split(),
    "ru": "что как все она так его но да ты же вы за бы по ее мне было вот от меня".split(),
}
DOCS = "doc_id long, text string, lang string, note string"


def _prose(rng, lang, n_words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n_words))


@pytest.fixture(scope="module")
def kept(spark):
    rng = random.Random(4)
    rows = [(i, _prose(rng, "en" if i % 2 else "de", rng.randint(100, 200)), "en" if i % 2 else "de", "known") for i in range(160)]
    rows += [(200 + i, _prose(rng, "en" if i % 2 else "de", 150), None, "known, no label") for i in range(20)]
    rows += [(300 + i, _prose(rng, "fi", 150), None, "unlearned") for i in range(10)]
    rows += [(400 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/ ") for _ in range(900)), None, "noise") for i in range(10)]
    rows += [(500 + i, _prose(rng, "ru", n), None, "other letters") for i, n in enumerate((1, 5, 150))]
    docs = spark.createDataFrame(rows, DOCS)
    out = language_id.drop_unknown(docs)
    assert out.columns == docs.columns
    counts = {r.note: r["count"] for r in out.groupBy("note").count().collect()}
    return counts


def test_known_languages_are_kept(kept):
    assert kept["known"] == 160 and kept["known, no label"] == 20


@pytest.mark.parametrize("note", ["unlearned", "noise", "other letters"])
def test_unknown_languages_go(kept, note):
    assert note not in kept


def test_every_labelled_row_makes_its_language_known(spark):
    rng = random.Random(5)
    fold = {f: [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == f] for f in range(3)}
    for f in range(3):
        first, *others = fold[f][:4]
        rows = [(first, _prose(rng, "ru", 150), "ru", ""), *((i, _prose(rng, "ru", 150), None, "") for i in others)]
        rows += [(1000 + i, _prose(rng, "en", 50), "en", "") for i in range(6)]
        assert language_id.drop_unknown(spark.createDataFrame(rows, DOCS)).count() == len(rows)


def test_each_row_is_scored_once(spark, monkeypatch):
    """Labelled rows once by profiles without their fold, all rows once by those of all."""
    plans = []
    monkeypatch.setattr(language_id, "_least_steps", lambda judged, real=language_id._least_steps: plans.append(judged) or real(judged))
    out = language_id.drop_unknown(spark.createDataFrame([(i, "a text of a few words", "en", "") for i in range(20)], DOCS))
    assert out._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    (judged,) = plans
    counted = language_id._score_counts(judged)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("EvalPython") == language_id.FOLDS


def _steps(spark, scores, lang_pred="a"):
    found = F.struct(F.lit(lang_pred).alias("lang_pred"), F.col("score"), F.lit(5).alias("extent"))
    judged = spark.createDataFrame([(s,) for s in scores], "score double").select(F.lit("a").alias("lang"), found.alias("_found"))
    return language_id._least_steps(judged)


def test_bounds_by_plain_counting(spark):
    # of 2,999 rows the two lowest may be lost, of 1,500 none
    assert _steps(spark, [(1000 + i) / 10_000 + 1e-6 for i in range(2999)]) == {("a", 5): 1002.0}
    assert _steps(spark, [(1000 + i) / 10_000 + 1e-6 for i in range(1500)]) == {("a", 5): 1000.0}
    # too few for a share of 1 in 1,000: the bound lies below the lowest
    (few,) = _steps(spark, [(5000 + 10 * i) / 10_000 + 1e-6 for i in range(50)]).values()
    assert few == pytest.approx(5240 - 240 * 3.0902 / 2.0619, abs=0.5)
    # copies of few texts say nothing of others, and wrong finds are no measure
    assert _steps(spark, [0.8, 0.81] * 500) == {}
    assert _steps(spark, [i / 1000 for i in range(500)], "b") == {}
