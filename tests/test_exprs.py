from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from devpulse.functions.exprs import (
    capitalize,
    decimal1,
    heat_level,
    iso_timestamp,
    lookup,
    pct1,
    pct_change1,
    round1,
    short_name,
    trend_direction,
    trend_value,
)


def test_share_equals_python_round_for_all_small_ratios(spark):
    pairs = [(n, d) for d in range(1, 401) for n in range(0, d + 1)]
    df = spark.createDataFrame(pairs, "n long, d long").select("n", "d", pct1("n", "d").alias("p"))
    wrong = [r for r in df.collect() if r.p != round(r.n / r.d * 100, 1)]
    assert wrong == []


def test_share_at_exact_decimal_ties(spark):
    pairs = [(n, 2000) for n in range(1, 2001, 2)]
    df = spark.createDataFrame(pairs, "n long, d long").select("n", "d", pct1("n", "d").alias("p"))
    assert [r for r in df.collect() if r.p != round(r.n / r.d * 100, 1)] == []


def test_round1_equals_python_round(spark):
    rnd = random.Random(7)
    values = [rnd.uniform(-1e4, 1e4) for _ in range(20_000)]
    values += [i / 20 for i in range(-4000, 4001)] + [0.35, 0.45, 2.675, -0.04, 0.0, 123456789.25, 1e12 + 0.75]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", round1("v").alias("r"))
    assert [r for r in df.collect() if r.r != round(r.v, 1)] == []


def test_zero_total_gives_zero_share_and_no_change_figure(spark):
    df = spark.createDataFrame([(0, 0), (5, 0)], "n long, d long")
    got = df.select(pct1("n", "d").alias("p"), pct_change1("n", "d").alias("c")).collect()
    assert [(r.p, r.c) for r in got] == [(0.0, None), (0.0, None)]


@pytest.mark.parametrize(("now", "before"), [(3, 2), (1, 3), (0, 7), (2, 3), (1999, 2000), (5, 5), (100000, 3)])
def test_change(spark, now, before):
    got = spark.range(1).select(pct_change1(F.lit(now), F.lit(before)).alias("c")).first().c
    assert got == round((now - before) / before * 100, 1)


def test_labels(spark):
    df = spark.createDataFrame([("feature", "own/repo/x"), ("", "plain"), (None, None)], "c string, n string")
    got = df.select(capitalize("c").alias("c"), short_name("n").alias("n")).collect()
    assert [(r.c, r.n) for r in got] == [("Feature", "repo"), ("", "plain"), (None, None)]


def test_lookup_falls_back(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r.v for r in df.select(lookup("k", {"a": "1"}, "d").alias("v")).collect()] == ["1", "d", "d"]


def test_heat_levels(spark):
    df = spark.createDataFrame([(c, 8) for c in range(9)] + [(0, 0)], "c long, m long")
    assert [r.x for r in df.select(heat_level("c", "m").alias("x")).collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 0]


def test_trend(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (-0.4,), (0.0,), (None,)], "p double")
    got = df.select(trend_direction("p").alias("d"), trend_value("p").alias("v")).collect()
    assert [(r.d, r.v) for r in got] == [("up", 3), ("down", 2), ("down", 0), ("stable", 0), (None, None)]


def test_score_and_time_text(spark):
    df = spark.createDataFrame([(0.25, "2024-01-02T03:04:05Z"), (0.35, ""), (None, "soon")], "s double, t string")
    got = df.select(decimal1("s").cast("string").alias("s"), iso_timestamp("t").cast("string").alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [("0.2", "2024-01-02 03:04:05"), ("0.3", None), (None, None)]
