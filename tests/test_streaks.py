"""Streaks from monthly bitmaps against those from days."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import streaks, widgets
from devpulse.plans import incremental, store


def table(spark, entries):
    return spark.createDataFrame(entries, "user_id long, commit_date date, repo_id long, commit_count long")


@pytest.mark.parametrize("as_of", [date(2024, 3, 1), date(2024, 2, 29), date(2023, 12, 31), date(2024, 1, 1)])
def test_equals_the_streak_of_days(spark, as_of):
    rng, entries = random.Random(as_of.toordinal()), []
    for user in range(60):
        length, gap = rng.choice([1, 2, 27, 28, 29, 30, 31, 32, 59, 60, 61, 62, 91, 120, 121, 200]), rng.randrange(3)
        newest = as_of - timedelta(days=gap - rng.randrange(2))
        entries += [(user, newest - timedelta(days=i), 1, 1) for i in range(length)]
        entries += [(user, newest - timedelta(days=length + 1 + rng.randrange(90)), 2, 1) for _ in range(20)]
        entries += [(user, as_of + timedelta(days=rng.randrange(1, 40)), 2, 1)] * rng.randrange(2)
    entries += [(100, as_of + timedelta(days=3), 1, 1), (101, as_of - timedelta(days=500), 1, 1)]
    daily = table(spark, entries)
    bitmaps = streaks.active_days(daily)
    for lookback in (None, 0, 1, 30, 120):
        assert rows(streaks.current_streak(bitmaps, as_of, lookback)) == rows(widgets.current_streak(daily, as_of, lookback))
    assert rows(streaks.current_streak(bitmaps, as_of, user_id=3)) == rows(widgets.current_streak(daily, as_of, user_id=3))


def test_months_follow_changes_of_old_days(spark, tmp_path):
    root, first = str(tmp_path), date(2024, 1, 1)
    whole = [(user, first + timedelta(days=i), 1, 1) for user in (1, 2) for i in range(70)]
    without = [e for e in whole if not (e[0] == 1 and e[1] == date(2024, 2, 10))]

    def take(entries, touched):
        store.commit(table(spark, entries), f"{root}/daily", "commit_date", None)
        incremental.refresh_active_days(spark, f"{root}/daily", f"{root}/active", table(spark, touched))
        return store.read(spark, f"{root}/active")

    as_of = first + timedelta(days=69)
    assert rows(streaks.current_streak(take(whole, whole), as_of)) == [(1, 70), (2, 70)]
    files = set(store.read(spark, f"{root}/active", ["2024-01"]).inputFiles())
    gone = take(without, [(1, date(2024, 2, 10), 1, 1)])
    assert rows(streaks.current_streak(gone, as_of)) == [(1, 29), (2, 70)]
    assert files == set(store.read(spark, f"{root}/active", ["2024-01"]).inputFiles())
    # a user's only day of a month goes
    assert rows(streaks.current_streak(take(without[:1], whole), first), "user_id", "current_streak") == [(1, 1)]
    assert rows(store.read(spark, f"{root}/active").select("user_id", "days", F.col("month_start").cast("string"))) == [(1, 1, "2024-01-01")]


def test_no_day_no_row(spark):
    assert rows(streaks.current_streak(streaks.active_days(table(spark, [])), date(2024, 1, 1))) == []
