from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from conftest import rows
from devpulse.operators import present, rollups, widgets

TODAY = date(2024, 3, 20)


def daily(spark, entries):
    """entries: (user, repo, day, commits)."""
    data = [(d, r, u, f"u{u}/r{r}", "Go", n, 10 * n, n, n) for u, r, d, n in entries]
    return spark.createDataFrame(
        data,
        "commit_date date, repo_id long, user_id long, full_name string, primary_language string, "
        "commit_count long, total_additions long, total_deletions long, total_changed_files long",
    )


def days_back(*offsets):
    return [TODAY - timedelta(days=o) for o in offsets]


def test_a_streak_is_as_long_as_it_is(spark):
    entries = [(1, 1, d, 1) for d in days_back(*range(200))]
    assert rows(widgets.current_streak(daily(spark, entries), TODAY)) == [(1, 200)]
    assert rows(widgets.current_streak(daily(spark, entries), TODAY, 120)) == [(1, 121)]


def test_streaks(spark):
    entries = [(1, 1, d, 1) for d in days_back(0, 1, 2, 5)]
    entries += [(2, 2, d, 1) for d in days_back(1, 2, 3, 4, 9)]
    entries += [(3, 3, d, 1) for d in days_back(2, 3)]
    entries += [(4, 4, d, 1) for d in days_back(*range(130))]
    entries += [(5, 5, d, 1) for d in days_back(121)]
    entries += [(6, r, d, 2) for r in (6, 7) for d in days_back(0, 1)]
    got = dict(rows(widgets.current_streak(daily(spark, entries), TODAY, 120)))
    assert got == {1: 3, 2: 4, 3: 0, 4: 121, 6: 2}


def test_days_after_as_of_do_not_count(spark):
    entries = [(1, 1, TODAY + timedelta(days=1), 1), (1, 1, TODAY, 1)]
    assert rows(widgets.current_streak(daily(spark, entries), TODAY)) == [(1, 1)]


def test_empty_previous_month_gives_no_change(spark):
    entries = [(1, 1, TODAY, 4), (2, 2, date(2024, 2, 10), 3), (2, 2, TODAY, 4), (2, 2, date(2024, 3, 25), 50)]
    got = rows(widgets.month_over_month(daily(spark, entries), TODAY), "user_id", "commit_change_pct")
    assert got == [(1, None), (2, 33.3)]


def test_repository_shares_are_of_the_kept_rows(spark):
    entries = [(1, r, TODAY, r) for r in range(1, 13)]
    got = widgets.repo_breakdown(daily(spark, entries), TODAY, limit=10).orderBy("rank").collect()
    assert [r.repo_id for r in got] == list(range(12, 2, -1))
    assert {r.total_commits for r in got} == {75}
    assert got[0].percentage == round(12 / 75 * 100, 1)
    with pytest.raises(ValueError):
        widgets.repo_breakdown(daily(spark, entries), TODAY, limit=51)


def test_activity_filters_days_before_bucketing(spark):
    entries = [(1, 1, date(2024, 3, d), 1) for d in (4, 5, 11, 18)]
    got = rows(
        widgets.commit_activity(daily(spark, entries), TODAY, "weekly", date(2024, 3, 5), date(2024, 3, 11)),
        "date",
        "count",
        "total_commits",
    )
    assert got == [(date(2024, 3, 4), 1, 2), (date(2024, 3, 11), 1, 2)]


def test_empty_repo_list_means_no_filter(spark):
    entries = [(1, 1, TODAY, 1), (1, 2, TODAY, 1)]
    assert rows(widgets.commit_activity(daily(spark, entries), TODAY, repo_ids=[]), "count") == [(2,)]
    assert rows(widgets.commit_activity(daily(spark, entries), TODAY, repo_ids=[2]), "count") == [(1,)]


def test_trend_window_tests_the_monday(spark):
    weekly = spark.createDataFrame(
        [(date(2024, 3, 4), 1, 1, "t", 2), (date(2024, 3, 11), 1, 1, "t", 3)],
        "week_start date, repo_id long, user_id long, tech_tag string, tag_count long",
    )
    assert rows(widgets.tech_trends(weekly, TODAY, date(2024, 3, 6)), "count") == [(3,)]
    assert len(rows(widgets.tech_trends(weekly, TODAY, date(2024, 3, 4)), "count")) == 2


def test_grid_is_full_even_without_activity(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    hourly = spark.createDataFrame(
        [(1, TODAY, 2, 5, 3, 1)],
        "user_id long, activity_date date, day_of_week short, hour_of_day short, commit_count long, pr_count long",
    )
    grid = widgets.hourly_heatmap(hourly, TODAY, users=users).collect()
    assert len(grid) == 2 * 168
    filled = [(r.user_id, r.day_of_week, r.hour, r["count"], r.max_count) for r in grid if r["count"]]
    assert filled == [(1, 2, 5, 4, 4)]
    assert {r.max_count for r in grid if r.user_id == 2} == {0}


def test_language_share_and_top_language(spark, repos):
    got = rows(widgets.language_breakdown(repos), "user_id", "language", "percentage", "color")
    assert got == [(1, "Go", 100.0, "#00ADD8")]
    assert rows(widgets.top_language(repos)) == [(1, "Go")]


def test_empty_language_is_unknown(spark):
    repos = spark.createDataFrame(
        [(1, 1, "", True), (2, 1, "Zig", True), (3, 1, None, True)],
        "repo_id long, user_id long, primary_language string, is_active boolean",
    )
    got = rows(widgets.language_breakdown(repos), "language", "percentage", "color")
    assert got == [("Unknown", 50.0, "#8b8b8b"), ("Zig", 50.0, "#ec915c")]


def test_stats_cover_users_without_data(spark, repos):
    users = spark.createDataFrame([(1,), (2,), (9,)], "user_id long")
    got = rows(
        widgets.dashboard_stats(daily(spark, [(1, 1, TODAY, 3)]), repos, users, TODAY),
        "user_id",
        "total_commits",
        "active_repos",
        "current_streak",
        "top_language",
        "commit_change_pct",
    )
    assert got == [(1, 3, 2, 1, "Go", None), (2, 0, 1, 0, None, None), (9, 0, 0, 0, None, None)]


def test_repeated_tags_count_twice_and_empty_arrays_not_at_all(spark, repos):
    at = datetime(2024, 3, 20, 12)
    analyses = spark.createDataFrame(
        [(1, "commit", 1, ["x", "x"], "c", at), (2, "weekly_summary", 1, [], "summary", at), (3, "commit", 2, None, "c", at)],
        "analysis_id long, source_type string, repo_id long, tech_tags array<string>, work_category string, analyzed_at timestamp",
    )
    tags = rollups.weekly_tech_trends(analyses, repos)
    assert rows(tags, "week_start", "tech_tag", "tag_count") == [(date(2024, 3, 18), "x", 2)]
    categories = rollups.work_category_stats(analyses, repos)
    assert rows(categories, "repo_id", "work_category", "category_count") == [(1, "c", 1), (1, "summary", 1), (2, "c", 1)]
    only = rollups.work_category_stats(analyses, repos, source_types=["commit"])
    assert rows(only, "work_category") == [("c",), ("c",)]


def test_hourly_activity(spark, repos):
    commits = spark.createDataFrame(
        [(1, datetime(2024, 3, 18, 5, 1), 10, 2), (2, datetime(2024, 3, 18, 5, 59), 1, 1)],
        "repo_id long, committed_at timestamp, additions int, deletions int",
    )
    prs = spark.createDataFrame([(1, datetime(2024, 3, 18, 5, 0))], "repo_id long, pr_created_at timestamp")
    got = rows(rollups.hourly_activity(commits, prs, repos))
    assert got == [(1, date(2024, 3, 18), 0, 5, 2, 1, 11, 3)]


def test_pie_slices(spark):
    five = [(1, f"r{i}", 10 - i) for i in range(5)]
    six = [(2, f"r{i}", 10 - i) for i in range(6)] + [(2, "r9", 1)]
    df = spark.createDataFrame(five + six, "user_id long, name string, n long")
    got = present.top_n_other(df, "name", "n").orderBy("user_id", "rank").collect()
    assert [(r.name, r.n) for r in got if r.user_id == 1] == [(n, c) for _, n, c in five]
    assert [(r.name, r.n) for r in got if r.user_id == 2] == [("r0", 10), ("r1", 9), ("r2", 8), ("r3", 7), ("Other", 12)]


def test_trend_maps_split_but_lose_nothing(spark):
    data = [(1, TODAY, f"t{i:03}", i) for i in range(50)] + [(2, TODAY, "only", 1)]
    trends = spark.createDataFrame(data, "user_id long, period_start date, tag string, count long")
    for letters, count in ((2, 1), (3, 5)):
        parts = present.trend_maps(trends, letters).collect()
        whole = {k: v for r in parts if r.user_id == 1 for k, v in r.tags.items()}
        assert whole == {f"t{i:03}": i for i in range(50)} and len([r for r in parts if r.user_id == 1]) == count
        assert [(r.start, r.tags) for r in parts if r.user_id == 2] == [("only"[:letters], {"only": 1})]


def test_orderings(spark):
    entries = [(1, 1, d, 1) for d in days_back(2, 0, 1)]
    got = present.ordered(widgets.commit_activity(daily(spark, entries), TODAY), "activity")
    assert [r.date for r in got.collect()] == sorted(days_back(0, 1, 2))
