from __future__ import annotations

import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import summaries

MONDAY = date(2024, 3, 4)


def users(spark):
    return spark.createDataFrame([(1,), (2,)], "user_id long")


def commits(spark, *entries):
    return spark.createDataFrame(
        [(i, r, t, 2, 1, f"m{i}") for i, (r, t) in enumerate(entries)],
        "commit_id long, repo_id long, committed_at timestamp, additions int, deletions int, message string",
    )


def prs(spark, *entries):
    return spark.createDataFrame(
        [(i, r, c, m, "t", "open", 1, 1) for i, (r, c, m) in enumerate(entries)],
        "pr_id long, repo_id long, pr_created_at timestamp, merged_at timestamp, title string, state string, "
        "additions int, deletions int",
    )


def analyses(spark, *entries):
    """entries: (type, source, repo, tags, category, raw, analyzed_at)."""
    return spark.createDataFrame(
        [(i, k, s, r, tags, c, f"s{i}", json.dumps(raw) if raw else None, t) for i, (k, s, r, tags, c, raw, t) in enumerate(entries)],
        "analysis_id long, source_type string, source_id long, repo_id long, tech_tags array<string>, "
        "work_category string, summary string, raw_response string, analyzed_at timestamp",
    )


def weekly(spark, repos, cs=(), ps=(), ans=(), start=MONDAY, count=1):
    return summaries.weekly_summary(
        users(spark), commits(spark, *cs), prs(spark, *ps), analyses(spark, *ans), repos, start, count, 10, 3
    )


def test_merges_count_up_to_the_last_moment_of_the_week(spark, repos):
    created = datetime(2024, 1, 1)
    ps = [(1, created, t) for t in (datetime(2024, 3, 10, 23, 59, 59, 900000), datetime(2024, 3, 11), None)]
    got = rows(weekly(spark, repos, cs=[(1, datetime(2024, 3, 4))], ps=ps), "user_id", "total_prs_merged", "highlight")
    assert got == [(1, 1, "1件のコミットと1件のPRマージを実施"), (2, 0, "この週のアクティビティはありません")]


def test_week_lists(spark, repos):
    t = datetime(2024, 3, 5)
    ans = [("commit", 1, 1, ["b", "b", "a"], "feature", None, t)]
    ans += [("commit", 1, 2, [f"x{i}" for i in range(12)], "docs", None, t + timedelta(hours=i)) for i in range(1, 5)]
    ans += [("weekly_summary", 1, 1, ["zzz"], "summary", None, t + timedelta(days=3))]
    (r,) = weekly(spark, repos, ans=ans).filter("user_id = 1").collect()
    assert r.key_achievements == ["s4", "s3", "s2"]
    # four times each, so by name; b and a come later
    assert r.technologies_used == sorted(f"x{i}" for i in range(12))[:10]
    assert r.generated_at == t + timedelta(days=3)
    assert (r.total_commits, r.week_end) == (0, date(2024, 3, 10))


def test_weeks_need_not_start_on_monday(spark, repos):
    cs = [(1, datetime(2024, 3, d, 1)) for d in (5, 6, 12, 13, 20)]
    got = rows(weekly(spark, repos, cs=cs, start=date(2024, 3, 13), count=2).filter("user_id = 1"), "week_start", "total_commits")
    assert got == [(date(2024, 3, 6), 2), (date(2024, 3, 13), 1)]


def test_stored_week_replaces_the_computed_one(spark, repos):
    def raw(week, **kw):
        return {"week_start": week, "commits_count": 99, "highlight": "stored", **kw}

    t = datetime(2024, 3, 12)
    ans = [
        ("weekly_summary", 1, 1, [], "summary", raw("2024-03-04", prs_count=3, key_achievements=["k"]), t),
        ("weekly_summary", 1, 1, [], "summary", raw("2024-03-04", commits_count=50), t - timedelta(hours=1)),
        ("weekly_summary", 1, 3, [], "summary", raw("2024-02-26"), t),  # inactive repository
        ("weekly_summary", 2, 1, [], "summary", raw("2024-03-04"), t),  # not that user's repository
    ]
    computed = weekly(spark, repos, ans=ans, count=2)
    got = rows(
        summaries.resolve_weekly(computed, analyses(spark, *ans), repos),
        "user_id", "week_start", "total_commits", "total_prs_merged", "highlight", "key_achievements", "origin",
    )
    assert got[1] == (1, date(2024, 3, 4), 99, 3, "stored", ["k"], "generated")
    assert [r[-1] for r in got] == ["computed", "generated", "computed", "computed"]


def test_all_stored_weeks_are_searched_unless_limited(spark, repos):
    t = datetime(2024, 3, 12)
    old = ("weekly_summary", 1, 1, [], "summary", {"week_start": "2024-03-04"}, t)
    newer = [("weekly_summary", 1, 1, [], "summary", {"week_start": "2023-01-02"}, t + timedelta(days=i)) for i in range(1, 11)]
    for ans, keep, origin in (([old, *newer], None, "generated"), ([old, *newer[:9]], 10, "generated"), ([old, *newer], 10, "computed")):
        resolved = summaries.resolve_weekly(weekly(spark, repos, ans=ans), analyses(spark, *ans), repos, keep)
        assert rows(resolved.filter("user_id = 1"), "origin") == [(origin,)]


def test_months(spark, repos):
    cs = [(1, datetime(2024, 2, 29, 23, 59)), (1, datetime(2024, 3, 1)), (2, datetime(2024, 3, 31)), (3, datetime(2024, 3, 31)), (3, datetime(2024, 3, 9))]
    ans = [("commit", i, 1, [], c, None, datetime(2024, 3, 3)) for i, c in enumerate("aabbbcdefgh")]
    march = date(2024, 3, 1)
    got = summaries.monthly_summary(users(spark), commits(spark, *cs), analyses(spark, *ans), repos, march, 2, areas_kept=5)
    by_month = {(r.user_id, r.month): r for r in got.collect()}
    r = by_month[1, 3]
    assert (r.total_commits, r.active_repo_count, r.growth_areas) == (4, 3, ["b", "a", "c", "d", "e"])
    assert r.narrative == "2024年3月は4件のコミットを行い、3個のリポジトリで活動しました。"
    assert by_month[1, 2].total_commits == 1 and by_month[2, 3].narrative == "2024年3月のアクティビティはありません。"
    names = summaries.monthly_active_repos(commits(spark, *cs), repos, march)
    assert rows(names, "full_name", "commit_count") == [("a/one", 1), ("a/three", 2), ("a/two", 1)]


def test_month_statistics_leave_out_inactive_repositories(spark, repos):
    cs = [(1, datetime(2024, 3, 1)), (3, datetime(2024, 3, 1))]
    ans = [("commit", 1, 1, [], "docs", None, datetime(2024, 3, 3)), ("weekly_summary", 1, 1, [], "summary", None, datetime(2024, 3, 3))]
    ps = [(1, datetime(2024, 3, 5), None), (1, datetime(2024, 4, 1), None)]
    stats = summaries.month_stats(users(spark), commits(spark, *cs), prs(spark, *ps), analyses(spark, *ans), repos, date(2024, 3, 1), with_breakdown=True)
    r = {x.user_id: x for x in stats.collect()}
    assert tuple(r[1]) == (1, 2024, 3, 1, 1, 2, 1, 1, {"docs": 1})
    assert tuple(r[2]) == (2, 2024, 3, 0, 0, 0, 0, 0, {})


def test_stored_month_lists_all_active_repositories(spark, repos):
    cs = [(1, datetime(2024, 3, 1)), (4, datetime(2024, 3, 1))]
    raw = {"year": 2024, "month": 3, "narrative": "told", "month_stats": {"total_commits": 7}}
    ans = [("monthly_summary", 1, 1, [], "summary", raw, datetime(2024, 4, 1))]
    march = date(2024, 3, 1)
    computed = summaries.monthly_summary(users(spark), commits(spark, *cs), analyses(spark, *ans), repos, march)
    resolved = summaries.resolve_monthly(computed, analyses(spark, *ans), repos)
    assert rows(resolved, "user_id", "total_commits", "active_repo_count", "narrative", "origin") == [
        (1, 7, 2, "told", "generated"),
        (2, 1, 1, "2024年3月は1件のコミットを行い、1個のリポジトリで活動しました。", "computed"),
    ]
    names = summaries.resolved_month_repos(resolved, summaries.monthly_active_repos(commits(spark, *cs), repos, march), repos)
    assert rows(names, "user_id", "full_name") == [(1, "a/one"), (1, "a/two"), (2, "b/four")]


def test_evidence_is_limited_per_user_and_week(spark, repos):
    cs = [(1 + i % 2, datetime(2024, 3, 4) + timedelta(minutes=i)) for i in range(150)] + [(4, datetime(2024, 3, 4))]
    got = summaries.evidence_commits(commits(spark, *cs), repos, MONDAY, limit=100).collect()
    mine = sorted((r for r in got if r.user_id == 1), key=lambda r: r.rank)
    assert len(mine) == 100 and mine[0].message == "m149" and mine[-1].message == "m50"
    assert len([r for r in got if r.user_id == 2]) == 1


def test_lists_without_a_bound_are_rows_that_no_window_sorts(spark, repos):
    at = lambda day: datetime(2024, 3, day, 9)
    found = [(i, 1 + i % 2, "commit", f"s{i}", ["x", f"t{i}"], at(4 + i % 9)) for i in range(40)] + [(99, 1, "weekly_summary", "w", ["y"], at(5))]
    df = spark.createDataFrame(found, "analysis_id long, repo_id long, source_type string, summary string, tech_tags array<string>, analyzed_at timestamp")
    week = date(2024, 3, 4)
    in_week = [f for f in found if f[2] == "commit" and f[5] < datetime(2024, 3, 11)]
    tags = rows(summaries.weekly_technologies(df, repos, week), "user_id", "tag", "tag_count")
    assert tags == sorted([(1, "x", len(in_week))] + [(1, f[4][1], 1) for f in in_week], key=lambda r: [str(v) for v in r])
    achieved = summaries.weekly_achievements(df, repos, week)
    assert rows(achieved, "summary") == sorted((f[3],) for f in in_week)
    commits_ = df.select(F.col("analysis_id").alias("commit_id"), "repo_id", F.col("summary").alias("message"), F.lit(1).alias("additions"), F.lit(1).alias("deletions"), F.col("analyzed_at").alias("committed_at"))
    everything = summaries.evidence_commits(commits_, repos, week, limit=None)
    assert everything.count() == len(in_week) + 1 and everything.filter("rank IS NOT NULL").count() == 0
    for whole in (achieved, everything):
        assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    assert summaries.evidence_commits(commits_, repos, week, limit=5).count() == 5
