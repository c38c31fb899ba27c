from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import backlog, jobs, listings, quality
from devpulse.plans import enrichment, store
from devpulse.schemas import COMMIT_RAW


def results(spark, *records):
    return spark.createDataFrame(
        list(records), "job_id long, ord long, repo_full_name string, items long, error_type string, message string"
    )


def test_job_outcomes(spark):
    df = results(
        spark,
        (1, 1, "r1", 5, None, None),
        (1, 2, "r2", 9, "rate_limit", "slow"),
        (1, 3, "r3", 7, None, None),
        (1, 4, "r4", 7, "api_error", "late"),
        (2, 1, "r1", 5, None, None),
        (2, 2, "r2", 9, "api_error", "one"),
        (2, 3, "r3", 7, "unexpected_error", "two"),
        (2, 4, "r4", 2, None, None),
        (3, 1, "r1", 4, None, None),
    )
    got = rows(jobs.job_outcomes(df), "job_id", "items_fetched", "status", "error_detail.type", "error_detail.repo_full_name")
    assert got == [
        (1, 5, "failed", "rate_limit", "r2"),
        (2, 7, "completed", "unexpected_error", "r3"),
        (3, 4, "completed", None, None),
    ]


def test_targets_and_users(spark, repos):
    users = spark.createDataFrame([(1, True), (2, False), (3, True)], "user_id long, has_token boolean")
    assert rows(jobs.sync_users(users, repos), "user_id") == [(1,)]
    assert rows(jobs.sync_targets(repos, user_id=1), "repo_id") == [(1,), (2,)]
    assert rows(jobs.sync_targets(repos, [1, 3, 4]), "repo_id") == [(1,), (4,)]
    assert rows(jobs.require_targets(repos, [1, 4], 1), "repo_id") == [(1,)]
    with pytest.raises(LookupError):
        jobs.require_targets(repos, [4], 1)


def test_incremental_slice(spark):
    repos = spark.createDataFrame(
        [(1, 1, datetime(2024, 1, 2)), (2, 1, None)], "repo_id long, user_id long, last_synced_at timestamp"
    )
    users = spark.createDataFrame([(1, "me")], "user_id long, github_login string")
    batch = spark.createDataFrame(
        [(1, datetime(2024, 1, d), who) for d in (1, 2, 3) for who in ("me", "you")] + [(2, datetime(2020, 1, 1), "me")],
        "repo_id long, at timestamp, author_login string",
    )
    assert jobs.incremental_slice(batch, repos, "at").count() == 5
    assert jobs.incremental_slice(batch, repos, "at", users).count() == 3
    assert jobs.incremental_slice(batch, repos, "at", full_sync=True).count() == 7
    moved = jobs.advance_watermark(repos, batch.filter("repo_id = 2"), datetime(2024, 5, 5))
    assert rows(moved, "repo_id", "last_synced_at") == [(1, datetime(2024, 1, 2)), (2, datetime(2024, 5, 5))]


def test_cached_stack_analysis(spark):
    stamps = {
        1: "2024-01-01T00:00:00+00:00",  # exactly 30 days
        2: "2024-01-01T00:00:01+00:00",  # a second less
        3: "2024-01-31T09:00:00+09:00",
        4: "2024-01-30T00:00:00",  # no offset
        5: "soon",
        6: "",
        7: "2025-01-01T00:00:00Z",  # ahead of the clock
    }
    data = [(i, f'{{"tech_analysis":{{"analyzed_at":"{t}"}}}}') for i, t in stamps.items()] + [(8, "{}"), (9, None)]
    repos = spark.createDataFrame(data, "repo_id long, repo_metadata string")
    due = rows(backlog.tech_analysis_due(repos, datetime(2024, 1, 31)), "repo_id")
    assert due == [(1,), (4,), (5,), (6,), (8,), (9,)]


def commits(spark):
    file = [("f", "added", 1, 0, "+x")]
    data = [
        (i, 1, f"s{i}", f"m{i}", datetime(2024, 1, i), i, i, ({"additions": 1, "deletions": 0}, file if i != 3 else [], None))
        for i in range(1, 7)
    ]
    return spark.createDataFrame(
        data,
        "commit_id long, repo_id long, github_commit_sha string, message string, committed_at timestamp, "
        f"additions int, deletions int, raw_data {COMMIT_RAW.simpleString()}",
    )


def analyses(spark):
    return spark.createDataFrame(
        [("commit", 6), ("commit", 6), ("weekly_summary", 5)], "source_type string, source_id long"
    )


def test_backlog(spark, repos):
    got = backlog.analysis_backlog(commits(spark), analyses(spark), repos, limit=3)
    assert [r.commit_id for r in got.collect()] == [5, 4, 3]
    batch = spark.createDataFrame([(1, "s6"), (1, "s2"), (1, "s2"), (2, "s1")], "repo_id long, github_commit_sha string")
    assert rows(backlog.batch_backlog(commits(spark), batch, analyses(spark)), "commit_id") == [(2,)]


def test_enrichment_isolates_records(spark, repos):
    def analyze(diff, message, repo):
        if message == "m5":
            raise KeyError("bad")
        return {"technologies_detected": [repo], "work_category": "docs", "summary": diff[:7], "complexity_score": 2.35}

    todo = backlog.with_raw_data(backlog.analysis_backlog(commits(spark), analyses(spark), repos), commits(spark))
    done = backlog.enrich(todo, backlog.per_record(analyze), tasks=2)
    assert rows(done, "commit_id", "status") == [(1, "analyzed"), (2, "analyzed"), (3, "skipped"), (4, "analyzed"), (5, "error")]
    kept = backlog.to_analyses(done, datetime(2024, 2, 1))
    assert rows(kept, "source_id", "tech_tags", "summary") == [(i, ["a/one"], "--- a/f") for i in (1, 2, 4)]
    assert {str(r.complexity_score) for r in kept.collect()} == {str(round(2.35, 1))}


def test_rate_limit_leaves_the_rest_pending(spark, repos):
    def analyze(diff, message, repo):
        raise backlog.RateLimited("wait")

    todo = commits(spark).withColumnRenamed("github_commit_sha", "full_name")
    statuses = rows(backlog.enrich(todo.coalesce(1), backlog.per_record(analyze)), "status")
    assert statuses == [("pending",)] * 5 + [("skipped",)]


def test_settings_and_stack_report(spark, repos):
    users = spark.createDataFrame(
        [(1, "me", True, '{"timezone":"UTC"}'), (2, "you", False, None)],
        "user_id long, github_login string, has_token boolean, profile_data string",
    )
    columns = ["user_id", "sync_interval_hours", "gemini_analysis_enabled", "timezone", "tracked_repos_count"]
    assert rows(listings.user_settings(users, repos), *columns) == [(1, 6, True, "UTC", 2), (2, 6, True, "Asia/Tokyo", 1)]

    docs = spark.createDataFrame(
        [
            (1, '{"tech_analysis":{"domain":"iot","tools":["make"]}}'),
            (2, '{"tech_analysis":{}}'),
            (4, '{"tech_analysis":[1]}'),
        ],
        "repo_id long, repo_metadata string",
    )
    full = repos.join(docs, "repo_id", "left").selectExpr("*", "null as description")
    report = listings.tech_stack_report(full)
    got = rows(report, "repo_id", "tech_analysis.domain", "tech_analysis.tools", "tech_analysis.project_type", "domain_label")
    assert got == [(1, "iot", ["make"], "", "IoT"), (2, None, None, None, "Not Analyzed"), (4, None, None, None, "Not Analyzed")]


def test_audit_counts_violations(spark, repos):
    users = spark.createDataFrame(
        [(1, "a" * 300), (2, "b"), (2, "b"), (None, None)], "user_id long, github_login string"
    )
    facts = spark.createDataFrame(
        [(1, "commit", 1, datetime(2023, 12, 31)), (2, "other", 77, datetime(2024, 1, 1)), (3, None, 77, datetime(2028, 1, 1))],
        "analysis_id long, source_type string, repo_id long, analyzed_at timestamp",
    )
    hourly = spark.createDataFrame([(1, 7, 24), (9, 0, 0)], "user_id long, day_of_week short, hour_of_day short")
    found = quality.audit({"users": users, "repositories": repos, "analyses": facts, "hourly_activity": hourly})
    bad = {r.rule: r.violations for r in found.collect() if r.violations}
    assert bad == {
        "V1 analyses.source_type in list": 1,
        "V2 hourly_activity.day_of_week in range": 1,
        "V2 hourly_activity.hour_of_day in range": 1,
        "V3 users(github_login) unique": 1,
        "V4 hourly_activity.user_id in users": 1,
        "V4 analyses.repo_id in repositories": 2,
        "V5 users.user_id not null": 1,
        "V5 users.github_login not null": 1,
        "V5 analyses.source_type not null": 1,
        "V6 users.github_login length": 1,
        "V7 analyses.analyzed_at in month range": 2,
    }


def test_incremental_slice_collects_no_records(spark):
    """Records are wider than Spark's estimate, so only the watermarks may be the side that is hashed."""
    batch = spark.range(9).select(F.col("id").alias("repo_id"), F.lit("ann").alias("author_login"), F.current_timestamp().alias("at"))
    repos = spark.range(99).select(F.col("id").alias("repo_id"), F.lit(1).alias("user_id"), F.lit(None).cast("timestamp").alias("last_synced_at"))
    users = spark.range(1).select(F.lit(1).alias("user_id"), F.lit("ann").alias("github_login"))
    sliced = jobs.incremental_slice(batch, repos, "at", users)
    plan = sliced._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [repo_id" in plan and "BroadcastHashJoin [repo_id" not in plan
    assert sliced.count() == 9


def test_an_analysis_gets_few_diffs_at_a_time(spark, tmp_path):
    """However many rows a task has, Python holds a bounded number of diffs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    commits = spark.range(0, 1200, 1, 1).select(
        F.col("id").alias("commit_id"), F.col("id").alias("repo_id"), F.lit("sha").alias("github_commit_sha"), F.lit("m").alias("message"),
        F.lit(datetime(2024, 1, 5)).alias("committed_at"), F.lit(1).alias("additions"), F.lit(1).alias("deletions"),
        F.from_json(F.lit('{"diff": "d"}'), COMMIT_RAW).alias("raw_data"),
    )

    def sized(batch):
        return batch[[]].assign(status="analyzed", tech_tags=None, work_category="docs", summary=str(len(batch)), complexity_score=None, raw_response=None, error=None)

    repos = spark.range(1200).select(F.col("id").alias("repo_id"), F.lit("o/r").alias("full_name"), F.lit(1).cast("long").alias("user_id"))
    enrichment.enrich_backlog(spark, commits, f"{tmp_path}/analyses", repos, sized, datetime(2024, 1, 6), tasks=1)
    sizes = {int(r[0]) for r in store.read(spark, f"{tmp_path}/analyses").select("summary").distinct().collect()}
    assert store.read(spark, f"{tmp_path}/analyses").count() == 1200 and max(sizes) <= backlog.BATCH_ROWS
    assert spark.conf.get(name) == before
