"""The sync job: what one run stores, all of it or nothing."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import rollups
from devpulse.plans import files, incremental, store, sync
from devpulse.sources.tables import stored_schema

SINCE = datetime(2024, 1, 10)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "ann", True), (2, "bob", True), (3, "cy", False)], "user_id long, github_login string, has_token boolean")


def repository(i, user, active=True, since=None, github=None):
    return (i, user, github or i, f"o/{i}", None, "C", False, active, "{}", since, SINCE, SINCE)


def commit(repo, seq, sha, day, login="ann", additions=1):
    payload = {"sha": sha, "commit": {"message": sha, "committer": {"date": f"{day}T10:00:00Z" if day else None}}, "author": {"login": login}, "stats": {"additions": additions}}
    return (repo, seq, json.dumps(payload))


def pull(repo, seq, i, created, merged=None):
    return (repo, seq, json.dumps({"id": i, "number": i, "created_at": f"{created}T01:00:00Z", "merged_at": f"{merged}T01:00:00Z" if merged else None, "state": "closed" if merged else "open"}))


def listing(user, seq, i, fork=False):
    return (user, seq, json.dumps({"id": i, "full_name": f"o/{i}", "language": "Go", "fork": fork}))


def landed(spark, commits=(), pulls=(), listings=(), languages=(), errors=()):
    payload = "repo_id long, seq long, payload string"
    return sync.Landed(
        spark.createDataFrame(list(listings), "user_id long, seq long, payload string"),
        spark.createDataFrame(list(commits), payload),
        spark.createDataFrame(list(pulls), payload),
        spark.createDataFrame(list(languages), payload),
        spark.createDataFrame(list(errors), "repo_id long, error_type string, message string"),
    )


@pytest.fixture
def root(spark, tmp_path):
    known = [repository(1, 1), repository(2, 1, since=SINCE), repository(3, 1, False), repository(4, 2), repository(5, 2), repository(6, 3)]
    sync.create(spark, f"{tmp_path}/store", spark.createDataFrame(known, stored_schema("repositories")))
    return f"{tmp_path}/store"


FIRST = dict(
    commits=[
        commit(1, 0, "a", "2024-01-05"), commit(1, 1, "other", "2024-01-05", "eve"), commit(1, 2, "none", None),
        commit(2, 3, "old", "2024-01-09"), commit(2, 4, "b", "2024-01-10"), commit(3, 5, "inactive", "2024-01-06"),
        commit(4, 6, "c", "2024-02-02", "bob"), commit(5, 7, "failed", "2024-02-02", "bob"), commit(6, 8, "no token", "2024-02-02", "cy"),
        commit(1, 9, "old times", "1999-01-01"),
    ],
    pulls=[pull(1, 0, 70, "2024-01-05"), pull(2, 1, 71, "2023-12-31"), pull(2, 2, 72, "2024-01-02", "2024-01-12"), pull(4, 3, 73, "2024-02-02")],
    listings=[listing(1, 0, 1), listing(1, 1, 100), listing(2, 2, 100), listing(2, 3, 101, True), listing(3, 4, 102)],
    languages=[(1, 0, '{"Zig": 5, "C": 2}'), (5, 1, '{"Rust": 1}')],
    errors=[(5, "api_error", "gone")],
)


def state(spark, root):
    """Everything stored, as plain rows."""
    tx = store.Transaction(spark, root)
    repos = sync.repositories(spark, root)
    known = {f.name for f in stored_schema("repositories")}
    out = {"repositories": rows(repos, *sorted(known))}
    for table in ("commits", "pull_requests", sync.DAILY, sync.HOURLY, "sync_jobs"):
        if tx.has(table):
            found = store.read(spark, root, table=table)
            out[table] = rows(found.select(*[F.to_json(F.struct(*sorted(found.columns))).alias("row")]))
    return out


def check_rollups(spark, root):
    repos = sync.repositories(spark, root)
    commits = store.read(spark, root, schema=stored_schema("commits"), table="commits")
    prs = store.read(spark, root, schema=stored_schema("pull_requests"), table="pull_requests")
    for table, whole in ((sync.DAILY, rollups.daily_commit_stats(commits, repos)), (sync.HOURLY, rollups.hourly_activity(commits, prs, repos))):
        assert rows(store.read(spark, root, table=table), *whole.columns) == rows(whole)


def test_a_run(spark, users, root, tmp_path):
    run = sync.Run(datetime(2024, 3, 1))
    done = sync.run_sync(spark, root, users, landed(spark, **FIRST), run, f"{tmp_path}/rejects")
    got = rows(done, "user_id", "status", "items_fetched", "job_type", "error_detail.type", "error_detail.repo_full_name")
    assert got == [(1, "completed", 2, "scheduled_sync", None, None), (2, "completed", 1, "scheduled_sync", "api_error", "o/5")]
    assert rows(store.read(spark, root, table="commits"), "github_commit_sha") == [("a",), ("b",), ("c",)]
    assert rows(store.read(spark, root, table="pull_requests"), "github_pr_id") == [(70,), (72,), (73,)]
    repos = sync.repositories(spark, root)
    marks = {r.github_repo_id: (r.user_id, r.last_synced_at, r.primary_language) for r in repos.collect()}
    now = run.as_of
    assert marks == {
        1: (1, now, "Zig"), 2: (1, now, "C"), 3: (1, None, "C"), 4: (2, now, "C"), 5: (2, None, "C"), 6: (3, None, "C"), 100: (1, now, "Go"),
    }
    assert json.loads(repos.filter("repo_id = 1").first().repo_metadata) == {"languages": {"Zig": 5, "C": 2}}
    check_rollups(spark, root)
    for reason, n in (("undated", 1), ("commits_out_of_range", 1), ("pull_requests_out_of_range", 1)):
        assert spark.read.parquet(f"{tmp_path}/rejects/{reason}").count() == n

    once = state(spark, root)
    sync.run_sync(spark, root, users, landed(spark, **FIRST), run, f"{tmp_path}/rejects")
    assert state(spark, root) == once

    # later: only what is new since the watermark, and a language that the rollup carries
    later = dict(
        commits=[commit(1, 0, "a", "2024-01-05", additions=50), commit(1, 1, "d", "2024-03-02"), commit(4, 2, "e", "2024-02-25", "bob")],
        pulls=[pull(1, 0, 70, "2024-01-05", "2024-03-03")],
        languages=[(4, 0, '{"Ada": 1}')],
    )
    sync.run_sync(spark, root, users, landed(spark, **later), sync.Run(datetime(2024, 3, 5)), f"{tmp_path}/rejects")
    assert rows(store.read(spark, root, table="commits"), "github_commit_sha", "additions") == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]
    assert rows(store.read(spark, root, table="pull_requests").filter("github_pr_id = 70"), "state") == [("closed",)]
    assert rows(store.read(spark, root, table=sync.DAILY).filter("repo_id = 4"), "primary_language") == [("Ada",)]
    check_rollups(spark, root)
    # a full sync of requested repositories finds no new ones and takes old records
    full = dict(later, listings=[listing(1, 0, 555)])
    done = sync.run_sync(spark, root, users, landed(spark, **full), sync.Run(datetime(2024, 3, 6), [1, 3, 4], True), f"{tmp_path}/rejects")
    assert rows(done, "user_id", "job_type", "items_fetched") == [(1, "manual_sync", 2), (2, "manual_sync", 1)]
    assert rows(store.read(spark, root, table="commits"), "github_commit_sha", "additions") == [("a", 50), ("b", 1), ("c", 1), ("d", 1), ("e", 1)]
    assert sync.repositories(spark, root).filter("github_repo_id = 555").count() == 0
    check_rollups(spark, root)


@pytest.mark.parametrize("step", ["update_daily", "update_hourly", "merge", "stale_days"])
def test_a_killed_run_leaves_nothing(spark, users, root, tmp_path, monkeypatch, step):
    if step == "stale_days":
        sync.run_sync(spark, root, users, landed(spark, **FIRST), sync.Run(datetime(2024, 3, 1)), f"{tmp_path}/rejects")
    before = state(spark, root)

    def killed(*args, **kw):
        raise KeyboardInterrupt

    monkeypatch.setattr(incremental, step, killed)
    shared = spark.conf.get("spark.checkpoint.dir")
    staged = set(files.child_names(spark, shared))
    run = sync.Run(datetime(2024, 3, 7))
    with pytest.raises(KeyboardInterrupt):
        sync.run_sync(spark, root, users, landed(spark, **FIRST), run, f"{tmp_path}/rejects")
    assert state(spark, root) == before
    monkeypatch.undo()
    sync.run_sync(spark, root, users, landed(spark, **FIRST), run, f"{tmp_path}/rejects")
    assert len(state(spark, root)["sync_jobs"]) == 2 * (2 if step == "stale_days" else 1)
    check_rollups(spark, root)
    assert {n for n in files.child_names(spark, shared)} - staged <= {n for n in files.child_names(spark, shared) if n.startswith(("found", "hours", "collapsed"))}


def test_a_rate_limit_ends_the_users_job(spark, users, root, tmp_path):
    errors = [(1, "rate_limit", "slow"), (1, "api_error", "x"), (4, "unexpected_error", "y")]
    found = dict(FIRST, errors=errors, listings=[])
    done = sync.run_sync(spark, root, users, landed(spark, **found), sync.Run(datetime(2024, 3, 1)), f"{tmp_path}/rejects")
    got = rows(done, "user_id", "status", "items_fetched", "error_detail.type")
    assert got == [(1, "failed", 0, "rate_limit"), (2, "completed", 1, "unexpected_error")]
    assert rows(store.read(spark, root, table="commits"), "github_commit_sha") == [("failed",)]
    assert rows(sync.repositories(spark, root).filter("last_synced_at = '2024-03-01'"), "repo_id") == [(5,)]


def test_nothing_landed_and_nothing_stored(spark, users, tmp_path):
    root = f"{tmp_path}/empty"
    done = sync.run_sync(spark, root, users, landed(spark), sync.Run(datetime(2024, 3, 1)), f"{tmp_path}/rejects")
    assert rows(done) == [] and rows(sync.repositories(spark, root)) == []


def test_undecided_records_are_kept_apart(spark, users, root, tmp_path):
    same = [commit(1, 3, "x", "2024-02-01", additions=1), commit(1, 3, "x", "2024-02-01", additions=2), commit(1, 4, "y", "2024-02-01")]
    done = sync.run_sync(spark, root, users, landed(spark, commits=same), sync.Run(datetime(2024, 3, 1)), f"{tmp_path}/rejects")
    assert rows(done.filter("user_id = 1"), "items_fetched") == [(1,)]
    assert rows(store.read(spark, root, table="commits"), "github_commit_sha") == [("y",)]
    assert rows(spark.read.parquet(f"{tmp_path}/rejects/commits_undecided"), "additions") == [(1,), (2,)]
