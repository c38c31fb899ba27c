"""The audit of a stored table reads only what is new."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import quality
from devpulse.plans import audit, store

KEYS = ["repo_id", "github_commit_sha"]
SCHEMA = "commit_id long, repo_id long, github_commit_sha string, message string, committed_at timestamp, additions int, deletions int, changed_files int"


def commits(spark, *entries):
    return spark.createDataFrame([(i, repo, sha, "m", datetime(2024, month, 5), extra, 1, 0) for i, repo, sha, month, extra in entries], SCHEMA)


def run(spark, tmp_path, repos):
    found = audit.audit_store(spark, f"{tmp_path}/commits", f"{tmp_path}/results", "commits", {"repositories": repos}, KEYS)
    # the same rules over the whole table, without those on the surrogate id
    whole = quality.audit({"commits": store.read(spark, f"{tmp_path}/commits").drop("year_month"), "repositories": repos})
    about = whole.filter(F.col("rule").contains("commits") & (F.col("rule") != "V3 commits(commit_id) unique"))
    assert rows(found.rules) == rows(about)
    return found.read_folders, found.folders, {r.rule: r.violations for r in found.rules.collect() if r.violations}


def put(spark, tmp_path, *entries, months=(), keys=KEYS):
    store.commit(commits(spark, *entries), f"{tmp_path}/commits", "committed_at", months, keys=keys)


UNIQUE, KNOWN = "V3 commits(repo_id, github_commit_sha) unique", "V4 commits.repo_id in repositories"


def test_only_new_folders_are_read(spark, repos, tmp_path):
    put(spark, tmp_path, *[(i, 1 + i % 4, f"s{i}", 1 + i % 6, 1) for i in range(60)], (70, 99, "lost", 1, None), (71, 99, "x" * 41, 2, 1))
    bad = {KNOWN: 2, "V5 commits.additions not null": 1, "V6 commits.github_commit_sha length": 1}
    assert run(spark, tmp_path, repos) == (6, 6, bad)
    assert run(spark, tmp_path, repos) == (0, 6, bad)
    # the same commit in another month, and one more of an unknown repository
    put(spark, tmp_path, (1, 2, "s1", 7, 1), (80, 98, "y", 7, 1))
    assert run(spark, tmp_path, repos) == (1, 7, bad | {KNOWN: 3, UNIQUE: 1})
    # a month is written again without the repeated commit
    put(spark, tmp_path, (80, 98, "y", 7, 1), months=["2024-07"])
    assert run(spark, tmp_path, repos) == (1, 7, bad | {KNOWN: 3})
    # the unknown repository is found
    more = repos.unionByName(spark.createDataFrame([(99, 1, "n", "C", True)], repos.schema))
    assert run(spark, tmp_path, more)[2] == {k: v for k, v in bad.items() if k != KNOWN} | {KNOWN: 1}
    # compacted folders are read again; the result stays
    put(spark, tmp_path, (90, 1, "z", 1, 1))
    assert store.compact(spark, f"{tmp_path}/commits", "committed_at", 1) == ["2024-01"]
    assert run(spark, tmp_path, more)[:2] == (1, 7)


def test_folders_without_hashes_and_equal_hashes(spark, repos, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "key_hash", lambda keys: F.lit(5).cast("long"))
    put(spark, tmp_path, (1, 1, "a", 1, 1), (2, 1, "b", 1, 1), (3, 1, "c", 2, 1))
    assert run(spark, tmp_path, repos)[2] == {}
    monkeypatch.undo()
    put(spark, tmp_path, (1, 1, "a", 3, 1), keys=None)
    assert run(spark, tmp_path, repos) == (1, 3, {UNIQUE: 1})


def test_an_empty_table(spark, repos, tmp_path):
    put(spark, tmp_path)
    found = audit.audit_store(spark, f"{tmp_path}/commits", f"{tmp_path}/results", "commits", {"repositories": repos}, KEYS)
    assert found.folders == 0 and rows(found.rules) == [(UNIQUE, 0)]
