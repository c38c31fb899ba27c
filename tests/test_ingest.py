from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import upsert
from devpulse.sources import discovery, payloads


def landed(spark, records):
    return spark.createDataFrame(
        [(r, s, json.dumps(p) if not isinstance(p, str) else p) for r, s, p in records],
        "repo_id long, seq long, payload string",
    )


def commit(sha, committer="2024-01-02T03:04:05Z", author=None, additions=1, files=(), message="m"):
    return {
        "sha": sha,
        "commit": {"message": message, "committer": {"date": committer}, "author": {"date": author}},
        "stats": {"additions": additions, "total": 9},
        "files": list(files),
    }


def test_commit_records(spark):
    many = [{"filename": f"f{i}", "status": "added", "additions": 1, "patch": "p" * 600} for i in range(60)]
    records = landed(
            spark,
            [
                (1, 0, commit("a", files=many, message="x" * 2500)),
                (1, 1, commit("b", committer="", author="2024-01-03T00:00:00+09:00")),
                (1, 2, commit("c", committer=None)),
                (1, 3, "not json"),
                (1, 4, {"sha": "d", "commit": {"author": {"date": "2024-01-04T00:00:00Z"}}}),
            ],
    )
    whole = {r.github_commit_sha: r for r in payloads.parse_commits(records)[0].collect()}["a"]
    assert (whole.changed_files, len(whole.raw_data.files), len(whole.message)) == (60, 60, 2500)
    assert {len(f.patch) for f in whole.raw_data.files} == {600} and whole.raw_data.stats == {"additions": 1, "total": 9}
    ok, rejected = payloads.parse_commits(records, payloads.Cuts(2000, 50, 500))
    got = {r.github_commit_sha: r for r in ok.collect()}
    assert set(got) == {"a", "b", "d"} and sorted(r.seq for r in rejected.collect()) == [2, 3]
    a = got["a"]
    assert (a.changed_files, len(a.raw_data.files), len(a.message)) == (60, 50, 2000)
    assert {len(f.patch) for f in a.raw_data.files} == {500} and a.deletions == 0
    assert got["b"].committed_at == datetime(2024, 1, 2, 15)
    assert (got["d"].message, got["d"].additions, got["d"].changed_files) == ("", 0, 0)


def test_pull_request_records(spark):
    base = {"id": 5, "number": 1, "created_at": "2024-01-02T00:00:00Z"}
    ok, rejected = payloads.parse_pull_requests(
        landed(
            spark,
            [
                (1, 0, {**base, "labels": [{"name": "bug"}], "merged_at": "2024-01-03T00:00:00Z", "head": {"ref": "h"}}),
                (1, 1, {**base, "number": 0}),
                (1, 2, {**base, "id": None}),
                (1, 3, {**base, "created_at": ""}),
            ],
        )
    )
    (r,) = ok.collect()
    assert (r.state, r.raw_data.labels, r.raw_data.head_ref, r.raw_data.base_ref) == ("open", ["bug"], "h", None)
    assert r.merged_at == datetime(2024, 1, 3) and r.pr_closed_at is None
    assert rejected.count() == 3


def test_repository_flags(spark):
    listed = spark.createDataFrame(
        [
            (1, i, json.dumps({"id": i, "full_name": f"o/{i}", "private": p, "fork": f}))
            for i, (p, f) in enumerate([(None, None), (True, False), (False, True)])
        ],
        "user_id long, seq long, payload string",
    )
    names = lambda **kw: rows(payloads.parse_repositories(listed, **kw), "full_name")
    assert names() == [("o/0",), ("o/1",)]
    assert names(include_private=False) == [("o/0",)]
    assert names(include_forks=True) == [("o/0",), ("o/1",), ("o/2",)]


def test_first_of_equal_languages_wins(spark):
    df = spark.createDataFrame([('{"Zig":5,"Ada":5,"C":4}',), ("{}",), (None,)], "p string")
    got = df.select(payloads.primary_language(payloads.language_bytes("p")).alias("l")).collect()
    assert [r.l for r in got] == ["Zig", None, None]


def test_manifests(spark):
    files = [(1, "README.md", 0), (1, "go.mod", 1), (1, "sub/pom.xml", 2)]
    files += [(2, f"d{i:02}/x.c", i) for i in range(12)] + [(2, "d09/go.mod", 50), (2, "d09/Dockerfile", 51), (2, "d11/pom.xml", 52)]
    files += [(3, f"d{i:02}/x.c", i) for i in range(10)] + [(3, "late/go.mod", 99)]
    files += [(4, "a/b/go.mod", 0), (4, "c/Gemfile", 1), (4, "c/Gemfile", 1)]
    df = spark.createDataFrame(files, "repo_id long, path string, ord long")
    assert (3, "late/go.mod") in rows(payloads.select_manifests(df))
    assert rows(payloads.select_manifests(df, searched_dirs=10)) == [
        (1, "go.mod"),
        (2, "d09/Dockerfile"),
        (2, "d09/go.mod"),
        (4, "c/Gemfile"),
    ]


def stored_commits(spark, *records):
    return payloads.parse_commits(landed(spark, records))[0]


def test_commit_upsert_keeps_message_and_date(spark):
    base = stored_commits(spark, (1, 0, commit("a", message="old")), (2, 1, commit("a", message="other repository")))
    batch = stored_commits(
        spark,
        (1, 0, commit("a", "2025-05-05T00:00:00Z", message="new", additions=7)),
        (1, 1, commit("a", "2025-06-06T00:00:00Z", message="newer", additions=9)),
        (1, 2, commit("b", message="first", additions=1)),
        (1, 3, commit("b", "2025-06-06T00:00:00Z", message="second", additions=5)),
    )
    once = upsert.upsert_commits(base.drop("seq", "author_login"), batch)
    columns = ["repo_id", "github_commit_sha", "message", "additions", F.col("committed_at").cast("string")]
    wanted = [
        (1, "a", "old", 9, "2024-01-02 03:04:05"),
        (1, "b", "first", 5, "2024-01-02 03:04:05"),
        (2, "a", "other repository", 1, "2024-01-02 03:04:05"),
    ]
    assert rows(once, *columns) == wanted
    assert rows(upsert.upsert_commits(once, batch), *columns) == wanted
    assert upsert.collapse_batch(batch, upsert.COMMITS).agg(F.sum("processed")).first()[0] == 4


def test_an_update_can_clear_a_field(spark):
    pr = {"id": 5, "number": 1, "created_at": "2024-01-02T00:00:00Z", "title": "t", "closed_at": "2024-01-03T00:00:00Z"}
    base = payloads.parse_pull_requests(landed(spark, [(1, 0, pr)]))[0].drop("seq")
    reopened = {**pr, "closed_at": None, "title": None, "number": 9}
    batch = payloads.parse_pull_requests(landed(spark, [(1, 0, reopened)]))[0]
    (r,) = upsert.upsert_pull_requests(base, batch).collect()
    assert (r.title, r.pr_closed_at, r.github_pr_number) == (None, None, 1)


def test_json_patch_keeps_other_keys(spark):
    df = spark.createDataFrame(
        [(1, '{"a":{"x":1},"b":"s","c":[1,2]}'), (2, None), (3, '{"z":true}'), (4, "[1,2]"), (5, "not json"), (6, " ")], "repo_id long, doc string"
    )
    patches = spark.createDataFrame([(1, 0, "1"), (1, 1, '{"n":null}'), (2, 0, '"v"'), (4, 0, "1"), (5, 0, "1"), (6, 0, "1")], "repo_id long, seq long, value string")
    got = {r.repo_id: r.doc for r in upsert.patch_json(df, patches, "repo_id", "doc", "a").collect()}
    assert (got.pop(4), got.pop(5)) == ("[1,2]", "not json")
    assert {k: json.loads(v) for k, v in got.items()} == {1: {"a": {"n": None}, "b": "s", "c": [1, 2]}, 2: {"a": "v"}, 3: {"z": True}, 6: {"a": 1}}
    assert rows(upsert.unreadable_documents(df, "doc"), "repo_id") == [(4,), (5,)]


def test_an_uncertain_arrival_order_ends_the_job(spark):
    same = [(1, 3, commit("a", additions=1)), (1, 3, commit("a", additions=2))]
    with pytest.raises(Exception, match="share the position"):
        upsert.collapse_batch(stored_commits(spark, *same), upsert.COMMITS).collect()
    # equal records, and ties between the first and the last one, decide nothing
    fine = [(1, 1, commit("a")), (1, 1, commit("a")), (1, 2, commit("a", additions=5)), (1, 2, commit("a", additions=6)), (1, 3, commit("a", additions=7))]
    (r,) = upsert.collapse_batch(stored_commits(spark, *fine), upsert.COMMITS).collect()
    assert (r.additions, r.processed) == (7, 5)


def test_discovery_and_registration(spark):
    repos = spark.createDataFrame([(10, 1, 100)], "repo_id long, user_id long, github_repo_id long")
    discovered = spark.createDataFrame(
        [(1, 0, 100, "a/x"), (2, 1, 100, "a/x"), (2, 2, 200, "b/first"), (1, 3, 200, "b/second")],
        "user_id long, seq long, github_repo_id long, full_name string",
    ).withColumns({"description": F.lit(None).cast("string"), "primary_language": F.lit("Go"), "is_private": F.lit(False)})
    report = discovery.discovery_report(discovered, repos)
    assert rows(report, "user_id", "github_repo_id", "already_tracked", "repo_id", "total") == [
        (1, 100, True, 10, 2),
        (1, 200, False, None, 2),
        (2, 100, False, None, 2),
        (2, 200, False, None, 2),
    ]
    new = discovery.auto_register(discovered, repos, datetime(2024, 1, 1))
    assert rows(new, "github_repo_id", "user_id", "full_name", "is_active") == [(200, 2, "b/first", True)]
