from __future__ import annotations

import json
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import rollups, upsert
from devpulse.plans import files, incremental, refresh, store
from devpulse.session import scratch_dir
from devpulse.sources import payloads, tables
from devpulse.streaming import daily, ingest

ROLLUP = ["commit_date", "repo_id", "user_id", "commit_count", "total_additions", "total_deletions", "total_changed_files"]


def record(repo, seq, sha, day, additions=1):
    stamp = f"{day}T10:00:00Z"
    return {
        "repo_id": repo,
        "seq": seq,
        "payload": {
            "sha": sha,
            "commit": {"message": f"{sha}{seq}", "committer": {"date": stamp if day else None}},
            "stats": {"additions": additions, "deletions": 1},
            "files": [{"filename": "f"}],
        },
    }


def parsed(spark, records):
    df = spark.createDataFrame([(r["repo_id"], r["seq"], json.dumps(r["payload"])) for r in records], "repo_id long, seq long, payload string")
    return payloads.parse_commits(df)[0]


FIRST = [record(1, 0, "a", "2024-01-05"), record(1, 1, "b", "2024-02-05"), record(4, 2, "c", "2024-03-05")]
# "a" changes in January although the record claims March; "d" is new and comes twice
SECOND = [record(1, 0, "a", "2024-03-09", 50), record(4, 1, "d", "2024-01-09", 2), record(4, 2, "d", "2024-05-09", 7)]


def take(spark, root, repos, records, **kw):
    merged = incremental.merge_monthly(spark, f"{root}/commits", parsed(spark, records), upsert.COMMITS, **kw)
    incremental.refresh_daily_stats(spark, f"{root}/commits", f"{root}/daily", repos, merged.touched)
    merged.release()
    return merged.rewritten_months


def check(spark, root, repos, *batches):
    """The stored table and rollup equal a recomputation from scratch."""
    whole = parsed(spark, batches[0])
    base = upsert.collapse_batch(whole, upsert.COMMITS).drop("processed")
    for batch in batches[1:]:
        base = upsert.upsert_commits(base, parsed(spark, batch))
    stored = store.read(spark, f"{root}/commits")
    columns = ["repo_id", "github_commit_sha", "message", "additions", F.col("committed_at").cast("string")]
    assert rows(stored, *columns) == rows(base, *columns)
    assert rows(stored.filter("year_month <> date_format(committed_at, 'yyyy-MM')")) == []
    assert rows(store.read(spark, f"{root}/daily"), *ROLLUP) == rows(rollups.daily_commit_stats(base, repos), *ROLLUP)


def test_merge_touches_only_months_with_a_hit(spark, repos, tmp_path):
    root = str(tmp_path)
    assert take(spark, root, repos, FIRST) == []

    def february():
        return {f for f in store.read(spark, f"{root}/commits").inputFiles() if "2024-02" in f}

    untouched = february()
    assert take(spark, root, repos, SECOND) == ["2024-01"]
    check(spark, root, repos, FIRST, SECOND)
    assert untouched == february()


def test_replaying_a_batch_changes_nothing(spark, repos, tmp_path):
    root = str(tmp_path)
    for batch in (FIRST, SECOND, SECOND, FIRST[:0]):
        take(spark, root, repos, batch)
    check(spark, root, repos, FIRST, SECOND)


def test_trusted_dates_search_the_months_of_the_batch(spark, repos, tmp_path):
    root = str(tmp_path)
    take(spark, root, repos, FIRST)
    again = [record(1, 0, "a", "2024-01-05", 8)]
    assert take(spark, root, repos, again, trust_dates=True) == ["2024-01"]
    check(spark, root, repos, FIRST, again)


def test_renamed_repositories_are_brought_up_to_date(spark, repos, tmp_path):
    root = str(tmp_path)
    take(spark, root, repos, FIRST)
    renamed = repos.withColumn("full_name", F.when(F.col("repo_id") == 1, "a/new").otherwise(F.col("full_name")))
    renamed = renamed.withColumn("primary_language", F.when(F.col("repo_id") == 4, "Zig").otherwise(F.col("primary_language")))
    for _ in range(2):
        incremental.refresh_renamed(spark, f"{root}/commits", f"{root}/daily", renamed)
        stored = store.read(spark, f"{root}/daily")
        whole = rollups.daily_commit_stats(store.read(spark, f"{root}/commits"), renamed)
        assert rows(stored, *whole.columns) == rows(whole)


def test_scratch_is_released(spark, repos, tmp_path):
    merged = incremental.merge_monthly(spark, f"{tmp_path}/t", parsed(spark, FIRST), upsert.COMMITS)
    assert all(files.exists(spark, p) for p in merged.scratch)
    merged.release()
    assert not any(files.exists(spark, p) for p in merged.scratch)


@pytest.mark.parametrize("name", ["weekly_tech_trends", "work_category_stats"])
def test_analysis_rollups_are_maintained(spark, repos, tmp_path, name):
    schema = "analysis_id long, source_type string, repo_id long, tech_tags array<string>, work_category string, analyzed_at timestamp"

    def batch(*entries):
        return spark.createDataFrame([(i, "commit", r, ["x", "y"], "docs", t) for i, r, t in entries], schema)

    # the week of Monday 29 January reaches into February
    one = batch((1, 1, datetime(2024, 1, 30)), (2, 4, datetime(2024, 2, 20)))
    two = batch((3, 1, datetime(2024, 2, 2)), (4, 1, datetime(2024, 2, 21)))
    for df in (one, two):
        store.commit(df, f"{tmp_path}/analyses", "analyzed_at")
        incremental.refresh_analysis_rollup(spark, name, f"{tmp_path}/analyses", f"{tmp_path}/{name}", repos, df)
    whole = getattr(rollups, name)(one.unionByName(two), repos)
    assert rows(store.read(spark, f"{tmp_path}/{name}"), *whole.columns) == rows(whole)


DAILY, WEEKLY, CATEGORY = "daily_commit_stats", "weekly_tech_trends", "work_category_stats"


def days(spark, n, column="commit_date"):
    return spark.range(n).select(F.col("id").alias("user_id"), F.date_add(F.lit(date(2024, 1, 20)), F.col("id").cast("int") * 5).alias(column))


def test_refresh_reports_and_isolates_failures(spark, tmp_path):
    root = str(tmp_path)
    for name in (DAILY, CATEGORY):
        refresh.create_rollup(spark, root, name, days(spark, 1, refresh.DAY[name]))

    def broken():
        raise RuntimeError("no source")

    report = refresh.refresh_rollups(spark, root, {CATEGORY: broken, DAILY: lambda: days(spark, 5), WEEKLY: broken})
    assert rows(report, "name", "status") == [(DAILY, "refreshed"), (WEEKLY, "skipped"), (CATEGORY, "failed")]
    assert refresh.read_rollup(spark, root, DAILY).count() == 5
    assert refresh.read_rollup(spark, root, CATEGORY).count() == 1
    with pytest.raises(FileNotFoundError):
        refresh.read_rollup(spark, root, WEEKLY)


def test_old_versions_stay_readable_during_a_refresh_and_unfinished_ones_do_not_count(spark, tmp_path):
    root = str(tmp_path)
    refresh.create_rollup(spark, root, DAILY, days(spark, 1))
    reader = refresh.read_rollup(spark, root, DAILY)
    refresh.create_rollup(spark, root, DAILY, days(spark, 2))
    assert reader.count() == 1
    # a run that died with its rows written but not its list, or the list not committed
    days(spark, 9).withColumn("year_month", F.lit("2024-01")).write.partitionBy("year_month").parquet(f"{root}/{DAILY}/data/version-00000003")
    spark.createDataFrame([("2024-01", "version-00000003")], "year_month string, version string").write.json(f"{root}/{DAILY}/lists/version-00000003")
    files.delete(spark, f"{root}/{DAILY}/lists/version-00000003/_SUCCESS")
    assert refresh.read_rollup(spark, root, DAILY).count() == 2
    refresh.create_rollup(spark, root, DAILY, days(spark, 4))
    assert refresh.read_rollup(spark, root, DAILY).count() == 4
    assert reader.count() == 1
    store.expire(spark, f"{root}/{DAILY}", 1)
    assert refresh.read_rollup(spark, root, DAILY).count() == 4
    assert files.child_names(spark, f"{root}/{DAILY}/lists")[-1:] == ["version-00000004"]
    assert not files.exists(spark, f"{root}/{DAILY}/data/version-00000001/year_month=2024-01")


def test_a_merge_that_dies_loses_nothing(spark, repos, tmp_path, monkeypatch):
    root = str(tmp_path)
    take(spark, root, repos, FIRST)
    before = rows(store.read(spark, f"{root}/commits"), "repo_id", "github_commit_sha", "additions")

    real = store.files.child_names

    def dies(session, path):
        if "/data/version-" in path:
            raise OSError("lost")  # after the rows are written, before the switch
        return real(session, path)

    monkeypatch.setattr(store.files, "child_names", dies)
    with pytest.raises(OSError):
        take(spark, root, repos, SECOND)
    monkeypatch.undo()
    assert rows(store.read(spark, f"{root}/commits"), "repo_id", "github_commit_sha", "additions") == before
    take(spark, root, repos, SECOND)
    check(spark, root, repos, FIRST, SECOND)


def test_small_pieces_of_a_month_are_joined(spark, tmp_path):
    for i in range(4):
        store.commit(days(spark, 3), f"{tmp_path}/t", "commit_date", sort_by=("user_id",))
    assert store.compact(spark, f"{tmp_path}/t", "commit_date", 3, ("user_id",)) == ["2024-01"]
    assert store.compact(spark, f"{tmp_path}/t", "commit_date", 3, ("user_id",)) == []
    assert store.read(spark, f"{tmp_path}/t").count() == 12


def test_hourly_rollup_is_maintained(spark, repos, tmp_path):
    root, schema = str(tmp_path), "pr_id long, repo_id long, pr_created_at timestamp"
    prs = [spark.createDataFrame([(1, 1, datetime(2024, 1, 5, 10))], schema), spark.createDataFrame([(2, 4, datetime(2024, 2, 1, 1)), (3, 2, datetime(2024, 1, 5, 10))], schema)]
    for records, pulls in zip((FIRST, SECOND), prs):
        merged = incremental.merge_monthly(spark, f"{root}/commits", parsed(spark, records), upsert.COMMITS)
        store.commit(pulls, f"{root}/prs", "pr_created_at")
        times = merged.touched.select("repo_id", F.col("committed_at").alias("at")).union(pulls.select("repo_id", "pr_created_at"))
        incremental.refresh_hourly(spark, f"{root}/commits", f"{root}/prs", f"{root}/rollups/hourly_activity", repos, times)
        whole = rollups.hourly_activity(store.read(spark, f"{root}/commits"), store.read(spark, f"{root}/prs"), repos)
        assert rows(refresh.read_rollup(spark, f"{root}/rollups", "hourly_activity"), *whole.columns) == rows(whole)


def test_rows_outside_the_month_range_are_set_aside(spark):
    df = spark.createDataFrame([(datetime(2023, 12, 31),), (datetime(2024, 1, 1),), (datetime(2027, 12, 31, 23),), (datetime(2028, 1, 1),), (None,)], "at timestamp")
    inside, outside = tables.split_month_range(df, "at")
    assert (inside.count(), outside.count()) == (2, 3)


def test_typed_scan(spark, repos, tmp_path):
    rows_ = spark.createDataFrame([(1, 1, "sha", "m", datetime(2024, 2, 3), 1, 2, 3)], "commit_id long, repo_id long, github_commit_sha string, message string, committed_at timestamp, additions int, deletions int, changed_files int")
    tables.write_monthly(rows_, "committed_at", f"{tmp_path}/commits")
    df = tables.load(spark, str(tmp_path), "commits")
    assert [f.name for f in df.schema][-1] == "year_month" and df.first().year_month == "2024-02"


# --- streams -----------------------------------------------------------------


def land(path, name, records):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in records))


def test_streamed_files_give_the_batch_result(spark, repos, tmp_path):
    root = str(tmp_path)

    def run():
        ingest.ingest_commits(
            spark, f"{root}/landing", f"{root}/commits", f"{root}/daily", repos, f"{root}/checkpoint", 1, quarantine=f"{root}/rejects"
        ).awaitTermination()

    land(tmp_path / "landing", "1.json", FIRST)
    run()
    land(tmp_path / "landing", "2.json", [*SECOND, record(1, 5, "x", None), record(1, 6, "y", "1999-01-01")])
    run()
    run()
    check(spark, root, repos, FIRST, SECOND)
    assert spark.read.parquet(f"{root}/rejects/undated").count() == 1
    assert spark.read.parquet(f"{root}/rejects/out_of_range").count() == 1


def test_files_in_one_micro_batch_arrive_in_their_order(spark, repos, tmp_path):
    """`seq` starts anew in each file; a later file wins over an earlier one."""
    first, second = [record(1, 9, "a", "2024-01-05", 111)], [record(1, 0, "a", "2024-01-05", 222)]
    got = []
    for name, max_files in (("one", 1), ("all", None)):
        root = tmp_path / name
        root.mkdir()
        land(root / "landing", "1.json", first)
        time.sleep(0.02)
        land(root / "landing", "2.json", second)
        ingest.ingest_commits(
            spark, f"{root}/landing", f"{root}/commits", f"{root}/daily", repos, f"{root}/checkpoint", max_files, quarantine=f"{root}/rejects"
        ).awaitTermination()
        got.append(rows(store.read(spark, f"{root}/commits"), "additions", "message"))
    assert got[0] == got[1] == [(222, "a9")]


def test_streamed_pull_requests(spark, tmp_path):
    root = str(tmp_path)
    pr = {"id": 7, "number": 1, "created_at": "2024-01-02T00:00:00Z", "state": "open"}
    land(tmp_path / "landing", "1.json", [{"repo_id": 1, "seq": 0, "payload": pr}])
    ingest.ingest_pull_requests(spark, f"{root}/landing", f"{root}/prs", f"{root}/cp", quarantine=f"{root}/rejects").awaitTermination()
    land(tmp_path / "landing", "2.json", [{"repo_id": 1, "seq": 0, "payload": {**pr, "state": "closed", "number": 3}}])
    ingest.ingest_pull_requests(spark, f"{root}/landing", f"{root}/prs", f"{root}/cp", quarantine=f"{root}/rejects").awaitTermination()
    assert rows(store.read(spark, f"{root}/prs"), "state", "github_pr_number") == [("closed", 1)]


def test_live_counts_with_late_rows(spark, tmp_path):
    schema = "repo_id long, committed_at timestamp, additions int, deletions int"
    source = f"{tmp_path}/in"
    batches = [
        [(1, datetime(2024, 1, 10, 5), 1, 1), (1, datetime(2024, 1, 11, 5), 2, 1)],
        [(1, datetime(2024, 1, 10, 23), 4, 1), (2, datetime(2024, 1, 9, 1), 8, 1), (1, datetime(2020, 1, 1), 16, 1)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        daily.write_counts(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        got = rows(daily.read_counts(spark, f"{tmp_path}/out"), "commit_date", "repo_id", "commit_count", "total_additions")
        daily.compact(spark, f"{tmp_path}/out")
        assert got == rows(daily.read_counts(spark, f"{tmp_path}/out"), "commit_date", "repo_id", "commit_count", "total_additions")
    assert got == [(date(2020, 1, 1), 1, 1, 16), (date(2024, 1, 9), 2, 1, 8), (date(2024, 1, 10), 1, 2, 5), (date(2024, 1, 11), 1, 1, 2)]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch_dir(Cluster, "x")


def test_a_heavy_month_is_spread_over_files_and_light_ones_are_not(spark, tmp_path):
    heavy = F.when(F.col("id") % 10 != 0, F.lit("2024-05-05 00:00:00")).otherwise(F.lit("2024-06-06 00:00:00"))
    df = spark.range(300_000).select(
        F.xxhash64("id").alias("repo_id"), heavy.cast("timestamp").alias("committed_at"), F.md5(F.col("id").cast("string")).alias("sha")
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2MB")
    try:
        tables.write_monthly(df.repartition(8), "committed_at", f"{tmp_path}/t")
    finally:
        spark.conf.set(key, before)
    names = {m: [f for f in files.child_names(spark, f"{tmp_path}/t/year_month=2024-{m}") if f.startswith("part")] for m in ("05", "06")}
    assert len(names["05"]) >= 4 and len(names["06"]) == 1
