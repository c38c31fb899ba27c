"""Rollups from one read of each fact table equal those that each read their own."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from conftest import rows
from devpulse.plans import files, refresh

START = datetime(2023, 12, 20)


def facts(spark):
    rng = random.Random(8)
    at = lambda: START + timedelta(hours=rng.randrange(24 * 40))
    some = lambda *values: rng.choice([*values, None])
    commits = [(some(i), rng.randrange(6), some(at()), some(3, 5), some(1), some(2)) for i in range(300)]
    prs = [(i, rng.randrange(6), at()) for i in range(100)]
    analyses = [(some(i), rng.randrange(6), some([], ["x"], ["x", "x", "y"], ["y", None]), some("docs", "bugfix"), some(at())) for i in range(300)]
    return (
        spark.createDataFrame(commits, "commit_id long, repo_id long, committed_at timestamp, additions int, deletions int, changed_files int"),
        spark.createDataFrame(prs, "pr_id long, repo_id long, pr_created_at timestamp"),
        spark.createDataFrame(analyses, "analysis_id long, repo_id long, tech_tags array<string>, work_category string, analyzed_at timestamp"),
    )


def test_equal_to_their_own_definitions(spark, repos):
    commits, prs, analyses = facts(spark)
    shared = refresh.SharedDefinitions(commits, prs, analyses, repos)
    for name, build in refresh.definitions(commits, prs, analyses, repos).items():
        mine, own = shared.builds[name](), build()
        assert mine.columns == own.columns and [f.dataType for f in mine.schema] == [f.dataType for f in own.schema]
        assert rows(mine) == rows(own), name
    shared.release()


def test_each_fact_table_is_read_once(spark, repos, tmp_path):
    paths = []
    for name, df in zip(("commits", "prs", "analyses"), facts(spark)):
        df.write.parquet(f"{tmp_path}/{name}")
        paths.append(f"{tmp_path}/{name}")
    shared = refresh.SharedDefinitions(*[spark.read.parquet(p) for p in paths], repos)
    reads = [f for build in shared.builds.values() for f in {p.split("/part-")[0].rpartition("/")[2] for p in build().inputFiles()}]
    assert sum(f in ("commits", "analyses") for f in reads) == 0 and reads.count("prs") == 1
    staged = [path for _, path in shared._staged.values()]
    assert len(staged) == 2 and all(files.exists(spark, p) for p in staged)
    shared.release()
    assert not any(files.exists(spark, p) for p in staged)
