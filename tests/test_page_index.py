"""Pages through an index of days."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import listings, ranking
from devpulse.plans import incremental, store


def jobs(spark, n):
    start = datetime(2024, 1, 1)
    # a third of all jobs is on one day
    data = [(i, i % 3, start + (timedelta(days=40, seconds=i) if i % 3 == 1 and i % 2 else timedelta(hours=5 * i)), "completed", i % 4 or None) for i in range(n)]
    return spark.createDataFrame(data, "job_id long, user_id long, created_at timestamp, status string, repo_id long")


@pytest.fixture
def stored(spark, tmp_path, repos):
    df = jobs(spark, 600)
    for part in range(3):
        some = df.filter(F.col("job_id") % 3 == part) if part else df.filter("job_id % 3 = 0")
        store.commit(some, f"{tmp_path}/jobs", "created_at", sort_by=("user_id",))
        incremental.refresh_history_index(spark, f"{tmp_path}/jobs", f"{tmp_path}/index", some)
    return df, f"{tmp_path}/jobs", f"{tmp_path}/index"


def test_the_index_equals_a_recount(spark, stored):
    df, _, index = stored
    whole = ranking.level_counts(df, F.to_date("created_at"))
    assert rows(store.read(spark, index), "level", "user_id", "n") == rows(whole, "level", "user_id", "n")


@pytest.mark.parametrize("page", [1, 2, 9, 20, 21])
def test_pages(spark, stored, repos, page):
    df, path, index = stored
    columns = ["user_id", "job_id", "position", "total", "total_pages", "repo_full_name"]
    whole = rows(listings.sync_history(df, repos, page, 10), *columns)
    assert rows(incremental.history_page(spark, path, index, repos, page, 10), *columns) == whole
    assert len(whole) == (30 if page <= 20 else 0)
    one = rows(incremental.history_page(spark, path, index, repos, page, 10, user_id=1), *columns)
    assert one == [r for r in whole if r[0] == 1]


def test_deep_and_first_pages_read_alike(spark, stored, repos):
    _, path, index = stored

    def plan(page):
        found = incremental.history_page(spark, path, index, repos, page, 10, user_id=0)
        text = found._jdf.queryExecution().executedPlan().toString()
        return len(re.findall("FileScan", text)), len(re.findall("Exchange", text)), {f.split("year_month=")[1][:7] for f in found.inputFiles() if path in f}

    first, deep = plan(1), plan(15)
    assert first[:2] == deep[:2]
    assert first[2] == {"2024-05", "2024-04"} or len(first[2]) <= 2
    assert len(deep[2]) <= 2 and first[2] != deep[2]


def test_a_shallow_page_needs_no_levels(spark, repos, monkeypatch):
    df = jobs(spark, 300)
    columns = ["user_id", "job_id", "position", "total"]
    shallow = rows(listings.sync_history(df, repos, 3, 10), *columns)
    monkeypatch.setattr(listings, "SHALLOW", 0)
    assert rows(listings.sync_history(df, repos, 3, 10), *columns) == shallow
