"""Streaming day counts with late rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from devpulse.operators import rollups
from devpulse.streaming import daily, windows

SCHEMA = "commit_id long, repo_id long, committed_at timestamp, additions int, deletions int, changed_files int"
COLUMNS = ["commit_date", "repo_id", "commit_count", "total_additions", "total_deletions"]
START = datetime(2024, 1, 1, 5)


class Landing:
    def __init__(self, spark, root):
        self.spark, self.root, self.n, self.progress = spark, str(root), 0, []

    def land(self, *entries):
        """(day, repository) of new commits, in a file of their own."""
        found = []
        for day, repo in entries:
            found.append((self.n, repo, START + timedelta(days=day, minutes=self.n), self.n + 1, 1, 0))
            self.n += 1
        self.spark.createDataFrame(found, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/landing")

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/landing")

    def stored(self):
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/landing")

    def count(self):
        run = windows.count_days(self.stream(), f"{self.root}/days", f"{self.root}/cp/days", 3)
        run.awaitTermination()
        self.progress += run.recentProgress

    def reconcile(self):
        months = lambda months: self.stored().filter(F.date_format("committed_at", "yyyy-MM").isin(months))
        windows.reconcile_late(self.stream(), months, f"{self.root}/days", f"{self.root}/cp/late", 3).awaitTermination()

    def same(self):
        found = windows.read_days(self.spark, f"{self.root}/days")
        return rows(found, *COLUMNS) == rows(rollups.commit_counts_by_day(self.stored()), *COLUMNS)


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def test_rows_sixty_days_late_count(landing):
    landing.land((0, 1), (0, 1), (1, 2))
    landing.land((90, 1))
    landing.count()
    assert landing.same()
    landing.land((30, 1), (30, 1), (0, 1), (91, 2))  # sixty and ninety days late
    landing.count()
    assert not landing.same()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in landing.progress for s in p["stateOperators"])
    assert dropped > 0
    landing.reconcile()
    assert landing.same()
    landing.count(), landing.reconcile()  # nothing new
    assert landing.same()
    landing.land((88, 5), (90, 1), (90, 1), (2, 9))  # open days and a late one together
    landing.count(), landing.reconcile()
    assert landing.same()


def test_the_state_stays_small(landing):
    for day in range(0, 40, 2):
        landing.land(*[(day, repo) for repo in range(5)])
    landing.count()
    assert landing.same()
    held = [s["numRowsTotal"] for p in landing.progress for s in p["stateOperators"]]
    assert max(held) <= 25 and landing.n == 100


@pytest.mark.parametrize("seed", range(2))
def test_random_arrival(landing, seed):
    import random

    rng = random.Random(seed)
    for _ in range(4):
        landing.land(*[(rng.choice([rng.randrange(100), 60 + rng.randrange(5)]), rng.randrange(3)) for _ in range(12)])
        if rng.random() < 0.6:
            landing.count(), landing.reconcile()
            assert landing.same()
    landing.count(), landing.reconcile()
    assert landing.same()


def test_a_sum_leaves_its_parts_to_their_readers(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for day in (1, 2, 3):
        spark.createDataFrame([(1, 1, datetime(2024, 1, day), 1, 1, 0)], SCHEMA).write.mode("append").parquet(source)
        daily.write_counts(spark.readStream.schema(SCHEMA).parquet(source), out, f"{tmp_path}/cp").awaitTermination()
    reader = daily.read_counts(spark, out)
    daily.compact(spark, out)
    assert reader.count() == 3 == daily.read_counts(spark, out).count()
    daily.remove_summed(spark, out)
    assert daily.read_counts(spark, out).count() == 3
    assert len([n for n in daily.files.child_names(spark, out) if "=" in n]) == 1
