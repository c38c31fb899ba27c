from __future__ import annotations

from datetime import date, datetime

import pytest

from conftest import rows
from devpulse.functions import timeops


def test_default_window_is_inclusive(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 30, 31)], "d date")
    got = rows(timeops.date_window(days, "d", date(2024, 1, 30), default_days=28))
    assert got == [(date(2024, 1, 2),), (date(2024, 1, 30),)]


def test_start_after_end_is_an_error(spark):
    with pytest.raises(ValueError):
        timeops.resolve_window(date(2024, 1, 1), date(2024, 2, 1), date(2024, 1, 1))
    # only explicit bounds are checked against each other
    assert timeops.resolve_window(date(2024, 1, 1), start=date(2024, 2, 1)) == (date(2024, 2, 1), date(2024, 1, 1))


def test_period_edges(spark):
    ts = [datetime(2024, 1, 7, 23, 59, 59, 900000), datetime(2024, 1, 8), datetime(2024, 1, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    half_open = timeops.period_filter(df, "t", date(2024, 1, 1), date(2024, 1, 8))
    closed = timeops.closed_period_filter(df, "t", date(2024, 1, 1), date(2024, 1, 7))
    assert half_open.count() == closed.count() == 2


def test_month_partitions_are_pruned(spark, tmp_path):
    from devpulse.sources.tables import write_monthly

    df = spark.createDataFrame(
        [(1, datetime(2024, m, 3)) for m in range(1, 13)], "repo_id long, committed_at timestamp"
    )
    write_monthly(df, "committed_at", str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = timeops.period_filter(stored, "committed_at", date(2024, 3, 1), date(2024, 5, 1))
    assert kept.count() == 2
    assert {p.split("year_month=")[1][:7] for p in kept.inputFiles()} >= {"2024-03", "2024-04"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan
    # a different timestamp must not prune the months of the partition column
    other = timeops.period_filter(stored, "committed_at", date(2024, 3, 1), date(2024, 5, 1), partitioned_by=False)
    assert "PartitionFilters: []" in other._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("as_of", "preset", "expected"),
    [
        (date(2024, 8, 31), "6m", date(2024, 3, 2)),
        (date(2024, 2, 29), "1y", date(2023, 3, 1)),
        (date(2024, 3, 15), "6m", date(2023, 9, 15)),
        (date(2024, 1, 30), "30d", date(2023, 12, 31)),
        (date(2024, 1, 30), "90d", date(2023, 11, 1)),
    ],
)
def test_presets(as_of, preset, expected):
    assert timeops.preset_start(as_of, preset) == expected


def test_month_stepping():
    assert timeops.first_of_month(date(2024, 1, 31), 1) == date(2023, 12, 1)
    assert timeops.first_of_month(date(2024, 12, 5), -1) == date(2025, 1, 1)
    assert timeops.parse_year_month("2024-02") == date(2024, 2, 1)
    for text in ("2024-13", "2024-2", "x"):
        with pytest.raises(ValueError):
            timeops.parse_year_month(text)
    assert timeops.monday_of(date(2024, 1, 28)) == date(2024, 1, 22)


def test_weeks_follow_the_given_start(spark):
    days = [date(2024, 1, d) for d in range(3, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", timeops.week_of("d", date(2024, 1, 24), 4).alias("w")).collect()
    starts = timeops.week_starts(date(2024, 1, 24), 4)
    assert all(r.w in starts and 0 <= (r.d - r.w).days <= 6 for r in got)


def test_buckets_reject_unknown_periods():
    with pytest.raises(ValueError):
        timeops.bucket("d", "yearly")
