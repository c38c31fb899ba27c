"""Materialized rollups with versioned refresh."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.operators import rollups
from devpulse.plans import files, store

log = logging.getLogger(__name__)

#: the day that a rollup is stored by; its files are sorted by user, so a read for
#: one user and some days skips most of them by their column statistics
DAY = {
    "daily_commit_stats": "commit_date",
    "weekly_tech_trends": "week_start",
    "work_category_stats": "analysis_date",
    "hourly_activity": "activity_date",
}


def read_rollup(spark: SparkSession, root: str, name: str) -> DataFrame:
    if not store.exists(spark, f"{root}/{name}"):
        raise FileNotFoundError(f"rollup {name} was never created under {root}")
    return store.read(spark, f"{root}/{name}").drop(MONTH_COLUMN)


def create_rollup(spark: SparkSession, root: str, name: str, df: DataFrame) -> None:
    """Write the whole rollup anew and switch to it.

    A failed write leaves the old version in place.  Old versions stay until
    `store.expire` removes them, as only the caller knows which are being read.
    """
    store.commit(df, f"{root}/{name}", DAY[name], None, sort_by=("user_id", DAY[name]))


def definitions(
    commits: DataFrame, pull_requests: DataFrame, analyses: DataFrame, repos: DataFrame
) -> dict[str, Callable[[], DataFrame]]:
    """How each rollup is built from the stored tables."""
    return {
        "daily_commit_stats": lambda: rollups.daily_commit_stats(commits, repos),
        "weekly_tech_trends": lambda: rollups.weekly_tech_trends(analyses, repos),
        "work_category_stats": lambda: rollups.work_category_stats(analyses, repos),
        "hourly_activity": lambda: rollups.hourly_activity(commits, pull_requests, repos),
    }


class SharedDefinitions:
    """The rollups' definitions from one read of each fact table.

    Commits are counted once by hour and analyses once by week, day and label; the first
    rollup that needs such counts stages them, the others start from there.  `release`
    removes them.
    """

    def __init__(self, commits: DataFrame, pull_requests: DataFrame, analyses: DataFrame, repos: DataFrame):
        self._sources = {"commits": lambda: rollups.commit_grain(commits), "analyses": lambda: rollups.analysis_grain(analyses)}
        self._staged: dict[str, tuple[DataFrame, str]] = {}
        self.builds: dict[str, Callable[[], DataFrame]] = {
            "daily_commit_stats": lambda: rollups.daily_from_grain(self._grain("commits"), repos),
            "weekly_tech_trends": lambda: rollups.tags_from_grain(self._grain("analyses"), repos),
            "work_category_stats": lambda: rollups.categories_from_grain(self._grain("analyses"), repos),
            "hourly_activity": lambda: rollups.hourly_from_grain(self._grain("commits"), pull_requests, repos),
        }

    def _grain(self, name: str) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = files.staged(self._sources[name](), f"{name}_grain")
        return self._staged[name][0]

    def release(self) -> None:
        for df, path in self._staged.values():
            files.delete(df.sparkSession, path)
        self._staged.clear()


def refresh_rollups(
    spark: SparkSession,
    root: str,
    definitions: dict[str, Callable[[], DataFrame]],
    names: list[str] | None = None,
) -> DataFrame:
    """Rebuild existing rollups; one failure does not stop the others.

    Returns ``name, status, detail`` with status refreshed, skipped or failed.
    """
    report = []
    for name in names or list(definitions):
        try:
            if not store.exists(spark, f"{root}/{name}"):
                report.append((name, "skipped", "does not exist"))
                continue
            create_rollup(spark, root, name, definitions[name]())
            report.append((name, "refreshed", None))
        except Exception as e:  # reported per rollup; the others must still run
            log.exception("refresh of %s failed", name)
            report.append((name, "failed", str(e).splitlines()[0] if str(e) else type(e).__name__))
    return spark.createDataFrame(report, "name string, status string, detail string")
