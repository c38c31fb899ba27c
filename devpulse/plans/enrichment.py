"""The enrichment job: backlog, analysis, append."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devpulse.functions.diff import DIFF_BUDGET
from devpulse.operators import backlog
from devpulse.plans import files, incremental, store
from devpulse.sources.tables import stored_schema


def enrich_backlog(
    spark: SparkSession,
    commits: DataFrame,
    analyses_path: str,
    repos: DataFrame,
    analyze: backlog.BatchAnalysis,
    analyzed_at: datetime,
    limit: int | None = None,
    max_chars: int | None = DIFF_BUDGET,
    tasks: int | None = None,
    rollups_root: str | None = None,
) -> DataFrame:
    """Analyze the largest commits without an analysis and append what was found.

    Results are written down once before they are appended, so a slow or paid
    analysis does not run twice, and all become visible in one step.  A run that
    dies leaves the table as it was; a second run takes only what is still
    missing.  With ``rollups_root`` the tag and category rollups are brought up
    to date.  Returns ``status, commits``.
    """
    schema = stored_schema("analyses")
    known = store.read(spark, analyses_path, schema=schema)
    todo = backlog.analysis_backlog(commits, known, repos, limit)
    with backlog.small_batches(spark):
        results, path = files.staged(backlog.enrich(backlog.with_raw_data(todo, commits), analyze, max_chars, tasks), "enriched")
    fresh = backlog.to_analyses(results, analyzed_at)
    if not fresh.isEmpty():
        store.commit(fresh, analyses_path, "analyzed_at")
        for name in ("weekly_tech_trends", "work_category_stats") if rollups_root else ():
            incremental.refresh_analysis_rollup(spark, name, analyses_path, f"{rollups_root}/{name}", repos, fresh)
    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("commits"))
    report = spark.createDataFrame(counts.collect(), counts.schema)  # one row for each of four statuses
    files.delete(spark, path)
    return report
