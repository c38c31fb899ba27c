"""Enrichment backlog and the batch analysis hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devpulse.functions.diff import DIFF_BUDGET, assemble_diff, truncate_diff
from devpulse.functions.exprs import decimal1

ANALYSIS_CACHE_DAYS = 30


class RateLimited(Exception):
    """Raised by an analysis function to stop its partition; the rest stays pending."""


def unanalyzed(commits: DataFrame, analyses: DataFrame) -> DataFrame:
    """Commits without a commit analysis.

    The id list is made distinct before the shuffle, so repeated analyses of one
    commit cannot pile up in a task.
    """
    done = analyses.filter(F.col("source_type") == "commit").select(F.col("source_id").alias("commit_id")).distinct()
    return commits.join(done, "commit_id", "left_anti")


def analysis_backlog(commits: DataFrame, analyses: DataFrame, repos: DataFrame, limit: int | None = None) -> DataFrame:
    """The largest commits still to analyze, or all of them, largest first.

    Only narrow columns travel; use `with_raw_data` to fetch the documents of
    the rows that were chosen.
    """
    narrow = commits.select(
        "commit_id", "repo_id", "github_commit_sha", "message", "committed_at", "additions", "deletions"
    )
    rows = (
        unanalyzed(narrow, analyses)
        .join(repos.select("repo_id", "full_name"), "repo_id")
        .withColumn("change_size", F.col("additions").cast("long") + F.col("deletions"))
        .orderBy(F.desc("change_size"), F.asc("commit_id"))
    )
    return rows if limit is None else rows.limit(limit)


def with_raw_data(backlog: DataFrame, commits: DataFrame) -> DataFrame:
    """Attach ``raw_data`` to backlog rows; stored months without any are pruned."""
    keys = ["commit_id"]
    if "year_month" in commits.columns:
        backlog = backlog.withColumn("year_month", F.date_format("committed_at", "yyyy-MM"))
        keys.append("year_month")
    return backlog.join(commits.select(*keys, "raw_data"), keys)


def batch_backlog(commits: DataFrame, batch: DataFrame, analyses: DataFrame) -> DataFrame:
    """Commits whose sha came in with the batch and that have no analysis."""
    keys = ["repo_id", "github_commit_sha"]
    arrived = commits.join(batch.select(*keys).distinct(), keys, "left_semi")
    return unanalyzed(arrived, analyses)


def tech_analysis_due(repos: DataFrame, as_of: datetime, days: int = ANALYSIS_CACHE_DAYS) -> DataFrame:
    """repositories whose stack analysis is missing, unreadable or too old.

    A time without zone offset counts as unreadable.
    """
    stamp = F.get_json_object("repo_metadata", "$.tech_analysis.analyzed_at")
    analyzed = F.when(stamp.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(stamp))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(analyzed)
    fresh = age < days * 86_400_000_000
    return repos.filter(~F.coalesce(fresh, F.lit(False)))


ENRICHED = (
    "commit_id long, repo_id long, status string, tech_tags array<string>, work_category string, "
    "summary string, complexity_score double, raw_response string, error string"
)


def with_diff(commits: DataFrame, max_chars: int | None = DIFF_BUDGET) -> DataFrame:
    """H18 + H19: the text handed to the analysis, whole without a budget."""
    if max_chars is None:
        return commits.withColumn("diff", assemble_diff(F.col("raw_data")))
    assembled = commits.withColumn("_full_diff", assemble_diff(F.col("raw_data")))
    return truncate_diff(assembled, "_full_diff", "diff", max_chars).drop("_full_diff")


#: what an analysis function gets, and what it returns, row by row in the same order
ANALYZED = ["diff", "message", "full_name"]
FOUND = ["status", "tech_tags", "work_category", "summary", "complexity_score", "raw_response", "error"]
BatchAnalysis = Callable[[pd.DataFrame], pd.DataFrame]


def per_record(analyze: Callable[[str, str, str], dict[str, Any]]) -> BatchAnalysis:
    """A batch function from one for single records.

    ``analyze(diff, message, repo_name)`` returns technologies_detected,
    work_category, summary and complexity_score.  An exception marks its record
    only; `RateLimited` leaves that record and all later ones of the task pending.
    """
    limited = False

    def one(diff: str, message: str, full_name: str) -> tuple:
        nonlocal limited
        if limited:
            return ("pending", None, None, None, None, None, None)
        try:
            found = analyze(diff, message, full_name)
            text = json.dumps(found, ensure_ascii=False)
            score = float(found["complexity_score"])
            return ("analyzed", list(found["technologies_detected"]), found["work_category"], found["summary"], score, text, None)
        except RateLimited as e:
            limited = True
            return ("pending", None, None, None, None, None, str(e))
        except Exception as e:  # isolate the record, as a batch must go on
            return ("error", None, None, None, None, None, f"{type(e).__name__}: {e}")

    def analyze_batch(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(*r) for r in zip(*(batch[c] for c in ANALYZED))], columns=FOUND)

    return analyze_batch


#: diffs that go to Python at a time; at the default budget at most 15 million characters
BATCH_ROWS = 500
_MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """From now on an analysis that is run gets few diffs at a time, so that Python holds a bounded amount of text; returns the setting before."""
    before = spark.conf.get(_MOST_ROWS)
    spark.conf.set(_MOST_ROWS, str(rows if int(before) <= 0 else min(rows, int(before))))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """`set_small_batches` for what is run within this."""
    before = set_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_MOST_ROWS, before)


def enrich(
    backlog: DataFrame,
    analyze: BatchAnalysis,
    max_chars: int | None = DIFF_BUDGET,
    tasks: int | None = None,
) -> DataFrame:
    """Run a batch function over a backlog with raw data.

    ``analyze`` takes a frame with diff, message and full_name and returns one
    with the columns ``FOUND``, as many rows in the same order; `per_record`
    makes one from a function for single records.  One row per commit with a
    status: ``analyzed``, ``skipped`` (no diff), ``error`` (that record only) or
    ``pending`` (rate limit in its task).  ``tasks`` spreads a backlog of few,
    slow calls.
    """
    names = [f.split()[0] for f in ENRICHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            has_diff = pdf["diff"] != ""
            skipped = pdf.loc[~has_diff, ["commit_id", "repo_id"]].assign(status="skipped")
            given = pdf[has_diff].reset_index(drop=True)
            parts = [skipped]
            if len(given):
                parts.append(pd.concat([given[["commit_id", "repo_id"]], analyze(given[ANALYZED])], axis=1))
            out = pd.concat(parts).reindex(columns=names).astype(object)
            yield out.where(out.notna(), None)

    rows = with_diff(backlog, max_chars).select(
        "commit_id", "repo_id", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("full_name", F.lit("")).alias("full_name"), F.coalesce("diff", F.lit("")).alias("diff")
    )
    if tasks:
        rows = rows.repartition(tasks, "commit_id")
    return rows.mapInPandas(run, ENRICHED)


def to_analyses(enriched: DataFrame, analyzed_at: datetime) -> DataFrame:
    """The analyzed rows of `enrich` as rows of the analyses table."""
    return enriched.filter(F.col("status") == "analyzed").select(
        F.xxhash64(F.lit("commit"), "commit_id").alias("analysis_id"),
        F.lit("commit").alias("source_type"),
        F.col("commit_id").alias("source_id"),
        "repo_id",
        "tech_tags",
        "work_category",
        "summary",
        decimal1("complexity_score").alias("complexity_score"),
        "raw_response",
        F.lit(analyzed_at).cast("timestamp").alias("analyzed_at"),
        F.lit(analyzed_at).cast("timestamp").alias("created_at"),
    )
