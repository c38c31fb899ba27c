"""Sync jobs: outcomes, targets and incremental slices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.operators.filters import active, for_user, in_list


def job_outcomes(repo_results: DataFrame) -> DataFrame:
    """One row per job from its per-repository results.

    Input: ``job_id, ord, repo_full_name, items, error_type, message`` in run
    order.  The first rate limit ends the job: later results do not count and
    the job failed.  Other errors leave it completed; the last error is kept.
    The cut is a separate small aggregate, so no job is sorted in one task.
    """
    rate_limited = F.col("error_type") == "rate_limit"
    cuts = repo_results.filter(rate_limited).groupBy("job_id").agg(F.min("ord").alias("cut"))
    counted = repo_results.join(cuts, "job_id", "left").filter(F.col("cut").isNull() | (F.col("ord") <= F.col("cut")))
    error = F.when(F.col("error_type").isNotNull(), F.struct(
        F.col("error_type").alias("type"), "message", "repo_full_name"
    ))
    error_order = F.when(F.col("error_type").isNotNull(), F.col("ord"))
    return (
        counted.groupBy("job_id")
        .agg(
            F.sum(F.when(F.col("error_type").isNull(), F.col("items")).otherwise(0)).cast("long").alias("items_fetched"),
            F.max_by(error, error_order).alias("error_detail"),
        )
        .withColumn(
            "status",
            F.when(F.col("error_detail.type") == "rate_limit", "failed").otherwise("completed"),
        )
    )


def sync_users(users: DataFrame, repos: DataFrame) -> DataFrame:
    """Users with a token and at least one active repository."""
    return users.filter("has_token").join(active(repos).select("user_id").distinct(), "user_id", "left_semi")


def sync_targets(
    repos: DataFrame, requested: list[int] | DataFrame | None = None, user_id: int | None = None
) -> DataFrame:
    """C14: the active repositories to sync, optionally only requested ones.

    An empty result for a request means that nothing matched; whether that is an
    error is up to the caller (`require_targets`).
    """
    return in_list(for_user(active(repos), user_id), "repo_id", requested).select("user_id", "repo_id", "full_name")


def require_targets(repos: DataFrame, requested: list[int] | DataFrame, user_id: int) -> DataFrame:
    """C14: `sync_targets` that fails when no requested repository is the user's."""
    owned = in_list(for_user(repos, user_id), "repo_id", requested)
    if owned.isEmpty():
        raise LookupError("no matching repositories")
    return sync_targets(repos, requested, user_id)


def incremental_slice(
    batch: DataFrame, repos: DataFrame, ts: str, users: DataFrame | None = None, full_sync: bool = False
) -> DataFrame:
    """Batch rows at or after their repository's watermark, all of a full sync.

    With ``users`` given, commits are limited to the owner's own login.  The hint makes
    the watermarks the side that is hashed: records are wide, and Spark's estimate of
    parsed ones is that of their packed files, so it might collect them on the driver.
    """
    marks = repos.select("repo_id", "user_id", "last_synced_at")
    if users is not None:
        marks = marks.join(users.select("user_id", "github_login"), "user_id")
    rows = batch.join(marks.hint("shuffle_hash"), "repo_id")
    if not full_sync:
        rows = rows.filter(F.col("last_synced_at").isNull() | (F.col(ts) >= F.col("last_synced_at")))
    if users is not None:
        rows = rows.filter(F.col("author_login") == F.col("github_login"))
    return rows.select(*batch.columns)


def advance_watermark(repos: DataFrame, written: DataFrame, as_of: datetime) -> DataFrame:
    """Move the watermark of the repositories whose slice was written."""
    done = written.select("repo_id").distinct().withColumn("_done", F.lit(True))
    moved = F.when(F.col("_done"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_synced_at"))
    return repos.join(done, "repo_id", "left").withColumn("last_synced_at", moved).select(*repos.columns)
