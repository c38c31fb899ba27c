"""Repository discovery and registration."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def discovery_report(discovered: DataFrame, repos: DataFrame) -> DataFrame:
    """C4: listed repositories with whether, and as what, their user tracks them."""
    tracked = repos.select("user_id", "github_repo_id", "repo_id")
    totals = discovered.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return (
        discovered.join(tracked, ["user_id", "github_repo_id"], "left")
        .withColumn("already_tracked", F.col("repo_id").isNotNull())
        .join(totals, "user_id")
    )


def auto_register(discovered: DataFrame, repos: DataFrame, as_of: datetime) -> DataFrame:
    """New active repositories among the discovered ones.

    The forge id is unique across users, so an id anyone tracks is not added
    again, and of several listings of an id the first one counts.
    """
    fields = ["user_id", "full_name", "description", "primary_language", "is_private"]
    first = F.min_by(F.struct(*fields), F.struct("seq", "user_id"))
    fresh = (
        discovered.groupBy("github_repo_id")
        .agg(first.alias("r"))
        .join(repos.select("github_repo_id").distinct(), "github_repo_id", "left_anti")
    )
    now = F.lit(as_of).cast("timestamp")
    return fresh.select(
        F.xxhash64(F.lit("repository"), "github_repo_id").alias("repo_id"),
        "github_repo_id",
        "r.*",
        F.lit(True).alias("is_active"),
        F.lit("{}").alias("repo_metadata"),
        F.lit(None).cast("timestamp").alias("last_synced_at"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
