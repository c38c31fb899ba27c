"""Pre-aggregated tables (A1-A3, A17, A18; joins J1-J3).

Facts are grouped on ``repo_id`` *before* they meet the repository dimension:
partial aggregation shrinks a busy repository to one row per key in every map
task, and the join then runs on rollup rows.  The repository side is never
force-broadcast; Spark compares its size with the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.functions.timeops import bucket
from devpulse.operators.filters import in_list

ROLLUP_KEYS = {
    "daily_commit_stats": ["commit_date", "repo_id"],
    "weekly_tech_trends": ["week_start", "repo_id", "tech_tag"],
    "work_category_stats": ["analysis_date", "repo_id", "work_category"],
}


def _sum0(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def commit_counts_by_day(commits: DataFrame) -> DataFrame:
    """The fact side of A1: one row per (day, repository)."""
    return commits.groupBy(F.to_date("committed_at").alias("commit_date"), "repo_id").agg(
        F.count("commit_id").alias("commit_count"),
        _sum0("additions").alias("total_additions"),
        _sum0("deletions").alias("total_deletions"),
        _sum0("changed_files").alias("total_changed_files"),
    )


def tag_counts_by_week(analyses: DataFrame) -> DataFrame:
    """The fact side of A2: one row per (week, repository, tag)."""
    tags = analyses.select(
        bucket(F.to_date("analyzed_at"), "weekly").alias("week_start"),
        "repo_id",
        F.explode("tech_tags").alias("tech_tag"),
    )
    return tags.groupBy("week_start", "repo_id", "tech_tag").agg(F.count(F.lit(1)).alias("tag_count"))


def category_counts_by_day(analyses: DataFrame) -> DataFrame:
    """The fact side of A3: one row per (day, repository, category)."""
    return (
        analyses.filter(F.col("work_category").isNotNull())
        .groupBy(F.to_date("analyzed_at").alias("analysis_date"), "repo_id", "work_category")
        .agg(F.count("analysis_id").alias("category_count"))
    )


def with_owner(counts: DataFrame, repos: DataFrame, *attributes: str) -> DataFrame:
    """Attach the user, and further attributes, of each repository."""
    owned = counts.join(repos.select("repo_id", "user_id", *attributes), "repo_id")
    first, *measures = [c for c in counts.columns if c != "repo_id"]
    return owned.select(first, "repo_id", "user_id", *attributes, *measures)


def daily_commit_stats(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """A1: commits and line counts per day and repository, active or not."""
    return with_owner(commit_counts_by_day(commits), repos, "full_name", "primary_language")


def weekly_tech_trends(
    analyses: DataFrame, repos: DataFrame, source_types: list[str] | None = None
) -> DataFrame:
    """A2: tag occurrences per week (Monday) and repository.

    A tag repeated within one analysis counts each time; all source types count
    unless ``source_types`` narrows them.
    """
    return with_owner(tag_counts_by_week(in_list(analyses, "source_type", source_types)), repos)


def work_category_stats(
    analyses: DataFrame, repos: DataFrame, source_types: list[str] | None = None
) -> DataFrame:
    """A3: analyses per day, repository and work category."""
    return with_owner(category_counts_by_day(in_list(analyses, "source_type", source_types)), repos)


def hourly_activity(commits: DataFrame, pull_requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Commits, pull requests and changed lines per user, day and hour.

    Pull requests count at their creation time; lines come from commits.
    """
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    moments = commits.select(
        "repo_id",
        F.col("committed_at").alias("at"),
        one.alias("commit_count"),
        zero.alias("pr_count"),
        F.col("additions").cast("long").alias("additions"),
        F.col("deletions").cast("long").alias("deletions"),
    ).unionByName(
        pull_requests.select(
            "repo_id",
            F.col("pr_created_at").alias("at"),
            zero.alias("commit_count"),
            one.alias("pr_count"),
            zero.alias("additions"),
            zero.alias("deletions"),
        )
    )
    measures = ["commit_count", "pr_count", "additions", "deletions"]
    sums = [_sum0(m).alias(m) for m in measures]
    by_repo = moments.groupBy(
        "repo_id", F.to_date("at").alias("activity_date"), F.hour("at").alias("hour_of_day")
    ).agg(*sums)
    return (
        by_repo.join(repos.select("repo_id", "user_id"), "repo_id")
        .groupBy("user_id", "activity_date", "hour_of_day")
        .agg(*sums)
        .select(
            "user_id",
            "activity_date",
            F.weekday("activity_date").cast("short").alias("day_of_week"),
            F.col("hour_of_day").cast("short").alias("hour_of_day"),
            *measures,
        )
    )


# --- all rollups from one read of each fact table -----------------------------

_COMMIT_MEASURES = ["commit_count", "additions", "deletions", "changed_files"]


def commit_grain(commits: DataFrame) -> DataFrame:
    """Commits and lines per repository, day and hour: what A1 and A17 add up."""
    return commits.groupBy("repo_id", F.to_date("committed_at").alias("day"), F.hour("committed_at").alias("hour")).agg(
        F.count("commit_id").alias("commit_count"),
        # of lines A17 counts all rows and A1 takes an empty sum as 0, so one sum serves both
        *[F.sum(c).cast("long").alias(c) for c in _COMMIT_MEASURES[1:]],
        F.count(F.lit(1)).alias("row_count"),
    )


def analysis_grain(analyses: DataFrame) -> DataFrame:
    """``kind, day, repo_id, label, n``: tags by week and categories by day, in one pass."""
    analyzed = F.to_date("analyzed_at")

    def entry(kind: str, day: Column, label: Column, counted: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), day.alias("day"), label.alias("label"), counted.alias("counted"))

    tags = F.transform("tech_tags", lambda tag: entry("tag", bucket(analyzed, "weekly"), tag, F.lit(True)))
    none = F.array().cast("array<struct<kind:string,day:date,label:string,counted:boolean>>")
    category = F.when(
        F.col("work_category").isNotNull(), F.array(entry("category", analyzed, F.col("work_category"), F.col("analysis_id").isNotNull()))
    ).otherwise(none)
    each = analyses.select("repo_id", F.explode(F.concat(F.coalesce(tags, none), category)).alias("e")).select("repo_id", "e.*")
    return each.groupBy("kind", "day", "repo_id", "label").agg(F.count_if("counted").alias("n"))


def daily_from_grain(grain: DataFrame, repos: DataFrame) -> DataFrame:
    """A1 from `commit_grain`."""
    daily = grain.groupBy(F.col("day").alias("commit_date"), "repo_id").agg(
        F.sum("commit_count").alias("commit_count"), *[_sum0(c).alias(f"total_{c}") for c in _COMMIT_MEASURES[1:]]
    )
    return with_owner(daily, repos, "full_name", "primary_language")


def hourly_from_grain(grain: DataFrame, pull_requests: DataFrame, repos: DataFrame) -> DataFrame:
    """A17 from `commit_grain` and the pull requests."""
    zero = F.lit(0).cast("long")
    prs = pull_requests.groupBy("repo_id", F.to_date("pr_created_at").alias("day"), F.hour("pr_created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("pr_count")
    )
    moments = grain.select("repo_id", "day", "hour", F.col("row_count").alias("commit_count"), zero.alias("pr_count"), "additions", "deletions")
    moments = moments.unionByName(prs.select("repo_id", "day", "hour", zero.alias("commit_count"), "pr_count", zero.alias("additions"), zero.alias("deletions")))
    measures = ["commit_count", "pr_count", "additions", "deletions"]
    return (
        moments.join(repos.select("repo_id", "user_id"), "repo_id")
        .groupBy("user_id", F.col("day").alias("activity_date"), F.col("hour").alias("hour_of_day"))
        .agg(*[_sum0(m).alias(m) for m in measures])
        .select(
            "user_id",
            "activity_date",
            F.weekday("activity_date").cast("short").alias("day_of_week"),
            F.col("hour_of_day").cast("short").alias("hour_of_day"),
            *measures,
        )
    )


def tags_from_grain(grain: DataFrame, repos: DataFrame) -> DataFrame:
    """A2 from `analysis_grain`."""
    counts = grain.filter(F.col("kind") == "tag").select(F.col("day").alias("week_start"), "repo_id", F.col("label").alias("tech_tag"), F.col("n").alias("tag_count"))
    return with_owner(counts, repos)


def categories_from_grain(grain: DataFrame, repos: DataFrame) -> DataFrame:
    """A3 from `analysis_grain`."""
    counts = grain.filter(F.col("kind") == "category").select(
        F.col("day").alias("analysis_date"), "repo_id", F.col("label").alias("work_category"), F.col("n").alias("category_count")
    )
    return with_owner(counts, repos)


def repo_counts(facts: DataFrame, name: str) -> DataFrame:
    """Rows per repository."""
    return facts.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name))
