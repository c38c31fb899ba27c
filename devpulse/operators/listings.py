"""Listings with counts, history pages, reports and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.functions.exprs import lookup, short_name
from devpulse.operators.filters import active, for_user
from devpulse.operators.ranking import paginate
from devpulse.operators.rollups import repo_counts
from devpulse.schemas import (
    DEFAULT_SYNC_INTERVAL_HOURS,
    DEFAULT_TIMEZONE,
    DOMAIN_COLORS,
    DOMAIN_LABELS,
    NOT_ANALYZED_LABEL,
    PROFILE,
    TECH_ANALYSIS,
)

_ID_BLOCK = 100_000


def _id_block(column: str) -> Column:
    return F.floor(F.col(column) / F.lit(_ID_BLOCK))


def _newest_first(time: str, ident: str) -> list[tuple[Column, bool]]:
    """Day, minute, instant and id range: none has many values within the one before."""
    steps = [F.to_date(time), F.date_trunc("minute", time), F.col(time)]
    return [*((step, False) for step in steps), (_id_block(ident), True)]


#: rows down to which a page is taken from the top of its group, which needs no levels
SHALLOW = 1000


def _levels(time: str, ident: str, page: int, per_page: int, index: DataFrame | None = None) -> list[tuple[Column, bool]] | None:
    return None if index is None and page * per_page <= SHALLOW else _newest_first(time, ident)


def repository_listing(
    repos: DataFrame,
    commits: DataFrame,
    pull_requests: DataFrame,
    page: int = 1,
    per_page: int = 20,
    active_only: bool = True,
    user_id: int | None = None,
) -> DataFrame:
    """A page of repositories, newest change first, with their fact counts.

    Facts are counted per repository before the join (J4): partial aggregation
    reads one column and sends one row per repository and map task.
    """
    listed = paginate(
        for_user(active(repos, active_only), user_id),
        [F.desc("updated_at"), F.asc("repo_id")],
        page,
        per_page,
        levels=_levels("updated_at", "repo_id", page, per_page),
    )
    return (
        listed.join(repo_counts(commits, "commit_count"), "repo_id", "left")
        .join(repo_counts(pull_requests, "pr_count"), "repo_id", "left")
        .withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))
        .withColumn("pr_count", F.coalesce("pr_count", F.lit(0)))
    )


def sync_history(
    jobs: DataFrame, repos: DataFrame, page: int = 1, per_page: int = 20, user_id: int | None = None, index: DataFrame | None = None
) -> DataFrame:
    """A page of jobs, newest first, with the repository name.

    ``index`` holds the jobs of each user and day (`ranking.level_counts`), if they are kept.
    """
    listed = paginate(
        for_user(jobs, user_id),
        [F.desc("created_at"), F.asc("job_id")],
        page,
        per_page,
        levels=_levels("created_at", "job_id", page, per_page, index),
        index=index if index is None else for_user(index, user_id),
    )
    return listed.join(repos.select("repo_id", F.col("full_name").alias("repo_full_name")), "repo_id", "left")


def tech_stack_report(repos: DataFrame, user_id: int | None = None) -> DataFrame:
    """Stack analysis of active repositories, with display label and color.

    The analysis is NULL when missing, empty or not an object; absent keys of a
    present one take defaults.  Order by ``full_name`` to list (L7).
    """
    text = F.get_json_object("repo_metadata", "$.tech_analysis")
    parsed = F.when(text.startswith("{") & (text != "{}"), F.from_json(text, TECH_ANALYSIS))
    t = F.col("_tech")
    empty = F.array().cast("array<string>")
    analysis = F.struct(
        F.coalesce(t["domain"], F.lit("general")).alias("domain"),
        F.coalesce(t["domain_detail"], F.lit("")).alias("domain_detail"),
        F.coalesce(t["frameworks"], empty).alias("frameworks"),
        F.coalesce(t["tools"], empty).alias("tools"),
        F.coalesce(t["infrastructure"], empty).alias("infrastructure"),
        F.coalesce(t["project_type"], F.lit("")).alias("project_type"),
        t["analyzed_at"].alias("analyzed_at"),
    )
    general = DOMAIN_COLORS["general"]
    domain = F.col("tech_analysis.domain")
    return (
        for_user(active(repos), user_id)
        .withColumn("_tech", parsed)
        .withColumn("tech_analysis", F.when(t.isNotNull(), analysis))
        .select(
            "user_id",
            "repo_id",
            "full_name",
            short_name("full_name").alias("short_name"),
            "description",
            "primary_language",
            "tech_analysis",
            F.when(domain.isNull(), NOT_ANALYZED_LABEL)
            .otherwise(lookup(domain, DOMAIN_LABELS, domain))
            .alias("domain_label"),
            lookup(domain, DOMAIN_COLORS, general).alias("domain_color"),
        )
    )


def user_settings(users: DataFrame, repos: DataFrame, user_id: int | None = None) -> DataFrame:
    """Settings with defaults and the number of tracked repositories."""
    tracked = active(repos).groupBy("user_id").agg(F.count(F.lit(1)).alias("tracked"))
    profile = F.from_json("profile_data", PROFILE)
    return (
        for_user(users, user_id)
        .withColumn("_p", profile)
        .join(tracked, "user_id", "left")
        .select(
            "user_id",
            F.col("has_token").alias("github_token_configured"),
            F.col("github_login").alias("github_username"),
            F.coalesce("_p.sync_interval_hours", F.lit(DEFAULT_SYNC_INTERVAL_HOURS)).alias("sync_interval_hours"),
            F.coalesce("_p.gemini_analysis_enabled", F.lit(True)).alias("gemini_analysis_enabled"),
            F.coalesce("_p.timezone", F.lit(DEFAULT_TIMEZONE)).alias("timezone"),
            F.coalesce("tracked", F.lit(0)).alias("tracked_repos_count"),
        )
    )
