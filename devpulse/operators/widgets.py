"""Dashboard widgets over the rollups, for all users at once.

Windows here run over bounded groups only: days of a date window, cells of a
week grid, kept top-k rows, labels of a fixed vocabulary.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devpulse.functions.exprs import lookup, pct1, pct_change1
from devpulse.functions.timeops import bucket, date_window, first_of_month
from devpulse.operators.filters import active, for_user, in_list
from devpulse.operators.ranking import top_k
from devpulse.schemas import DEFAULT_COLOR, LANGUAGE_COLORS, UNKNOWN_LANGUAGE


def _user_total(column: str) -> Column:
    return F.sum(column).over(Window.partitionBy("user_id"))


def commit_activity(
    daily: DataFrame,
    as_of: date,
    period: str = "daily",
    start: date | None = None,
    end: date | None = None,
    repo_ids: list[int] | DataFrame | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """A4: commits and lines per day / week / month of the window.

    Days are filtered before they are bucketed, so edge buckets are partial;
    buckets without commits are absent.
    """
    days = in_list(for_user(date_window(daily, "commit_date", as_of, start, end), user_id), "repo_id", repo_ids)
    return (
        days.groupBy("user_id", bucket("commit_date", period).alias("date"))
        .agg(
            F.sum("commit_count").alias("count"),
            F.sum("total_additions").alias("additions"),
            F.sum("total_deletions").alias("deletions"),
        )
        .withColumn("total_commits", _user_total("count"))
    )


def language_breakdown(repos: DataFrame, user_id: int | None = None) -> DataFrame:
    """A5: share of each primary language among active repositories."""
    return (
        language_counts(repos, user_id)
        .withColumn("percentage", pct1("repo_count", _user_total("repo_count")))
        .withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit(UNKNOWN_LANGUAGE)))
        .withColumn("color", lookup("language", LANGUAGE_COLORS, DEFAULT_COLOR))
    )


def language_counts(repos: DataFrame, user_id: int | None = None) -> DataFrame:
    return (
        for_user(active(repos), user_id)
        .filter(F.col("primary_language").isNotNull())
        .groupBy("user_id", F.col("primary_language").alias("language"))
        .agg(F.count(F.lit(1)).alias("repo_count"))
    )


def repo_breakdown(
    daily: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    limit: int = 10,
    user_id: int | None = None,
) -> DataFrame:
    """The ``limit`` busiest repositories; shares are of the kept rows."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    per_repo = (
        for_user(date_window(daily, "commit_date", as_of, start, end), user_id)
        .groupBy("user_id", "repo_id", F.col("full_name").alias("repo_name"), "primary_language")
        .agg(F.sum("commit_count").alias("commit_count"))
    )
    kept = top_k(per_repo, ["user_id"], [F.desc("commit_count"), F.asc("repo_id")], limit)
    return kept.withColumn("total_commits", _user_total("commit_count")).withColumn(
        "percentage", pct1("commit_count", "total_commits")
    )


def hourly_heatmap(
    hourly: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    users: DataFrame | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """A7 + J10: a full 7 x 24 grid per user with zeros and the grid maximum.

    The grid is spread from the user list, one aggregated row per user holding
    168 slots, so no spine is joined.  ``users`` adds users without activity.
    """
    cells = (
        for_user(date_window(hourly, "activity_date", as_of, start, end), user_id)
        .groupBy("user_id", "day_of_week", "hour_of_day")
        .agg(F.sum(F.col("commit_count") + F.col("pr_count")).alias("count"))
        .select("user_id", (F.col("day_of_week") * 24 + F.col("hour_of_day")).cast("int").alias("slot"), "count")
    )
    if users is not None:
        nobody = for_user(users, user_id).select(
            "user_id", F.lit(None).cast("int").alias("slot"), F.lit(0).cast("long").alias("count")
        )
        cells = cells.unionByName(nobody)
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", "count"))
    grid = cells.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("filled"),
        F.max("count").alias("max_count"),
    )
    return (
        grid.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(167))))
        .select(
            "user_id",
            F.expr("slot div 24").cast("int").alias("day_of_week"),
            (F.col("slot") % 24).cast("int").alias("hour"),
            F.coalesce(F.element_at("filled", F.col("slot")), F.lit(0)).cast("long").alias("count"),
            F.coalesce("max_count", F.lit(0)).alias("max_count"),
        )
    )


def tech_trends(
    weekly: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Tag counts per week.

    The window tests the Monday itself: the week holding ``start`` drops out
    unless ``start`` is a Monday.
    """
    return (
        for_user(date_window(weekly, "week_start", as_of, start, end), user_id)
        .groupBy("user_id", F.col("week_start").alias("period_start"), F.col("tech_tag").alias("tag"))
        .agg(F.sum("tag_count").alias("count"))
    )


def category_breakdown(
    categories: DataFrame,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Share of each work category in the window."""
    return (
        for_user(date_window(categories, "analysis_date", as_of, start, end), user_id)
        .groupBy("user_id", F.col("work_category").alias("category"))
        .agg(F.sum("category_count").alias("count"))
        .withColumn("percentage", pct1("count", _user_total("count")))
    )


def top_language(repos: DataFrame, user_id: int | None = None) -> DataFrame:
    """Most common language among active repositories; ties by name."""
    most = F.min_by("language", F.struct(-F.col("repo_count"), F.col("language")))
    return language_counts(repos, user_id).groupBy("user_id").agg(most.alias("top_language"))


def _commit_totals(daily: DataFrame, as_of: date) -> DataFrame:
    """All-time, month-to-date and whole-previous-month commits in one pass."""
    this_month, last_month = first_of_month(as_of), first_of_month(as_of, 1)
    day, n = F.col("commit_date"), F.col("commit_count")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return daily.groupBy("user_id").agg(
        F.sum(n).alias("total_commits"),
        total(day.between(F.lit(this_month), F.lit(as_of))).alias("current_month_commits"),
        total((day >= F.lit(last_month)) & (day < F.lit(this_month))).alias("previous_month_commits"),
    )


def month_over_month(daily: DataFrame, as_of: date, user_id: int | None = None) -> DataFrame:
    """Month to date against the whole previous month, in percent."""
    recent = date_window(for_user(daily, user_id), "commit_date", as_of, first_of_month(as_of, 1), as_of)
    return _commit_totals(recent, as_of).select(
        "user_id",
        "current_month_commits",
        "previous_month_commits",
        pct_change1("current_month_commits", "previous_month_commits").alias("commit_change_pct"),
    )


def current_streak(
    daily: DataFrame, as_of: date, lookback: int | None = None, user_id: int | None = None
) -> DataFrame:
    """Consecutive active days up to ``as_of``, or up to the day before.

    ``lookback`` limits the days looked at, and with them the streak.  Users
    without a day among these have no row; without a running streak they have 0.
    The window sees distinct dates, one for each day of a user's history at most.
    """
    own = for_user(daily, user_id)
    seen = own.filter(F.col("commit_date") <= F.lit(as_of)) if lookback is None else date_window(own, "commit_date", as_of, default_days=lookback)
    days = seen.select("user_id", "commit_date").distinct()
    latest_first = Window.partitionBy("user_id").orderBy(F.desc("commit_date"))
    runs = days.withColumn("position", F.row_number().over(latest_first)).withColumn(
        # constant within a run of consecutive days
        "run", F.date_add("commit_date", F.col("position"))
    )
    newest = F.max("commit_date").over(Window.partitionBy("user_id"))
    # the newest run ends `newest`; every date of it shares newest + 1
    in_newest = F.col("run") == F.date_add("newest", 1)
    return (
        runs.withColumn("newest", newest)
        .groupBy("user_id")
        .agg(
            F.sum(F.when(in_newest & (F.col("newest") >= F.date_sub(F.lit(as_of), 1)), 1).otherwise(0)).alias(
                "current_streak"
            )
        )
    )


def dashboard_stats(
    daily: DataFrame,
    repos: DataFrame,
    users: DataFrame,
    as_of: date,
    user_id: int | None = None,
    lookback: int | None = None,
) -> DataFrame:
    """A10: one row of headline figures per user, users without data included."""
    everyone = for_user(users, user_id).select("user_id").distinct()
    tracked = for_user(active(repos), user_id).groupBy("user_id").agg(F.count(F.lit(1)).alias("active_repos"))
    totals = _commit_totals(for_user(daily, user_id), as_of)
    return (
        everyone.join(totals, "user_id", "left")
        .join(tracked, "user_id", "left")
        .join(top_language(repos, user_id), "user_id", "left")
        .join(current_streak(daily, as_of, lookback, user_id), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("total_commits", F.lit(0)).alias("total_commits"),
            F.coalesce("active_repos", F.lit(0)).alias("active_repos"),
            F.coalesce("current_streak", F.lit(0)).alias("current_streak"),
            "top_language",
            pct_change1("current_month_commits", "previous_month_commits").alias("commit_change_pct"),
        )
    )
