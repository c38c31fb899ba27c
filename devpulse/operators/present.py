"""Chart shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from devpulse.functions.exprs import capitalize, heat_level, lookup, trend_direction, trend_value
from devpulse.operators.ranking import top_k
from devpulse.schemas import CATEGORY_COLORS, HEAT_COLORS


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """Rows in the order a chart or list shows them."""
    orders = {
        "activity": ["user_id", "date"],
        "languages": ["user_id", F.desc("repo_count"), "language"],
        "repositories": ["user_id", "rank"],
        "heatmap": ["user_id", "day_of_week", "hour"],
        "trends": ["user_id", "period_start", F.desc("count"), "tag"],
        "categories": ["user_id", F.desc("count"), "category"],
        "tech_stacks": ["user_id", "full_name"],
        "month_repos": ["user_id", "month_start", F.desc("commit_count"), "full_name"],
    }
    return df.orderBy(*orders[kind])


def top_n_other(
    df: DataFrame, key: str, value: str, n: int = 4, max_rows: int = 5, by: str = "user_id", other: str = "Other"
) -> DataFrame:
    """The ``n`` largest slices and the sum of the rest.

    Groups of at most ``max_rows`` stay as they are.  Only ``max_rows`` rows per
    group are ranked; the rest of a group enters through its total.
    """
    if max_rows <= n:
        raise ValueError("max_rows must exceed n")
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_total"))
    head = top_k(df.select(by, key, value), [by], [F.desc(value), F.asc(key)], max_rows)
    kept = F.sum(F.when(F.col("rank") <= n, F.col(value)).otherwise(0)).over(Window.partitionBy(by))
    crowded = F.col("_rows") > max_rows
    is_rest = crowded & (F.col("rank") == n + 1)
    return (
        head.withColumn("_kept", kept)
        .join(totals, by)
        .filter(~crowded | (F.col("rank") <= n + 1))
        .select(
            by,
            "rank",
            F.when(is_rest, F.lit(other)).otherwise(F.col(key)).alias(key),
            F.when(is_rest, F.col("_total") - F.col("_kept")).otherwise(F.col(value)).alias(value),
        )
    )


def pivot_trends(trends: DataFrame, tags: list[str]) -> DataFrame:
    """One row per (user, week) with a column per given tag, NULL if absent."""
    return trends.groupBy("user_id", "period_start").pivot("tag", tags).agg(F.sum("count"))


def trend_maps(trends: DataFrame, letters: int = 2) -> DataFrame:
    """A24 without a tag list: tag -> count maps per (user, week, beginning of the tag).

    Tags share a map when their first ``letters`` characters are equal, whatever
    their number, so a week's tags are spread over rows by their names alone.
    For all tags of a week in order read the long relation this is made from.
    """
    start = F.substring("tag", 1, letters).alias("start")
    return trends.groupBy("user_id", "period_start", start).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "count")))).alias("tags")
    )


def heatmap_levels(grid: DataFrame) -> DataFrame:
    """Intensity level and color of each heatmap cell."""
    level = heat_level("count", "max_count")
    colors = F.array(*[F.lit(c) for c in HEAT_COLORS])
    return grid.withColumn("level", level).withColumn("color", F.get(colors, F.col("level")))


def category_slices(breakdown: DataFrame) -> DataFrame:
    """H13 + J11: display label and color of each category."""
    return breakdown.withColumn("label", capitalize("category")).withColumn(
        "color", lookup("category", CATEGORY_COLORS, CATEGORY_COLORS["other"])
    )


def stat_trend(stats: DataFrame) -> DataFrame:
    """Direction and rounded size of the month-over-month change."""
    return stats.withColumn("trend_direction", trend_direction("commit_change_pct")).withColumn(
        "trend_value", trend_value("commit_change_pct")
    )
