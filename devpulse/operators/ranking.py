"""Top-k per group and pagination without whole groups in one task.

``row_number() <= k`` is planned with a partial group limit before the shuffle,
so each map task sends at most k rows per group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, or all, with their 1-based position.

    Without ``k`` each group is sorted as a whole.
    """
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def page_totals(df: DataFrame, per_page: int = 20, by: str = "user_id", groups: DataFrame | None = None) -> DataFrame:
    """Rows and pages per group; 0 for listed ``groups`` without any row.

    This is what a page past the end still reports.
    """
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    if groups is not None:
        totals = (
            groups.select(by)
            .distinct()
            .join(totals, by, "left")
            .select(by, F.coalesce("total", F.lit(0)).alias("total"))
        )
    return _pages(totals, per_page)


def _pages(totals: DataFrame, per_page: int) -> DataFrame:
    return totals.withColumn("total_pages", F.ceil(F.col("total") / F.lit(per_page)).cast("long"))


def paginate(
    df: DataFrame,
    order: list[Column],
    page: int = 1,
    per_page: int = 20,
    by: str = "user_id",
    levels: list[tuple[Column, bool]] | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """One page of every group plus ``total`` and ``total_pages``.

    ``levels`` refine the sort order step by step as ``(column, ascending)``,
    for instance the day of a timestamp, the timestamp, a range of ids.  Given
    them, counting rows per value of a level tells which values the page
    overlaps, only their rows go on to the next level, and the last ones are
    sorted, each value on its own, whatever the page.  Without levels the rows
    up to the page are taken from the top of each group, which suits first pages.

    ``index`` holds `level_counts` of the first level, kept beside the table: totals
    and the values that the page overlaps then come from it, and of ``df`` only the
    rows with such a value are counted on, whatever the page.
    """
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page must be >= 1 and per_page within 1..100")
    first, last = (page - 1) * per_page, page * per_page
    if not levels:
        rows, totals = top_k(df, [by], order, last, "position").filter(F.col("position") > first), page_totals(df, per_page, by)
    else:
        names = [f"_level{i}" for i in range(len(levels))]
        ascending = [up for _, up in levels]
        leveled, chosen = df.withColumns({n: c for n, (c, _) in zip(names, levels)}), None
        if index is not None:
            chosen = pages_overlap(index, first, last, by, ascending[0]).withColumnRenamed("level", names[0])
            leveled = _rows_of(leveled, chosen, [by, names[0]]).drop("_before")
        # the one count that all levels, and without an index the totals, are derived from
        counts = leveled.groupBy(by, *names).agg(F.count(F.lit(1)).alias("_n"))
        rows = _deep_page(leveled, counts, order, first, last, by, names, ascending, chosen)
        totals = counts.groupBy(by).agg(F.sum("_n").alias("total")) if index is None else index.groupBy(by).agg(F.sum("n").alias("total"))
        totals = _pages(totals, per_page)
    return rows.join(totals, by).withColumn("page", F.lit(page)).withColumn("per_page", F.lit(per_page))


def level_counts(df: DataFrame, level: Column, by: str = "user_id") -> DataFrame:
    """``level, <by>, n``: rows of each group at each value of a level, such as the day of a timestamp."""
    return df.groupBy(level.alias("level"), by).agg(F.count(F.lit(1)).alias("n"))


def pages_overlap(index: DataFrame, first: int, last: int, by: str = "user_id", ascending: bool = False) -> DataFrame:
    """The values of a level that the rows after ``first`` up to ``last`` of each group have, and the rows ``_before`` them."""
    level = index.select(by, "level", F.col("n").alias("_n"), F.lit(0).cast("long").alias("_before"))
    return _overlapping(level, [by], "level", ascending, first, last)


def _overlapping(level: DataFrame, keys: list[str], name: str, ascending: bool, first: int, last: int) -> DataFrame:
    step = F.col(name).asc() if ascending else F.col(name).desc()
    running = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_before") + F.sum("_n").over(running) - F.col("_n")
    overlapping = (F.col("_start") < last) & (F.col("_start") + F.col("_n") > first)
    return level.withColumn("_start", start).filter(overlapping).select(*keys, name, F.col("_start").alias("_before"))


def _deep_page(
    leveled: DataFrame,
    counts: DataFrame,
    order: list[Column],
    first: int,
    last: int,
    by: str,
    names: list[str],
    ascending: list[bool],
    chosen: DataFrame | None = None,
) -> DataFrame:
    """``chosen`` are the values of the first level, if they are known."""
    for depth, name in enumerate(names):
        if depth == 0 and chosen is not None:
            continue
        keys = [by, *names[:depth]]
        level = counts if depth == len(names) - 1 else counts.groupBy(*keys, name).agg(F.sum("_n").alias("_n"))
        level = level.withColumn("_before", F.lit(0).cast("long")) if chosen is None else _rows_of(level, chosen, keys)
        chosen = _overlapping(level, keys, name, ascending[depth], first, last)
    finest = [by, *names]
    position = F.row_number().over(Window.partitionBy(*finest).orderBy(*order)) + F.col("_before")
    return (
        _rows_of(leveled, chosen, finest)
        .withColumn("position", position.cast("int"))
        .filter((F.col("position") > first) & (F.col("position") <= last))
        .drop(*names, "_before")
    )


def _rows_of(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a chosen key and its ``_before``; a key may be NULL."""
    left, right = rows.alias("l"), chosen.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).select("l.*", "r._before")
