"""Active days as one bitmap for each user and month, and the streak read from them.

A month is a number whose bit d - 1 says that day d was active.  Bitmaps of the months a
batch touched are made anew from the daily rollup; all others stay.  A streak then needs
one row for each month it spans instead of one for each day and repository.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devpulse.operators.filters import for_user

_ALL = 0x7FFFFFFF


def active_days(daily: DataFrame) -> DataFrame:
    """``month_start, user_id, days`` from any rows with ``user_id, commit_date``."""
    bit = F.expr("shiftleft(1, day(commit_date) - 1)")
    return daily.groupBy(F.trunc("commit_date", "month").alias("month_start"), "user_id").agg(F.bit_or(bit).alias("days"))


def _days_up_to(bits: Column, day: Column) -> Column:
    """How many days in a row are active up to a day of the month, itself included."""
    # the day at the top of 31 bits; what is left of the zeros below tells where the run ends
    moved = F.call_function("shiftleft", bits, F.lit(31) - day).bitwiseAND(F.lit(_ALL))
    gaps = F.bitwise_not(moved).bitwiseAND(F.lit(_ALL))
    return F.least(F.when(gaps == 0, 31).otherwise(F.lit(31) - F.length(F.bin(gaps))), day)


def _through(day: date) -> int:
    return (1 << day.day) - 1


def current_streak(active: DataFrame, as_of: date, lookback: int | None = None, user_id: int | None = None) -> DataFrame:
    """A13 from `active_days`: the result of `widgets.current_streak` over the daily rollup."""
    seen = for_user(active, user_id).filter(F.col("month_start") <= F.lit(as_of))
    first = F.col("month_start")
    bits = F.when(first == F.lit(as_of.replace(day=1)), F.col("days").bitwiseAND(F.lit(_through(as_of)))).otherwise(F.col("days"))
    if lookback is not None:
        start = as_of - timedelta(days=lookback)
        seen = seen.filter(first >= F.lit(start.replace(day=1)))
        bits = F.when(first == F.lit(start.replace(day=1)), bits.bitwiseAND(F.lit(_ALL & ~(_through(start) >> 1)))).otherwise(bits)
    latest_first = Window.partitionBy("user_id").orderBy(F.desc("month_start"))
    newer = latest_first.rowsBetween(Window.unboundedPreceding, -1)
    months = (
        seen.withColumn("days", bits)
        .filter("days <> 0")
        .withColumn("rank", F.row_number().over(latest_first))
        # a run enters a month at its last day, and the newest one at its last active day
        .withColumn("top", F.when(F.col("rank") == 1, F.length(F.bin("days"))).otherwise(F.day(F.last_day("month_start"))))
        .withColumn("run", _days_up_to(F.col("days"), F.col("top")))
        .withColumn("follows", F.coalesce(F.add_months("month_start", 1) == F.lag("month_start").over(latest_first), F.lit(True)))
        .withColumn("full", F.col("run") == F.col("top"))
        .withColumn("reached", F.coalesce(F.every(F.col("full") & F.col("follows")).over(newer), F.lit(True)) & F.col("follows"))
    )
    newest = F.max(F.when(F.col("rank") == 1, F.date_add("month_start", F.col("top") - 1)))
    length = F.sum(F.when(F.col("reached"), F.col("run")).otherwise(0))
    return months.groupBy("user_id").agg(F.when(newest >= F.lit(as_of - timedelta(days=1)), length).otherwise(0).alias("current_streak"))
