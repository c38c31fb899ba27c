"""Date windows, period filters, buckets and period spines."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("daily", "weekly", "monthly")
MONTH_COLUMN = "year_month"


def resolve_window(
    as_of: date, start: date | None = None, end: date | None = None, default_days: int = 90
) -> tuple[date, date]:
    """Fill in the default window ``[as_of - default_days, as_of]``."""
    if start is not None and end is not None and start > end:
        raise ValueError("start must be <= end")
    return start or as_of - timedelta(days=default_days), end or as_of


def date_window(
    df: DataFrame,
    column: str,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    default_days: int = 90,
) -> DataFrame:
    """keep days in the inclusive window."""
    lo, hi = resolve_window(as_of, start, end, default_days)
    return df.filter(F.col(column).between(F.lit(lo), F.lit(hi)) & _month_guard(df, lo, hi))


def _month_guard(df: DataFrame, lo: date, hi: date) -> Column:
    """Partition predicate for tables stored by month; TRUE for all others.

    Catalyst prunes directories on the partition column only, so every filter on
    the raw timestamp is paired with the months it can touch.
    """
    if MONTH_COLUMN not in df.columns:
        return F.lit(True)
    return F.col(MONTH_COLUMN).between(F.lit(f"{lo:%Y-%m}"), F.lit(f"{hi:%Y-%m}"))


def _midnight(d: date) -> Column:
    return F.lit(datetime.combine(d, time.min).isoformat(sep=" ")).cast("timestamp")


def period_filter(df: DataFrame, ts: str, start: date, end_excl: date, partitioned_by: bool = True) -> DataFrame:
    """keep timestamps in the half-open period ``[start, end_excl)``.

    ``partitioned_by`` says whether ``ts`` is the column the month partitions
    were cut from; only then may the months be pruned.
    """
    keep = (F.col(ts) >= _midnight(start)) & (F.col(ts) < _midnight(end_excl))
    if partitioned_by:
        keep = keep & _month_guard(df, start, end_excl - timedelta(days=1))
    return df.filter(keep)


def closed_period_filter(df: DataFrame, ts: str, start: date, end: date, partitioned_by: bool = True) -> DataFrame:
    """keep timestamps from the first to the last microsecond of the days."""
    last = F.lit(datetime.combine(end, time.max).isoformat(sep=" ")).cast("timestamp")
    keep = F.col(ts).between(_midnight(start), last)
    if partitioned_by:
        keep = keep & _month_guard(df, start, end)
    return df.filter(keep)


def bucket(column: Column | str, period: str) -> Column:
    """H2: the first day of the day / week (Monday) / month a date falls in."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("date") if period == "daily" else F.trunc(c, "week" if period == "weekly" else "month").cast("date")


def monday_of(d: date) -> date:
    return d - timedelta(days=d.weekday())


def first_of_month(d: date, months_back: int = 0) -> date:
    """H6: first day of the month ``months_back`` months before ``d``."""
    index = d.year * 12 + (d.month - 1) - months_back
    return date(index // 12, index % 12 + 1, 1)


def parse_year_month(text: str) -> date:
    """H6: first day of a ``YYYY-MM`` month."""
    parsed = datetime.strptime(text, "%Y-%m")
    if len(text) != 7:
        raise ValueError("expected YYYY-MM")
    return parsed.date()


def preset_start(as_of: date, preset: str) -> date:
    """start of a relative range: 30d, 90d, 6m or 1y before ``as_of``.

    Month steps keep the day number and let it run over into the next month
    (31 August minus six months is 2 or 3 March).
    """
    days = {"30d": 30, "90d": 90}
    months = {"6m": 6, "1y": 12}
    if preset in days:
        return as_of - timedelta(days=days[preset])
    if preset in months:
        return first_of_month(as_of, months[preset]) + timedelta(days=as_of.day - 1)
    raise ValueError("preset must be 30d, 90d, 6m or 1y")


def week_starts(week_start: date, count: int) -> list[date]:
    return [week_start - timedelta(weeks=i) for i in range(count)]


def week_of(ts: Column | str, week_start: date, count: int) -> Column:
    """First day of the 7-day block, counted from ``week_start``, holding ``ts``.

    Blocks follow the given start day, which need not be a Monday.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    base = F.lit(week_start - timedelta(weeks=count - 1))
    offset = F.datediff(c.cast("date"), base)
    return F.date_add(base, (F.floor(offset / 7) * 7).cast("int"))


def spine(users: DataFrame, starts: list[date], name: str) -> DataFrame:
    """Every user with every period start; a Generate, not a join."""
    return users.select("user_id").distinct().withColumn(name, F.explode(F.array(*[F.lit(d) for d in starts])))
