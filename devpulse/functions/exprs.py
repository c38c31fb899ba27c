"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(1 << 26)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round1(x: Column | str) -> Column:
    """Round a double to one decimal on its exact binary value, ties to even.

    Spark's ``round``/``bround`` work on the shortest decimal text of the double
    and so differ from this for values such as 0.35.  The fraction is cut into
    two short halves, which makes 20 * fraction - (2q + 1) exact in doubles.
    """
    x = _col(x).cast("double")
    mag = F.abs(x)
    whole = F.floor(mag).cast("double")
    frac = mag - whole
    hi = F.floor(frac * F.lit(_SPLIT)) / F.lit(_SPLIT)
    lo = frac - hi
    q = F.floor(frac * F.lit(10.0)).cast("double")
    side = (hi * F.lit(20.0) - (q * F.lit(2.0) + F.lit(1.0))) + lo * F.lit(20.0)
    tenths = whole * F.lit(10.0) + q
    up = (side > 0) | ((side == 0) & (F.pmod(tenths, F.lit(2.0)) == 1))
    rounded = (tenths + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(10.0)
    return F.when(x < 0, F.lit(0.0) - rounded).otherwise(rounded)


def pct1(part: Column | str, total: Column | str) -> Column:
    """H1: share of ``total`` in percent, one decimal; 0.0 when the total is 0."""
    part, total = _col(part), _col(total)
    ratio = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    return F.coalesce(round1(ratio * F.lit(100.0)), F.lit(0.0))


def pct_change1(current: Column | str, previous: Column | str) -> Column:
    """Change against ``previous`` in percent; NULL when there was none."""
    current, previous = _col(current), _col(previous)
    ratio = (current - previous).cast("double") / F.when(
        previous > 0, previous.cast("double")
    )
    return round1(ratio * F.lit(100.0))


def decimal1(x: Column | str) -> Column:
    """A score rounded to one decimal, as DECIMAL(3,1)."""
    return round1(x).cast("decimal(3,1)")


def lookup(key: Column | str, table: dict[str, str], default: Column | str | None) -> Column:
    """Constant dictionary lookup; stays inside the projection, no join."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    fallback = F.lit(default) if default is None or isinstance(default, str) else default
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(key)), fallback)


def capitalize(c: Column | str) -> Column:
    """First letter upper-cased, the rest untouched."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def short_name(c: Column | str) -> Column:
    """The part between the first and second slash, else the whole name."""
    c = _col(c)
    return F.when(F.contains(c, F.lit("/")), F.split_part(c, F.lit("/"), F.lit(2))).otherwise(c)


def heat_level(count: Column | str, max_count: Column | str) -> Column:
    """Intensity 0-4 by count / max at 0.25, 0.5 and 0.75."""
    count, max_count = _col(count), _col(max_count)
    return (
        F.when((count == 0) | (max_count == 0), 0)
        .when(count * 4 <= max_count, 1)
        .when(count * 2 <= max_count, 2)
        .when(count * 4 <= max_count * 3, 3)
        .otherwise(4)
    )


def trend_direction(pct: Column | str) -> Column:
    """Up / down / stable; NULL when there is no change figure."""
    pct = _col(pct)
    return F.when(pct > 0, "up").when(pct < 0, "down").when(pct == 0, "stable")


def trend_value(pct: Column | str) -> Column:
    """Absolute change rounded half up (towards plus infinity) before abs."""
    return F.abs(F.floor(_col(pct) + F.lit(0.5)))


def iso_timestamp(c: Column | str) -> Column:
    """H7: ISO-8601 text to a timestamp; empty or unreadable text gives NULL."""
    return F.try_to_timestamp(F.nullif(_col(c), F.lit("")))


def array_size(c: Column | str) -> Column:
    """Array length with 0 for NULL, whatever ``spark.sql.legacy.sizeOfNull`` says."""
    c = _col(c)
    return F.when(c.isNull(), 0).otherwise(F.size(c))
