"""Column names for what an operator keeps beside the caller's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, reserved: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(df)`` for a job that makes columns of the reserved names; those of the caller have other names meanwhile."""
    clashing = [c for c in df.columns if c.lower() in reserved]
    names = unused(df, *(f"{c}_" for c in clashing))
    out = work(df.withColumnsRenamed(dict(zip(clashing, names))))
    return out.withColumnsRenamed(dict(zip(names, clashing)))
