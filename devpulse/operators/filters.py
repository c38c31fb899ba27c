"""Small predicates shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def for_user(df: DataFrame, user_id: int | None) -> DataFrame:
    """narrow to one user; all users when None."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def in_list(df: DataFrame, column: str, ids: Iterable | DataFrame | None) -> DataFrame:
    """keep listed values; an absent or empty list keeps everything.

    A list too long for a literal is passed as a DataFrame and semi-joined.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_semi")
    ids = list(ids or [])
    return df.filter(F.col(column).isin(ids)) if ids else df


def active(repos: DataFrame, active_only: bool = True) -> DataFrame:
    """repositories being tracked."""
    return repos.filter("is_active") if active_only else repos


def split_valid(df: DataFrame, is_valid: Column) -> tuple[DataFrame, DataFrame]:
    """the usable records and the rejected ones (NULL counts as rejected)."""
    ok = F.coalesce(is_valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)
