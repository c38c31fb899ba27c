"""Stored entities: typed scans and month-partitioned writes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.operators.filters import split_valid
from devpulse.schemas import ENTITIES, MONTH_RANGE, PARTITION_TIMESTAMP


def stored_schema(entity: str) -> T.StructType:
    fields = list(ENTITIES[entity].fields)
    if entity in PARTITION_TIMESTAMP:
        fields.append(T.StructField(MONTH_COLUMN, T.StringType()))
    return T.StructType(fields)


def load(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """Scan an entity with its fixed schema; nothing is inferred."""
    return spark.read.schema(stored_schema(entity)).parquet(f"{root}/{entity}")


def month_of(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def split_month_range(
    df: DataFrame, ts: str, months: tuple[date, date] = MONTH_RANGE
) -> tuple[DataFrame, DataFrame]:
    """Rows inside the stored month range and the rows to quarantine."""
    day = F.to_date(ts)
    return split_valid(df, (day >= F.lit(months[0])) & (day < F.lit(months[1])))


def write_monthly(df: DataFrame, ts: str, path: str, mode: str = "append", sort_by: tuple[str, ...] = ("repo_id",)) -> None:
    """Write ``[first of month, first of next)`` partitions.

    The rebalance hint lets AQE split a heavy month over many tasks and merge
    light ones, so neither one giant nor thousands of tiny files come out.
    With ``mode="overwrite"`` only the months present in ``df`` are replaced.
    """
    (
        df.withColumn(MONTH_COLUMN, month_of(ts))
        .hint("rebalance", MONTH_COLUMN)
        .sortWithinPartitions(MONTH_COLUMN, *sort_by, ts)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )
