"""Live daily commit counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from devpulse.plans import files

_KEYS = ["commit_date", "repo_id"]
_MEASURES = ["commit_count", "total_additions", "total_deletions"]


def daily_counts(commits: DataFrame) -> DataFrame:
    """Commits and lines per (day, repository)."""
    return commits.groupBy(F.to_date("committed_at").alias("commit_date"), "repo_id").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
    )


def write_counts(commits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of each micro-batch of a stream of commits.

    Counts add up, so a row may come as late as it likes: it counts for its own
    day, no state is held and nothing is dropped.  A replayed batch replaces its
    own counts.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        daily_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        commits.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _parts(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The newest complete sum of many batches, and the complete batches after it."""
    done = [n for n in files.child_names(spark, path) if files.exists(spark, f"{path}/{n}/_SUCCESS")]
    sums = [n for n in done if n.startswith("upto=")]
    last = sums[-1].partition("=")[2] if sums else ""
    return (sums[-1] if sums else None), [n for n in done if n.startswith("batch=") and n.partition("=")[2] > last]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far of each (day, repository)."""
    whole, batches = _parts(spark, path)
    names = ([whole] if whole else []) + batches
    if not names:
        raise FileNotFoundError(f"no counts were ever written under {path}")
    parts = spark.read.option("recursiveFileLookup", "true").parquet(*[f"{path}/{n}" for n in names])
    return parts.groupBy(*_KEYS).agg(*[F.sum(m).alias(m) for m in _MEASURES])


def compact(spark: SparkSession, path: str) -> None:
    """Sum up the batches so far, so that a read does not add up all there ever were.

    The commit marker of the sum is the switch.  The parts stay for those who read them
    already; `remove_summed` takes them away.
    """
    _, batches = _parts(spark, path)
    if batches:
        read_counts(spark, path).write.mode("overwrite").parquet(f"{path}/upto={batches[-1].partition('=')[2]}")


def remove_summed(spark: SparkSession, path: str) -> None:
    """Remove the parts that the newest sum holds; the caller knows that nobody reads them any more."""
    whole, batches = _parts(spark, path)
    if whole:
        for name in files.child_names(spark, path):
            if name.startswith(("batch=", "upto=")) and name != whole and name not in batches:
                files.delete(spark, f"{path}/{name}")
