"""Daily counts as a streaming aggregate over event time, exact whatever comes late.

`count_days` keeps the open days in Spark's state store: a watermark bounds the state, and
each micro-batch writes the new counts of the days it touched.  What comes after its day
was closed is dropped there.  `reconcile_late` reads the same stream, finds every row that
can have been dropped, and counts its day anew from the stored commits.  The counts are a
table by month, so a read costs the same after any number of batches.

The session's time zone must be UTC, as windows of a day begin at midnight UTC.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.operators.rollups import commit_counts_by_day
from devpulse.plans import files, store
from devpulse.plans.incremental import Reader, months_in, replace_keys, touched_counts
from devpulse.sources.tables import month_of

KEYS = ["commit_date", "repo_id"]


def count_days(commits: DataFrame, root: str, checkpoint: str, delay_days: int) -> StreamingQuery:
    """Keep the daily counts of a stream of commits, each of which comes once.

    A day is closed, and its state let go, when a commit of ``delay_days`` after its end has
    been seen.  A replayed batch writes the same counts.
    """
    spark = commits.sparkSession
    counted = (
        commits.withWatermark("committed_at", f"{delay_days} days")
        .groupBy(F.window("committed_at", "1 day").alias("day"), "repo_id")
        .agg(
            F.count(F.lit(1)).alias("commit_count"),
            F.sum("additions").alias("total_additions"),
            F.sum("deletions").alias("total_deletions"),
        )
        .select(F.to_date("day.start").alias("commit_date"), "repo_id", "commit_count", "total_additions", "total_deletions")
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows, path = files.staged(batch, "days")  # the state is read once
        _put(spark, root, rows.select(*KEYS), lambda months: rows)
        files.delete(spark, path)

    return _start(counted.writeStream.outputMode("update").foreachBatch(keep), checkpoint)


def reconcile_late(commits: DataFrame, stored: Reader, root: str, checkpoint: str, delay_days: int) -> StreamingQuery:
    """Count the days anew for which commits of a stream came late.

    To be run after `count_days` over the same stream with the same delay.  The line below
    which a row counts as late is drawn from the newest day seen so far, this batch
    included, so no row that was dropped is above it; days are counted from all ``stored``
    commits, so one too many does no harm.
    """
    spark = commits.sparkSession

    def mend(batch: DataFrame, batch_id: int) -> None:
        days, path = files.staged(batch.select(F.to_date("committed_at").alias("commit_date"), "repo_id").distinct(), "late")
        newest = max(filter(None, [_newest_day(spark, root), days.agg(F.max("commit_date")).first()[0]]), default=None)
        if newest is not None:
            late = days.filter(F.col("commit_date") <= F.date_sub(F.lit(newest), delay_days))
            _put(spark, root, late, lambda months: touched_counts(_counts(stored(months)), late))
        files.delete(spark, path)

    return _start(commits.writeStream.foreachBatch(mend), checkpoint)


def read_days(spark: SparkSession, root: str) -> DataFrame:
    return store.read(spark, root).drop(MONTH_COLUMN)


def _counts(commits: DataFrame) -> DataFrame:
    return commit_counts_by_day(commits.withColumns({"commit_id": F.lit(1), "changed_files": F.lit(0)})).drop("total_changed_files")


def _put(spark: SparkSession, root: str, keys: DataFrame, fresh: Reader) -> None:
    months = months_in(keys.select(month_of("commit_date").alias(MONTH_COLUMN)))
    if months:
        store.attempt(spark, root, lambda tx: replace_keys(tx, "", fresh(months), keys, months, sort_by=("repo_id", "commit_date")))


def _newest_day(spark: SparkSession, root: str) -> date | None:
    tx = store.Transaction(spark, root)
    parts = [e.part.partition("=")[2] for e in tx.parts()]
    return tx.read(values=[max(parts)]).agg(F.max("commit_date")).first()[0] if parts else None


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
