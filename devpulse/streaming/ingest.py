"""Ingest of landed payload files (T1) with rollup maintenance."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from devpulse.operators.upsert import COMMITS, PULL_REQUESTS
from devpulse.plans import files
from devpulse.plans.incremental import MergeResult, merge_monthly, refresh_daily_stats, refresh_hourly
from devpulse.schemas import COMMIT_PAYLOAD, PULL_REQUEST_PAYLOAD, envelope
from devpulse.sources.payloads import parse_commits, parse_pull_requests
from devpulse.sources.tables import MONTH_RANGE, split_month_range


def ingest_commits(
    spark: SparkSession,
    landing: str,
    commits_path: str,
    daily_path: str,
    repos: DataFrame,
    checkpoint: str,
    max_files: int | None = None,
    months: tuple[date, date] = MONTH_RANGE,
    *,
    quarantine: str,
    prs_path: str | None = None,
    hourly_path: str | None = None,
) -> StreamingQuery:
    """Upsert landed commit files, then bring the daily rollup up to date.

    The checkpoint remembers which files were taken in, so a commit pushed late
    with an old date is still picked up.  Records arrive in the order of the
    files' times, then names, then ``seq``, so it makes no difference how many
    files one micro-batch takes, and a replayed batch changes nothing.  Records
    without a date or outside the month range go to ``quarantine``, and so do
    different records of one commit at one position, of which none can be said to
    be the last.  With ``hourly_path`` the hourly rollup follows too; it is computed
    from commits and the pull requests at ``prs_path``.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        records, path = files.staged(batch, "landed", "zstd")  # the files are parsed once for all outputs
        try:
            parsed, undated = parse_commits(records)
            inside, outside = split_month_range(parsed, COMMITS.timestamp, months)
            _keep({"undated": undated, "out_of_range": outside}, quarantine, batch_id)
            merged = merge_monthly(spark, commits_path, inside, COMMITS, undecided=_undecided(quarantine, batch_id), landed=True)
            try:
                refresh_daily_stats(spark, commits_path, daily_path, repos, merged.touched)
                if hourly_path:
                    _refresh_hours(spark, commits_path, prs_path, hourly_path, repos, merged, COMMITS.timestamp)
            finally:
                merged.release()
        finally:
            files.delete(spark, path)

    return _start(_landed(spark, landing, COMMIT_PAYLOAD, max_files), take_in, checkpoint)


def ingest_pull_requests(
    spark: SparkSession,
    landing: str,
    prs_path: str,
    checkpoint: str,
    max_files: int | None = None,
    months: tuple[date, date] = MONTH_RANGE,
    *,
    quarantine: str,
    repos: DataFrame | None = None,
    commits_path: str | None = None,
    hourly_path: str | None = None,
) -> StreamingQuery:
    """Upsert landed pull-request files, in the order of `ingest_commits`.

    With ``hourly_path``, which needs ``repos`` and ``commits_path``, the hourly rollup follows.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        records, path = files.staged(batch, "landed", "zstd")
        try:
            parsed, unusable = parse_pull_requests(records)
            inside, outside = split_month_range(parsed, PULL_REQUESTS.timestamp, months)
            _keep({"unusable": unusable, "out_of_range": outside}, quarantine, batch_id)
            merged = merge_monthly(spark, prs_path, inside, PULL_REQUESTS, undecided=_undecided(quarantine, batch_id), landed=True)
            try:
                if hourly_path:
                    _refresh_hours(spark, commits_path, prs_path, hourly_path, repos, merged, PULL_REQUESTS.timestamp)
            finally:
                merged.release()
        finally:
            files.delete(spark, path)

    return _start(_landed(spark, landing, PULL_REQUEST_PAYLOAD, max_files), take_in, checkpoint)


def _refresh_hours(
    spark: SparkSession, commits_path: str, prs_path: str, hourly_path: str, repos: DataFrame, merged: MergeResult, ts: str
) -> None:
    refresh_hourly(spark, commits_path, prs_path, hourly_path, repos, merged.touched.select("repo_id", F.col(ts).alias("at")))


def _undecided(quarantine: str, batch_id: int) -> Callable[[DataFrame], None]:
    return lambda records: _keep({"undecided": records}, quarantine, batch_id)


def _keep(rejects: dict[str, DataFrame], path: str, batch_id: int) -> None:
    """A replayed batch replaces its own rejects."""
    for reason, rows in rejects.items():
        rows.write.mode("overwrite").parquet(f"{path}/{reason}/batch={batch_id}")


def _landed(spark: SparkSession, landing: str, payload: StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(envelope(payload))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrival = F.struct("_metadata.file_modification_time", "_metadata.file_path", "seq")
    return reader.json(landing).select("repo_id", arrival.alias("seq"), "payload")


def _start(stream: DataFrame, take_in: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
