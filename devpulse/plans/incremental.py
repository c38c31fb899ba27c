"""Incremental upserts and rollup maintenance by month (S9, S10 on storage; T2).

A batch touches some months of a table.  Its keys are looked up in the key hashes of
the store, and one join with the folders that hold some finds the rows it changes; the
months holding one are rewritten, all other new rows are added, and both become visible
together.  Replaying a batch after a failure gives the same table.  Rollups live in the
store that `read_rollup` reads.

Each step works in a transaction (`store.Transaction`), so several of them can be made
one commit; the functions with a path are transactions of their own, run anew if another
writer was faster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.operators import listings, ranking, rollups, streaks
from devpulse.operators.upsert import UpsertSpec, collapse_batch, collapse_marked, undecided_records, updated_rows
from devpulse.plans import files, store
from devpulse.sources.tables import month_of, stored_schema

#: gives some months of a stored table
Reader = Callable[[list[str]], DataFrame]


@dataclass
class MergeResult:
    """The rows a batch touched: their key, repository and *kept* timestamp."""

    touched: DataFrame
    rewritten_months: list[str]
    scratch: list[str]
    #: folders that were searched for keys, of so many in the table
    opened_folders: int = 0
    stored_folders: int = 0

    def release(self) -> None:
        for path in self.scratch:
            files.delete(self.touched.sparkSession, path)


def months_in(df: DataFrame) -> list[str]:
    # one value per stored month, so the list is as short as the table's history
    return [r[0] for r in df.select(MONTH_COLUMN).distinct().collect()]


def merge_monthly(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    spec: UpsertSpec,
    order: str = "seq",
    trust_dates: bool = False,
    undecided: Callable[[DataFrame], None] | None = None,
    landed: bool = False,
) -> MergeResult:
    """Upsert a batch into a month-partitioned table.

    Keys are looked up in every month, because a stored row keeps its timestamp
    even when the incoming record says otherwise.  ``trust_dates`` limits the
    search to the batch's own months for sources whose record time is immutable.
    Records that cannot be put in order go to ``undecided``; without it they end the job.
    ``landed`` says that the batch is read from files, which must stay until the result
    is released; another batch is written down first.
    """
    incoming, scratch = collapsed(batch, spec, order, undecided, landed)
    merged = store.attempt(spark, path, lambda tx: merge(tx, "", incoming, spec, trust_dates))
    merged.scratch.extend(scratch)
    return merged


def collapsed(
    batch: DataFrame,
    spec: UpsertSpec,
    order: str = "seq",
    undecided: Callable[[DataFrame], None] | None = None,
    landed: bool = False,
) -> tuple[DataFrame, list[str]]:
    """One row for each decided key of a batch, and the folders it is read from; records of other keys are handed on.

    Most keys come once.  Of all records only the key hashes are counted, and whole
    records are brought together only where a hash comes several times.
    """
    scratch: list[str] = []

    def stage(df: DataFrame) -> DataFrame:
        found, path = files.staged(df, "collapsed")
        scratch.append(path)
        return found

    batch = batch if landed else stage(batch)
    keyed = batch.withColumn("_hash", store.key_hash(spec.keys))
    often = stage(keyed.groupBy("_hash").count().filter("count > 1").select("_hash"))
    some = not often.isEmpty()
    once = keyed.join(often, "_hash", "left_anti") if some else keyed
    once = once.select(*spec.columns, F.lit(1).cast("long").alias("processed"))
    several = keyed.join(often, "_hash", "left_semi").drop("_hash") if some else batch.limit(0)
    if undecided is None:
        return (once.unionByName(stage(collapse_batch(several, spec, order))) if some else once), scratch
    if not some:
        undecided(several)
        return once, scratch
    marked = stage(collapse_marked(several, spec, order))
    undecided(undecided_records(several, marked, spec))
    return once.unionByName(marked.filter("NOT undecided").drop("undecided")), scratch


def merge(tx: store.Transaction, table: str, incoming: DataFrame, spec: UpsertSpec, trust_dates: bool = False) -> MergeResult:
    """`merge_monthly` of a collapsed batch, within a transaction; the batch is read several times."""
    ts = spec.timestamp
    stored = T.StructType([*incoming.select(*spec.columns).schema, T.StructField(MONTH_COLUMN, T.StringType())])
    months = months_in(incoming.select(month_of(ts).alias(MONTH_COLUMN))) if trust_dates else None
    total = len(tx.parts(table))
    base, opened = tx.lookup(incoming, spec.keys, table, months, stored)
    if not opened:  # no key is known, so the records need not meet any
        tx.write(incoming.select(*spec.columns), month_of(ts), table, keys=spec.keys)
        return MergeResult(incoming.select(*spec.keys, ts), [], [], opened, total)
    at = F.struct(F.col(ts).alias("at"), F.col(MONTH_COLUMN).alias("month"))
    known = base.select(*spec.keys, at.alias("_stored"))
    found, scratch = files.staged(incoming.join(known, spec.keys, "left"), "found")

    hits, fresh = found.filter("_stored IS NOT NULL"), found.filter("_stored IS NULL").select(*spec.columns)
    rewritten = sorted(months_in(hits.select(F.col("_stored.month").alias(MONTH_COLUMN))))
    changed = tx.read(table, rewritten, stored).drop(MONTH_COLUMN)
    # the hint keeps whole records from being collected on the driver, where their packed files look small
    merged = updated_rows(changed, hits.hint("merge"), spec).unionByName(fresh, allowMissingColumns=True) if rewritten else fresh
    # rows for a rewritten month come in with it, others are added to theirs
    tx.write(merged, month_of(ts), table, rewritten, keys=spec.keys)

    touched = hits.select(*spec.keys, F.col("_stored.at").alias(ts)).unionByName(fresh.select(*spec.keys, ts))
    return MergeResult(touched, rewritten, [scratch], opened, total)


def refresh_daily_stats(
    spark: SparkSession, commits_path: str, rollup_path: str, repos: DataFrame, touched: DataFrame
) -> None:
    """Recompute the touched (day, repository) keys of the daily rollup (A1).

    ``touched`` must be stored rows (see `merge_monthly`).  Only commits in the
    touched months are read and only those months of the rollup are replaced.
    """
    store.attempt(spark, rollup_path, lambda tx: update_daily(tx, "", _months_of(spark, commits_path), repos, touched))


def update_daily(tx: store.Transaction, table: str, commits: Reader, repos: DataFrame, touched: DataFrame) -> None:
    """`refresh_daily_stats` within a transaction."""
    keys = touched.select(F.to_date("committed_at").alias("commit_date"), "repo_id").distinct()
    months = months_in(keys.withColumn(MONTH_COLUMN, month_of("commit_date")))
    if months:
        fresh = touched_counts(rollups.commit_counts_by_day(commits(months)), keys)
        rows = rollups.with_owner(fresh, repos, "full_name", "primary_language")
        replace_keys(tx, table, rows, keys, months)


def _months_of(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Reader:
    return lambda months: store.read(spark, path, months, schema)


def refresh_renamed(spark: SparkSession, commits_path: str, rollup_path: str, repos: DataFrame) -> None:
    """Bring rows up to date whose repository changed name, language or owner.

    The daily rollup carries these attributes, and a full rebuild would pick the
    new ones up; here only the days of such repositories are recomputed.
    """
    stale = stale_days(store.read(spark, rollup_path), repos)
    touched, path = files.staged(stale, "renamed")
    refresh_daily_stats(spark, commits_path, rollup_path, repos, touched)
    files.delete(spark, path)


def stale_days(daily: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo_id, committed_at``: the days of the daily rollup whose repository has other attributes now."""
    attributes = ["user_id", "full_name", "primary_language"]
    now = repos.select("repo_id", F.struct(*attributes).alias("_now"))
    return (
        daily.select("repo_id", F.col("commit_date").cast("timestamp").alias("committed_at"), F.struct(*attributes).alias("_then"))
        .join(now, "repo_id")
        .filter(~F.col("_now").eqNullSafe(F.col("_then")))
        .select("repo_id", "committed_at")
    )


def refresh_analysis_rollup(
    spark: SparkSession, name: str, analyses_path: str, rollup_path: str, repos: DataFrame, touched: DataFrame
) -> None:
    """T2 for the tag (A2) and category (A3) rollups.

    ``touched`` holds ``repo_id, analyzed_at`` of new analyses.  A week can reach
    into the next month, so source months are widened to whole weeks.
    """
    weekly = {"weekly_tech_trends": True, "work_category_stats": False}[name]
    analyzed = F.to_date("analyzed_at")
    if weekly:
        day, start, count = "week_start", F.trunc(analyzed, "week"), rollups.tag_counts_by_week
    else:
        day, start, count = "analysis_date", analyzed, rollups.category_counts_by_day
    keys = touched.select(start.alias(day), "repo_id").distinct()
    months = months_in(keys.withColumn(MONTH_COLUMN, month_of(day)))

    def update(tx: store.Transaction) -> None:
        last = F.date_add(day, 6 if weekly else 0)
        sources = {*months, *months_in(keys.withColumn(MONTH_COLUMN, month_of(last)))}
        analyses = store.read(spark, analyses_path, sorted(sources))
        replace_keys(tx, "", rollups.with_owner(touched_counts(count(analyses), keys), repos), keys, months)

    if months:
        store.attempt(spark, rollup_path, update)


def refresh_hourly(
    spark: SparkSession, commits_path: str, prs_path: str, rollup_path: str, repos: DataFrame, touched: DataFrame
) -> None:
    """T2 for the hourly rollup (A17): recompute the touched (user, day) keys.

    ``touched`` holds ``repo_id`` and ``at``, the time of a commit or of a pull
    request's creation.
    """
    sources = [_months_of(spark, path, stored_schema(entity)) for path, entity in ((commits_path, "commits"), (prs_path, "pull_requests"))]
    store.attempt(spark, rollup_path, lambda tx: update_hourly(tx, "", *sources, repos, touched))


def update_hourly(tx: store.Transaction, table: str, commits: Reader, prs: Reader, repos: DataFrame, touched: DataFrame) -> None:
    """`refresh_hourly` within a transaction."""
    days = touched.select(F.to_date("at").alias("activity_date"), "repo_id").distinct()
    owned = days.join(repos.select("repo_id", "user_id"), "repo_id")
    keys, scratch = files.staged(owned.select("activity_date", "user_id").distinct(), "hours")
    months = months_in(keys.withColumn(MONTH_COLUMN, month_of("activity_date")))
    if months:
        mine = repos.join(keys.select("user_id").distinct(), "user_id", "left_semi")
        fresh = touched_counts(rollups.hourly_activity(commits(months), prs(months), mine), keys)
        replace_keys(tx, table, fresh, keys, months)
    files.delete(tx.spark, scratch)


def refresh_active_days(spark: SparkSession, daily_path: str, path: str, touched: DataFrame) -> None:
    """T2 for the months of active days (A13): recompute those of the touched ``user_id, commit_date``."""

    def update(tx: store.Transaction) -> None:
        keys = touched.select(F.trunc("commit_date", "month").alias("month_start"), "user_id").distinct()
        months = months_in(keys.select(month_of("month_start").alias(MONTH_COLUMN)))
        if months:
            daily = store.read(spark, daily_path, months)
            replace_keys(tx, "", touched_counts(streaks.active_days(daily), keys), keys, months)

    store.attempt(spark, path, update)


def refresh_history_index(spark: SparkSession, jobs_path: str, index_path: str, touched: DataFrame) -> None:
    """Keep the jobs of each user and day beside the stored jobs; ``touched`` holds ``user_id, created_at``."""

    def update(tx: store.Transaction) -> None:
        keys = touched.select(F.to_date("created_at").alias("level"), "user_id").distinct()
        months = months_in(keys.select(month_of("level").alias(MONTH_COLUMN)))
        if months:
            jobs = store.read(spark, jobs_path, months)
            replace_keys(tx, "", touched_counts(ranking.level_counts(jobs, F.to_date("created_at")), keys), keys, months)

    store.attempt(spark, index_path, update)


def history_page(
    spark: SparkSession, jobs_path: str, index_path: str, repos: DataFrame, page: int = 1, per_page: int = 20, user_id: int | None = None
) -> DataFrame:
    """C2 from the stored jobs: the index tells the days that the page overlaps, and only their months are read."""
    index = store.read(spark, index_path).drop(MONTH_COLUMN)
    days = ranking.pages_overlap(index if user_id is None else index.filter(F.col("user_id") == user_id), (page - 1) * per_page, page * per_page)
    jobs = store.read(spark, jobs_path, months_in(days.select(month_of("level").alias(MONTH_COLUMN)))).drop(MONTH_COLUMN)
    return listings.sync_history(jobs, repos, page, per_page, user_id, index)


def touched_counts(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """The counts of the touched keys.

    Written after the aggregation, so a busy key is reduced on the map side
    before it is shuffled.  When the key list is small enough to broadcast,
    Spark moves this join below the aggregation and filters the scan with it.
    """
    return counts.join(keys, keys.columns, "left_semi")


def replace_keys(
    tx: store.Transaction, table: str, fresh: DataFrame, keys: DataFrame, months: list[str], sort_by: tuple[str, ...] | None = None
) -> None:
    """Replace the rows of the given keys in the given months of a rollup."""
    stored = tx.read(table, months, fresh.schema).drop(MONTH_COLUMN)
    if tx.parts(table, months):
        fresh = stored.join(keys, keys.columns, "left_anti").unionByName(fresh)
    tx.write(fresh, month_of(keys.columns[0]), table, months, sort_by or ("user_id", keys.columns[0]))
