"""The sync job: registration, slices, upserts, rollups, watermarks and job rows as one commit.

All tables of a run live in one store and switch together, so a job that is killed
between two steps leaves nothing of any, and no reader sees a moved watermark without
the facts it stands for.  A run is known by its time; running it again stores the same.

Repositories are dealt over buckets by the hash of their id, and only buckets with a
changed repository are written again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devpulse.operators import jobs
from devpulse.operators.upsert import COMMITS, PULL_REQUESTS, UpsertSpec, apply_languages
from devpulse.plans import files, incremental, store
from devpulse.sources.discovery import auto_register
from devpulse.sources.payloads import language_bytes, parse_commits, parse_pull_requests, parse_repositories
from devpulse.sources.tables import MONTH_RANGE, month_of, split_month_range, stored_schema

BUCKET, BUCKETS = "bucket", 64
#: the rollups that a run keeps up to date
DAILY, HOURLY = "daily_commit_stats", "hourly_activity"


@dataclass(frozen=True)
class Landed:
    """What was fetched for a run.

    ``listings`` are repositories listed for ``user_id``; commits, pull requests and
    ``languages`` (JSON text of bytes by language) belong to a ``repo_id``; all have ``seq``
    and ``payload``.  ``errors`` holds ``repo_id, error_type, message`` of failed fetches.
    """

    listings: DataFrame
    commits: DataFrame
    pull_requests: DataFrame
    languages: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Run:
    """When and what to sync: the requested repositories, or all after looking for new ones."""

    as_of: datetime
    requested: list[int] | DataFrame | None = None
    full_sync: bool = False
    #: take only commits of the repository's user
    own_commits: bool = True
    months: tuple[date, date] = MONTH_RANGE


def bucket_of(key: str | Column = "repo_id") -> Column:
    return F.format_string("%02x", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))


def create(spark: SparkSession, root: str, repositories: DataFrame) -> None:
    """A store that knows some repositories and has no facts yet."""
    tx = store.Transaction(spark, root)
    tx.write(repositories, bucket_of(), "repositories", None, column=BUCKET)
    tx.commit()


def repositories(spark: SparkSession, root: str) -> DataFrame:
    return store.read(spark, root, None, stored_schema("repositories"), "repositories", BUCKET).drop(BUCKET)


def plan(known: DataFrame, users: DataFrame, errors: DataFrame, requested: list[int] | DataFrame | None) -> DataFrame:
    """C14: ``user_id, repo_id, full_name, error_type, message, taken`` of every repository to sync, in the order of ids.

    A repository whose fetch failed is not taken; neither are a user's repositories after
    the first one that met a rate limit, as that ends the user's job.
    """
    targets = jobs.sync_targets(known, requested).join(users.select("user_id"), "user_id", "left_semi")
    limit = F.col("error_type") == "rate_limit"
    error = F.max(F.struct(limit.alias("limit"), "error_type", "message")).alias("error")
    failed = errors.groupBy("repo_id").agg(error).select("repo_id", "error.error_type", "error.message")
    met = targets.join(failed, "repo_id", "left")
    cuts = met.filter(limit).groupBy("user_id").agg(F.min("repo_id").alias("cut"))
    before = F.col("cut").isNull() | (F.col("repo_id") < F.col("cut"))
    return met.join(cuts, "user_id", "left").select(
        "user_id", "repo_id", "full_name", "error_type", "message", (F.col("error_type").isNull() & before).alias("taken")
    )


def job_rows(planned: DataFrame, items: DataFrame, run: Run) -> DataFrame:
    """One finished job for each user, with what it fetched (``repo_id, items``) and its last error."""
    at = F.lit(run.as_of).cast("timestamp")
    job_id = F.xxhash64(F.lit("sync"), "user_id", at)
    results = planned.join(items, "repo_id", "left").select(
        job_id.alias("job_id"),
        F.col("repo_id").alias("ord"),
        F.col("full_name").alias("repo_full_name"),
        F.coalesce("items", F.lit(0)).alias("items"),
        "error_type",
        "message",
    )
    owners = planned.select(job_id.alias("job_id"), "user_id").distinct()
    return jobs.job_outcomes(results).join(owners, "job_id").select(
        "job_id",
        "user_id",
        F.lit(None).cast("long").alias("repo_id"),
        F.lit("scheduled_sync" if run.requested is None else "manual_sync").alias("job_type"),
        "status",
        at.alias("started_at"),
        at.alias("completed_at"),
        F.col("items_fetched").cast("int").alias("items_fetched"),
        "error_detail",
        at.alias("created_at"),
    )


def run_sync(spark: SparkSession, root: str, users: DataFrame, landed: Landed, run: Run, quarantine: str) -> DataFrame:
    """Sync all users with a token; returns the run's job rows.

    Records that cannot be used are kept under ``quarantine``, in folders with the run's time.
    Another writer's commit in the same months makes the job start anew.
    """
    scratch: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        found, path = files.staged(df, name)
        scratch.append(path)
        return found

    def keep(reason: str):
        return lambda rows: rows.write.mode("overwrite").parquet(f"{quarantine}/{reason}/run={run.as_of:%Y%m%dT%H%M%S}")

    def merged(tx: store.Transaction, table: str, rows: DataFrame, spec: UpsertSpec) -> tuple[DataFrame, DataFrame]:
        """The rows a batch touched and how many records came in for each repository."""
        incoming, paths = incremental.collapsed(rows, spec, undecided=keep(f"{table}_undecided"))
        scratch.extend(paths)
        result = incremental.merge(tx, table, incoming, spec)
        scratch.extend(result.scratch)
        return result.touched, incoming.groupBy("repo_id").agg(F.sum("processed").alias("items"))

    def work(tx: store.Transaction) -> None:
        stored = tx.read("repositories", None, stored_schema("repositories"), BUCKET).drop(BUCKET)
        able = users.filter("has_token")
        if run.requested is None:
            able = jobs.sync_users(users, stored)
            listed = parse_repositories(landed.listings).join(able.select("user_id"), "user_id", "left_semi")
            stored = stored.unionByName(auto_register(listed, stored, run.as_of))
        known = stage(stored, "repositories")
        planned = stage(plan(known, able, landed.errors, run.requested), "planned")
        taken = planned.filter("taken").select("repo_id")
        mine = stage(known.join(taken, "repo_id", "left_semi").select("repo_id", "user_id", "last_synced_at"), "taken")

        parsed, undated = parse_commits(landed.commits)
        inside, outside = split_month_range(parsed, COMMITS.timestamp, run.months)
        keep("undated")(undated), keep("commits_out_of_range")(outside)
        sliced = jobs.incremental_slice(inside, mine, COMMITS.timestamp, users if run.own_commits else None, run.full_sync)
        commits, items = merged(tx, "commits", sliced, COMMITS)

        parsed, unusable = parse_pull_requests(landed.pull_requests)
        inside, outside = split_month_range(parsed, PULL_REQUESTS.timestamp, run.months)
        keep("unusable")(unusable), keep("pull_requests_out_of_range")(outside)
        # an old pull request comes in again when it is closed or merged
        moved = inside.withColumn("_moved_at", F.greatest("pr_created_at", "pr_closed_at", "merged_at"))
        sliced = jobs.incremental_slice(moved, mine, "_moved_at", full_sync=run.full_sync).drop("_moved_at")
        prs, _ = merged(tx, "pull_requests", sliced, PULL_REQUESTS)

        sizes = landed.languages.join(taken, "repo_id", "left_semi").select("repo_id", "seq", language_bytes("payload").alias("bytes"))
        after = stage(jobs.advance_watermark(apply_languages(known, sizes), taken, run.as_of), "synced")
        new = known.join(tx.read("repositories", None, stored_schema("repositories"), BUCKET).select("repo_id"), "repo_id", "left_anti")
        changed = [r[0] for r in taken.unionByName(new.select("repo_id")).select(bucket_of().alias("b")).distinct().collect()]  # at most BUCKETS
        tx.write(after.filter(bucket_of().isin(changed)), bucket_of(), "repositories", changed, column=BUCKET)

        def reader(table: str) -> incremental.Reader:
            return lambda months: tx.read(table, months, stored_schema(table))

        days = commits.select("repo_id", "committed_at")
        if tx.parts(DAILY):
            days = days.unionByName(incremental.stale_days(tx.read(DAILY), after))
        incremental.update_daily(tx, DAILY, reader("commits"), after, stage(days, "days"))
        hours = commits.select("repo_id", F.col("committed_at").alias("at")).unionByName(prs.select("repo_id", F.col("pr_created_at").alias("at")))
        incremental.update_hourly(tx, HOURLY, reader("commits"), reader("pull_requests"), after, hours)

        month = f"{run.as_of:%Y-%m}"
        before = tx.read("sync_jobs", [month], stored_schema("sync_jobs"))
        fresh = job_rows(planned, items, run).join(before.select("job_id"), "job_id", "left_anti")
        tx.write(fresh, month_of("created_at"), "sync_jobs", sort_by=("user_id",))

    try:
        store.attempt(spark, root, work)
    finally:
        for path in scratch:
            files.delete(spark, path)
    done = store.read(spark, root, [f"{run.as_of:%Y-%m}"], stored_schema("sync_jobs"), "sync_jobs")
    return done.filter(F.col("created_at") == F.lit(run.as_of).cast("timestamp")).drop("year_month")
