"""Upserts (S9-S11, W5, J9).

Within a batch the first occurrence of a key supplies the insert-only fields and
the last one the updated fields.  That is two ordered aggregates, combined on
the map side, so any number of copies of one key costs one row per map task.
Which record came first must be certain: different records of one key at the
same position end the job, or are set aside by a job that keeps such records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.sources.payloads import primary_language


@dataclass(frozen=True)
class UpsertSpec:
    """Which fields identify a row, which are updated, which are kept for good."""

    keys: list[str]
    updated: list[str]
    kept: list[str]
    timestamp: str

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.kept, *self.updated]


COMMITS = UpsertSpec(
    keys=["repo_id", "github_commit_sha"],
    updated=["additions", "deletions", "changed_files", "raw_data"],
    kept=["commit_id", "message", "committed_at"],
    timestamp="committed_at",
)
PULL_REQUESTS = UpsertSpec(
    keys=["repo_id", "github_pr_id"],
    updated=["title", "state", "additions", "deletions", "changed_files", "pr_closed_at", "merged_at", "raw_data"],
    kept=["pr_id", "github_pr_number", "pr_created_at"],
    timestamp="pr_created_at",
)


def collapse_marked(batch: DataFrame, spec: UpsertSpec, order: str = "seq") -> DataFrame:
    """One row per key with its ``processed`` record count, and whether it is ``undecided``.

    ``order`` is the arrival position, of any type that can be compared.  Equal records may
    share one.  A key is undecided if different records do where it decides which of them
    counts, or if it is repeated and a position is missing.
    """
    records = batch.select(
        *spec.keys,
        F.col(order).alias("_at"),
        F.struct(*spec.kept).alias("_kept"),
        F.struct(*spec.updated).alias("_updated"),
        F.xxhash64(F.to_json(F.struct(*spec.kept, *spec.updated))).alias("_content"),
    )

    def tied(extreme: Callable[[Column], Column]) -> Column:
        # of the records at the extreme position, the smallest and the largest hash
        one = extreme(F.struct("_at", F.col("_content").alias("of")))
        other = extreme(F.struct("_at", F.bitwise_not("_content").alias("of")))
        return one["of"] != F.bitwise_not(other["of"])

    several = F.count(F.lit(1)) > 1
    unknown = several & (F.count("_at") < F.count(F.lit(1)))
    unsure = unknown | (several & (tied(F.min) | tied(F.max)))
    first = F.coalesce(F.min_by("_kept", "_at"), F.first("_kept"))
    last = F.coalesce(F.max_by("_updated", "_at"), F.first("_updated"))
    return (
        records.groupBy(*spec.keys)
        .agg(first.alias("_first"), last.alias("_last"), F.count(F.lit(1)).alias("processed"), unsure.alias("undecided"))
        .select(*spec.keys, "_first.*", "_last.*", "processed", "undecided")
    )


def collapse_batch(batch: DataFrame, spec: UpsertSpec, order: str = "seq") -> DataFrame:
    """`collapse_marked` in which an undecided key is an error."""
    error = F.raise_error(F.lit(f"records of one key ({', '.join(spec.keys)}) share the position `{order}`"))
    marked = collapse_marked(batch, spec, order)
    at = spec.updated[-1]
    checked = F.when(F.col("undecided"), error).otherwise(F.col(at))
    return marked.withColumn(at, checked).drop("undecided")


def undecided_records(batch: DataFrame, marked: DataFrame, spec: UpsertSpec) -> DataFrame:
    """The records of a batch whose key is undecided."""
    return batch.join(marked.filter("undecided").select(*spec.keys), spec.keys, "left_semi").select(*batch.columns)


def updated_rows(base: DataFrame, incoming: DataFrame, spec: UpsertSpec) -> DataFrame:
    """Every base row, with the updated fields replaced where a key came in.

    A left join keeps the base in place when the incoming side is small enough
    for Spark to broadcast it; a full outer join would always shuffle the base.
    """
    changes = incoming.select(*spec.keys, F.struct(*spec.updated).alias("_new"))

    def value(name: str) -> Column:
        if name not in spec.updated:
            return F.col(name)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)

    return base.join(changes, spec.keys, "left").select(*[value(c) for c in base.columns])


def matched_keys(base: DataFrame, incoming: DataFrame, spec: UpsertSpec, *extra: str) -> DataFrame:
    """The base rows an incoming key hits; reads the key columns only."""
    return base.select(*spec.keys, *extra).join(incoming.select(*spec.keys), spec.keys, "left_semi")


def new_rows(incoming: DataFrame, hits: DataFrame, spec: UpsertSpec) -> DataFrame:
    return incoming.join(hits.select(*spec.keys), spec.keys, "left_anti").select(*spec.columns)


def upsert(base: DataFrame, batch: DataFrame, spec: UpsertSpec, order: str = "seq") -> DataFrame:
    """The table after the batch; nothing is written.

    The batch is collapsed first; a left join brings its values to the stored
    rows and an anti join finds the new ones, so a table stays where it is when
    the batch is small enough to broadcast.  For a stored table use
    `plans.incremental.merge_monthly`, which leaves most of its files alone.
    """
    incoming = collapse_batch(batch, spec, order)
    fresh = new_rows(incoming, matched_keys(base, incoming, spec), spec)
    return updated_rows(base, incoming, spec).unionByName(fresh, allowMissingColumns=True).select(*base.columns)


def upsert_commits(base: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Statistics and file list change; message and commit time stay."""
    return upsert(base, batch, COMMITS, order)


def upsert_pull_requests(base: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Title, state, counts and end times change; number and creation stay."""
    return upsert(base, batch, PULL_REQUESTS, order)


def _patched(document: str, key: str, value: str) -> Column:
    """The JSON document with one key set to JSON text ``value``, the others kept; an unreadable one stays."""
    current = F.coalesce(_parsed(document), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(current, lambda k, v: k != key)
    patched = F.to_json(F.map_concat(others, F.create_map(F.lit(key), F.parse_json(value))))
    return F.when(_unreadable(document), F.col(document)).otherwise(patched)


def _parsed(document: str) -> Column:
    return F.from_json(document, "map<string,variant>")


def _unreadable(document: str) -> Column:
    return F.col(document).isNotNull() & (F.trim(document) != "") & _parsed(document).isNull()


def unreadable_documents(df: DataFrame, document: str) -> DataFrame:
    """The rows whose document is no JSON object; patches leave them alone."""
    return df.filter(_unreadable(document))


def patch_json(df: DataFrame, patches: DataFrame, on: str, document: str, key: str, order: str = "seq") -> DataFrame:
    """Set one key of a JSON document column and keep all its other keys.

    ``patches`` has ``on``, ``value`` (JSON text) and an order; the last wins.
    A document that is no JSON object stays as it is, see `unreadable_documents`.
    """
    latest = patches.groupBy(on).agg(F.max_by("value", order).alias("_value"))
    patched = F.when(F.col("_value").isNotNull(), _patched(document, key, "_value")).otherwise(F.col(document))
    return df.join(latest, on, "left").withColumn(document, patched).select(*df.columns)


def apply_languages(repos: DataFrame, languages: DataFrame) -> DataFrame:
    """S5 + S11: store language bytes and make the largest the primary language.

    ``languages`` holds ``(repo_id, seq, bytes map<string,bigint>)``.
    """
    latest = (
        languages.filter(F.size("bytes") > 0)
        .groupBy("repo_id")
        .agg(F.max_by("bytes", "seq").alias("bytes"))
        .select("repo_id", F.to_json("bytes").alias("_value"), primary_language("bytes").alias("_primary"))
    )
    known = F.col("_value").isNotNull()
    document = "repo_metadata"
    return (
        repos.join(latest, "repo_id", "left")
        .withColumn("primary_language", F.coalesce("_primary", "primary_language"))
        .withColumn(document, F.when(known, _patched(document, "languages", "_value")).otherwise(F.col(document)))
        .select(*repos.columns)
    )
