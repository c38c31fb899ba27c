"""Forge payloads to typed rows.

Input rows are ``repo_id, seq, payload``: the repository a record belongs to,
its position in the fetch, and the record itself, either typed or as JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devpulse.functions.exprs import array_size, iso_timestamp
from devpulse.operators.filters import split_valid
from devpulse.operators.ranking import top_k
from devpulse.schemas import (
    COMMIT_PAYLOAD,
    LANGUAGE_BYTES,
    MANIFEST_NAMES,
    PULL_REQUEST_PAYLOAD,
    REPOSITORY_PAYLOAD,
)


@dataclass(frozen=True)
class Cuts:
    """Limits on what is kept of a commit record; none by default."""

    message_chars: int | None = None
    files: int | None = None
    patch_chars: int | None = None


def typed_payload(df: DataFrame, schema: T.DataType) -> DataFrame:
    """Parse ``payload`` if it is still JSON text; unreadable text gives NULLs.

    The parsed record is generated as a row of its own.  A plain projection
    would be inlined into every filter and field access, and parse the text
    again in each of them.
    """
    if not isinstance(df.schema["payload"].dataType, T.StringType):
        return df
    others = [c for c in df.columns if c != "payload"]
    return df.select(*others, F.explode(F.array(F.from_json("payload", schema))).alias("payload"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _leading(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _stored_file(f: Column, cuts: Cuts) -> Column:
    return F.struct(
        f["filename"].alias("filename"),
        f["status"].alias("status"),
        _zero(f["additions"]).alias("additions"),
        _zero(f["deletions"]).alias("deletions"),
        _leading(F.coalesce(f["patch"], F.lit("")), cuts.patch_chars).alias("patch"),
    )


def parse_commits(raw: DataFrame, cuts: Cuts = Cuts()) -> tuple[DataFrame, DataFrame]:
    """Commit rows and the records rejected for lack of a date.

    The committer date counts before the author date; an empty one is missing.
    All files are counted; ``cuts`` may shorten what is stored of them, and the
    message.
    """
    p = F.col("payload")
    ok, rejected = split_valid(typed_payload(raw, COMMIT_PAYLOAD).withColumn("_at", _commit_time(p)), F.col("_at").isNotNull())
    files = F.coalesce(p["files"], F.array().cast(COMMIT_PAYLOAD["files"].dataType))
    stored = files if cuts.files is None else F.slice(files, 1, cuts.files)
    sha = F.coalesce(p["sha"], F.lit(""))
    parsed = ok.select(
        F.xxhash64("repo_id", sha).alias("commit_id"),
        "repo_id",
        "seq",
        sha.alias("github_commit_sha"),
        _leading(F.coalesce(p["commit"]["message"], F.lit("")), cuts.message_chars).alias("message"),
        F.col("_at").alias("committed_at"),
        _zero(p["stats"]["additions"]).alias("additions"),
        _zero(p["stats"]["deletions"]).alias("deletions"),
        array_size(p["files"]).alias("changed_files"),
        F.struct(
            p["stats"].alias("stats"),
            F.transform(stored, lambda f: _stored_file(f, cuts)).alias("files"),
            F.lit(None).cast("string").alias("diff"),
        ).alias("raw_data"),
        p["author"]["login"].alias("author_login"),
    )
    return parsed, rejected.drop("_at")


def _commit_time(p: Column) -> Column:
    committer, author = p["commit"]["committer"]["date"], p["commit"]["author"]["date"]
    return iso_timestamp(F.coalesce(F.nullif(committer, F.lit("")), author))


def parse_pull_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: pull-request rows and the records without id, number or creation time."""
    p = F.col("payload")
    created = iso_timestamp(p["created_at"])
    valid = (_zero(p["id"]) != 0) & (_zero(p["number"]) != 0) & created.isNotNull()
    ok, rejected = split_valid(typed_payload(raw, PULL_REQUEST_PAYLOAD), valid)
    no_labels = F.array().cast("array<string>")
    parsed = ok.select(
        F.xxhash64("repo_id", p["id"]).alias("pr_id"),
        "repo_id",
        "seq",
        p["id"].alias("github_pr_id"),
        p["number"].alias("github_pr_number"),
        p["title"].alias("title"),
        F.coalesce(p["state"], F.lit("open")).alias("state"),
        *[_zero(p[n]).alias(n) for n in ("additions", "deletions", "changed_files")],
        created.alias("pr_created_at"),
        iso_timestamp(p["closed_at"]).alias("pr_closed_at"),
        iso_timestamp(p["merged_at"]).alias("merged_at"),
        F.struct(
            F.coalesce(F.transform(p["labels"], lambda x: x["name"]), no_labels).alias("labels"),
            p["user"]["login"].alias("user"),
            p["head"]["ref"].alias("head_ref"),
            p["base"]["ref"].alias("base_ref"),
        ).alias("raw_data"),
    )
    return parsed, rejected


def parse_repositories(raw: DataFrame, include_private: bool = True, include_forks: bool = False) -> DataFrame:
    """Listed repositories of ``user_id`` with defaults, filtered by flags."""
    p = F.col("payload")
    no = F.lit(False)
    listed = typed_payload(raw, REPOSITORY_PAYLOAD).select(
        "user_id",
        "seq",
        p["id"].alias("github_repo_id"),
        p["full_name"].alias("full_name"),
        p["description"].alias("description"),
        p["language"].alias("primary_language"),
        F.coalesce(p["private"], no).alias("is_private"),
        F.coalesce(p["fork"], no).alias("is_fork"),
        p["pushed_at"].alias("pushed_at"),
        _zero(p["stargazers_count"]).alias("stargazers_count"),
    )
    if not include_private:
        listed = listed.filter(~F.col("is_private"))
    return listed if include_forks else listed.filter(~F.col("is_fork"))


def language_bytes(text: Column | str) -> Column:
    return F.from_json(text, LANGUAGE_BYTES)


def primary_language(sizes: Column | str) -> Column:
    """The language with the most bytes; of equals the first listed."""
    sizes = F.col(sizes) if isinstance(sizes, str) else sizes
    nothing = F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).cast("long").alias("value"))
    return F.aggregate(
        F.map_entries(sizes), nothing, lambda best, e: F.when(e["value"] > best["value"], e).otherwise(best)
    )["key"]


def select_manifests(files: DataFrame, searched_dirs: int | None = None) -> DataFrame:
    """The dependency manifests of each repository, from ``repo_id, path, ord``.

    Manifests in the root win; else those of the first of its subdirectories, in
    listing order, that has any; ``searched_dirs`` limits the search to so many.
    """
    parts = F.split("path", "/")
    located = files.select(
        "repo_id",
        "path",
        "ord",
        F.size(parts).alias("depth"),
        F.get(parts, F.lit(0)).alias("top"),
        F.get(parts, F.size(parts) - 1).alias("name"),
    )
    subdirs = (
        located.filter("depth > 1").groupBy("repo_id", F.col("top").alias("dir")).agg(F.min("ord").alias("dir_ord"))
    )
    searched = top_k(subdirs, ["repo_id"], [F.asc("dir_ord"), F.asc("dir")], searched_dirs, "dir_rank")
    # at most one path per known name, so these arrays hold no more than the names
    candidates = (
        located.filter(F.col("name").isin(MANIFEST_NAMES) & (F.col("depth") <= 2))
        .groupBy("repo_id", F.when(F.col("depth") == 2, F.col("top")).otherwise("").alias("dir"))
        .agg(F.array_sort(F.collect_set("path")).alias("paths"))
    )
    ranked = candidates.join(searched.select("repo_id", "dir", "dir_rank"), ["repo_id", "dir"], "left").withColumn(
        "dir_rank", F.when(F.col("dir") == "", 0).otherwise(F.col("dir_rank"))
    )
    chosen = (
        ranked.filter(F.col("dir_rank").isNotNull())
        .groupBy("repo_id")
        .agg(F.min_by("paths", "dir_rank").alias("paths"))
    )
    return chosen.select("repo_id", F.explode("paths").alias("path"))
