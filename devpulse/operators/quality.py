"""Integrity rules as one audit (V1-V7): ``rule, violations`` per rule.

Row-level rules of a table share a single pass, and its keys another.  Uniqueness
and references are checked on counted keys, so copies of a key never meet in one
task as rows.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.operators.rollups import ROLLUP_KEYS
from devpulse.schemas import ENTITIES, MONTH_RANGE, JOB_STATUSES, PARTITION_TIMESTAMP, SOURCE_TYPES

# The storage rules of the data model.
ENUMS = {("analyses", "source_type"): SOURCE_TYPES, ("sync_jobs", "status"): JOB_STATUSES}
RANGES = {("hourly_activity", "day_of_week"): (0, 6), ("hourly_activity", "hour_of_day"): (0, 23)}
UNIQUE = {
    "users": [["github_login"], ["github_user_id"]],
    "repositories": [["repo_id"], ["github_repo_id"]],
    "commits": [["commit_id"], ["repo_id", "github_commit_sha"]],
    "pull_requests": [["pr_id"], ["repo_id", "github_pr_id"]],
    "hourly_activity": [["user_id", "activity_date", "hour_of_day"]],
    **{name: [keys] for name, keys in ROLLUP_KEYS.items()},
}
REFERENCES = [
    ("hourly_activity", "user_id", "users"),
    ("repositories", "user_id", "users"),
    ("commits", "repo_id", "repositories"),
    ("analyses", "repo_id", "repositories"),
    ("pull_requests", "repo_id", "repositories"),
    ("sync_jobs", "user_id", "users"),
    ("sync_jobs", "repo_id", "repositories"),
]
LENGTHS = {
    ("users", "github_login"): 255,
    ("repositories", "full_name"): 512,
    ("repositories", "primary_language"): 100,
    ("commits", "github_commit_sha"): 40,
    ("pull_requests", "state"): 50,
    ("analyses", "source_type"): 20,
    ("analyses", "work_category"): 100,
    ("sync_jobs", "job_type"): 50,
    ("sync_jobs", "status"): 20,
}


def row_rules(table: str, df: DataFrame, months: tuple[date, date]) -> dict[str, Column]:
    """When a row violates each rule on single rows."""
    rules: dict[str, Column] = {}
    for (owner, column), allowed in ENUMS.items():
        if owner == table and column in df.columns:
            rules[f"V1 {table}.{column} in list"] = ~F.col(column).isin(allowed)
    for (owner, column), (lo, hi) in RANGES.items():
        if owner == table and column in df.columns:
            rules[f"V2 {table}.{column} in range"] = ~F.col(column).between(lo, hi)
    for field in ENTITIES.get(table, []):
        if not field.nullable and field.name in df.columns:
            rules[f"V5 {table}.{field.name} not null"] = F.col(field.name).isNull()
    for (owner, column), limit in LENGTHS.items():
        if owner == table and column in df.columns:
            rules[f"V6 {table}.{column} length"] = F.length(column) > limit
    stamp = PARTITION_TIMESTAMP.get(table)
    if stamp in df.columns:
        outside = (F.to_date(stamp) < F.lit(months[0])) | (F.to_date(stamp) >= F.lit(months[1]))
        rules[f"V7 {table}.{stamp} in month range"] = outside
    return rules


def _one_pass(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)]
    return counts.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


#: what a key value stands for in the shared count of keys
_PARENT = "parent"


def _keys(table: str, df: DataFrame, tables: dict[str, DataFrame]) -> list[tuple[str, str, list[str]]]:
    """(rule, domain, key columns) of the uniqueness rules, references and referenced keys of a table."""
    found = []
    for keys in UNIQUE.get(table, []):
        if set(keys) <= set(df.columns):
            rule = f"V3 {table}({', '.join(keys)}) unique"
            found.append((rule, rule, keys))
    for child, key, parent in REFERENCES:
        parent_key = key_of_parent(parent)
        if parent in tables and child in tables and key in tables[child].columns:
            if child == table:
                found.append((f"V4 {table}.{key} in {parent}", f"{parent}.{parent_key}", [key]))
            if parent == table and (_PARENT, f"{parent}.{parent_key}", [parent_key]) not in found:
                found.append((_PARENT, f"{parent}.{parent_key}", [parent_key]))
    return found


def key_of_parent(parent: str) -> str:
    return "user_id" if parent == "users" else "repo_id"


#: a key as columns of its own: numbers and days, and a text; NULL where it has fewer
_NUMBERS, _TEXT = ["k0", "k1", "k2"], "text"
_KEY = [*_NUMBERS, _TEXT]


def _typed(df: DataFrame, columns: list[str]) -> list[Column]:
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    numbers = [F.unix_date(c).cast("long") if df.schema[c].dataType.typeName() == "date" else F.col(c).cast("long") for c in columns if c not in texts]
    if len(texts) > 1 or len(numbers) > len(_NUMBERS):
        raise ValueError(f"a key of {columns} is too wide")
    numbers += [F.lit(None).cast("long")] * (len(_NUMBERS) - len(numbers))
    text = F.col(texts[0]) if texts else F.lit(None).cast("string")
    return [c.alias(name) for c, name in zip([*numbers, text], _KEY)]


def _key_counts(df: DataFrame, keys: list[tuple[str, str, list[str]]]) -> DataFrame:
    """How often each value of each key stands, all keys of a table in one pass; NULLs never clash."""

    def entry(rule: str, domain: str, columns: list[str]) -> Column:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return F.when(known, F.struct(F.lit(rule).alias("rule"), F.lit(domain).alias("domain"), *_typed(df, columns)))

    each = df.select(F.explode(F.array_compact(F.array(*[entry(*k) for k in keys]))).alias("e")).select("e.*")
    return each.groupBy("domain", *_KEY, "rule").agg(F.count(F.lit(1)).alias("n"))


def _key_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """V3 and V4 for all tables: keys are counted where they stand, then met by their domain."""
    wanted = {table: keys for table, df in tables.items() if (keys := _keys(table, df, tables))}
    if not wanted:
        return []
    counts = reduce(DataFrame.unionByName, [_key_counts(tables[table], keys) for table, keys in wanted.items()])
    # a value of a domain has one entry for each rule at most
    met = counts.groupBy("domain", *_KEY).agg(F.collect_list(F.struct("rule", "n")).alias("by"))
    orphan = ~F.exists("by", lambda e: e["rule"] == _PARENT)
    found = met.withColumn("orphan", orphan).select("orphan", F.explode("by").alias("e")).select("orphan", "e.*")
    repeated = F.col("rule").startswith("V3") & (F.col("n") > 1)
    lost = F.col("rule").startswith("V4") & F.col("orphan")
    bad = F.when(repeated, F.lit(1).cast("long")).when(lost, F.col("n")).otherwise(F.lit(0).cast("long"))
    rules = [rule for keys in wanted.values() for rule, _, _ in keys if rule != _PARENT]
    # a rule without any key has no violation
    zeros = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("rule"), F.lit(0).cast("long").alias("violations"))
    sums = found.filter(F.col("rule") != _PARENT).select("rule", bad.alias("violations")).unionByName(zeros)
    return [sums.groupBy("rule").agg(F.sum("violations").alias("violations"))]


def audit(tables: dict[str, DataFrame], months: tuple[date, date] = MONTH_RANGE) -> DataFrame:
    """Count the violations of every rule that applies to the given tables.

    Each table is read twice: once for the rules on single rows, once for its keys.
    """
    parts = [_one_pass(df, rules) for table, df in tables.items() if (rules := row_rules(table, df, months))]
    return reduce(DataFrame.unionByName, parts + _key_rules(tables))
