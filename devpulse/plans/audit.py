"""The audit of a stored table, of which only folders that are new since the last one are read (V1-V7).

A folder of a store never changes, so what was counted in it stays true.  For each folder
the violations of the row rules and the rows of each referenced key are kept; an audit
counts them for new folders, adds up those of the folders in use, and meets the keys with
their parent table.  Uniqueness is looked at in the key hashes that stand beside the rows;
only rows whose hash is met twice are read and counted exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.operators import quality
from devpulse.plans import store
from devpulse.sources.tables import MONTH_RANGE

_COUNTS, _KEYS = "counts", "keys"
_S, _L = T.StringType(), T.LongType()
_COUNT_SCHEMA = T.StructType().add("folder", _S).add("rule", _S).add("violations", _L).add(MONTH_COLUMN, _S)
_KEY_SCHEMA = T.StructType().add("folder", _S).add("rule", _S).add("key", _L).add("n", _L).add(MONTH_COLUMN, _S)


@dataclass(frozen=True)
class Audit:
    """``rule, violations``, and how many of the folders in use were read for it."""

    rules: DataFrame
    read_folders: int
    folders: int


def audit_store(
    spark: SparkSession,
    root: str,
    results: str,
    entity: str,
    parents: dict[str, DataFrame],
    keys: list[str] | None = None,
    months: tuple[date, date] = MONTH_RANGE,
    table: str = "",
) -> Audit:
    """Count the violations of an entity stored by month.

    ``parents`` are the tables that it refers to; ``keys`` are the columns that must be
    unique, and that the store keeps hashes of.
    """
    tx = store.Transaction(spark, root)
    entries = tx.parts(table)
    rules = _references(entity, parents)
    done = store.Transaction(spark, results)
    known = {tuple(r) for r in done.read(_COUNTS, schema=_COUNT_SCHEMA).select("folder", MONTH_COLUMN).distinct().collect()}
    new = [e for e in entries if (e.folder, _month(e)) not in known]
    if new:
        rows = tx.open(table, new).withColumn("folder", _folder())
        _count(done, rows, entity, rules, months)
        done.commit()

    # one row for each folder in use
    used = spark.createDataFrame([(e.folder, _month(e)) for e in entries], f"folder string, {MONTH_COLUMN} string")
    at = ["folder", MONTH_COLUMN]
    counts = store.read(spark, results, None, _COUNT_SCHEMA, _COUNTS).join(used, at, "left_semi")
    parts = [counts.filter("rule <> ''").select("rule", "violations")]
    met = store.read(spark, results, None, _KEY_SCHEMA, _KEYS).join(used, at, "left_semi")
    for rule, (_, parent, parent_key) in rules.items():
        lost = met.filter(F.col("rule") == rule).join(parents[parent].select(F.col(parent_key).cast("long").alias("key")), "key", "left_anti")
        parts.append(lost.select("rule", F.col("n").alias("violations")))
    if keys:
        rule = F.lit(f"V3 {entity}({', '.join(keys)}) unique")
        parts.append(_repeated(tx, table, keys).agg(F.count(F.lit(1)).alias("violations")).select(rule.alias("rule"), "violations"))
    names = [*quality.row_rules(entity, tx.open(table, entries[:1]), months), *rules] if entries else []
    zeros = spark.createDataFrame([(name, 0) for name in names], "rule string, violations long")
    sums = reduce(DataFrame.unionByName, parts, zeros).groupBy("rule").agg(F.sum("violations").alias("violations"))
    return Audit(sums, len(new), len(entries))


def _month(entry: store.Entry) -> str:
    return entry.part.partition("=")[2]


def _folder() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1)


def _references(entity: str, parents: dict[str, DataFrame]) -> dict[str, tuple[str, str, str]]:
    """Rule to (key, parent, key of the parent)."""
    return {
        f"V4 {child}.{key} in {parent}": (key, parent, quality.key_of_parent(parent))
        for child, key, parent in quality.REFERENCES
        if child == entity and parent in parents
    }


def _count(done: store.Transaction, rows: DataFrame, entity: str, references: dict[str, tuple[str, str, str]], months: tuple[date, date]) -> None:
    """Keep the violations and referenced keys of each folder; a folder without any has a row as well."""
    rules = quality.row_rules(entity, rows, months)
    counted = rows.groupBy("folder", MONTH_COLUMN).agg(F.count(F.lit(1)).alias("r"), *[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = [F.struct(F.lit("").alias("rule"), F.col("r").alias("violations"))]
    pairs += [F.struct(F.lit(name), F.col(f"r{i}")) for i, name in enumerate(rules)]
    each = counted.select("folder", MONTH_COLUMN, F.explode(F.array(*[p.cast("struct<rule:string,violations:bigint>") for p in pairs])).alias("e"))
    done.write(each.select("folder", "e.*", MONTH_COLUMN), F.col(MONTH_COLUMN), _COUNTS, sort_by=("folder",))
    if references:
        entry = [F.struct(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("key")) for rule, (key, _, _) in references.items()]
        found = rows.select("folder", MONTH_COLUMN, F.explode(F.array(*entry)).alias("e")).select("folder", MONTH_COLUMN, "e.*")
        held = found.filter("key IS NOT NULL").groupBy("folder", MONTH_COLUMN, "rule", "key").agg(F.count(F.lit(1)).alias("n"))
        done.write(held, F.col(MONTH_COLUMN), _KEYS, sort_by=("rule", "key"))


def _repeated(tx: store.Transaction, table: str, keys: list[str]) -> DataFrame:
    """The key values that stand more than once, counted exactly where hashes are met twice."""
    hashes, unhashed = tx.hashes(keys, table)
    suspects = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("folder", "part")).alias("at")).filter("n > 1")
    places = {tuple(r) for r in suspects.select(F.explode("at").alias("e")).select("e.folder", "e.part").distinct().collect()}
    opened = [e for e in tx.parts(table) if (e.folder, e.part) in places]
    if unhashed:  # nothing is known of some folders
        rows = tx.open(table, tx.parts(table)).select(*keys)
    elif opened:
        rows = tx.open(table, opened).withColumn("h", store.key_hash(keys)).join(suspects.select("h"), "h", "left_semi").select(*keys)
    else:
        return tx.spark.range(0).toDF("n")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
