"""Tables stored in parts whose content changes in one step.

A store is a folder with one or more tables.  Every write goes to a folder of its own;
a small numbered list then says which folders make up each part of each table, and
creating the next list is the switch, for all tables at once.  A run that dies before
it leaves everything as it was; readers keep the files they started with.

Writers do not wait for each other.  A transaction notes which parts it read and
replaced.  If another writer's list came first, it is taken as the new base, and the
commit goes on unless the content of one of those parts has changed since: then it
raises `Conflict` and nothing is stored.  `attempt` runs such a job anew.

Beside the rows of a table with a key stand their 64-bit key hashes.  A batch is
looked up in these 8 bytes a row, and only folders with a hit are opened.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devpulse.functions.timeops import MONTH_COLUMN
from devpulse.plans import files
from devpulse.sources.tables import month_of

_VERSION = "version-"
#: folders of runs that ended without a commit are kept for so long, as they may still be at work
ABANDONED_SECONDS = 86_400

R = TypeVar("R")


class Conflict(RuntimeError):
    """Another writer changed what a transaction had read or replaced."""


@dataclass(frozen=True)
class Entry:
    """A folder of a part; no folder says that the part is empty."""

    table: str
    part: str
    folder: str | None
    #: the version that last changed the content of the part
    since: int
    #: the columns whose hashes stand beside the rows, comma-separated
    keys: str = ""


def _number(version: str) -> int:
    return int(version.removeprefix(_VERSION).partition("-")[0])


def _named(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in files.child_names(spark, folder) if n.startswith(_VERSION)]


def _entries(spark: SparkSession, root: str, version: str) -> list[Entry]:
    """A few for each part of the tables' history."""
    return [Entry(**json.loads(line)) for line in files.read_text(spark, f"{root}/lists/{version}").splitlines()]


def _newest(spark: SparkSession, root: str) -> tuple[int, list[Entry], int]:
    """The newest version, its entries, and the next free number, all from one look at the folder.

    Whoever takes that number has seen every list before it.
    """
    versions = _named(spark, f"{root}/lists")
    free = 1 + max(map(_number, versions), default=0)
    for version in reversed(versions):
        if files.is_file(spark, f"{root}/lists/{version}"):  # a list is complete once it has its name
            return _number(version), _entries(spark, root, version), free
    return 0, [], free


def key_hash(keys: Iterable[str]) -> Column:
    return F.xxhash64(*keys)


class Transaction:
    """Reads of one version and writes that become visible together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base, self.entries, _ = _newest(spark, root)
        self._seen: set[tuple[str, str | None]] = set()  # no part: all of them
        self._replaced: set[tuple[str, str]] = set()
        self._same: set[tuple[str, str]] = set()
        self._written: list[Entry] = []

    # --- reading --------------------------------------------------------------

    def parts(self, table: str = "", values: Iterable[str] | None = None, column: str = MONTH_COLUMN) -> list[Entry]:
        """The folders of the given parts, of all if None."""
        wanted = None if values is None else {f"{column}={v}" for v in values}
        return [e for e in self.entries if e.table == table and e.folder and (wanted is None or e.part in wanted)]

    def has(self, table: str = "") -> bool:
        return any(e.table == table for e in self.entries)

    def read(
        self, table: str = "", values: Iterable[str] | None = None, schema: T.StructType | None = None, column: str = MONTH_COLUMN
    ) -> DataFrame:
        """The table, or some parts of it, with its part column; ``schema`` is needed while it holds no row.

        Rows written by this transaction are included.
        """
        values = None if values is None else list(values)
        self.note(table, values, column)
        return self.open(table, self.parts(table, values, column), schema, column)

    def note(self, table: str = "", values: Iterable[str] | None = None, column: str = MONTH_COLUMN) -> None:
        """The commit must not go on if the given parts change meanwhile."""
        self._seen |= {(table, None)} if values is None else {(table, f"{column}={v}") for v in values}

    def open(self, table: str, entries: list[Entry], schema: T.StructType | None = None, column: str = MONTH_COLUMN) -> DataFrame:
        """The rows of some folders, which is not noted."""
        if not entries:
            if schema is None:
                known = self.parts(table)
                if not known:
                    raise FileNotFoundError(f"no table was ever written under {self.root}")
                schema = self.spark.read.parquet(self._path(known[-1])).schema
            names = [c for c in schema.fieldNames() if c != column]
            return self.spark.createDataFrame([], schema).select(*names, F.lit(None).cast("string").alias(column))
        # each folder names its part, so one read of all folders needs no common parent
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(*[self._path(e) for e in entries])
        return found.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), f"/{column}=([^/]+)/", 1))

    def _path(self, entry: Entry, kind: str = "data") -> str:
        return f"{self.root}/{kind}/{entry.folder}/{entry.part}"

    def lookup(
        self,
        batch: DataFrame,
        keys: list[str],
        table: str = "",
        values: Iterable[str] | None = None,
        schema: T.StructType | None = None,
        column: str = MONTH_COLUMN,
    ) -> tuple[DataFrame, int]:
        """The rows of the folders that can hold a key of the batch, and how many folders these are.

        Folders without hashes are always among them.  The commit must not go on if any of
        the parts looked through changes meanwhile, as it could then hold such a key.
        """
        self.note(table, values, column)
        entries = self.parts(table, values, column)
        hashes, opened = self.hashes(keys, table, values, column)
        if len(opened) < len(entries):
            asked = batch.select(key_hash(keys).alias("h"))
            hits = {tuple(r) for r in hashes.join(asked, "h", "left_semi").select("folder", "part").distinct().collect()}
            opened += [e for e in entries if e not in opened and (e.folder, e.part) in hits]
        return self.open(table, opened, schema, column), len(opened)

    def hashes(
        self, keys: list[str], table: str = "", values: Iterable[str] | None = None, column: str = MONTH_COLUMN
    ) -> tuple[DataFrame, list[Entry]]:
        """``h, folder, part`` of the rows in folders with hashes of the keys, and the folders without."""
        entries = self.parts(table, values, column)
        hashed = [e for e in entries if e.keys == ",".join(keys)]
        schema = "h long, folder string, part string"
        if not hashed:
            return self.spark.createDataFrame([], schema), entries
        folders = sorted({f"{self.root}/keys/{e.folder}" for e in hashed})
        known = self.spark.read.schema("h long, part string").option("recursiveFileLookup", "true").parquet(*folders)
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/keys/([^/]+)/", 1)
        # parts of a folder that were replaced since are still in its hashes
        used = self.spark.createDataFrame([(e.folder, e.part) for e in hashed], "folder string, part string")
        found = known.select("h", folder.alias("folder"), "part").join(used, ["folder", "part"], "left_semi").select("h", "folder", "part")
        return found, [e for e in entries if e not in hashed]

    # --- writing --------------------------------------------------------------

    def write(
        self,
        df: DataFrame,
        part: Column,
        table: str = "",
        replaced: Iterable[str] | None = (),
        sort_by: tuple[str, ...] = ("repo_id",),
        keys: list[str] | None = None,
        column: str = MONTH_COLUMN,
        same: bool = False,
    ) -> None:
        """Write rows to their parts.

        The parts in ``replaced`` hold nothing else afterwards (all parts if None); to
        others the rows are added.  ``same`` says that replaced parts get the rows they had.
        The rebalance hint lets AQE split a heavy part over many tasks and merge light ones.
        """
        folder = f"{_VERSION}{self.base + 1:08d}-{uuid.uuid4().hex[:12]}"
        data = f"{self.root}/data/{folder}"
        (
            df.withColumn(column, part)
            .hint("rebalance", column)
            .sortWithinPartitions(column, *sort_by)
            .write.partitionBy(column)
            .parquet(data)
        )
        fresh = [Entry(table, n, folder, 0, ",".join(keys or [])) for n in files.child_names(self.spark, data) if n.startswith(f"{column}=")]
        if not fresh:
            files.delete(self.spark, data)
        if keys and fresh:
            # in few files: what is later replaced of a folder stays in its hashes and is passed over
            part_name = F.concat(F.lit(f"{column}="), F.col(column)).alias("part")
            rows = self.open(table, fresh, None, column).select(key_hash(keys).alias("h"), part_name)
            rows.hint("rebalance").write.parquet(f"{self.root}/keys/{folder}")
        if replaced is None:
            self.note(table)
            gone = {(table, e.part) for e in self.entries if e.table == table}
        else:
            gone = {(table, f"{column}={v}") for v in replaced}
            self._seen |= gone
        self._replaced |= gone
        if same:
            self._same |= gone
        self._written = [e for e in self._written if (e.table, e.part) not in gone] + fresh
        self.entries = [e for e in self.entries if (e.table, e.part) not in gone] + fresh

    def _changed(self, newest: list[Entry]) -> list[str]:
        return sorted(
            {
                f"{e.table}/{e.part}".lstrip("/")
                for e in newest
                if e.since > self.base and ((e.table, None) in self._seen or (e.table, e.part) in self._seen)
            }
        )

    def commit(self) -> int:
        """Make all writes visible; returns the version.  Raises `Conflict`, after removing what was written."""
        while True:
            number, newest, mine = _newest(self.spark, self.root)
            if number > self.base and (changed := self._changed(newest)):
                self.abort()
                raise Conflict(f"changed meanwhile: {', '.join(changed)}")
            before = {}
            for e in newest:
                before[e.table, e.part] = max(e.since, before.get((e.table, e.part), 0))
            fresh = [replace(e, since=before.get(k, mine) if (k := (e.table, e.part)) in self._same else mine) for e in self._written]
            held = {(e.table, e.part) for e in fresh}
            emptied = [Entry(t, p, None, mine) for t, p in sorted(self._replaced - held) if (t, p) in before]
            stay = [e for e in newest if (e.table, e.part) not in self._replaced and (e.folder or (e.table, e.part) not in held)]
            lines = [json.dumps(asdict(e)) for e in [*stay, *emptied, *fresh]]
            if files.write_new(self.spark, f"{self.root}/lists/{_VERSION}{mine:08d}", "\n".join(lines)):
                return mine

    def abort(self) -> None:
        for folder in {e.folder for e in self._written}:
            for kind in ("data", "keys"):
                files.delete(self.spark, f"{self.root}/{kind}/{folder}")


def attempt(spark: SparkSession, root: str, work: Callable[[Transaction], R], tries: int = 3) -> R:
    """Run a job in a transaction and commit it; start anew if another writer was faster."""
    while True:
        tx, tries = Transaction(spark, root), tries - 1
        result = work(tx)
        try:
            tx.commit()
            return result
        except Conflict:
            if tries <= 0:
                raise


# --- stores of one table by month ---------------------------------------------


def exists(spark: SparkSession, root: str) -> bool:
    return _newest(spark, root)[0] > 0


def read(
    spark: SparkSession, root: str, months: list[str] | None = None, schema: T.StructType | None = None, table: str = "", column: str = MONTH_COLUMN
) -> DataFrame:
    """The table, or some months of it, with its month column; ``schema`` is needed while it holds no row."""
    return Transaction(spark, root).read(table, months, schema, column)


def commit(
    df: DataFrame,
    root: str,
    ts: str | Column,
    replaced: list[str] | None = (),
    sort_by: tuple[str, ...] = ("repo_id",),
    keys: list[str] | None = None,
) -> None:
    """Write rows, by the month of ``ts``, and switch to the table that holds them.

    The months in ``replaced`` hold nothing else afterwards (all months if None);
    to others the rows are added.  A `Conflict` is raised if a replaced month changes
    while the rows are written.
    """
    tx = Transaction(df.sparkSession, root)
    tx.write(df, month_of(ts), "", replaced, sort_by, keys)
    tx.commit()


def compact(spark: SparkSession, root: str, ts: str, most: int, sort_by: tuple[str, ...] = ("repo_id",), table: str = "") -> list[str]:
    """Rewrite the months that consist of more than ``most`` folders; returns them.

    The rows stay the same, so this disturbs no other writer; if one changes such a month
    first, nothing is rewritten and the months are left for the next run.
    """
    tx = Transaction(spark, root)
    pieces: dict[str, list[Entry]] = {}
    for e in tx.parts(table):
        pieces.setdefault(e.part, []).append(e)
    months = sorted(p.partition("=")[2] for p, found in pieces.items() if len(found) > most)
    if months:
        keys = {e.keys for e in tx.parts(table, months)}
        hashed = keys.pop().split(",") if len(keys) == 1 and keys != {""} else None
        tx.write(tx.read(table, months).drop(MONTH_COLUMN), month_of(ts), table, months, sort_by, hashed, same=True)
        try:
            tx.commit()
        except Conflict:
            return []
    return months


def expire(spark: SparkSession, root: str, keep: int, abandoned_seconds: int = ABANDONED_SECONDS) -> None:
    """Remove what only versions older than the ``keep`` newest use, and folders that runs without a commit left long ago.

    The caller knows which versions are still being read; nothing else removes any.
    """
    versions = [v for v in _named(spark, f"{root}/lists") if files.is_file(spark, f"{root}/lists/{v}")]
    kept, old = versions[-max(1, keep) :], versions[: -max(1, keep)]
    used = {(e.folder, e.part) for v in kept for e in _entries(spark, root, v)}
    unused = {(e.folder, e.part) for v in old for e in _entries(spark, root, v) if e.folder} - used
    for version in old:
        files.delete(spark, f"{root}/lists/{version}")
    in_use = {folder for folder, _ in used}
    for folder, part in unused:
        files.delete(spark, f"{root}/data/{folder}/{part}")
    for kind in ("data", "keys"):
        for folder in set(_named(spark, f"{root}/{kind}")) - in_use:
            path = f"{root}/{kind}/{folder}"
            if folder in {f for f, _ in unused} or files.modified(spark, path) < time.time() - abandoned_seconds:
                files.delete(spark, path)
