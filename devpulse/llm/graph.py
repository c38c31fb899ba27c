"""Connected components over link tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.plans.files import delete, staged

#: union-find over so many links at a time inside a task
_HELD_LINKS = 200_000


class Forest:
    """Disjoint sets; the root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        self.parent.setdefault(x, x)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links as stars around the smallest member."""
    forest, schema = Forest(), None

    def flushed() -> pa.RecordBatch:
        pairs = [(x, root) for x in list(forest.parent) if (root := forest.root(x)) != x]
        forest.parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
        if len(forest.parent) > _HELD_LINKS:
            yield flushed()
    if schema is not None:
        yield flushed()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of a link (a, b) that is not the smallest of its component.

    The component is the smallest node that can be reached.  Each task first
    reduces its links to stars; then large-star and small-star steps alternate,
    each written to the shared folder, until the links stay the same.  Only sums
    reach the driver.  Links with a null end and links of a node to itself count
    for nothing; links may repeat and may have either direction.
    """
    a, b = links.columns
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = edges.mapInArrow(_stars, edges.schema).distinct()
    edges, path = staged(edges, "links")
    seen = _sums(edges)
    while seen[0]:
        fresh, fresh_path = staged(_small_star(_large_star(edges)), "links")
        delete(edges.sparkSession, path)
        edges, path = fresh, fresh_path
        before, seen = seen, _sums(edges)
        if before == seen:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def splittable(grouped: DataFrame) -> DataFrame:
    """A grouped side for a join on its key.

    As it comes out of the aggregation it would be joined where it lies, with
    all rows of a frequent key in one task; dealt anew, the join has two shuffled
    sides, and Spark splits the frequent key.
    """
    return grouped.hint("rebalance")


def _sums(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(found)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = splittable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    tied = edges.join(splittable(least), "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return tied.union(least).distinct()
