"""Near-duplicate embeddings: spherical k-means cells, cosine products in blocks within cells."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devpulse.llm.graph import components, splittable
from devpulse.plans.files import staged

COSINE = 0.9
#: independent partitions into cells, and cells of each that a vector is compared in
TABLES, PROBES = 3, 6
#: vectors that a cell should hold, and the most cells of a partition
CELL, MOST_CELLS = 256, 4096
#: k-means is fitted on at most so many vectors for each cell, and bytes in all
SAMPLE_PER_CELL, SAMPLE_BYTES = 16, 32 << 20
ITERATIONS = 10
#: centroids as close as this become one cell, so that a tight cluster is not cut up
APART = 0.8
#: residents of a cell, and members of it, that are compared in one product
BLOCK = 1024
#: what a vector is in a product: a row, a column or both
_RESIDENT, _MEMBER = 1, 2


def _matrix(column: pa.Array, kind: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The vectors, and which of them have a direction: not null, not zero, all components finite."""
    rows, usable = [], np.zeros(len(column), bool)
    values = column.values.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
    bounds = column.offsets.to_pylist()
    for i, there in enumerate(column.is_valid().to_pylist()):
        v = values[bounds[i] : bounds[i + 1]] if there else values[:0]
        usable[i] = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
        rows.append(v + kind(0))  # -0 becomes 0
    return rows, usable


def _described(kind: type):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, usable = _matrix(batch["embedding"], kind)
            packed = [v.tobytes() if ok else None for v, ok in zip(rows, usable)]
            digests = [None if p is None else xxhash.xxh3_128_digest(p) for p in packed]
            yield pa.record_batch({"vec_id": batch["vec_id"], "digest": pa.array(digests, pa.binary()), "vector": pa.array(packed, pa.binary())})

    return describe


def unit(packed: list[bytes], kind: type) -> np.ndarray:
    """Rows of length 1, in double precision."""
    rows = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centroids of spherical k-means, thinned until all are apart."""
    rng = np.random.default_rng(seed)
    centroids = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(ITERATIONS):
        home = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centroids)
    kept: list[int] = []
    close = centroids @ centroids.T >= APART
    for i in range(len(centroids)):
        if not close[i, kept].any():
            kept.append(i)
    return centroids[kept]


class Cells(NamedTuple):
    """Centroids of each partition, for each length of vectors; lengths without any are one cell."""

    of: dict[int, list[np.ndarray]]
    kind: type

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """Cells (row, table, probe) by falling cosine; -1 where there are fewer."""
        out = np.full((len(rows), TABLES, PROBES), -1, np.int64)
        out[:, :, 0] = 0
        for t, centroids in enumerate(self.of.get(rows.shape[1], ())):
            cosines = rows @ centroids.T
            top = np.argsort(-cosines, axis=1, kind="stable")[:, :PROBES]
            out[:, t, : top.shape[1]] = top
        return out


_DEALT = "cell long, home boolean, digest binary, copies long, probes binary, vector binary"


def _cell_number(dim: int, table: int, cell: int) -> int:
    return (dim * TABLES + table) * MOST_CELLS + cell


def _dealt(cells: Cells):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch["vector"].to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, p in enumerate(packed):
                by_size.setdefault(len(p), []).append(i)
            for own in by_size.values():
                rows = unit([packed[i] for i in own], cells.kind)
                near = cells.nearest(rows)
                part = batch.take(pa.array(own))
                at, table, probe = np.nonzero(near >= 0)
                number = _cell_number(rows.shape[1], 0, 0) + table * MOST_CELLS + near[at, table, probe]
                probes = pa.array([n.astype(np.int32).tobytes() for n in near], pa.binary())
                picked = [part[c].take(pa.array(at)) for c in ("digest", "copies", "vector")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(probe == 0), picked[0], picked[1], probes.take(pa.array(at)), picked[2]],
                    ["cell", "home", "digest", "copies", "probes", "vector"],
                )

    return deal


_FOUND = "digest binary, n long, other binary"


class _Members(NamedTuple):
    table: int
    cell: int
    digest: np.ndarray
    copies: np.ndarray
    near: np.ndarray

    def counted_here(self, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For pairs of a resident r and a member t: is this the one cell that counts the pair?"""
        near, j = self.near, self.table
        first = self.digest[r] < self.digest[t]
        alone = ~(near[r, j] == near[t, j, 0][:, None]).any(axis=1)  # t's cell does not see r
        here = first | ((near[t, j, 0] != self.cell) & alone)
        for i in range(j):  # an earlier partition has counted it
            here &= ~((near[r, i] == near[t, i, 0][:, None]).any(axis=1) | (near[t, i] == near[r, i, 0][:, None]).any(axis=1))
        return here


def _compared(kind: type, cosine: float):
    """One block of a cell's residents against one block of its members."""

    def compare(table: pa.Table) -> pa.Table:
        rows = unit(table["vector"].to_pylist(), kind)
        role = table["role"].to_numpy(zero_copy_only=False)
        residents, others = np.flatnonzero(role & _RESIDENT), np.flatnonzero(role & _MEMBER)
        number = table["cell"][0].as_py()
        near = np.frombuffer(b"".join(table["probes"].to_pylist()), np.int32).reshape(len(rows), TABLES, PROBES)
        digests = table["digest"].to_pylist()
        rank = np.empty(len(rows), np.int64)
        rank[sorted(range(len(rows)), key=digests.__getitem__)] = np.arange(len(rows))
        copies = table["copies"].to_numpy(zero_copy_only=False)
        members = _Members(number // MOST_CELLS % TABLES, number % MOST_CELLS, rank, copies, near)
        counts = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        for start in range(0, len(residents), 128):
            some = residents[start : start + 128]
            r, t = np.nonzero(rows[some] @ rows[others].T >= cosine)
            r, t = some[r], others[t]
            apart = r != t
            r, t = r[apart], t[apart]
            for a, b in zip(*_bounds(r)):  # each resident with its links
                linked = np.concatenate((label[t[a:b]], label[r[a : a + 1]]))
                least = linked.min()
                if (linked != least).any():
                    label[np.isin(label, linked)] = least
            here = members.counted_here(r, t)
            np.add.at(counts, r[here], copies[t[here]])
            np.add.at(counts, t[here], copies[r[here]])
        told = np.flatnonzero((counts > 0) | (label != np.arange(len(rows))))
        other = [digests[label[i]] if label[i] != i else None for i in told]
        return pa.table({"digest": pa.array([digests[i] for i in told], pa.binary()), "n": pa.array(counts[told]), "other": pa.array(other, pa.binary())})

    return compare


def _bounds(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(sorted_values):
        return [], []
    cuts = (np.flatnonzero(np.diff(sorted_values)) + 1).tolist()
    return [0, *cuts], [*cuts, len(sorted_values)]


def fit(classes: DataFrame, kind: type, n: int) -> Cells:
    """Cells for ``n`` vectors, fitted on a bounded sample of them in the order of their digests, which are hashes."""
    cells = min(MOST_CELLS, max(1, n // CELL))
    width = classes.agg(F.max(F.length("vector"))).first()[0] or 1
    most = max(1, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // width))
    taken = [bytes(r.vector) for r in classes.orderBy("digest").limit(most).select("vector").collect()]
    by_size: dict[int, list[bytes]] = {}
    for p in taken:
        by_size.setdefault(len(p), []).append(p)
    of = {}
    for packed in by_size.values():
        sample = unit(packed, kind)
        of[sample.shape[1]] = [fit_cells(sample, max(1, cells * len(packed) // len(taken)), seed) for seed in range(TABLES)]
    return Cells(of, kind)


def _tiles(dealt: DataFrame) -> DataFrame:
    """Each cell's residents and members in blocks, and a tile for each pair of blocks: cell, block, part and role of each row.

    A row is a resident of the tiles of its own block and a member of those of its
    own part; every resident meets every member in one tile.
    """
    # one row for each cell: at most MOST_CELLS for each partition and length of vectors
    sizes = dealt.groupBy("cell").agg(F.count_if("home").alias("n"), F.count("*").alias("members")).where("n > 0")
    sized = dealt.join(splittable(sizes), "cell")
    for name, n in (("blocks", "n"), ("parts", "members")):
        sized = sized.withColumn(name, F.ceil(F.col(n) / BLOCK).cast("int"))
    sized = sized.withColumn("own_block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    sized = sized.withColumn("own_part", F.pmod(F.xxhash64("digest", F.lit(1)), "parts").cast("int"))
    resident = f"""transform(IF(home, sequence(0, parts - 1), array()), j -> named_struct(
        'block', own_block, 'part', j, 'role', IF(j = own_part, {_RESIDENT | _MEMBER}, {_RESIDENT})))"""
    member = f"""transform(filter(sequence(0, blocks - 1), i -> NOT home OR i <> own_block), i -> named_struct(
        'block', i, 'part', own_part, 'role', {_MEMBER}))"""
    tiles = sized.withColumn("tile", F.explode(F.expr(f"concat({resident}, {member})")))
    return tiles.select("cell", "tile.*", "digest", "copies", "probes", "vector")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    Vectors with a cosine of at least ``cosine`` in double precision are linked;
    ``n_links`` counts a vector's links, ``component_id`` is the smallest vec_id
    that links reach, and that vector is kept.

    Equal vectors are one class with a count.  Spherical k-means, fitted on a
    bounded sample, assigns classes to cells of about 256, three times from
    different seeds; every class is compared in its cell and visits the next
    five of each partition.  A cell's residents and its members are dealt into blocks
    of 1,024, and each two blocks are compared in a group of their own, so that
    none grows with the cell.  A pair that several cells see is counted in one of
    them.  A pair is missed only if no partition brings it
    together (below 1 in 1,000 at the limit in 64 dimensions, see the README).

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows with a null vec_id, link with nothing and are kept, in a component
    of their own (null for a null id).  Vectors of different lengths do not
    link.  Repeated rows are equal vectors: each counts as one link of the
    others.  An empty table gives no rows.
    """
    kind = np.float64 if vectors.schema[embedding].dataType.elementType.typeName() == "double" else np.float32
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows, _ = staged(plain.mapInArrow(_described(kind), "vec_id long, digest binary, vector binary"), "vectors")
    usable = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes, _ = staged(classes, "classes")

    cells = fit(classes, kind, classes.count())
    dealt, _ = staged(classes.drop("first_id").mapInArrow(_dealt(cells), _DEALT), "cells")
    found, _ = staged(_tiles(dealt).groupBy("cell", "block", "part").applyInArrow(_compared(kind, cosine), _FOUND), "links")

    counts = found.groupBy("digest").agg(F.sum("n").alias("n"))
    groups = components(found.where("other IS NOT NULL").select("digest", "other")).withColumnRenamed("node", "digest")
    named = classes.drop("vector").join(groups, "digest", "left").join(counts, "digest", "left")
    named = named.withColumn("component", F.coalesce("component", "digest"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1
    ids = named.join(splittable(least), "component").select("digest", linked.alias("n_links"), "component_id")
    known = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = rows.drop("vector").withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest"))).join(ids, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), known.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
