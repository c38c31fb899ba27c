"""Embedding whitening (operator 11): leading principal components of whole-number vectors, exactly fitted.

Method: exact characteristic polynomial.  Tasks add up the products of vector entries as
whole numbers; from the sums, `exact_eigen` finds the characteristic polynomial of the
scatter matrix, its largest roots and their eigenvectors.  The fit list, each distinct
vector once, is staged; only sums of one number for each two dimensions reach the driver.

A null vector and one with null or non-finite entries give no row.  An entry c becomes
floor(256 * c), at the limits of a long beyond them.  A vector shorter than the longest
counts as ending in zeros.  Repeated rows and ids, and null ids, give a row each.  A
component without variance (all of them, if there is one distinct vector) has a null
`whitened`.  An empty table gives no row.  Other columns are not read, so their names do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devpulse.llm.exact_eigen import DIGITS, Component, Matrix, leading
from devpulse.plans import files

#: vectors whose products are added at a time
ROWS = 4096
#: an entry's steps, and the components of a row
STEPS, COMPONENTS = 256, 4
_PART = 62


@dataclass(frozen=True)
class Fit:
    """Sums of the distinct vectors and their leading components."""

    n: int
    sums: list[int]
    #: n * n times the trace of the covariance
    trace: int
    #: of n * n times the covariance
    components: list[Component]

    def explained(self) -> list[float]:
        with localcontext(prec=DIGITS):
            return [float(c.value / self.trace) for c in self.components]

    def weights(self) -> np.ndarray:
        """What n * x - sums is multiplied with, one column for each component."""
        with localcontext(prec=DIGITS):
            columns = [[float(x / c.value.sqrt()) for x in c.vector] for c in self.components]
        return np.array(columns, np.float64).reshape(len(columns), len(self.sums)).T


def _whole(vector: str) -> Column:
    limit = float(1 << 63)

    def entry(c: Column) -> Column:
        at = F.floor(F.lit(float(STEPS)) * c.cast("double"))
        far = F.lit(float(STEPS)) * c.cast("double")
        return F.when(far >= limit, F.lit((1 << 63) - 1)).when(far < -limit, F.lit(-(1 << 62)) * 2).otherwise(at).cast("long")

    return F.transform(vector, entry)


def whole_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: the usable vectors in whole numbers."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))

    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, finite)).select(F.col(id), _whole(vector).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact sums of the products of each two columns, as Python integers."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if most * most * len(x) < 1 << 52:  # every partial sum is a double
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x if most * most * len(x) < 1 << 62 else x.astype(object)
    return (y.T @ y).astype(object)


def scatter(x: DataFrame, size: int) -> tuple[int, list[int], Matrix]:
    """(n, sums, sums of products) of all vectors of a column ``x``, exact whatever their number.

    Each task sends one row for each two dimensions, in two parts that Spark adds as decimals.
    """

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column("x").slice(at, ROWS), size)
                total += _products(np.hstack([rows, np.ones((len(rows), 1), np.int64)]))
        i, j = np.triu_indices(size + 1)
        values = total[i, j].tolist()
        parts = [[Decimal(v >> _PART) for v in values], [Decimal(v & (1 << _PART) - 1) for v in values]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(p, pa.decimal128(38, 0)) for p in parts]], names=["i", "j", "high", "low"]
        )

    sums = x.mapInArrow(added, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high"), F.sum("low"))
    total = [[0] * (size + 1) for _ in range(size + 1)]
    for i, j, high, low in sums.collect():  # one row for each two dimensions
        total[i][j] = total[j][i] = (int(high) << _PART) + int(low)
    return total[size][size], total[size][:size], [row[:size] for row in total[:size]]


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Fit:
    """Components of distinct whole-number vectors ``x`` of equal length."""
    n, sums, products = scatter(distinct, size)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(matrix[i][i] for i in range(size))
    return Fit(n, sums, trace, leading(distinct.sparkSession, matrix, components))


def projected(x: str, model: Fit, components: int) -> Column:
    """A struct of ``deviation`` (null beyond 38 digits) and the array ``whitened`` of a whole-number vector."""
    n, sums, weights = model.n, model.sums, model.weights()
    size, met = len(sums), weights.shape[1]
    far = max([abs(s) for s in sums], default=0)

    @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
    def solve(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = _matrix(part, size)
            most = n * (int(np.abs(rows.astype(np.float64)).max(initial=0)) + 1) + far
            if most * most * max(size, 1) >= 1 << 62:
                rows = rows.astype(object)
            centred = rows * n - np.array(sums, dtype=rows.dtype)
            deviation = [Decimal(v) if v < 10**38 else None for v in (centred * centred).sum(axis=1).tolist()]
            values = centred.astype(np.float64) @ weights
            whole = np.hstack([values, np.full((len(rows), components - met), np.nan)])
            flat = pa.array(whole.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * components, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.decimal128(38, 0)), lists], ["deviation", "whitened"])

    return solve(x)


def identity_error(distinct: DataFrame, model: Fit) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, measured on the list."""
    met = len(model.components)
    if not met:
        return None
    rows = distinct.select(projected("x", model, met).alias("p")).select(*[F.col("p.whitened")[k].alias(f"w{k}") for k in range(met)])
    pairs = [(a, b) for a in range(met) for b in range(a, met)]
    found = rows.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, found))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``, a row for each usable vector and component.

    ``deviation`` is the summed square of n * x - sums as a decimal, null beyond 38 digits.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id, vector)
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    size = longest or 0
    if shortest != longest:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", zeros))
    distinct, path = files.staged(rows.select("x").distinct(), "distinct_vectors")
    model = fit(distinct, size, components)
    error = identity_error(distinct, model)
    files.delete(spark, path)
    named = min(components, size)
    shares = [*model.explained(), *[0.0 if model.trace else None] * (named - len(model.components))]
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    return (
        rows.select(id, projected("x", model, named).alias("_p"))
        .select(id, "_p.deviation", F.posexplode("_p.whitened").alias("_k", "whitened"))
        .select(
            id,
            (F.col("_k") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("_k")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
