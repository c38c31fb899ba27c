"""Leading eigenvalues and eigenvectors of a symmetric integer matrix without negative eigenvalues.

The characteristic polynomial is found modulo many primes (Hessenberg form, in Spark
tasks) and put together by Chinese remaindering, so its coefficients are exact.  All its
roots are real, so by Descartes' rule the number of roots above a point is the number of
sign changes of the polynomial moved there: roots are isolated by bisection in whole
numbers.  Eigenvectors follow by inverse iteration in decimal arithmetic.

The matrix has as many rows as a vector has entries, however many vectors there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: relative width of an isolated root, in bits
ROOT_BITS = 96
#: roots nearer than this, in bits, count as one eigenvalue
EQUAL_BITS = 80
#: digits of the inverse iteration
DIGITS = 110
#: values held by one batch of primes
BATCH_VALUES = 1 << 20

Matrix = list[list[int]]


@dataclass(frozen=True)
class Component:
    """An eigenvalue, at most ``2 ** -ROOT_BITS`` of itself too large, and a unit eigenvector."""

    value: Decimal
    vector: list[Decimal]


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.2e9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def _primes(n: int) -> list[int]:
    """The n largest primes below 2 ** 31."""
    found, candidate = [], (1 << 31) - 1
    while len(found) < n:
        if _is_prime(candidate):
            found.append(candidate)
        candidate -= 2
    return found


def _hessenberg(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Similar matrices in upper Hessenberg form; ``h[i]`` is taken modulo ``p[i]``."""
    each, n = np.arange(len(p)), h.shape[1]
    q = p[:, None, None]
    for m in range(1, n - 1):
        pivot = np.argmax(h[:, m:, m - 1] != 0, axis=1) + m
        h[each, pivot], h[each, m] = h[each, m], h[each, pivot]
        h[each, :, pivot], h[each, :, m] = h[each, :, m], h[each, :, pivot]
        inverse = np.array([pow(int(x), -1, int(y)) if x else 0 for x, y in zip(h[:, m, m - 1], p)], np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p[:, None]
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m : m + 1] % q) % q
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % q).sum(axis=2)) % p[:, None]
    return h


def _polynomials(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """det(xI - h[i]) modulo p[i], coefficients from the highest, of matrices in Hessenberg form."""
    n, q = h.shape[1], p[:, None]
    known = [np.zeros((len(p), n + 1), np.int64)]
    known[0][:, n] = 1  # kept from the lowest power at the end, to shift by one place
    for k in range(n):
        last = known[k]
        new = np.roll(last, -1, axis=1) - last * h[:, k, k, None] % q
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            new -= known[i] * (below * h[:, i, k] % p)[:, None] % q
        known.append(new % q)
    return known[n]


def residues(matrix: Matrix, primes: list[int]) -> np.ndarray:
    """The characteristic polynomial modulo each prime, one row each."""
    p = np.array(primes, np.int64)
    exact = np.array(matrix, dtype=object).reshape(len(matrix), len(matrix))
    h = np.stack([(exact % prime).astype(np.int64) for prime in primes])
    return _polynomials(_hessenberg(h, p), p)


def characteristic_polynomial(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Coefficients of det(xI - matrix), from the highest; primes are dealt over the tasks.

    The k-th symmetric function of roots that are not negative is at most that of as many equal roots
    with the same sum, which says how many primes suffice; one more checks them.
    """
    n = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(n)) // max(n, 1))
    bound = max(math.comb(n, k) * mean**k for k in range(n + 1))
    primes = _primes(bound.bit_length() // 30 + 2)
    sent = spark.sparkContext.broadcast(matrix)
    most = max(1, BATCH_VALUES // max(n * n, 1))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("p").to_pylist()
            for i in range(0, len(mine), most):
                part = mine[i : i + most]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(residues(sent.value, part).tolist(), pa.list_(pa.int64()))], names=["p", "c"]
                )

    tasks = max(1, min(len(primes) // 4, spark.sparkContext.defaultParallelism * 4))
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(solve, "p long, c array<long>").collect()
    sent.unpersist()
    product = math.prod(primes)
    parts = [(product // p * pow(product // p, -1, p), c) for p, c in found]
    coefficients = []
    for k in range(n + 1):
        sign = -1 if k % 2 else 1
        value = sign * sum(weight * c[k] for weight, c in parts) % product
        if value > bound:
            raise ArithmeticError("the residues fit no matrix without negative eigenvalues")
        coefficients.append(sign * value)
    return coefficients


class RealRoots:
    """The roots of a polynomial that are all real, by counts of those above a point."""

    def __init__(self, coefficients: list[int]):
        self.coefficients = coefficients
        self._scaled: dict[int, list[int]] = {}

    def above(self, point: int, bits: int = 0) -> int:
        """How many roots, with multiplicity, exceed ``point / 2 ** bits``."""
        if bits not in self._scaled:
            self._scaled[bits] = [c << bits * k for k, c in enumerate(self.coefficients)]
        c = list(self._scaled[bits])
        for end in range(len(c), 1, -1):
            for j in range(1, end):
                c[j] += point * c[j - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def largest(self, k: int, top: int) -> tuple[int, int]:
        """(a, bits): the k-th largest root, a positive one of at most ``top``, lies in ((a - 1) / 2 ** bits, a / 2 ** bits]."""
        bits, low, high = 0, 0, top
        while True:
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if self.above(middle, bits) >= k else (low, middle)
            if low.bit_length() > ROOT_BITS:
                return high, bits
            more = ROOT_BITS + 1 - low.bit_length()
            bits, low, high = bits + more, low << more, high << more


def _null_vectors(matrix: Matrix, a: int, bits: int, n: int) -> list[list[Decimal]]:
    """Orthonormal vectors that the matrix minus the root maps to almost nothing, by inverse iteration.

    The shift is the middle of the root's interval, so the matrix to invert is one of whole numbers.
    """
    size = len(matrix)
    with localcontext(prec=DIGITS):
        lu = np.array([[Decimal((x << bits + 1) - (2 * a - 1 if i == j else 0)) for j, x in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
        order = list(range(size))
        for k in range(size):
            pivot = max(range(k, size), key=lambda i: abs(lu[i, k]))
            if pivot != k:
                lu[[k, pivot]] = lu[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
        found: list[np.ndarray] = []
        start = 0
        near = Decimal(2) ** (bits + 1 - EQUAL_BITS) * (Decimal(a) / 2**bits)
        while len(found) < n:
            v = np.array([Decimal(1 + (i + 1) * (7 * start + 13) % 101) for i in range(size)], dtype=object)
            start += 1
            if start > 20 * size:
                raise ArithmeticError("inverse iteration found too few vectors")
            shrunk = None
            for _ in range(6):
                for other in found:
                    v = v - other * np.dot(other, v)
                length = np.dot(v, v).sqrt()
                if not length:
                    break
                w = (v / length)[order]
                for i in range(1, size):
                    w[i] -= np.dot(lu[i, :i], w[:i])
                for i in range(size - 1, -1, -1):
                    w[i] = (w[i] - np.dot(lu[i, i + 1 :], w[i + 1 :])) / lu[i, i]
                v, shrunk = w, 1 / np.dot(w, w).sqrt()
            for other in found:
                v = v - other * np.dot(other, v)
            if shrunk is not None and shrunk <= near and (length := np.dot(v, v).sqrt()):
                found.append(v / length)
        return [v.tolist() for v in found]


def leading(spark: SparkSession, matrix: Matrix, most: int) -> list[Component]:
    """The components of the ``most`` largest eigenvalues, those of zero left out, by falling eigenvalue.

    Eigenvalues closer than ``2 ** -EQUAL_BITS`` of their size get an orthonormal basis of their common space.
    """
    common = math.gcd(*(x for row in matrix for x in row)) if matrix else 0
    if not common:
        return []
    reduced = [[x // common for x in row] for row in matrix]
    roots = RealRoots(characteristic_polynomial(spark, reduced))
    trace = sum(reduced[i][i] for i in range(len(reduced)))
    found = [roots.largest(k, trace) for k in range(1, min(most, roots.above(0)) + 1)]
    out: list[Component] = []
    while len(out) < len(found):
        a, bits = found[len(out)]
        equal = [x for x in found[len(out) :] if _close(x, (a, bits))]
        for vector in _null_vectors(reduced, a, bits, len(equal)):
            b, shift = found[len(out)]
            with localcontext(prec=DIGITS):
                out.append(Component(Decimal(b) / 2**shift * common, vector))
    return out


def _close(x: tuple[int, int], y: tuple[int, int]) -> bool:
    bits = max(x[1], y[1])
    a, b = x[0] << bits - x[1], y[0] << bits - y[1]
    return abs(a - b) <= b >> EQUAL_BITS
