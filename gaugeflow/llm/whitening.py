"""Embedding whitening by the exact characteristic polynomial.

Entries become integers, so the scatter matrix (n times the vectors' products
less the products of their sums) is one of integers, gathered exactly. Its
characteristic polynomial comes from its residues: each prime's Hessenberg
form gives the polynomial modulo that prime, and Chinese remaindering the
whole. All its roots are real; those wanted are isolated by the signs of
shifted coefficients, refined to some 120 bits, and inverse iteration in long
decimals gives their null vectors.

What leaves the tasks is bounded by the square of the vectors' length, never by
their number.
"""

from __future__ import annotations

import decimal
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, written

SCALE, SHIFT = 1024, 100_000
#: Of the sums that tasks send: digits so few that sums of millions of tasks fit a long.
LIMB = 10**12
BITS = 120


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, not finite, or beyond what a long holds once scaled."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(2**62 // SCALE), F.lit(False)))


def remaining(rows: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` (doubles) of the usable rows, and their length:
    the most frequent one, the longer one of two. Rows of other lengths drop."""
    kept = need(rows, "vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    common = kept.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = common["d"] if common else 0
    return kept.where(F.size("embedding") == dims), dims


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Scaled entries, not shifted, as longs."""
    values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * SCALE).astype(np.int64).reshape(batch.num_rows, dims)


def _product(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers: in doubles where no sum can pass 53 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 2**53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


@dataclass
class Scatter:
    """``n`` vectors, the ``sums`` of their shifted entries, and n Σ x x' − S S', a list of rows."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(len(self.matrix)))


def scatter(vectors: DataFrame, dims: int) -> Scatter:
    """The exact scatter of ``vectors`` (``embedding``: ``dims`` doubles). A
    task sends its sums in limbs of 12 digits, added up before they reach the
    driver as at most a few numbers a pair of dimensions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            y = _integers(batch, dims)
            n += len(y)
            one += y.astype(object).sum(axis=0) if len(y) else 0
            two += _product(y)
        found = [(-1, -1, n), *((-1, j, int(one[j])) for j in range(dims)), *((i, j, int(two[i, j])) for i in range(dims) for j in range(i, dims))]
        rows = []
        for i, j, v in found:
            sign, v, k = (1, -1)[v < 0], abs(v), 0
            while v:
                v, part = divmod(v, LIMB)
                rows.append((i, j, k, sign * part))
                k += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "v"])

    parts = vectors.select("embedding").mapInArrow(sums, "i int, j int, k int, v long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + r["v"] * LIMB ** r["k"]
    n, one = total.get((-1, -1), 0), [total.get((-1, j), 0) for j in range(dims)]
    # A shift of all entries changes no scatter, so it joins the sums alone.
    matrix = [[n * total.get((min(i, j), max(i, j)), 0) - one[i] * one[j] for j in range(dims)] for i in range(dims)]
    return Scatter(n, [s + SHIFT * n for s in one], matrix)


def is_prime(n: int) -> bool:
    """For n under 3 billion: Miller and Rabin's test with the bases that suffice there."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I − matrix) modulo the prime p < 2^31, constant
    term first: similarity steps to Hessenberg form, then its recurrence."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        if (i := k + 1 + int(below[0])) != k + 1:
            h[[k + 1, i]] = h[[i, k + 1]]
            h[:, [k + 1, i]] = h[:, [i, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1][None, :]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u[None, :] % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        new = -int(h[m - 1, m - 1]) * polys[m - 1] % p
        new[1:] = (new[1:] + polys[m - 1, :-1]) % p
        way, factors = 1, np.zeros(m - 1, dtype=np.int64)
        for i in range(m - 2, -1, -1):
            way = way * int(h[i + 1, i]) % p
            if not way:
                break
            factors[i] = way * int(h[i, m - 1]) % p
        polys[m] = (new - (factors[:, None] * polys[: m - 1] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d]]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """e_0, ..., e_d of a positive semidefinite integer matrix: its polynomial
    is Σ (−1)^k e_k x^(d−k), and no e_k is negative. Each prime is a task's
    row. With trace t, e_k is at most binomial(d, k) (t / d)^k, which says how
    many primes are enough."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    sent = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "c": [polynomial_mod(sent.value, int(p)) for p in pdf["p"]]})

    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    coeffs, product = [0] * (d + 1), 1
    for r in sorted(rows.mapInPandas(residues, "p long, c array<long>").collect(), key=lambda r: -r["p"]):
        inverse = pow(product % r["p"], -1, r["p"])
        for k in range(d + 1):
            want = (-1) ** k * r["c"][d - k]
            coeffs[k] += product * ((want - coeffs[k]) * inverse % r["p"])
        product *= r["p"]
    sent.destroy()
    return coeffs


def _above(poly: list[int], at: int, bits: int) -> int:
    """How many roots of ``poly`` (constant term first, all roots real) are
    above at / 2^bits: the changes of sign in the coefficients about it."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int, bits: int) -> int:
    """2^(bits d) times the value at at / 2^bits."""
    total, d = 0, len(poly) - 1
    for k in range(d, -1, -1):
        total = total * at + (poly[k] << (bits * (d - k)))
    return total


def largest_roots(elementary: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The ``most`` largest positive roots, with multiplicity, falling: each as
    (root, how often), to a relative 2^-120. Roots that agree to it count as one."""
    d = len(elementary) - 1
    rank = max((k for k in range(d + 1) if elementary[k]), default=0)
    poly = [(-1) ** k * elementary[k] for k in range(rank, -1, -1)]  # without the roots at 0
    found: list[tuple[Fraction, int]] = []
    if not rank:
        return found
    # Open intervals (low, high], their bits, and the roots above either end; the rightmost is last.
    todo = [(0, elementary[1], 0, rank, 0)]
    while todo and sum(m for _, m in found) < most:
        low, high, bits, n_low, n_high = todo.pop()
        if (n := n_low - n_high) == 0:
            continue
        if high - low == 1 and high.bit_length() > BITS or n == 1 and low:
            if n == 1:
                low, high, bits = _refine(poly, low, high, bits)
            found.append((Fraction(low + high, 2 ** (bits + 1)), n))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        n_middle = _above(poly, middle, bits)
        todo += [(low, middle, bits, n_low, n_middle), (middle, high, bits, n_middle, n_high)]
    return found


def _refine(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """Halve (low, high] with its one root until its ends agree to 2^-120."""
    if _value(poly, high, bits) == 0:
        return high, high, bits
    right = _value(poly, high, bits) > 0
    while (high - low) << BITS > high:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        value = _value(poly, middle, bits)
        if value == 0:
            return middle, middle, bits
        low, high = (low, middle) if (value > 0) == right else (middle, high)
    return low, high, bits


def null_vectors(matrix: list[list[int]], root: Fraction, many: int) -> list[list[float]]:
    """``many`` orthonormal vectors that the matrix less ``root`` takes to
    nearly nothing, by inverse iteration in decimals of 90 digits. Each one's
    entry of largest size is positive."""
    with decimal.localcontext(prec=90) as context:
        d, one = len(matrix), decimal.Decimal(1)
        shift = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
        a = [[decimal.Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        tiny = max((abs(v) for row in a for v in row), default=one) * decimal.Decimal(10) ** -85 or one
        swaps = []
        for k in range(d):
            i = max(range(k, d), key=lambda i: abs(a[i][k]))
            swaps.append(i)
            a[k], a[i] = a[i], a[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            top, inverse = a[k], one / a[k][k]
            for i in range(k + 1, d):
                if a[i][k]:
                    f = a[i][k] = a[i][k] * inverse
                    row = a[i]
                    for j in range(k + 1, d):
                        row[j] -= f * top[j]

        def solve(b: list) -> list:
            for k in range(d):
                b[k], b[swaps[k]] = b[swaps[k]], b[k]
            # Rows were swapped whole, factors with them, so all swaps come first.
            for i in range(d):
                b[i] -= sum((a[i][k] * b[k] for k in range(i)), decimal.Decimal(0))
            for i in range(d - 1, -1, -1):
                b[i] = (b[i] - sum((a[i][k] * b[k] for k in range(i + 1, d)), decimal.Decimal(0))) / a[i][i]
            return b

        def unit(v: list) -> list:
            size = context.sqrt(sum((x * x for x in v), decimal.Decimal(0)))
            return [x / size for x in v]

        out: list[list] = []
        for m in range(many):
            rng = random.Random(m)
            v = [decimal.Decimal(rng.randint(1, 1000)) for _ in range(d)]
            for _ in range(3):
                v = unit(solve(v))
                for w in out:
                    along = sum((x * y for x, y in zip(v, w, strict=True)), decimal.Decimal(0))
                    v = [x - along * y for x, y in zip(v, w, strict=True)]
                v = unit(v)
            out.append(v)
        return [[float(x if max(v, key=abs) > 0 else -x) for x in v] for v in out]


def components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """The largest eigenvalues above 0 of an integer matrix, falling, with unit
    eigenvectors; a task a distinct value."""
    if not matrix:
        return []
    roots = largest_roots(characteristic(spark, matrix), most)
    if not roots:
        return []
    sent = spark.sparkContext.broadcast(matrix)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, null_vectors(sent.value, Fraction(root), int(many))) for k, root, many in zip(pdf["k"], pdf["root"], pdf["many"], strict=True)]
            yield pd.DataFrame(found, columns=["k", "v"])

    rows = spark.createDataFrame([(k, str(root), many) for k, (root, many) in enumerate(roots)], "k int, root string, many int").repartition(len(roots))
    by = {r["k"]: r["v"] for r in rows.mapInPandas(vectors, "k int, v array<array<double>>").collect()}
    sent.destroy()
    return [(root, v) for k, (root, _) in enumerate(roots) for v in by[k]][:most]


def whiten(rows: DataFrame, most: int = 8) -> DataFrame:
    """Per usable row of ``rows`` (``vec_id, embedding``): ``vec_id, n``, its
    ``deviation`` (Σ (n x − S)², exact; null beyond a long), and ``whitened``
    by component; and ``explained`` by component and ``identity_error`` (the
    largest entry of the whitened rows' covariance less the identity), the same
    on all rows.

    x = floor(1024 c) + 100000 for each entry c. There are ``most`` components,
    or as many as the covariance has positive eigenvalues: an eigenvalue of 0
    has no whitened direction. Rows with a null vector, or with entries that
    are null, not finite or of 2^52 and more in size, drop, and so do vectors
    of another than the most frequent length. Null and repeated keys and equal
    vectors are rows of their own; extra columns are ignored. Without usable
    rows, or with equal vectors alone, there is no component, and arrays are
    empty.
    """
    spark = rows.sparkSession
    kept, dims = remaining(rows)
    found = scatter(kept, dims)
    parts = components(spark, found.matrix, most)
    n, sums, trace = found.n, np.array(found.sums, dtype=object), found.trace
    axes = np.array([[x / math.sqrt(root) for x in v] for root, v in parts]).reshape(len(parts), dims)
    safe = all(abs(s) < 2**62 for s in found.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _integers(batch, dims)
            if safe and (int(np.abs(y).max(initial=0)) + SHIFT) * n < 2**62:
                off = n * (y + SHIFT) - sums.astype(np.int64)
            else:
                off = n * (y.astype(object) + SHIFT) - sums
            most_off = int(np.abs(off).max(initial=0))
            squares = (off * off if most_off * most_off * dims < 2**62 else off.astype(object) ** 2).sum(axis=1)
            deviation = [int(v) if v < 2**63 else None for v in squares]
            white = off.astype(np.float64) @ axes.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(axes), pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = dict(kept.dtypes)["vec_id"]
    out = kept.mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>") if dims else kept.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    out = written(out, "whitened")
    error = 0.0
    if parts:
        pairs = [(i, j) for i in range(len(parts)) for j in range(i, len(parts))]
        w = [F.get("whitened", F.lit(i)) for i in range(len(parts))]
        sums_ = out.agg(*[F.sum(w[i] * w[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
        error = max(abs(sums_[f"{i}_{j}"] / n - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(Fraction(root) / trace)) for root, _ in parts]).cast("array<double>")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
