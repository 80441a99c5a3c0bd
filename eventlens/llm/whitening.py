"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventlens.llm.common import settle

#: x is floor(64 * c) + SHIFT.
SHIFT = 1_000_000
#: Entries whose 64-fold is beyond this count as this.
LARGEST = 2.0**62
#: Bits of the limbs whose products are summed in floating point, and rows summed at once: 2 ** (20 + 20 + 12)
#: is below 2 ** 53, so the sums are exact.
LIMB, ROWS = 20, 4096
#: Bits by which roots are isolated, beside those of the trace; digits of the inverse iteration.
FRACTION, DIGITS = 128, 100
MERGES = 32


# -- exact sums over the rows --------------------------------------------------


def vectors(embeddings: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``x``, an array of longs, of the rows whose vectors are whole."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(
        c.cast("double") * 64, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + F.lit(SHIFT))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select(*keep, scaled.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def products(x: np.ndarray) -> np.ndarray:
    """The sum of x x' over the rows of ``x``, in Python's integers: rows are cut into limbs whose products are
    summed exactly in floating point."""
    d = x.shape[1]
    total = np.full((d, d), 0, object)
    for lo in range(0, len(x), ROWS):
        rest, limbs = x[lo:lo + ROWS], []
        while rest.any():
            low = rest & ((1 << LIMB) - 1)
            rest = rest >> LIMB
            if (rest == -1).any():  # keep the sign in the last limb
                low, rest = np.where(rest == -1, low - (1 << LIMB), low), np.where(rest == -1, 0, rest)
            limbs.append(low.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """The number of rows, their sums by dimension and the sums of products, all of x - SHIFT and exact.

    Each task sums its rows; the sums of a dimension are added up in tasks of their own, and one
    row for each dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, prods = 0, np.full(d, 0, object), np.full((d, d), 0, object)
        for batch in batches:
            y = matrix(batch.column("x"), d) - SHIFT
            n += len(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            prods += products(y)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums]),
            pa.array([[str(p) for p in row] for row in prods]),
        ], ["i", "n", "s", "p"])

    def add(table: pa.Table) -> pa.Table:
        rows = [[int(p) for p in row] for row in table["p"].to_pylist()]
        return pa.table([
            table["i"].slice(0, 1), pa.array([sum(table["n"].to_pylist())], pa.int64()),
            pa.array([str(sum(map(int, table["s"].to_pylist())))]), pa.array([[str(sum(c)) for c in zip(*rows)]]),
        ], ["i", "n", "s", "p"])

    form = "i int, n long, s string, p array<string>"
    rows = fit.mapInArrow(run, form).groupBy("i").applyInArrow(add, form).orderBy("i").collect()
    if not rows:
        return 0, [0] * d, np.full((d, d), 0, object)
    return rows[0]["n"], [int(r["s"]) for r in rows], np.array([[int(p) for p in r["p"]] for r in rows], object)


# -- the characteristic polynomial ---------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top``, which is at most 2 ** 31."""
    small = [p for p in range(2, 46_342) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, high = [], top
    while len(found) < count:
        low = high - 100_000
        prime = np.ones(high - low, bool)
        for p in small:
            prime[-low % p::p] = False
        found += [int(low + k) for k in np.flatnonzero(prime)[::-1]]
        high = low
    return found[:count]


def hessenberg(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrices ``a``, each modulo its own prime of ``p``, brought to upper Hessenberg form by similarity."""
    m, d = len(a), a.shape[1]
    every, q = np.arange(m), p[:, None]
    for k in range(1, d - 1):
        pivot = k + (a[:, k:, k - 1] != 0).argmax(axis=1)
        rows = a[every, pivot].copy()
        a[every, pivot], a[:, k] = a[:, k].copy(), rows
        columns = a[every, :, pivot].copy()
        a[every, :, pivot], a[:, :, k] = a[:, :, k].copy(), columns
        inverse = np.array([pow(int(x), -1, int(y)) if x else 0 for x, y in zip(a[:, k, k - 1], p)], np.uint64)
        factor = a[:, k + 1:, k - 1] * inverse[:, None] % q
        a[:, k + 1:] = (a[:, k + 1:] + (q - factor)[:, :, None] * a[:, k:k + 1] % q[:, :, None]) % q[:, :, None]
        for j in range(k + 1, d):  # what the rows lost, the columns get
            a[:, :, k] = (a[:, :, k] + factor[:, j - k - 1, None] * a[:, :, j]) % q
    return a


def polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - a), from the constant one up, modulo each prime, of matrices in Hessenberg form."""
    m, d, q = len(a), a.shape[1], p[:, None]
    polys = [np.zeros((m, d + 1), np.uint64)]
    polys[0][:, 0] = 1
    for k in range(d):
        new = np.zeros((m, d + 1), np.uint64)
        new[:, 1:] = polys[k][:, :-1]
        new = (new + (p - a[:, k, k])[:, None] * polys[k]) % q
        along = np.ones(m, np.uint64)
        for i in range(k - 1, -1, -1):
            along = along * a[:, i + 1, i] % p
            new = (new + ((p - a[:, i, k]) % p * along % p)[:, None] * polys[i]) % q
        polys.append(new)
    return polys[d]


def characteristic(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Coefficients of det(x - scatter), from the constant one up. ``scatter`` has no negative eigenvalue, so the
    signs alternate and no coefficient is greater than (1 + trace / d) ** d: as many primes as that
    takes, each reduced in a task, and Chinese remainders."""
    d, trace = len(scatter), sum(int(scatter[i][i]) for i in range(len(scatter)))
    bits = math.ceil(d * (trace // d + 2).bit_length()) + 1
    primes = primes_below(2**31, bits // 30 + 1)
    text = [[str(v) for v in row] for row in scatter]  # d rows of d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in text], object)
        for batch in batches:
            own = batch.column("p").to_pylist()
            a = np.array([(whole % x).astype(np.uint64) for x in own])
            p = np.array(own, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("p"), pa.array(polynomials(hessenberg(a, p), p).astype(np.int64).tolist())], ["p", "c"])

    tasks = max(1, min(len(primes) // 8, spark.sparkContext.defaultParallelism))
    residues = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(
        run, "p long, c array<long>").collect()
    found, modulus = [0] * (d + 1), 1
    for row in residues:
        p = row["p"]
        inverse = pow(modulus % p, -1, p)
        # coefficients are kept with the sign that they have in the end
        for k, c in enumerate(row["c"]):
            c = c if (d - k) % 2 == 0 else -c
            found[k] += modulus * ((c - found[k]) * inverse % p)
        modulus *= p
    return [c if (d - k) % 2 == 0 else -c for k, c in enumerate(found)]


# -- roots and components --------------------------------------------------------


def roots_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial whose roots are all real are greater than ``at``, multiple ones as often as they
    are: the changes of sign of the coefficients once the roots are moved by ``at``."""
    c = list(poly)
    for lowest in range(len(c) - 1):
        for k in range(len(c) - 2, lowest - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_at(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return value


def greatest_roots(poly: list[int], count: int, highest: int) -> list[tuple[int, int]]:
    """(root, multiplicity) for the ``count`` greatest roots above 0 of an integer polynomial with real roots from 0 to
    ``highest``; each root is given as the first whole number that is not below it.

    Intervals are halved until they hold one root, and then by the sign of the polynomial; an interval of
    length 1 that still holds several is a multiple root."""
    found: list[tuple[int, int]] = []
    waiting = [(0, highest, roots_above(poly, 0), 0)]  # low < root <= high, roots above low and above high
    while waiting and sum(m for _, m in found) < count:
        low, high, above_low, above_high = waiting.pop()
        if above_low == above_high:
            continue
        if high - low == 1:
            found.append((high, above_low - above_high))
            continue
        if above_low - above_high == 1:
            # beyond an odd number of roots, counted from the greatest, the sign turns
            sign = 1 if above_high % 2 == 0 else -1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if sign * value_at(poly, middle) >= 0 else (middle, high)
            found.append((high, 1))
            continue
        middle = (low + high) // 2
        above = roots_above(poly, middle)
        waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def null_vectors(a: np.ndarray, root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors that ``a - root`` brings all but to nothing, by inverse iteration: the matrix
    is factored once, and what a solution has of other components shrinks by each step."""
    d = len(a)
    u = a.copy()
    for i in range(d):
        u[i][i] -= root
    tiny = max(abs(v) for v in a.ravel()).scaleb(-DIGITS)
    order, factors = list(range(d)), []
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(u[i][k]))
        u[[k, pivot]] = u[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        for f in factors:
            f[k], f[pivot] = f[pivot], f[k]
        if abs(u[k][k]) < tiny:
            u[k][k] = tiny
        f = [Decimal(0)] * d
        for i in range(k + 1, d):
            f[i] = u[i][k] / u[k][k]
        factors.append(f)
        if k + 1 < d:
            u[k + 1:, k:] = u[k + 1:, k:] - np.array(f[k + 1:], object)[:, None] * u[k, k:]
    found: list[list[Decimal]] = []
    for start in range(count):
        v = [Decimal(1 + (i * (start + 2) * 7919 + start * 31) % 101) for i in range(d)]
        for _ in range(3):
            v = [v[i] for i in order]
            for k in range(d):
                for i in range(k + 1, d):
                    v[i] -= factors[k][i] * v[k]
            for k in range(d - 1, -1, -1):
                v[k] = (v[k] - sum((u[k][i] * v[i] for i in range(k + 1, d)), Decimal(0))) / u[k][k]
            for w in [*found, *found]:
                share = sum((x * y for x, y in zip(v, w)), Decimal(0))
                v = [x - share * y for x, y in zip(v, w)]
            norm = sum((x * x for x in v), Decimal(0)).sqrt()
            v = [x / norm for x in v]
        found.append(v)
    return found


class Whitening:
    """What is fitted: the number of vectors, their mean, eigenvalues and components; all of the size of a vector."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, roots: list[tuple[int, int]], bits: int, most: int):
        self.n = n
        # the mean as whole + rest / n, of x itself
        self.whole = np.array([s // n + SHIFT for s in sums], object)
        self.rest = np.array([s % n for s in sums], np.int64)
        trace = sum(int(scatter[i][i]) for i in range(len(sums)))
        self.values, self.explained, components = [], [], []
        with decimal.localcontext(decimal.Context(prec=DIGITS)):
            a = np.array([[Decimal(int(v)) for v in row] for row in scatter], object)
            for root, multiplicity in roots:
                count = min(multiplicity, most - len(components))
                for v in null_vectors(a, Decimal(root) / (1 << bits), count):
                    v = [float(x) for x in v]
                    components.append(v if max(v, key=abs) > 0 else [-x for x in v])
                    self.values.append(root / (n * n << bits))
                    self.explained.append(root / (trace << bits))
        self.components = np.array(components).reshape(len(components), len(sums))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Deviations, at most 2 ** 63 - 1, and whitened vectors of the rows of ``x``."""
        far = max((abs(int(v) - int(w)) for v, w in zip([*x.max(axis=0), *x.min(axis=0)], [*self.whole] * 2)), default=0)
        if (far * self.n + self.n) ** 2 * x.shape[1] < 2**63:
            apart = (x - self.whole.astype(np.int64)) * self.n - self.rest
            deviation = (apart * apart).sum(axis=1)
        else:
            apart = (x.astype(object) - self.whole) * self.n - self.rest
            deviation = np.minimum((apart * apart).sum(axis=1), 2**63 - 1).astype(np.int64)
        centred = apart / self.n if apart.dtype != object else np.array([[v / self.n for v in row] for row in apart])
        return deviation, centred.astype(np.float64) @ self.components.T / np.sqrt(np.array(self.values))


def fitted(fit: DataFrame, d: int, most: int) -> Whitening | None:
    """The whitening of the distinct vectors ``fit`` (x); None if nothing varies."""
    n, sums, prods = moments(fit, d)
    scatter = n * prods - np.array(sums, object)[:, None] * np.array(sums, object)[None, :]
    trace = sum(int(scatter[i][i]) for i in range(d))
    if not trace:
        return None
    poly = characteristic(fit.sparkSession, scatter)
    bits = max(0, FRACTION - trace.bit_length()) + 8
    scaled = [c << bits * (d - k) for k, c in enumerate(poly)]  # the roots as multiples of 2 ** -bits
    return Whitening(n, sums, scatter, greatest_roots(scaled, min(most, d), trace << bits), bits, most)


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity. Tasks give counts, means
    and centred products, which are merged in tasks again; ``MERGES`` of them come to the driver."""
    k = len(model.values)

    def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, prods = 0, np.zeros(k), np.zeros((k, k))
        for m, other, own in parts:
            if m:
                apart = other - mean
                prods = prods + own + np.outer(apart, apart) * (n * m / (n + m))
                mean = mean + apart * (m / (n + m))
                n += m
        return n, mean, prods

    def row(part: tuple[int, np.ndarray, np.ndarray]) -> list[pa.Array]:
        return [pa.array([part[0]], pa.int64()), pa.array([part[1].tolist()]), pa.array([part[2].ravel().tolist()])]

    def parts_of(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return ((n, np.array(m), np.array(p).reshape(k, k)) for n, m, p in zip(rows["n"], rows["m"], rows["p"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own():
            for batch in batches:
                w = model(matrix(batch.column("x"), d))[1] if batch.num_rows else np.zeros((0, k))
                mean = w.mean(axis=0) if len(w) else np.zeros(k)
                yield len(w), mean, (w - mean).T @ (w - mean)

        place = pa.array([TaskContext.get().partitionId() % MERGES], pa.int32())
        yield pa.RecordBatch.from_arrays([place, *row(merged(own()))], ["g", "n", "m", "p"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, prods = merged(parts_of(rows))
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "n": [n], "m": [mean.tolist()], "p": [prods.ravel().tolist()]})

    form = "g int, n long, m array<double>, p array<double>"
    rows = fit.mapInArrow(run, form).groupBy("g").applyInPandas(merge, form).toPandas()
    n, _, prods = merged(parts_of(rows))
    return float(np.abs(prods / n - np.eye(k)).max())


def whitened(embeddings: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row and each of the
    ``most`` greatest components.

    The fit is on distinct vectors: exact integer sums, n times the sum of products less the product of sums, and
    the characteristic polynomial of this scatter by Hessenberg forms modulo primes and Chinese remainders.
    Its greatest roots are isolated by counting sign changes, and components solve for its null spaces.
    Repeated eigenvalues have orthonormal components; which, is as good as any other.

    Null vectors and those with null or non-finite entries have no row; nor have vectors of another length than most
    have (of equally frequent lengths the greater one counts). Entries beyond 2 ** 62 / 64 count as that, deviations
    beyond 64 bits as 2 ** 63 - 1. Components of eigenvalue zero cannot be whitened and have no row, so there is none at
    all for an empty table, or one with a single distinct vector. Repeated rows and null ids are rows of
    their own. Other columns are not looked at."""
    form = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = vectors(embeddings, F.col("vec_id").cast("long").alias("vec_id"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    fit = settle(rows.where(F.size("x") == d).select("x").distinct()) if d else None
    model = fitted(fit, d, most) if d else None
    if model is None:
        return spark.createDataFrame([], form)
    error, k = identity_error(fit, d, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.num_rows
                deviation, white = model(matrix(batch.column("x"), d))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(deviation, k)), pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(run, form)
