"""Whitened embeddings: principal components from the exact characteristic polynomial of an integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm.tables import in_batches
from variorum.session import stage

#: A coordinate c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb that sums of products are split in, and limbs of such a sum.
LIMB, LIMBS = 32, 6
#: Primes for one task of the modular reduction.
PRIMES_A_TASK = 16
#: Bits of a root behind the leading bit of the matrix, and decimal digits of the inverse iteration.
ROOT_BITS, DIGITS = 160, 90

WIDE = "vec_id long, deviation long, whitened array<double>"


# ---- sums over all rows --------------------------------------------------------------------------------


def fit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and xs (longs without OFFSET, which no scatter or deviation depends on) of the rows that count."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & whole).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("xs")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a batch as rows of one array; all of them are equally long."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def products(xs: np.ndarray) -> list[list[int]]:
    """Exact sums of products of each two columns, whatever their size.

    Sums below 2**53 are exact in float64; larger entries are cut into 16-bit limbs first.
    """
    d = xs.shape[1]
    top = max(int(xs.max(initial=0)), -int(xs.min(initial=0)))
    if top * top * len(xs) < 1 << 53:
        held = xs.astype(np.float64)
        return [[int(v) for v in row] for row in (held.T @ held).tolist()]
    total = np.zeros((d, d), object)
    for low in range(0, len(xs), 1 << 20):
        part = xs[low : low + (1 << 20)]
        limbs = [((part >> (16 * k)) & 0xFFFF if k < 3 else part >> 48).astype(np.float64) for k in range(4)]
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                held = (left.T @ right).astype(np.int64).astype(object)
                total = total + held * (1 << (16 * (a + b)))
    return total.tolist()


def limbs(value: int) -> list[int]:
    """LIMBS parts of LIMB bits, the last with the sign; sums of parts are parts of the sum."""
    out = [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, value >> (LIMB * (LIMBS - 1))]


@dataclass
class Fit:
    """n, column sums and sums of products of the fit list, as exact integers."""

    n: int
    sums: list[int]
    products: list[list[int]]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def scatter(self) -> list[list[int]]:
        """n squared times the covariance, exactly."""
        d = self.dim
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]


def fit_sums(rows: DataFrame) -> Fit:
    """Each task adds up its rows; parts of its sums go through one small aggregate keyed by place in the matrix.

    What comes to the driver is LIMBS numbers for each place of the matrix, whatever the number of rows.
    """
    names = [f"p{k}" for k in range(LIMBS)]

    def make():
        held: list = []

        def work(batch: pa.RecordBatch | None) -> Iterator[list]:
            if batch is None:
                if held:
                    d = len(held[1])
                    cells = [(-1, -1, held[0]), *((-1, i, held[1][i]) for i in range(d))]
                    cells += [(i, j, held[2][i][j]) for i in range(d) for j in range(i + 1)]
                    yield [list(c) for c in zip(*((i, j, *limbs(v)) for i, j, v in cells))]
                return
            xs = matrix(batch.column(0))
            with_one = np.hstack([xs, np.ones((len(xs), 1), np.int64)])
            found = products(with_one)
            if not held:
                held.extend([0, [0] * xs.shape[1], [[0] * xs.shape[1] for _ in range(xs.shape[1])]])
            d = xs.shape[1]
            held[0] += len(xs)
            held[1] = [a + b for a, b in zip(held[1], found[d][:d])]
            held[2] = [[a + b for a, b in zip(old, new)] for old, new in zip(held[2], found)]

        return work

    schema = ", ".join(["i int", "j int", *(f"{n} long" for n in names)])
    cells = in_batches(rows.select("xs"), schema, make, last=True)
    totals = cells.groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in names)).collect()
    at = {(r.i, r.j): sum(r[n] << (LIMB * k) for k, n in enumerate(names)) for r in totals}
    if not at:
        return Fit(0, [], [])
    d = max(j for _, j in at) + 1
    return Fit(
        at[-1, -1], [at[-1, i] for i in range(d)], [[at[max(i, j), min(i, j)] for j in range(d)] for i in range(d)]
    )


# ---- the characteristic polynomial ---------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller's test; these bases decide for all n below 3.2e9 (a fixed result)."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return n in (3, 5, 7)
    return True


def primes_below(top: int, bits: int) -> list[int]:
    """The largest primes below `top` whose product has more than `bits` bits."""
    out, n, held = [], top, 0.0
    while held <= bits + 1:
        n -= 1
        if is_prime(n):
            out.append(n)
            held += math.log2(n)
    return out


def polynomials_mod(scatter: list[list[int]], primes: list[int]) -> np.ndarray:
    """Characteristic polynomial modulo each prime (below 2**31), lowest coefficient first, all primes side by side.

    The matrix is brought to Hessenberg form by eliminations, each undone on the other side; then the
    polynomials of its leading blocks follow from one another.
    """
    p = np.array(primes, np.int64)[:, None]
    a = np.stack([np.array([[v % q for v in row] for row in scatter], np.int64) for q in primes])
    count, d = len(primes), len(scatter)
    every = np.arange(count)
    for k in range(d - 2):
        # The pivot below the diagonal: the first entry that is not zero, apart for each prime.
        below = a[:, k + 1 :, k] != 0
        pivot = np.argmax(below, 1) + k + 1
        here = below.any(1)
        swap = a[every, pivot].copy()
        a[every, pivot] = a[:, k + 1]
        a[:, k + 1] = swap
        swap = a[every, :, pivot].copy()
        a[every, :, pivot] = a[:, :, k + 1]
        a[:, :, k + 1] = swap
        inverse = np.array([pow(int(v), -1, int(q)) if ok else 0 for v, q, ok in zip(a[:, k + 1, k], p[:, 0], here)])
        factor = a[:, k + 2 :, k] * inverse[:, None] % p
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1][:, None, :] % p[:, :, None]) % p[:, :, None]
        moved = np.zeros((count, d), np.int64)
        for row in range(d - k - 2):  # sums of products below 2**62 are reduced one by one
            moved = (moved + a[:, :, k + 2 + row] * factor[:, row][:, None]) % p
        a[:, :, k + 1] = (a[:, :, k + 1] + moved) % p
    chain = [np.ones((count, 1), np.int64)]
    for k in range(d):
        last = chain[-1]
        new = np.zeros((count, k + 2), np.int64)
        new[:, 1:] = last
        new[:, :-1] = (new[:, :-1] - a[:, k, k][:, None] * last % p) % p
        down = np.ones((count, 1), np.int64)
        for i in range(k - 1, -1, -1):
            down = down * a[:, i + 1, i][:, None] % p
            held = chain[i]
            new[:, : i + 1] = (new[:, : i + 1] - down * a[:, i, k][:, None] % p * held % p) % p
        chain.append(new)
    return chain[-1]


def coefficient_bits(scatter: list[list[int]]) -> int:
    """No coefficient has more bits: each is a sum of products of eigenvalues, none of them over the trace."""
    trace = sum(scatter[i][i] for i in range(len(scatter)))
    return len(scatter) * (trace.bit_length() + 1) + 2


def characteristic(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Coefficients of det(x - scatter), lowest first: residues from tasks, joined by Chinese remainders."""
    primes = primes_below(1 << 31, coefficient_bits(scatter))
    tasks = max(1, -(-len(primes) // PRIMES_A_TASK))
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(primes)], "k int, prime long")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            own = batch.column(1).to_pylist()
            for at in range(0, len(own), PRIMES_A_TASK):
                part = own[at : at + PRIMES_A_TASK]
                found = polynomials_mod(scatter, part)
                yield [part, pa.array(found.tolist(), pa.list_(pa.int64()))]

        return work

    residues = in_batches(
        rows.repartitionByRange(tasks, "k").select("k", "prime"), "prime long, coefficients array<long>", make
    ).collect()
    modulus, joined = 1, [0] * (len(scatter) + 1)
    for r in residues:
        inverse = pow(modulus, -1, r.prime)
        joined = [
            x + modulus * ((int(c) - x) * inverse % r.prime) for x, c in zip(joined, r.coefficients)
        ]
        modulus *= r.prime
    return [x - modulus if 2 * x > modulus else x for x in joined]


# ---- roots and components ------------------------------------------------------------------------------


def shifted(poly: list[int], by: int) -> list[int]:
    """Coefficients of poly(x + by)."""
    out = list(poly)
    for k in range(len(out) - 1):
        for i in range(len(out) - 2, k - 1, -1):
            out[i] += by * out[i + 1]
    return out


def roots_above(poly: list[int], at: int) -> int:
    """How many roots lie above `at`, copies counted: with only real roots, just the changes of sign."""
    signs = [c > 0 for c in shifted(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are those of `poly` times 2**bits."""
    n = len(poly) - 1
    return [c << (bits * (n - k)) for k, c in enumerate(poly)]


def largest_roots(poly: list[int], k: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """(low, bits, copies) of the largest roots, k of them with copies: each lies in (low, low + 1] / 2**bits.

    Positive roots only. Halving splits (low, high] until it holds roots that lie within one unit of the
    last place, by exact counts of roots above a point; a lone root is halved on by its sign alone.
    """
    top = 1
    while roots_above(poly, top):
        top <<= 1
    bits = max(0, bits - top.bit_length())
    fine = scaled(poly, bits)
    out: list[tuple[int, int, int]] = []
    positive = roots_above(fine, 0)
    # (low, high, roots above low, roots above high), the largest interval on top
    open_ = [(0, top << bits, positive, 0)] if positive else []
    while open_ and sum(c for _, _, c in out) < k:
        low, high, over_low, over_high = open_.pop()
        if over_low == over_high:
            continue
        if over_low - over_high == 1:
            low, high = halved(fine, low, high)
        if high - low == 1:
            out.append((low, bits, over_low - over_high))
            continue
        middle = (low + high) // 2
        over = roots_above(fine, middle)
        open_ += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return out


def value(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


def halved(poly: list[int], low: int, high: int) -> tuple[int, int]:
    """The unit interval (low, low + 1] with the one root of (low, high]."""
    above = value(poly, high) > 0
    if not value(poly, high):
        return high - 1, high
    while high - low > 1:
        middle = (low + high) // 2
        found = value(poly, middle)
        if not found:
            return middle - 1, middle
        if (found > 0) == above:
            high = middle
        else:
            low = middle
    return low, high


def solved(a: np.ndarray, right: np.ndarray) -> np.ndarray:
    """a x = right by elimination with pivots, on Decimals; a pivot of zero counts as next to nothing."""
    a, x = a.copy(), right.copy()
    d = len(a)
    tiny = max(abs(v) for v in a.flat) * Decimal(10) ** (-2 * DIGITS) or Decimal(1)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]], x[[k, pivot]] = a[[pivot, k]], x[[pivot, k]]
        if not a[k, k]:
            a[k, k] = tiny
        factor = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= np.multiply.outer(factor, a[k, k:])
        x[k + 1 :] -= np.multiply.outer(factor, x[k])
    for k in range(d - 1, -1, -1):
        x[k] = x[k] / a[k, k]
        x[:k] -= np.multiply.outer(a[:k, k], x[k])
    return x


def orthonormal(vectors: np.ndarray) -> np.ndarray:
    """The columns, each less its parts along those before, of length one."""
    out = vectors.copy()
    for k in range(out.shape[1]):
        for _ in range(2):
            for j in range(k):
                out[:, k] = out[:, k] - (out[:, j] * out[:, k]).sum() * out[:, j]
        out[:, k] = out[:, k] / (out[:, k] * out[:, k]).sum().sqrt()
    return out


def null_space(scatter: list[list[int]], root: tuple[int, int, int], rounds: int = 3) -> list[list[float]]:
    """Unit vectors that span the null space of scatter - root, by inverse iteration; as many as the root has copies."""
    low, bits, copies = root
    with localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = DIGITS, 10**9, -(10**9)
        at = Decimal(2 * low + 1) / Decimal(1 << (bits + 1))
        d = len(scatter)
        held = np.array([[Decimal(v) for v in row] for row in scatter], object)
        for i in range(d):
            held[i, i] -= at
        draw = np.random.default_rng(13)
        start = np.array([[Decimal(int(v)) for v in row] for row in draw.integers(1, 1000, (d, copies))], object)
        found = orthonormal(start)
        for _ in range(rounds):
            found = orthonormal(solved(held, found))
        return [[float(v) for v in found[:, k]] for k in range(copies)]


@dataclass
class Components:
    """Eigenvalues of the covariance, as (double, share of the trace), and unit vectors, largest first."""

    values: list[float]
    shares: list[float]
    vectors: list[list[float]]


def components(spark: SparkSession, fit: Fit, k: int = COMPONENTS) -> Components:
    """The `k` largest components with a positive eigenvalue (fewer where the vectors span fewer dimensions)."""
    out = Components([], [], [])
    if not fit.n:
        return out
    scatter = fit.scatter()
    trace = sum(scatter[i][i] for i in range(fit.dim))
    if not trace:
        return out
    poly = characteristic(spark, scatter)
    for root in largest_roots(poly, k):
        low, bits, _ = root
        for vector in null_space(scatter, root):
            # The middle of the unit interval, over n squared, in one division of integers.
            out.values.append((2 * low + 1) / (fit.n * fit.n << (bits + 1)))
            out.shares.append((2 * low + 1) / (trace << (bits + 1)))
            out.vectors.append(vector)
    return Components(out.values[:k], out.shares[:k], out.vectors[:k])


# ---- whitening -----------------------------------------------------------------------------------------


def deviations(centred: np.ndarray | list[list[int]]) -> list[int | None]:
    """Sums of squares of each row; None where a sum is no long."""
    if isinstance(centred, np.ndarray):
        return (centred * centred).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in centred]
    return [s if s < 1 << 63 else None for s in sums]


def projected(rows: DataFrame, fit: Fit, found: Components) -> DataFrame:
    """WIDE: each row less the mean, on each component, over the root of its eigenvalue."""
    n, sums, d = fit.n, fit.sums, fit.dim
    weights = np.array(found.vectors, np.float64).T / np.sqrt(np.array(found.values, np.float64))

    def make():
        small = max(map(abs, sums), default=0) < 1 << 61

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            xs = matrix(batch.column(1))
            top = max(int(xs.max(initial=0)), -int(xs.min(initial=0)))
            centred = n * xs - np.array(sums, np.int64) if small and n * top < 1 << 61 else None
            if centred is not None and d * max(int(centred.max()), -int(centred.min())) ** 2 < 1 << 63:
                away, part = deviations(centred), centred / float(n)
            else:
                exact = [[n * int(x) - s for x, s in zip(row, sums)] for row in xs]
                away, part = deviations(exact), np.array([[v / n for v in row] for row in exact])
            yield [batch.column(0), away, pa.array((part @ weights).tolist(), pa.list_(pa.float64()))]

        return work

    return in_batches(rows.select("vec_id", "xs"), WIDE, make)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the covariance of the whitened columns less the identity; means first, then centred products."""
    at = [F.col("whitened")[a] for a in range(k)]
    means = whitened.agg(*(F.avg(w).alias(f"m{a}") for a, w in enumerate(at))).first()
    centred = [w - F.lit(m) for w, m in zip(at, means)]
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    found = whitened.agg(*(F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))


def whitened_rows(
    vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row for each vector that counts and each component up to `k`: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Left out are vectors that are null or empty, that hold a null or an infinite entry or no number, and that
    are not as long as most (of two lengths as common, the greater stays). Repeated rows and null ids count as
    rows. Components with an eigenvalue of zero can't be whitened and are left out, so equal vectors, or a
    single one, give no rows, nor do no rows. Of equal eigenvalues any unit vectors that span them come out,
    the same for all rows. A deviation that is no long is null.

    Sums are exact integers. They, one polynomial's residues, and means and covariances of `k` columns are all
    that reaches the driver: their number depends on the length of the vectors alone. Nothing is shuffled but
    the tasks' sums.
    """
    spark = vectors.sparkSession
    rows = fit_rows(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("xs").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("xs") == common.d)
    fit = fit_sums(rows)
    found = components(spark, fit, k)
    if not found.values:
        return spark.createDataFrame([], schema)
    wide = stage(projected(rows, fit, found), "whitened")
    error = identity_error(wide, len(found.values))
    shares = F.array(*map(F.lit, found.shares))
    each = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
