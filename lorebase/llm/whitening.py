"""Whitening of embeddings by the leading eigenvectors of their exact covariance.

An entry c becomes the whole number x = floor(64 c) + 1,000,000. Three statistics are summed by
Spark, each as one narrow row for a dimension and task, added up by dimension: the sums S; the
products of the entries centred at the whole part of their mean; and, of the result, the
covariance of the whitened coordinates. Products of centred whole numbers are added as whole
numbers, and the mean's fraction is settled at the end, so V is exact up to its rounding to
doubles and does not depend on how rows were dealt or on tasks that ran twice.

The driver holds V alone, d by d for d dimensions however many rows there are. Householder
reflections make it tridiagonal, bisection with Sturm counts finds the leading eigenvalues,
inverse iteration their vectors; vectors of one cluster of eigenvalues are orthogonalised
against each other in every step. The components (at most ``COMPONENTS`` times d doubles) are
broadcast, and every row is projected in its task.

Rows whose vector is null or empty, or has null or non-finite entries, are dropped. The space
is that of the vectors' most frequent number of entries (of several, the largest); vectors of
another length do not belong to it and are dropped too. Entries beyond the range of whole
numbers count as the nearest end of +-2^61; a ``deviation`` beyond 64 bits is null. Components
are those whose variance exceeds what rounding leaves; others have ``whitened`` null, and
``explained`` is null if there is no variance at all. Repeated rows give repeated results, a
null vec_id stays null, other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import partitions, written

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Numbers of a slice of rows that are worked on together.
SLICE = 1 << 21
#: Eigenvalues nearer to each other than this share of the largest are one cluster.
CLUSTER = 1e-3
_MOST = float(1 << 61)
_EPS = np.finfo(np.float64).eps


def valid(vector: Column) -> Column:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def whole_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, vector (array of doubles) of the rows that take part, and their number of entries."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(valid(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = sizes["d"] if sizes else 0
    return rows.filter(F.size("vector") == size), size


def _slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, x) of slices of a batch."""
    every = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    step = max(1, SLICE // size)
    for first in range(0, len(every), step):
        part = every[first : first + step]
        yield first, first + len(part), np.clip(np.floor(SCALE * part), -_MOST, _MOST).astype(np.int64) + SHIFT


def _sums(x: np.ndarray) -> np.ndarray:
    small = float(np.abs(x).max(initial=0)) * len(x) < 2.0**62
    return x.sum(axis=0).astype(object) if small else x.sum(axis=0, dtype=object)


def _product(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers of any size: by doubles where these hold every partial sum."""
    if not len(y):
        return np.zeros((y.shape[1], y.shape[1]), object)
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0**53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    far = np.abs(y).max(axis=1) >= 1 << 20
    if far.all():
        z = y.astype(object)
        return z.T @ z
    if far.any():
        return _product(y[~far]) + _product(y[far])
    half = len(y) // 2
    return _product(y[:half]) + _product(y[half:])


def added(parts: DataFrame) -> dict[int, list[int]]:
    """The sums by ``part`` of rows (part, numbers as strings); as many rows as parts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.array([int(x) for x in numbers], object)
                total[part] = total[part] + now if part in total else now
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([[str(x) for x in v] for v in total.values()], pa.list_(pa.string()))], ["part", "numbers"]
        )

    dealt = parts.repartition(partitions(parts.sparkSession), "part")
    return {r["part"]: [int(x) for x in r["numbers"]] for r in dealt.mapInArrow(run, parts.schema).collect()}


def _partial(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, numbers): for each task, the lines of the summed matrices ``of`` its slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, x in _slices(batch.column(0), size):
                now = of(x)
                total = now if total is None else total + now
        for part, line in enumerate(total if total is not None else ()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([[str(v) for v in line]], pa.list_(pa.string()))], ["part", "numbers"]
            )

    return rows.select("vector").mapInArrow(run, "part int, numbers array<string>")


def moments(rows: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and the covariance of the rows' x; the entries are centred before they are multiplied."""
    sums = added(_partial(rows, size, lambda x: np.vstack([_sums(x), np.full(size, len(x), object)]).T))
    if not sums:
        return 0, [0] * size, np.zeros((size, size))
    n, s = sums[0][1], [sums[i][0] for i in range(size)]
    centre = np.array([v // n for v in s], np.int64)
    products = added(_partial(rows, size, lambda x: _product(x - centre)))
    rest = [v - n * int(c) for v, c in zip(s, centre, strict=True)]  # sums of the centred entries: 0 .. n - 1
    return n, s, np.array([[(n * products[i][j] - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)], np.float64)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and Householder vectors of the symmetric matrix v."""
    a, mirrors = v.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if np.abs(x[1:]).max(initial=0.0) == 0.0 or norm == 0.0:
            continue
        u = x.copy()
        u[0] += np.copysign(norm, x[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, k:] -= 2.0 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ u, u)
        mirrors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues below each shift: negative pivots of T - shift."""
    tiny = np.finfo(np.float64).tiny / _EPS
    q = diagonal[0] - shifts
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - shifts - e * (e / q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection down to neighbouring doubles."""
    reach = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    low, high = low - np.abs(low) * _EPS * 4 - 1e-300, high + np.abs(high) * _EPS * 4 + 1e-300
    place = len(diagonal) - 1 - np.arange(k)  # so many eigenvalues are smaller
    for _ in range(1100):
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        below = sturm_count(diagonal, off, middle) > place
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of (T - shift) x = b by elimination with row exchanges; pivots are at least ``least``."""
    n = len(diagonal)
    a, b, c = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    below = off.tolist()
    steps = []
    for i in range(n - 1):
        swap = abs(below[i]) > abs(a[i])
        if swap:
            a[i], below[i] = below[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], c[i]
        if abs(a[i]) < least:
            a[i] = least
        factor = below[i] / a[i]
        a[i + 1] -= factor * b[i]
        b[i + 1] -= factor * c[i]
        steps.append((swap, factor))
    if abs(a[-1]) < least:
        a[-1] = least

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                x[i] -= b[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= c[i] * x[i + 2]
            x[i] /= a[i]
        return np.array(x)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of T, one in a column for each of the falling eigenvalues."""
    n, largest = len(diagonal), max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(1)
    found = np.empty((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * largest:
            first = k
        # Equal eigenvalues are moved apart by roundings, so that their solvers differ.
        solve = _solved(diagonal, off, value - (k - first) * 2 * _EPS * largest, _EPS * largest)
        x = rng.uniform(-1.0, 1.0, n)
        for _ in range(6):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[:, first:k] @ (found[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        found[:, k] = x
    return found


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of v, falling, and their unit vectors in columns; a vector's largest entry is positive."""
    scale = np.abs(v).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diagonal, off, mirrors = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for first, u in reversed(mirrors):
        vectors[first:] -= 2.0 * np.outer(u, u @ vectors[first:])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * scale, vectors


def _deviations(n: int, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """n x - S, as doubles, and the sums of its squares over the dimensions, in whole numbers."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**61 and max(map(abs, s.tolist()), default=0) < 1 << 61:
        apart = n * x - s.astype(np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return apart.astype(np.float64), (apart * apart).sum(axis=1).tolist()
        apart = apart.astype(object)
    else:
        apart = n * x.astype(object) - s
    squares = [int(q) for q in (apart * apart).sum(axis=1)]
    return apart.astype(np.float64), [q if q < 1 << 63 else None for q in squares]


def project(rows: DataFrame, size: int, n: int, s: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation, z: the whitened coordinates of every row."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((n, s, vectors / np.sqrt(values)))  # size x COMPONENTS doubles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, axes = sent.value
        sums = np.array(sums, object)
        for batch in batches:
            for first, last, x in _slices(batch.column(1), size):
                apart, squares = _deviations(count, x, sums)
                z = (apart / count) @ axes
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(squares, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel())),
                    ],
                    ["vec_id", "deviation", "z"],
                )

    return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, deviation bigint, z array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of z minus the identity; null without components."""
    if not k:
        return None
    means = np.zeros(k)
    for row in projected.select(F.posexplode("z").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        means[row["i"]] = row["v"] / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - means
            total += z.T @ z
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    entries = projected.select("z").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / n).alias("v"))
    return entries.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows, size = whole_vectors(vectors)
    k = min(components, size)
    n, s, v = moments(rows, size) if size else (0, [], np.zeros((0, 0)))
    if not n:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        )
    values, axes = leading_components(v, k)
    real = int((values > size * _EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    projected = written(project(rows, size, n, s, values[:real], axes[:, :real]), "whitened")
    error = identity_error(projected, n, real)
    trace = float(np.trace(v))
    shares = F.array(*[F.lit(max(float(e), 0.0) / trace if trace > 0 else None).cast("double") for e in values])
    number = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return projected.select("vec_id", "deviation", "z", number.alias("_at")).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.get("z", F.col("_at")).alias("whitened"), F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
