"""Whitening of embeddings along the leading components of their covariance.

Vectors are rounded to whole numbers, so that sums over them are exact.  Spark makes the distinct vectors, their sums
and the covariance; what comes to the driver is one number per two dimensions, however many rows there are.  Its
eigenvalues are found by contour integration: counts from the inertia of shifted covariances cut the spectrum into
intervals, the quadrature of complex shifted solves projects random vectors onto the eigenvectors of each interval,
Rayleigh-Ritz steps extract them, and an interval is done when as many came out as its inertia counts say.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.session import passing_folder, stage

COMPONENTS = 4
SCALE = 256
LARGEST = float(2**55)  # entries from here on have no whole number of 64 bits
NODES = 8  # of the quadrature on the half circle
PER_INTERVAL = 16  # eigenvalues of an interval, unless they lie closer than can be told apart
ROUNDS = 40
SEED = 23
VECTORS_PER_BATCH = 4096


# ---- eigenvalues of a symmetric matrix


def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are below and above zero.

    Symmetric elimination with pivots of one or two rows keeps both numbers; a pivot of two rows has one of either sign.
    """
    a = np.array(matrix, np.float64)
    below = above = 0
    tiny = np.finfo(float).eps * np.abs(a).max(initial=0.0) * len(a)
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        p = int(diagonal.argmax())
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[p], off[r, s]) <= tiny * 1e-3:
            break
        if diagonal[p] >= 0.64 * off[r, s]:  # the bound that keeps the elimination stable
            pivot = [p]
            below, above = below + (a[p, p] < 0), above + (a[p, p] > 0)
        else:
            pivot = [r, s]
            below, above = below + 1, above + 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(below), int(above)


def _above(matrix: np.ndarray, shift: float) -> int:
    return inertia(matrix - shift * np.eye(len(matrix)))[1]


def intervals(matrix: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, count)`` from the top that hold at least the ``wanted`` largest eigenvalues."""
    bound = float(np.abs(matrix).sum(axis=1).max())
    top, floor = bound * 1.01 + np.finfo(float).tiny, -bound * 0.01 - np.finfo(float).tiny
    width = bound * np.finfo(float).eps * 4
    counts = {top: 0, floor: len(matrix)}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = _above(matrix, shift)
        return counts[shift]

    def end_below(rank: int) -> tuple[float, int]:
        """A shift with this many eigenvalues above it, or with the fewest more where equal ones lie at that rank."""
        low, high = floor, top
        while above(low) != rank and high - low > width:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= rank else (low, middle)
        return low, above(low)

    found, high, done = [], top, 0
    while done < wanted:
        low, held = end_below(min(done + most, wanted))
        found.append((low, high, held - done))
        high, done = low, held
    return found


def eigenvectors_inside(matrix: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, and their vectors."""
    size = len(matrix)
    width = min(size, max(2 * count, count + 8))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi * (nodes + 1) / 2
    points = centre + radius * np.exp(1j * angles)
    tolerance = np.finfo(float).eps * size * max(np.abs(matrix).sum(axis=1).max(), np.finfo(float).tiny)
    start = rng.normal(size=(size, width))
    while True:
        best = np.inf
        for _ in range(ROUNDS):
            projected = np.zeros_like(start)
            for point, angle, weight in zip(points, angles, weights):
                solved = np.linalg.solve(point * np.eye(size) - matrix, start.astype(complex))
                projected += weight / 2 * radius * (np.exp(1j * angle) * solved).real
            basis, _ = np.linalg.qr(projected)
            small = basis.T @ matrix @ basis
            values, turned = np.linalg.eigh((small + small.T) / 2)
            start = basis @ turned
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                residual = np.abs(matrix @ start[:, inside] - start[:, inside] * values[inside]).max()
                if residual <= tolerance or (residual >= best / 2 and best <= 64 * tolerance):
                    return values[inside][::-1], start[:, inside][:, ::-1]
                best = min(best, residual)
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} were not found")
        width = min(size, 2 * width)
        start = np.hstack([start, rng.normal(size=(size, width - start.shape[1]))])


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix without negative ones, falling, and unit vectors as columns.

    Fewer where the others are zero, as far as double precision can tell.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.empty(0), np.empty((size, 0))
    plain, rng = matrix / scale, np.random.default_rng(SEED)
    found = [eigenvectors_inside(plain, *part, rng) for part in intervals(plain, min(wanted, size)) if part[2]]
    # A last step over all intervals makes vectors of neighbouring ones orthogonal.
    basis, _ = np.linalg.qr(np.hstack([vectors for _, vectors in found]))
    small = basis.T @ plain @ basis
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1][:wanted], (basis @ turned)[:, ::-1][:, :wanted]
    real = values > np.finfo(float).eps * size * values[0] * 8
    return values[real] * scale, vectors[:, real]


# ---- sums over the vectors


def _whole(vector: Column) -> Column:
    """The vector as whole numbers; null if an entry is null, not finite or too large."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(entry, lambda c: F.floor(c * SCALE)))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dimensions)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, VECTORS_PER_BATCH):
            yield batch.slice(begin, VECTORS_PER_BATCH)


def _sums(fit: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of every dimension."""

    def partial(batches):
        rows, sums = 0, np.zeros(dimensions, object)
        for part in _slices(batches):
            x = _matrix(part.column(0), dimensions)
            rows += len(x)
            # Halves of 32 bits can't overflow in a slice.
            sums = sums + ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        places = pa.array(range(-1, dimensions), pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([Decimal(int(v)) for v in (rows, *sums)], pa.decimal128(38, 0))], names=["place", "total"])

    found = fit.mapInArrow(partial, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    totals = {row.place: int(row.total) for row in found.collect()}  # one row per dimension
    return totals.get(-1, 0), [totals.get(i, 0) for i in range(dimensions)]


def _means(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of every dimension: its whole part and what is left."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums], np.float64)


def _moments(fit: DataFrame, dimensions: int, centred, width: int) -> np.ndarray:
    """The mean over ``fit`` of the products of every two of the ``width`` numbers that ``centred`` makes of a vector.

    A task adds up its vectors; the upper halves of its sums are added by pairs of dimensions.
    """
    upper = np.triu_indices(width)

    def partial(batches):
        rows, sums = 0, np.zeros((width, width))
        for part in _slices(batches):
            y = centred(_matrix(part.column(0), dimensions))
            rows += len(y)
            sums += y.T @ y
        if rows:
            columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(sums[upper]), pa.array(np.full(len(upper[0]), rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "total", "rows"])

    found = fit.mapInArrow(partial, "i int, j int, total double, rows bigint").groupBy("i", "j")
    result = np.zeros((width, width))
    for row in found.agg((F.sum("total") / F.sum("rows")).alias("mean")).toLocalIterator():  # one row per two dimensions
        result[row.i, row.j] = result[row.j, row.i] = row["mean"]
    return result


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of every vector, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest**2 * x.shape[1] < 2**63:
        y = x * n - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return (y * y).sum(axis=1).tolist()


def whiten(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    An entry c counts as x = floor(256 c).  The distinct x-vectors, n of them with sums S, are what components are
    fitted to; every row, copies too, gets its values.  ``deviation`` is the exact sum of (n x - S)^2 over the
    dimensions, null where it has more than 38 digits.  ``identity_error`` is measured in a pass of its own over the
    distinct vectors.

    Rows whose vector is null or empty, or holds an entry that is null, not finite or 2^55 and more, are left out, and so
    are vectors of another length than the most frequent one (of several, the longest).  Null ids stay.  Components without
    any spread (fewer distinct vectors than dimensions) have no rows; one distinct vector or an empty table give none.
    Equal eigenvalues share a space in which any basis may come.  Other columns are not read.
    """
    plain = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), _whole(F.col(f"`{vector}`")).alias("x")).where(F.size("x") > 0)
    schema = (
        f"vec_id {plain.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), "
        "whitened double, explained double, identity_error double"
    )
    lengths = plain.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dimensions = lengths["size"]
    plain = plain.where(F.size("x") == dimensions)
    with passing_folder(vectors.sparkSession, "whitening") as folder:
        # Copies are dropped where they are read, before the distinct vectors are dealt out.
        fit = stage(plain.select("x").distinct(), "fit", folder=folder)
        n, sums = _sums(fit, dimensions)
        whole, part = _means(n, sums)

        def centred(x: np.ndarray) -> np.ndarray:
            return (x - whole) - part

        covariance = _moments(fit, dimensions, centred, dimensions)
        values, axes = leading_components(covariance, components)
        if not len(values):
            return vectors.sparkSession.createDataFrame([], schema)
        explained = values / np.trace(covariance)
        turn = axes / np.sqrt(values)

        def whitened(x: np.ndarray) -> np.ndarray:
            return centred(x) @ turn

        error = float(np.abs(_moments(fit, dimensions, whitened, len(values)) - np.eye(len(values))).max())

    def rows(batches):
        kept = len(values)
        for batch in _slices(batches):
            x = _matrix(batch.column(1), dimensions)
            deviations = [Decimal(d) if d < 10**38 else None for d in _deviations(x, n, sums)]
            many = pa.array(np.repeat(np.arange(len(x)), kept))
            columns = [
                batch.column(0).take(many),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * kept, n, np.int64)),
                pa.array(deviations, pa.decimal128(38, 0)).take(many),
                pa.array(whitened(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return plain.mapInArrow(rows, schema)
