"""Whitening of embeddings on principal components found by FEAST contour integration.

The covariance of the distinct integer vectors is summed exactly over tasks: vectors are centred by the
rounded mean, their products are added as integers, and the rest of the centring is an exact correction, so
the matrix does not depend on partitioning. The matrix, as large as the dimension squared, is the only
thing the driver sees. There inertia counts (signs of the pivots of a symmetric factorisation) cut the
spectrum into intervals with a known number of eigenvalues; for each one a quadrature of complex shifted
solves along a circle projects random vectors onto its eigenvectors, and Rayleigh-Ritz extracts them. An
interval is accepted when as many Ritz pairs lie in it as the inertia says and their residuals vanish.

Rows whose vector is null or holds a null, NaN or infinity have no result. Vectors of another length than the
most frequent one (of ties the smaller) are outside the fit; their rows carry nulls. A component without
variance has explained and whitened 0 and no part in identity_error. Null ids and repeated rows give a row
per row and component; an empty table gives none. Integers saturate at 2^40; ``deviation`` is null where it
is beyond a long, ``deviation_text`` always has its digits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task
from corpusloom.llm.vectors import Sums, finite_rows, matrix, scaled, total
from corpusloom.session import store

SCALE = 256
COMPONENTS = 4
#: Eigenvalues per interval, its upper bound over its lower one, nodes on the half circle, rounds of refinement.
INTERVAL = 8
RATIO = 16
NODES = 8
REFINEMENTS = 40
_LONG = 2**63 - 1
_EPSILON = np.finfo(float).eps


def inertia_above(symmetric: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of a factorisation with complete pivoting."""
    rest = symmetric - shift * np.eye(len(symmetric))
    above = 0
    while len(rest):
        diagonal, off = np.abs(np.diag(rest)), np.abs(rest - np.diag(np.diag(rest)))
        i = int(diagonal.argmax())
        p, q = divmod(int(off.argmax()), len(rest))
        if diagonal[i] >= 0.6404 * off[p, q]:  # (1 + sqrt 17) / 8 bounds the growth
            if not diagonal[i]:
                break
            above += rest[i, i] > 0
            own, gone = rest[:, [i]] / rest[i, i] @ rest[[i]], [i]
        else:  # two by two pivots have one eigenvalue of each sign
            above += 1
            gone = [p, q]
            own = rest[:, gone] @ np.linalg.solve(rest[np.ix_(gone, gone)], rest[gone])
        kept = np.setdiff1d(np.arange(len(rest)), gone)
        rest = (rest - own)[np.ix_(kept, kept)]
    return int(above)


def _cut(symmetric: np.ndarray, low: float, high: float, wanted: int) -> float:
    """A bound between with at least ``wanted`` eigenvalues above it, as few more as bisection can tell apart."""
    top = high
    while top - low > 1e-12 * high:
        middle = (low + top) / 2
        count = inertia_above(symmetric, middle)
        if count == wanted:
            return _clear(symmetric, low, middle, wanted)
        low, top = (middle, top) if count > wanted else (low, middle)
    return _clear(symmetric, low / 2, low, inertia_above(symmetric, low))


def _clear(symmetric: np.ndarray, low: float, inside: float, count: int) -> float:
    """A bound that leaves ``count`` above it as ``inside`` does, away from the eigenvalues next to it."""
    reach = inside
    for _ in range(6):
        middle = (low + reach) / 2
        if inertia_above(symmetric, middle) == count:
            reach = middle
        else:
            low = middle
    return (inside + reach) / 2


def _settled(symmetric: np.ndarray, low: float, high: float) -> float:
    """The first bound from ``low`` down with a clear margin to both sides, whole clusters of eigenvalues above it."""
    margin = (high - low) / (4 * len(symmetric))
    while inertia_above(symmetric, low - margin) != inertia_above(symmetric, low + margin):
        low -= margin
    return low


def feast(symmetric: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high]: values and columns.

    Gauss-Legendre nodes lie on the upper half of the circle over the interval; for a real symmetric matrix
    the lower half adds the conjugate, so twice the real part stands for both.
    """
    size = len(symmetric)
    scale = np.abs(symmetric).max()
    width = min(size, 2 * count + 2)
    space = np.random.default_rng(size).standard_normal((size, width))
    centre, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(NODES)
    angles = -np.pi / 2 * (places - 1)
    best = None
    for _ in range(REFINEMENTS):
        projected = np.zeros_like(space)
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((centre + turn) * np.eye(size) - symmetric, space.astype(complex))
            projected += weight / 2 * (turn * solved).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ symmetric @ basis)
        space = basis @ small
        inside = (values > low) & (values <= high)
        found, columns = values[inside], space[:, inside]
        error = np.abs(symmetric @ columns - columns * found).max(initial=0)
        if len(found) == count:
            if best is not None and error >= best[0] / 2 and best[0] <= 1e3 * size * _EPSILON * scale:
                return best[1], best[2]  # as exact as doubles get
            if best is None or error < best[0]:
                best = (error, found, columns)
    if best is None or best[0] > 1e3 * size * _EPSILON * scale:
        raise ArithmeticError(f"inertia counts {count} eigenvalues above {low}; the contour found others")
    return best[1], best[2]


def principal(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, the largest entry positive.

    Intervals go down by factors, so that small eigenvalues are not next to a contour drawn for large ones.
    Eigenvalues within rounding of zero are left out; there may be fewer than ``count``.
    """
    size = len(covariance)
    top = np.abs(covariance).sum(axis=1).max(initial=0.0) * (1 + 1e-9)  # no eigenvalue is larger
    noise = 16 * size * _EPSILON * top
    wanted = min(count, inertia_above(covariance, noise)) if top else 0
    values, columns, done = np.zeros(0), np.zeros((size, 0)), 0
    while done < wanted and top > noise / RATIO:
        low = top / RATIO
        held = inertia_above(covariance, low)
        if held == done:
            top = low
            continue
        most = min(wanted, done + INTERVAL)
        low = _cut(covariance, low, top, most) if held > most else _clear(covariance, low / 2, low, held)
        low = _settled(covariance, low, top)
        held = inertia_above(covariance, low)
        found, own = feast(covariance, low, top, held - done)
        order = np.argsort(found)[::-1]
        values, columns = np.append(values, found[order]), np.hstack([columns, own[:, order]])
        done, top = held, low
    values, columns = values[:wanted], columns[:, :wanted]
    for column in columns.T:
        column *= np.sign(column[np.abs(column).argmax()])
    return values, columns


def _integers(batch) -> dict:
    usable, lengths, values = finite_rows(batch)
    kept = lengths[usable]
    flat = pa.array(scaled(values[np.repeat(usable, lengths)], SCALE))
    offsets = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32())
    ids = batch.column("vec_id").filter(pa.array(usable))
    return {"vec_id": ids, "size": kept.astype(np.int32), "x": pa.ListArray.from_arrays(offsets, flat)}


@per_task
class _Means(Sums):
    """Key 0: rows; key 1 + j: the sum of dimension j."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    def __call__(self, batch) -> dict:
        rows = matrix(batch, "x", self.width)
        self.add(0, [len(rows), *rows.sum(axis=0).tolist()])
        return {}


def gram(rows: np.ndarray) -> np.ndarray:
    """The exact sums of products of integer columns."""
    peak = int(np.abs(rows).max(initial=0))
    if peak >= 1 << 20:
        wide = rows.astype(object)
        return wide.T @ wide
    out = np.zeros((rows.shape[1], rows.shape[1]), object)
    step = 1 << 12  # sums of products below 2^53 are exact in doubles
    for at in range(0, len(rows), step):
        part = rows[at : at + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    return out


@per_task
class _Products(Sums):
    """Sums of the centred vectors, then of their products above and on the diagonal."""

    def __init__(self, centre):
        super().__init__()
        self.centre = centre

    def __call__(self, batch) -> dict:
        width = len(self.centre)
        rows = matrix(batch, "x", width) - self.centre
        self.add(0, rows.sum(axis=0).tolist())
        self.add(width, gram(rows)[np.triu_indices(width)].tolist())
        return {}


def _whitened(rows, rest, columns, values) -> np.ndarray:
    """Centred rows on the components over the root of their variance; ``rest`` completes the centring."""
    return (rows - rest) @ columns / np.sqrt(values)


@per_task
class _Check(Sums):
    """Sums and products of whitened rows, as integers of 2^-60."""

    def __init__(self, centre, rest, columns, values):
        super().__init__()
        self.centre, self.fit = centre, (rest, columns, values)

    def __call__(self, batch) -> dict:
        w = _whitened(matrix(batch, "x", len(self.centre)) - self.centre, *self.fit)
        sums = [int(np.ldexp(v, 60)) for v in np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]).tolist()]
        self.add(0, np.array(sums, object))
        return {}


def _exact_dots(rows: np.ndarray, other: np.ndarray) -> list[int]:
    """The products of every row with ``other`` as Python integers."""
    peak = int(np.abs(rows).max(initial=0)) * max(map(abs, other.tolist()), default=0) * max(len(other), 1)
    return (rows @ other.astype(np.int64)).tolist() if peak < 2**62 else (rows.astype(object) @ other).tolist()


def deviations(rows: np.ndarray, count: int, sums: np.ndarray) -> list[int]:
    """The exact sum over dimensions of (count * x - sum)^2 for every row."""
    peak = int(np.abs(rows).max(initial=0))
    wide = rows.astype(object) if peak * peak * max(rows.shape[1], 1) >= 2**62 else rows
    squares, own = (wide * wide).sum(axis=1).tolist(), _exact_dots(rows, sums)
    constant = sum(s * s for s in sums.tolist())
    return [count * (count * a - 2 * b) + constant for a, b in zip(squares, own)]


def _rows(batch, components, width, count, centre, sums, rest, columns, values, explained, error) -> dict:
    """A row per vector and component."""
    sizes = batch.column("size").to_numpy()
    fits = sizes == width
    rows = matrix(batch.filter(pa.array(fits)), "x", width) - centre
    whitened = np.zeros((len(sizes), components))
    whitened[fits, : len(values)] = _whitened(rows, rest, columns, values)
    exact = iter(deviations(rows, count, sums))
    deviation = np.repeat(np.array([next(exact) if f else None for f in fits], object), components).tolist()
    fits = np.repeat(fits, components)
    whole = len(fits)
    return {
        "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(sizes)), components))),
        "component": np.tile(np.arange(1, components + 1, dtype=np.int32), len(sizes)),
        "n": np.full(whole, count),
        "deviation": [d if d is not None and d <= _LONG else None for d in deviation],
        "whitened": pa.array(whitened.ravel(), mask=~fits),
        "explained": np.tile(explained, len(sizes)),
        "identity_error": np.full(whole, error),
        "deviation_text": [d if d is None else str(d) for d in deviation],
    }


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_text."""
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = store(map_batches(chosen, _integers, "vec_id long, size int, x array<long>"), "whitening-integers")
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    width = usual["size"] if usual else 0
    fit = store(rows.where(F.col("size") == width).select("x").distinct(), "whitening-fit")
    means = total(fit, _Means, width)
    count = means.get(0, 0)
    centre = np.array([(2 * means[1 + j] + count) // (2 * count) for j in range(width)] if count else [], np.int64)
    products = total(fit, _Products, centre)
    sums = np.array([products.get(j, 0) for j in range(width)], object)
    covariance = np.zeros((width, width))
    for k, (i, j) in enumerate(zip(*np.triu_indices(width)), width):
        # Python divides integers of any size with a single rounding.
        covariance[i, j] = covariance[j, i] = (count * products[k] - sums[i] * sums[j]) / count**2
    values, columns = principal(covariance, components)
    rest = np.array([s / count for s in sums.tolist()])
    error = _identity_error(fit, count, centre, rest, columns, values)
    shown = min(components, width)
    explained = np.zeros(shown)
    explained[: len(values)] = values / np.trace(covariance) if len(values) else 0.0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    schema += "identity_error double, deviation_text string"
    args = (shown, width, count, centre, sums, rest, columns, values, explained, error)
    return map_batches(rows, _rows, schema, *args)


def _identity_error(fit: DataFrame, count: int, centre, rest, columns, values) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity."""
    k = len(values)
    if not k:
        return 0.0
    sums = total(fit, _Check, centre, rest, columns, values)
    mean = np.array([sums[j] / count for j in range(k)]) / 2.0**60
    second = np.array([sums[k + j] / count for j in range(k * k)]).reshape(k, k) / 2.0**60
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
