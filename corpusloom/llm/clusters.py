"""k-means on integer vectors with a Walsh-Hadamard progressive search for the nearest centroid.

Vectors and centroids go through the exact integer Walsh-Hadamard transform, coefficients in order of
sequency, so coarse shape comes first. Squared distances between transforms are 64 times those between
vectors, and a sum over the first coefficients can only grow: a centroid whose sum already exceeds the
whole distance to a likely one is out. What is left finishes all 64 coefficients, so results are exact.

The transform is linear, so the sums for new centroids are sums of coefficients; vectors are transformed
once, stored, and read by every round. A round brings a count and 64 sums per centroid to the driver.

Kept are vectors of exactly 64 components without null, NaN or infinity; the rest has no row in the result.
Nulls: a vector with a null vec_id is clustered but starts a centroid only where ids run out. Repeated rows
count once each. Fewer than eight vectors give fewer centroids, an empty table an empty result. Integers
saturate at 2^40; a distance beyond a long is null, as are the sums it belongs to. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tasks import map_batches, per_task
from corpusloom.llm.vectors import Sums, finite_rows, list_column, matrix, scaled, total
from corpusloom.session import store

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: Coefficients added before candidates are looked at again.
STEPS = (8, 16, 32, WIDTH)
_LONG = 2**63 - 1


def _butterflies(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, in natural order; its own inverse but for a factor of 64."""
    half = 1
    while half < WIDTH:
        pairs = rows.reshape(-1, WIDTH // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(-1, WIDTH)
        half *= 2
    return rows


#: Natural positions in order of sequency, the number of sign changes along a basis row.
SEQUENCY = np.argsort((np.diff(_butterflies(np.eye(WIDTH, dtype=np.int64)), axis=1) != 0).sum(axis=1))


def transform(rows: np.ndarray) -> np.ndarray:
    """Coefficients of every row, coarse to fine."""
    return _butterflies(rows)[:, SEQUENCY]


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """The rows that have these coefficients."""
    natural = np.empty_like(coefficients)
    natural[:, SEQUENCY] = coefficients
    return _butterflies(natural) // WIDTH


def _reach(coefficients: np.ndarray) -> float:
    return float(np.square(coefficients.astype(np.float64)).sum(axis=1).max(initial=0))


def nearest(points: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target, squared distance of the vectors) for every row of coefficients; ties go to the smaller number."""
    if 2 * (_reach(points) + _reach(targets)) > 2**61:  # beyond exact longs: Python integers
        points, targets = points.astype(object), targets.astype(object)
    first = STEPS[0]
    sums = np.stack([((points[:, :first] - t[:first]) ** 2).sum(axis=1) for t in targets], axis=1)
    likely = sums.argmin(axis=1)
    bound = ((points - targets[likely]) ** 2).sum(axis=1)
    row, target = np.nonzero(sums <= bound[:, None])
    held = sums[row, target]
    for low, high in zip(STEPS, STEPS[1:]):
        held = held + ((points[row, low:high] - targets[target, low:high]) ** 2).sum(axis=1)
        alive = np.flatnonzero(held <= bound[row])
        row, target, held = row[alive], target[alive], held[alive]
    # A row's candidates come in ascending order and its likely one is never dropped.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(held, starts)
    ties = np.flatnonzero(held == least[row])
    _, at = np.unique(row[ties], return_index=True)
    return target[ties][at], least // WIDTH


def _coefficients(batch) -> dict:
    usable, lengths, values = finite_rows(batch)
    kept = usable & (lengths == WIDTH)
    rows = scaled(values[np.repeat(kept, lengths)].reshape(-1, WIDTH), SCALE)
    return {"vec_id": batch.column("vec_id").filter(kept), "coefficients": list_column(transform(rows))}


@per_task
class _Round(Sums):
    """Counts and sums of coefficients by nearest centroid."""

    def __init__(self, targets):
        super().__init__()
        self.targets = targets

    def __call__(self, batch) -> dict:
        points = matrix(batch, "coefficients", WIDTH)
        label, _ = nearest(points, self.targets)
        exact = points if np.abs(points).max(initial=0) < 2**40 else points.astype(object)
        for k in np.unique(label).tolist():
            mine = exact[label == k]
            self.add(k * (WIDTH + 1), [len(mine), *mine.sum(axis=0).tolist()])
        return {}


def _assigned(batch, targets) -> dict:
    label, distance = nearest(matrix(batch, "coefficients", WIDTH), targets)
    if distance.dtype == object:
        distance = [d if d <= _LONG else None for d in distance.tolist()]
    return {"vec_id": batch.column("vec_id"), "cluster": label.astype(np.int32), "distance": distance}


def _starts(points: DataFrame, count: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id, as integer vectors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(digest.asc_nulls_last(), "coefficients").limit(count).select("coefficients").collect()
    return inverse(np.array([r.coefficients for r in rows], np.int64).reshape(-1, WIDTH))


def _moved(centroids: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean."""
    moved = centroids.astype(object)
    for k in range(len(centroids)):
        if count := sums.get(k * (WIDTH + 1), 0):
            own = np.array([[sums[k * (WIDTH + 1) + 1 + j] for j in range(WIDTH)]], object)
            moved[k] = inverse(own)[0] // count
    return moved.astype(np.int64)


def _inertia(assigned: DataFrame) -> dict[int, int | None]:
    """The summed distance of every cluster; None where a distance is beyond a long."""
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    rows = assigned.groupBy("cluster").agg(whole.alias("inertia")).collect()
    return {r.cluster: None if r.inertia is None else int(r.inertia) for r in rows}


def _long(value: int | None) -> int | None:
    return value if value is not None and value <= _LONG else None


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    points = store(map_batches(chosen, _coefficients, "vec_id long, coefficients array<long>"), "coefficients")
    centres = _starts(points, centroids, seed)
    for _ in range(rounds):
        moved = _moved(centres, total(points.select("coefficients"), _Round, transform(centres)))
        if (moved == centres).all():
            break  # every further round would repeat this one
        centres = moved
    schema = "vec_id long, cluster int, distance long"
    assigned = store(map_batches(points, _assigned, schema, transform(centres)), "assigned")
    own = _inertia(assigned)
    whole = None if None in own.values() else sum(own.values())
    facts = [
        (k, _long(own[k]), _long(whole), hashlib.sha256(",".join(map(str, centres[k].tolist())).encode()).hexdigest())
        for k in own
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # A row per centroid, as many as the parameter says.
    return assigned.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
