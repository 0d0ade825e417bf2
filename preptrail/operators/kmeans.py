"""k-means for many numbers of clusters and many starts at once: one pass over the points per round.

All models meet a row together, so a round is one aggregate whatever their number. Only sums per cluster
leave the tasks; the driver holds the centres and nothing that grows with the points.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ITERATIONS = 300
TOLERANCE = 1e-4
#: Rounds of drawing candidates for centres, and how many of them per cluster and round.
DRAWS = 3
OVERSAMPLE = 2
#: Distances that a task holds at a time.
STEP = 4_000_000
#: Centres that move less than this part of the points' spread stand still, whatever the tolerance.
STILL = 1e-20
SUMS = pa.schema([("center", pa.int32()), ("axis", pa.int32()), ("value", pa.float64())])
DRAWN = pa.schema([("start", pa.int32()), ("rank_key", pa.float64()), ("tie", pa.int64()), ("vector", pa.list_(pa.float64()))])


@dataclass
class Fit:
    """Centres of one model and the summed squared distance of the points to their nearest one."""

    centers: np.ndarray
    inertia: float


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), dim)


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """From differences, axis by axis, so that near centres are told apart."""
    out = np.zeros((len(points), len(centers)))
    for axis in range(points.shape[1]):
        out += (points[:, axis, None] - centers[None, :, axis]) ** 2
    return out


def steps(points: np.ndarray, width: int) -> Iterator[np.ndarray]:
    size = max(1, STEP // max(1, width))
    for first in range(0, len(points), size):
        yield points[first : first + size]


def cluster_sums(points: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model the vector sums and counts of its clusters, and its inertia, in one pass.

    ``points`` has a ``vector``. A point belongs to the nearest centre, the first of equally near ones.
    """
    every, dim = np.concatenate(models), models[0].shape[1]
    edges = np.cumsum([0, *map(len, models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(every), dim + 2))  # count, inertia, vector sum
        for batch in batches:
            for part in steps(matrix(batch.column(0), dim), len(every)):
                apart = squared_distances(part, every)
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    own = apart[:, first:last].argmin(axis=1)
                    sums[first:last, 0] += np.bincount(own, minlength=last - first)
                    near = apart[np.arange(len(part)), first + own]
                    sums[first:last, 1] += np.bincount(own, near, last - first)
                    for axis in range(dim):
                        sums[first:last, axis + 2] += np.bincount(own, part[:, axis], last - first)
        center, axis = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(center, pa.int32()), pa.array(axis, pa.int32()), pa.array(sums[center, axis])], schema=SUMS
        )

    parts = points.select("vector").mapInArrow(run, "center int, axis int, value double")
    total = np.zeros((len(every), dim + 2))
    for center, axis, value in parts.groupBy("center", "axis").agg(F.sum("value")).collect():  # a row per centre and axis
        total[center, axis] = value
    return [(total[a:b, 2:], total[a:b, 0], float(total[a:b, 1].sum())) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes, others for each salt."""
    x = values.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def draw(points: DataFrame, starts: list[np.ndarray | None], count: int, salt: int) -> list[np.ndarray]:
    """For each start ``count`` points, drawn without replacement with chances in proportion to the squared
    distance from the start's centres so far (all alike, if it has none).

    ``points`` has ``vector`` and ``hash``, a 64-bit hash of the row, from which each row's luck follows: the
    result is the same however rows are dealt to tasks.
    """
    dim_of = points.select(F.max(F.size("vector"))).first()[0] if starts[0] is None else starts[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = matrix(batch.column(0), dim_of), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, centers in enumerate(starts):
                luck = -np.log(mixed(hashes, salt * len(starts) + s))
                if centers is None:
                    key = luck
                else:
                    far = np.concatenate([squared_distances(p, centers).min(axis=1) for p in steps(rows, len(centers))] or [np.zeros(0)])
                    key = np.divide(luck, far, out=np.full(len(luck), np.inf), where=far > 0)
                best = np.lexsort((hashes, key))[:count]
                best = best[np.isfinite(key[best])]
                vectors = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(best) + 1) * dim_of, pa.int32()), pa.array(rows[best].ravel(), pa.float64())
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), s), pa.int32()), pa.array(key[best]), pa.array(hashes[best]), vectors], schema=DRAWN
                )

    drawn = points.select("vector", "hash").mapInArrow(run, "start int, rank_key double, tie long, vector array<double>")
    order = W.partitionBy("start").orderBy("rank_key", "tie")
    found = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)
    rows = sorted((r["start"], r["place"], r["vector"]) for r in found.collect())  # ``count`` a start at most
    return [np.array([v for s, _, v in rows if s == start], dtype=float).reshape(-1, dim_of) for start in range(len(starts))]


def weighted_seeds(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the candidates, each drawn by weight and squared distance from those before."""
    luck = np.random.default_rng(seed)
    chosen = [int(luck.choice(len(candidates), p=weights / weights.sum()))]
    near = squared_distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        chance = near * weights
        if chance.sum() <= 0:  # fewer different points than clusters
            chance = np.ones(len(candidates))
        chosen.append(int(luck.choice(len(candidates), p=chance / chance.sum())))
        near = np.minimum(near, squared_distances(candidates, candidates[chosen[-1:]])[:, 0])
    return candidates[chosen]


def seeds(points: DataFrame, ks: range, starts: int, seed: int) -> dict[int, list[np.ndarray]]:
    """For each k as many sets of first centres as ``starts``: candidates are drawn in a few passes for the
    largest k, weighted by the points nearest to them, and thinned to k on the driver."""
    most = max(ks)
    found = draw(points, [None] * starts, 1, seed)
    for turn in range(1, DRAWS + 1):
        more = draw(points, list(found), OVERSAMPLE * most, seed + turn)
        found = [np.concatenate(both) for both in zip(found, more, strict=True)]
    weights = [counts for _, counts, _ in cluster_sums(points, found)]
    return {k: [weighted_seeds(c, w, k, seed + s) for s, (c, w) in enumerate(zip(found, weights, strict=True))] for k in ks}


def lloyd(points: DataFrame, starts: list[np.ndarray], iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> list[Fit]:
    """Fit a model from each set of first centres. All that still move advance in the same pass.

    A model stands still when its centres' summed squared moves are at most ``tolerance`` times the mean
    variance of the axes. A cluster without points keeps its centre.
    """
    centers = [np.asarray(s, dtype=float) for s in starts]
    dim = centers[0].shape[1]
    axes = [F.var_pop(F.col("vector")[a]) for a in range(dim)]
    spread = float(np.mean([v or 0.0 for v in points.agg(*axes).first()]))
    moving = list(range(len(centers)))
    for _ in range(iterations):
        sums = cluster_sums(points, [centers[m] for m in moving])
        still = []
        for m, (total, counts, _) in zip(moving, sums, strict=True):
            full = counts > 0
            fresh = np.where(full[:, None], total / np.maximum(counts, 1)[:, None], centers[m])
            if ((fresh - centers[m]) ** 2).sum() <= max(tolerance, STILL) * spread:
                still.append(m)
            centers[m] = fresh
        moving = [m for m in moving if m not in still]
        if not moving:
            break
    return [Fit(c, cost) for c, (_, _, cost) in zip(centers, cluster_sums(points, centers), strict=True)]


def assign(points: DataFrame, models: dict[str, np.ndarray], carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``points`` and, for each named model, the number of the nearest centre."""
    names, dim = list(models), next(iter(models.values())).shape[1]
    fields = ", ".join([f"{c} {points.schema[c].dataType.simpleString()}" for c in carry] + [f"{n} int" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = matrix(batch.column(0), dim), []
            for name in names:
                parts = [squared_distances(p, models[name]).argmin(axis=1) for p in steps(rows, len(models[name]))]
                labels.append(pa.array(np.concatenate(parts or [np.zeros(0)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *labels], names=[*carry, *names])

    return points.select(F.col("vector").alias("_vector"), *carry).mapInArrow(run, fields)
