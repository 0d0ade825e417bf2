"""k-means with restarts, choice of k, silhouette, projection and cluster summaries."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from preptrail import schemas as S
from preptrail.functions import pchip
from preptrail.functions.clean import clamp
from preptrail.operators import kmeans
from preptrail.operators.ranking import top_n
from preptrail.session import cut_lineage

#: Rows of a block at most, and at least where more blocks would only give more tasks.
SILHOUETTE_BLOCK_ROWS = 32_768
LEAST_BLOCK_ROWS = 512
#: Distances that a task holds at a time while it compares two blocks; these stay in a core's cache.
SILHOUETTE_STEP = 600_000
#: With more axes distances come from a matrix product; squares below this part of the points' own are taken from differences.
FEW_AXES = 8
NEAR = 4e-6
NEAR_STEP = 50_000
POINTS_PER_TASK = 25_000


@dataclass
class KSelection:
    best_k: int
    labels: DataFrame
    centers: list[list[float]]
    scores: list[tuple[int, float, float]]


def select_k(
    vectors: DataFrame,
    id_col: str,
    restarts: int = S.KMEANS_RESTARTS,
    starts: dict[int, list[list[float]]] | None = None,
    iterations: int = kmeans.MAX_ITERATIONS,
    tolerance: float = kmeans.TOLERANCE,
    squared: bool = False,
) -> KSelection:
    """Fit every k, score all of them in one silhouette pass, keep the best (lowest k on a tie).

    ``vectors`` has an id and a ``vector`` array of one size. All models of all k advance together. ``starts``
    gives the first centres of each k instead of drawn ones, one model each. ``squared`` scores by squared
    distances, from sums per cluster (``squared_silhouette_samples``), where points are too many to compare
    all pairs.
    """
    points = vectors.select(id_col, F.col("vector").cast("array<double>").alias("vector"), F.xxhash64(id_col).alias("hash"))
    points = cut_lineage(points, "points")
    n = points.count()
    points = points.coalesce(-(-n // POINTS_PER_TASK) or 1)
    ks = range(S.K_MIN, S.K_MAX + 1) if n >= S.K_MAX else range(S.K_MIN, max(3, n))
    if starts is None:
        first = kmeans.seeds(points, ks, restarts, S.KMEANS_SEED)
    else:
        first = {k: [np.array(centers, dtype=float)] for k, centers in starts.items()}
    settings = [(k, centers) for k, lots in first.items() for centers in lots]
    fits = kmeans.lloyd(points, [centers for _, centers in settings], iterations, tolerance)
    best = {k: min((f for (own, _), f in zip(settings, fits, strict=True) if own == k), key=lambda f: f.inertia) for k in first}
    labelled = kmeans.assign(points, {f"k{k}": fit.centers for k, fit in best.items()}, [id_col, "vector"])
    labelled = cut_lineage(labelled, "labels")
    score = mean_squared_silhouette if squared else mean_silhouette
    means = score(labelled, id_col, [f"k{k}" for k in best])
    scores = [(k, float(means[f"k{k}"]), fit.inertia) for k, fit in best.items()]
    best_k = max(scores, key=lambda s: (s[1], -s[0]))[0]
    return KSelection(
        best_k, labelled.select(id_col, F.col(f"k{best_k}").alias("cluster")), best[best_k].centers.tolist(), scores
    )


def _lifted(points: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products, one from the left and one from the right, are squared distances."""
    length = (points * points).sum(axis=1)[:, None]
    return np.hstack([-2 * points, length, np.ones_like(length)] if left else [points, np.ones_like(length), length])


def _distances(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All distances between two sets of points, from the products of their ``_lifted`` rows; for pairs so near
    that a product is not exact, and where points have few axes, from differences."""
    if a.shape[1] <= FEW_AXES:
        return np.sqrt(kmeans.squared_distances(a, b))
    apart = left @ right.T
    row, column = np.nonzero(apart < NEAR * left[:, -2:-1])
    for first in range(0, len(row), NEAR_STEP):
        i, j = row[first : first + NEAR_STEP], column[first : first + NEAR_STEP]
        apart[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(apart, 0.0, out=apart), out=apart)


def _members(owns: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A row per point and a column per code, 1 where the point has it; none for a point without a code."""
    return (owns[:, None] == codes[None, :]).astype(float)


def _distance_sums(
    left: tuple[np.ndarray, list[np.ndarray]], right: tuple[np.ndarray, list[np.ndarray]], same: bool
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each labelling the summed distances of the points of one block to each cluster of another, and the
    other way round (not for a block and itself). A block is its points and, per labelling, its ``_members``."""
    (a, of_a), (b, of_b) = left, right
    shift = b.mean(axis=0)
    a, b = a - shift, b - shift
    rows, columns = [np.zeros((len(a), m.shape[1])) for m in of_a], [np.zeros((len(b), m.shape[1])) for m in of_b]
    lifted, others, tile = _lifted(a, True), _lifted(b, False), max(1, int(SILHOUETTE_STEP**0.5))
    for first in range(0, len(a), tile):
        for second in range(0, len(b), tile):
            i, j = slice(first, first + tile), slice(second, second + tile)
            distance = _distances(a[i], b[j], lifted[i], others[j])
            for own, other, row, column in zip(of_a, of_b, rows, columns, strict=True):
                row[i] += distance @ other[j]
                if not same:
                    column[j] += (own[i].T @ distance).T
    return rows, columns


def silhouette_samples(
    points: DataFrame, id_col: str, label_cols: list[str], block_rows: int = SILHOUETTE_BLOCK_ROWS
) -> DataFrame:
    """Exact Euclidean silhouette of every point, for several labellings in one pass.

    Points are dealt evenly into blocks of bounded size; two blocks meet once, in one task that returns the
    summed distances per point and cluster for both of them, never the pairs. A cluster of any size is
    therefore spread over all blocks.
    """
    labels = [F.col(c).cast("int").alias(c) for c in label_cols]
    base = points.select(F.col(id_col).alias("point"), "vector", *labels)
    long_labels = F.explode(
        F.array(*[F.struct(F.lit(c).alias("labelling"), F.col(c).alias("other")) for c in label_cols])
    )
    sizes = base.select(long_labels.alias("l")).groupBy("l.labelling", "l.other").agg(F.count("*").alias("size"))
    counted = sorted((r["labelling"], r["other"], r["size"]) for r in sizes.filter("other is not null").collect())  # as many as clusters
    codes = {c: np.array([other for name, other, _ in counted if name == c], dtype=np.int64) for c in label_cols}
    held = {c: [n for name, _, n in counted if name == c] for c in label_cols}
    n, cores = base.count(), base.sparkSession.sparkContext.defaultParallelism
    # Enough pairs of blocks for all cores, where points are few.
    n_blocks = max(1, -(-n // block_rows), min(-(-n // LEAST_BLOCK_ROWS), round((16 * cores) ** 0.5)))
    place = F.pmod(F.xxhash64("point"), F.lit(n_blocks)).cast("int")
    dealt = base.withColumn("_block", place).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    dealt = dealt.withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")}).drop("_other")
    dealt = dealt.repartition(n_blocks * (n_blocks + 1) // 2, "_a", "_b")
    point_type = base.schema["point"].dataType.simpleString()
    fields = f"labelling string, point {point_type}, own int, totals array<double>"
    out_schema = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, dim = rows["_block"].to_numpy(), len(rows["vector"][0].as_py())
        vectors = kmeans.matrix(rows["vector"].combine_chunks(), dim)
        owns = [rows[c].to_pandas().to_numpy(dtype=float) for c in label_cols]  # nan: no label
        sides = [np.flatnonzero(block == k.as_py()) for k in key]
        if not all(map(len, sides)):
            return out_schema.empty_table()
        same = key[0].as_py() == key[1].as_py()
        met = [(vectors[at], [_members(own[at], codes[c]) for own, c in zip(owns, label_cols, strict=True)]) for at in sides]
        sums = _distance_sums(*met, same)
        out = []
        for at, totals in zip(sides[:1] if same else sides, sums, strict=False):
            for c, own, total in zip(label_cols, owns, totals, strict=True):
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * total.shape[1], total.ravel())
                own = pa.array(own[at], pa.float64(), from_pandas=True).cast(pa.int32())
                columns = [pa.array([c] * len(at), pa.string()), rows["point"].take(pa.array(at)).combine_chunks(), own, lists]
                out.append(pa.Table.from_arrays(columns, names=out_schema.names).cast(out_schema))
        return pa.concat_tables(out)

    most = max(map(len, codes.values()))
    sums = dealt.groupBy("_a", "_b").applyInArrow(run, fields).groupBy("labelling", "point", "own")
    sums = sums.agg(F.array(*[F.sum(F.get("totals", F.lit(i))) for i in range(most)]).alias("totals"))
    known = [(c, codes[c].tolist(), held[c]) for c in label_cols if len(codes[c])]
    known = base.sparkSession.createDataFrame(known, "labelling string, codes array<int>, sizes array<long>")
    at = (F.array_position("codes", F.col("own")) - 1).cast("int")  # null for a point without a label
    means = F.transform("codes", lambda code, i: F.when(code != F.col("own"), F.get("totals", i) / F.get("sizes", i)))
    per_point = sums.join(F.broadcast(known), "labelling").withColumn("own_size", F.get("sizes", at))
    per_point = per_point.withColumns(
        {"a": F.get("totals", at) / F.greatest(F.col("own_size") - 1, F.lit(1)), "b": F.array_min(means)}
    )
    spread = F.greatest("a", "b")
    score = F.when((F.col("own_size") > 1) & (spread > 0), (F.col("b") - F.col("a")) / spread)
    return per_point.select(
        "labelling",
        F.col("point").alias(id_col),
        F.col("own").alias("cluster"),
        F.coalesce(score, F.lit(0.0)).alias("silhouette"),
    )


def mean_silhouette(points: DataFrame, id_col: str, label_cols: list[str]) -> dict[str, float]:
    samples = silhouette_samples(points, id_col, label_cols)
    return {r["labelling"]: r["mean"] for r in samples.groupBy("labelling").agg(F.avg("silhouette").alias("mean")).collect()}


def squared_silhouette_samples(points: DataFrame, id_col: str, label_cols: list[str]) -> DataFrame:
    """Silhouette of every point by squared distances, in two passes over the points.

    The mean squared distance from a point x to a cluster follows from the cluster's count, vector sum and
    sum of squares, so no pair of points meets. These sums are as many as the clusters.
    """
    dim = points.select(F.max(F.size("vector"))).first()[0]
    base = points.select(F.col(id_col), F.col("vector").cast("array<double>").alias("vector"), *[F.col(c).cast("int").alias(c) for c in label_cols])
    sums: dict[str, tuple[np.ndarray, ...]] = {}
    axes = [F.sum(F.col("vector")[a]) for a in range(dim)]
    square = F.sum(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    for label in label_cols:
        rows = sorted(base.groupBy(label).agg(F.count("*"), square, *axes).collect())
        table = np.array([r[1:] for r in rows], dtype=float).reshape(-1, dim + 2)
        sums[label] = np.array([r[0] for r in rows]), table[:, 0], table[:, 1], table[:, 2:]

    def run(batches):
        for batch in batches:
            x = kmeans.matrix(batch.column(1), dim)
            length = (x * x).sum(axis=1)
            for i, label in enumerate(label_cols):
                codes, n, squares, total = sums[label]
                own = np.searchsorted(codes, batch.column(2 + i).to_numpy(zero_copy_only=False))
                apart = np.maximum(length[:, None] * n - 2 * (x @ total.T) + squares, 0.0)
                rows = np.arange(len(x))
                a = apart[rows, own] / np.maximum(n[own] - 1, 1)
                others = apart / n
                others[rows, own] = np.inf
                b = others.min(axis=1)
                spread = np.maximum(a, b)
                ok = (n[own] > 1) & (spread > 0) & np.isfinite(b)
                score = np.where(ok, (b - a) / np.where(ok, spread, 1.0), 0.0)
                names = pa.array([label] * len(x), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names, batch.column(0), pa.array(codes[own], pa.int32()), pa.array(score)], names=["labelling", id_col, "cluster", "silhouette"]
                )

    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"labelling string, {id_col} {kind}, cluster int, silhouette double")


def mean_squared_silhouette(points: DataFrame, id_col: str, label_cols: list[str]) -> dict[str, float]:
    samples = squared_silhouette_samples(points, id_col, label_cols)
    return {r["labelling"]: r["mean"] for r in samples.groupBy("labelling").agg(F.avg("silhouette").alias("mean")).collect()}


def pca_projection(vectors: DataFrame, id_col: str, centers: list[list[float]] | None = None) -> DataFrame:
    """Two principal components of the centred vectors (and of the centroids), with explained ratios.

    The sign of a component is arbitrary; here its largest loading is positive.
    """
    spark = vectors.sparkSession
    dim = vectors.select(F.max(F.size("vector"))).first()[0]
    means = vectors.agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(dim)])).scalar()
    points = vectors.select(F.lit("point").alias("kind"), F.col(id_col).cast("string").alias("name"), "vector")
    if centers:
        extra = spark.createDataFrame(
            [("centroid", str(i), c) for i, c in enumerate(centers)], "kind string, name string, vector array<double>"
        )
        points = points.withColumn("vector", F.col("vector").cast("array<double>")).unionByName(extra)
    centred = points.withColumn("_mean", means).withColumn(
        "features", array_to_vector(F.zip_with("vector", "_mean", lambda x, m: x.cast("double") - m))
    )
    model = PCA(k=2, inputCol="features", outputCol="projected").fit(centred.filter("kind = 'point'"))
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, j]).argmax(), j])) for j in range(2)]
    ratio = model.explainedVariance.toArray()
    projected = vector_to_array("projected")
    return model.transform(centred).select(
        "kind",
        "name",
        (projected[0] * signs[0]).alias("pc1"),
        (projected[1] * signs[1]).alias("pc2"),
        F.lit(float(ratio[0])).alias("explained1"),
        F.lit(float(ratio[1])).alias("explained2"),
    )


def centroid_spread(centers: DataFrame, columns: list[str]) -> DataFrame:
    """Population deviation of the centroids per feature."""
    stats = centers.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    return stats.unpivot([], columns, "feature", "spread").orderBy("spread", "feature")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n_companies"))


def cluster_balance(labels: DataFrame, n_clusters: int) -> DataFrame:
    """One row: smallest, largest and mean size, empty clusters, and whether all hold two or more."""
    return cluster_sizes(labels).agg(
        F.count("*").alias("n_clusters"),
        F.sum("n_companies").alias("n_companies"),
        F.min("n_companies").alias("min_size"),
        F.max("n_companies").alias("max_size"),
        F.avg("n_companies").alias("mean_size"),
        (F.lit(n_clusters) - F.count("*")).alias("empty_clusters"),
        ((F.count("*") == n_clusters) & (F.min("n_companies") >= 2)).alias("passed"),
    )


def cluster_summary(labels: DataFrame, curves: DataFrame, shown: int = 6) -> DataFrame:
    """Members, difficulty mix at the first horizon, and the first few names of every cluster."""
    names = (
        top_n(labels, ["cluster"], [F.col("company")], shown)
        .groupBy("cluster")
        .agg(F.array_join(F.array_sort(F.collect_list("company")), ", ").alias("names"))
    )
    day = F.lit(S.HORIZONS[0])

    def mix(part: str):
        at_day = pchip.value(day, F.col(f"{part}_y"), F.col(f"{part}_d"))
        return F.bround(clamp(at_day, 0.0, 1.0) * 100, 0).cast("int").alias(f"{part}_percent")

    return (
        cluster_sizes(labels)
        .join(names, "cluster")
        .join(curves.drop("n_companies"), "cluster")
        .select(
            "cluster",
            "n_companies",
            mix("easy"),
            mix("medium"),
            mix("hard"),
            F.concat("names", F.when(F.col("n_companies") > shown, "...").otherwise("")).alias("top_companies"),
        )
    )
