"""Demand curves per cluster and everything predicted from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.functions import clean, pchip, vectors
from preptrail.functions.clean import clamp
from preptrail.operators.selection import medians

SERIES = {"prop": "proportion", "easy": "easy_pct", "medium": "medium_pct", "hard": "hard_pct"}
GRID_POINTS = 300


def cluster_day_means(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean proportion and difficulty mix per (cluster, horizon) over the rows present."""
    return (
        shares.join(labels, "company")
        .groupBy("cluster", "days_until")
        .agg(*[F.avg(c).alias(c) for c in SERIES.values()])
    )


def fit_curves(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """Knot values and slopes of the four curves of every cluster, with its member count.

    Missing horizons count as zero, the curve starts at zero, and the last proportion is raised to
    the largest one. All means come from a single aggregation per cluster.
    """

    def at(horizon: int, column: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("days_until") == horizon, F.col(column))), F.lit(0.0))

    means = (
        shares.join(labels, "company")
        .groupBy("cluster")
        .agg(
            F.count_distinct("company").alias("n_companies"),
            *[F.array(F.lit(0.0), *[at(h, c) for h in S.HORIZONS]).alias(f"{s}_y") for s, c in SERIES.items()],
        )
    )
    last = len(S.KNOTS) - 1
    raised = F.concat(F.slice("prop_y", 1, last), F.array(F.array_max("prop_y")))
    knots = means.withColumn("prop_y", raised)
    return knots.withColumns({f"{s}_d": pchip.slopes(F.col(f"{s}_y")) for s in SERIES})


def evaluate(series: str, day: Column) -> Column:
    return pchip.value(day, F.col(f"{series}_y"), F.col(f"{series}_d"))


def curve_grid(curves: DataFrame, points: int = GRID_POINTS) -> DataFrame:
    """Every curve on an even grid from day 1 to the last day, clipped to 0..1."""
    step = (S.MAX_DAYS - 1) / (points - 1)
    grid = curves.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    day = F.lit(1.0) + F.col("point") * F.lit(step)
    grid = grid.withColumn("day", F.least(day, F.lit(float(S.MAX_DAYS))))
    return grid.select(
        "cluster", "point", "day", *[clamp(evaluate(s, F.col("day")), 0.0, 1.0).alias(c) for s, c in SERIES.items()]
    )


def _half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def predict_counts(requests: DataFrame, labels: DataFrame, curves: DataFrame, totals: DataFrame) -> DataFrame:
    """Recommended number of problems per difficulty for each requested (company, days_until).

    Companies without a cluster or without a curve get fixed counts. Rounding is half to even, the
    medium count is the remainder, and no count is negative.
    """
    known = (
        requests.join(labels.select("company", "cluster"), "company", "left")
        .join(curves.drop("n_companies").withColumn("_fitted", F.lit(True)), "cluster", "left")
        .join(totals, "company", "left")
    )
    day = F.greatest(F.lit(1), F.least(F.col("days_until"), F.lit(S.MAX_DAYS)))
    volume = clamp(evaluate("prop", day), 0.0, 1.0) * F.coalesce("max_total", F.lit(S.DEFAULT_MAX_TOTAL))
    parts = {p: clamp(evaluate(p, day), 0.0, 1.0) for p in ("easy", "medium", "hard")}
    known = known.withColumns(
        {"total": F.greatest(F.lit(1).cast("bigint"), _half_even(volume)), **{f"_{p}": c for p, c in parts.items()}}
    )
    known = known.withColumn("_sum", F.col("_easy") + F.col("_medium") + F.col("_hard"))

    def rounded(part: str) -> Column:
        share = F.when(F.col("_sum") > 0, F.col(f"_{part}") / F.col("_sum"))
        return _half_even(F.col("total") * share.otherwise(F.lit(S.DEFAULT_SHARES[part])))

    known = known.withColumns({"easy": rounded("easy"), "hard": rounded("hard")})
    known = known.withColumn("medium", F.col("total") - F.col("easy") - F.col("hard"))

    def settled(part: str) -> Column:
        count = F.greatest(F.col(part), F.lit(0).cast("bigint"))
        return F.when(F.col("_fitted"), count).otherwise(F.lit(S.DEFAULT_COUNTS[part]).cast("bigint")).alias(part)

    return known.select(*requests.columns, "cluster", *[settled(p) for p in S.DEFAULT_COUNTS])


def _curve_list(curves: DataFrame) -> Column:
    """All proportion curves as one array; there are at most ``K_MAX`` clusters."""
    fields = F.struct("cluster", "prop_y", "prop_d")
    return curves.agg(F.array_sort(F.collect_list(fields)).alias("curves")).scalar()


def assign_sparse(sparse: DataFrame, shares: DataFrame, curves: DataFrame) -> DataFrame:
    """Cluster whose proportion curve comes closest to any of a company's points.

    Ties go to the earliest horizon, then to the lowest cluster; a company without points goes to
    cluster 0. Each point is compared with the few curves inside the row, so nothing multiplies.
    """
    points = shares.join(sparse.select("company"), "company", "left_semi").withColumn("_curves", _curve_list(curves))
    distances = F.transform(
        "_curves",
        lambda c: F.struct(
            F.abs(F.col("proportion") - pchip.value(F.col("days_until"), c["prop_y"], c["prop_d"])).alias("distance"),
            F.col("days_until").alias("days_until"),
            c["cluster"].alias("cluster"),
        ),
    )
    nearest = points.groupBy("company").agg(F.min(F.array_min(distances)).alias("best"))
    return (
        sparse.select("company")
        .join(nearest, "company", "left")
        .select("company", F.coalesce("best.cluster", F.lit(0)).alias("cluster"))
    )


def merge_labels(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Union of both label tables in which ``overrides`` win."""
    kept = labels.join(overrides.select("company"), "company", "left_anti")
    return kept.select("company", "cluster").unionByName(overrides.select("company", "cluster"))


def nearest_centroid(encoded: DataFrame, centers: DataFrame, vector: Column) -> DataFrame:
    """Cluster of the closest centroid (lowest cluster on a tie); ``centers`` is (cluster, center)."""
    center_list = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "center")))).scalar()
    ranked = F.transform(
        "_centers",
        lambda c: F.struct(vectors.squared_distance(F.col("_vector"), c["center"]).alias("d"), c["cluster"].alias("cluster")),
    )
    placed = encoded.withColumn("_centers", center_list).withColumn("_vector", vector)
    return placed.withColumn("cluster", F.array_min(ranked)["cluster"]).drop("_centers", "_vector")


def encode_cold_start(meta: DataFrame, columns: list[str], features: DataFrame | None, industries: DataFrame | None = None) -> DataFrame:
    """Unscaled features of companies that were not part of the fit.

    The industry becomes the median code of the fitted companies (zero without any). Passing
    ``industries`` (industry, industry_enc) matches it by name first.
    """
    encoded = {c: F.lit(0.0) for c in S.VOLUME_COLUMNS}
    encoded.update(
        size_rank=clean.size_rank(F.col("size_range")),
        log_employees=clean.log_employees(F.col("employee_count")),
        year_founded=clean.founding_year_cold_start(F.col("year_founded")),
    )
    median = F.lit(0.0)
    if features is not None:
        median = F.lit(medians(features, ["industry_enc"])["industry_enc"])
    out = meta
    if industries is not None:
        key = F.lower(clean.strip_space(F.coalesce("industry", F.lit("unknown"))))
        lookup = industries.groupBy(F.lower(clean.strip_space(F.col("industry"))).alias("_industry")).agg(
            F.min("industry_enc").alias("_code")
        )
        out = out.withColumn("_industry", key).join(lookup, "_industry", "left")
        encoded["industry_enc"] = F.coalesce("_code", median)
    else:
        encoded["industry_enc"] = median
    return out.select("company", *[encoded[c].cast("double").alias(c) for c in columns])


def cluster_info(companies: DataFrame, labels: DataFrame, curves: DataFrame) -> DataFrame:
    """Cluster of each company and the number of companies its curve was fitted on."""
    return (
        companies.select("company")
        .join(labels.select("company", "cluster"), "company", "left")
        .join(curves.select("cluster", "n_companies"), "cluster", "left")
        .select("company", "cluster", F.coalesce("n_companies", F.lit(0)).alias("n_companies_in_cluster"))
    )


