"""Company features for clustering."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.functions import clean
from preptrail.operators.distributions import known_horizons
from preptrail.operators.ranking import first_per_key, numbered
from preptrail.operators.selection import medians


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank of each value among the sorted distinct values; null counts as ``unknown``."""
    value = F.coalesce(F.col(column), F.lit("unknown"))
    codes = numbered(df.select(value.alias("_value")).distinct(), [F.col("_value")], out)
    return df.withColumn("_value", value).join(codes, "_value").drop("_value")


def company_features(meta: DataFrame) -> DataFrame:
    """Four numeric features per company; repeated companies keep their first row by content."""
    columns = S.COMPANY_META.fieldNames()
    unique = first_per_key(meta.select(*columns), ["company"], [F.col(c) for c in columns[1:]])
    return label_encode(unique, "industry", "industry_code").select(
        "company",
        F.col("industry_code").cast("double").alias("industry_enc"),
        clean.size_rank(F.col("size_range")).alias("size_rank"),
        clean.log_employees(F.col("employee_count")).alias("log_employees"),
        clean.founding_year(F.col("year_founded")).alias("year_founded"),
    )


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    filler = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(filler[c])) for c in columns})


def split_clusterable(
    pivot: DataFrame, features: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Companies with usable features, the sparse rest, and the names of the feature columns.

    With company features only those are used; without, the four horizon shares of companies that
    have at least two of them.
    """
    if features is not None:
        known = features.join(pivot.select("company"), "company", "left_semi")
        sparse = pivot.join(features.select("company"), "company", "left_anti")
        return impute_median(known, S.FEATURE_COLUMNS), sparse, S.FEATURE_COLUMNS
    dense = known_horizons() >= 2
    return pivot.filter(dense).fillna(0.0, S.VOLUME_COLUMNS), pivot.filter(~dense), S.VOLUME_COLUMNS


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature, with the weight used for distances."""

    columns: list[str]
    mean: dict[str, float]
    scale: dict[str, float]

    def scaled(self, name: str) -> Column:
        weight = S.INDUSTRY_WEIGHT if name == "industry_enc" else 1.0
        return (F.col(name) - self.mean[name]) / self.scale[name] * weight

    def vector(self) -> Column:
        return F.array(*[self.scaled(c) for c in self.columns])


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregation; a feature without variance keeps scale 1."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first()
    return Scaler(
        list(columns),
        {c: stats[f"mean_{c}"] for c in columns},
        {c: stats[f"std_{c}"] or 1.0 for c in columns},
    )


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    scaler = fit_scaler(df, columns)
    return df.select("company", *[scaler.scaled(c).alias(c) for c in columns])
