"""Difficulty counts per company and horizon, and the shares derived from them."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail import schemas as S


def difficulty_distribution(problems: DataFrame) -> DataFrame:
    """Titles counted per company, horizon and difficulty, with one column per difficulty.

    One aggregation with conditional counts, so only (company, horizon) partials are shuffled.
    """
    used = problems.select("company", "preparation_days", "difficulty", "title").filter(
        F.col("company").isNotNull()
        & F.col("preparation_days").isNotNull()
        & F.col("difficulty").isNotNull()
    )

    def count_of(difficulty: str):
        return F.count(F.when(F.col("difficulty") == difficulty, F.col("title")))

    return used.groupBy("company", F.col("preparation_days").cast("int").alias("days_until")).agg(
        count_of("EASY").alias("easycount"),
        count_of("HARD").alias("hardcount"),
        count_of("MEDIUM").alias("mediumcount"),
    )


def normalized_shares(distributions: DataFrame) -> DataFrame:
    """Total, share of the company's largest total, and share of each difficulty."""
    total = F.col("easycount") + F.col("mediumcount") + F.col("hardcount")
    company_max = F.max("total").over(W.partitionBy("company"))
    floor = F.greatest(F.col("total"), F.lit(1))
    return (
        distributions.withColumn("total", total)
        .withColumn("proportion", F.col("total") / F.greatest(company_max, F.lit(1)))
        .withColumns({f"{d}_pct": F.col(f"{d}count") / floor for d in ("easy", "medium", "hard")})
    )


def max_totals(shares: DataFrame) -> DataFrame:
    return shares.groupBy("company").agg(F.max("total").alias("max_total"))


def volume_pivot(shares: DataFrame) -> DataFrame:
    """Proportion per company with one column per horizon, null where a horizon is missing."""
    pivoted = shares.groupBy("company").pivot("days_until", S.HORIZONS)
    return pivoted.agg(F.first("proportion", ignorenulls=True)).select(
        "company", *[F.col(str(h)).alias(c) for h, c in zip(S.HORIZONS, S.VOLUME_COLUMNS)]
    )


def known_horizons():
    """Number of horizons known for a row of the volume pivot."""
    return sum((F.col(c).isNotNull().cast("int") for c in S.VOLUME_COLUMNS), F.lit(0))
