"""Ranking, numbering and first-wins helpers that hold for hot groups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.session import cut_lineage

SALTS = 64
TASK_ROWS = 200_000


def _ranked_by_range(df: DataFrame, keys: list[str], order: list[Column], rank_col: str) -> DataFrame:
    """Rank within groups of any size: a range sort over keys and order splits a hot group over
    many tasks, and the rows of earlier ranges are added to the rank inside a range.

    The sorted rows are stored, so the ranges stay the same when a task is run again.
    """
    sort = [*[F.col(k) for k in keys], *order]
    ranges = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "ranked")
    sizes = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    ranked_rows = ranges.join(offsets, [*keys, "_range"]).withColumn(rank_col, (F.col("_before") + inside).cast("int"))
    return ranked_rows.select(*df.columns, rank_col)


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank_col: str, at_most: int) -> DataFrame:
    """Rank of every row within its keys (not null), for groups of ``at_most`` rows."""
    if at_most > TASK_ROWS:
        return _ranked_by_range(df, keys, order, rank_col)
    return df.withColumn(rank_col, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank", salts: int = SALTS
) -> DataFrame:
    """First ``n`` rows of every group with their rank, without one task per hot group.

    Each group is first cut to ``n`` rows in every one of ``salts`` slices (Spark already drops
    rows beyond ``n`` before either shuffle), so the task that ranks a group sees at most
    ``n * salts`` of its rows. Where that is still too much, groups are ranked by ranges.
    """
    if n * salts > TASK_ROWS:
        return _ranked_by_range(df, keys, order, rank_col).filter(F.col(rank_col) <= n)
    kept = df
    if salts > 1:
        kept = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        slices = W.partitionBy(*keys, "_salt").orderBy(*order)
        kept = kept.withColumn("_pos", F.row_number().over(slices)).filter(F.col("_pos") <= n)
        kept = kept.drop("_salt", "_pos")
    whole = W.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Row with the smallest ``order`` values within each key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def numbered(df: DataFrame, order: list[Column], index_col: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order: numbers inside the ranges of a stored range sort, after the
    rows of earlier ranges."""
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "numbered")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    joined = ranges.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, (F.col("_before") + inside + (start - 1)).alias(index_col))
