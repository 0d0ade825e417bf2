"""Positions in a global order from per-partition totals, in DataFrame operations only."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.session import cut_lineage


def with_positions(df: DataFrame, order: list[Column], size: Column, row: str = "_row", before: str = "_before") -> DataFrame:
    """Add each row's number (from 0) and the sizes of all rows before it, in the order given.

    Rows are dealt to ranges of the order and numbered inside their range; one short table of a row
    per range holds what precedes it. The ranges are stored, so they are the same when a task runs
    again. Rows that are equal in every order column are dealt by their place in the input, so that
    no value fills a range alone; such rows get their numbers in any order. Null keys come first, a
    null size counts as 0. The names ``_place`` and ``_range`` are taken.
    """
    placed = df.withColumns({before: F.coalesce(size, F.lit(0)).cast("long"), "_place": F.monotonically_increasing_id()})
    sort = [*order, F.col("_place")]
    ranges = placed.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges, "ranges")
    totals = ranges.groupBy("_range").agg(F.count("*").alias("_rows"), F.sum(before).alias("_sizes"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_sizes").over(earlier), F.lit(0)).alias("_sizes"),
    )
    inside = W.partitionBy("_range").orderBy(*sort)
    sums = F.sum(before).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col(before)
    numbered = ranges.withColumns({row: F.row_number().over(inside).cast("long") - 1, before: sums})
    joined = numbered.join(F.broadcast(starts), "_range")  # one row per range
    joined = joined.withColumns({row: F.col(row) + F.col("_rows"), before: F.col(before) + F.col("_sizes")})
    return joined.drop("_range", "_place", "_rows", "_sizes")


def with_row_numbers(df: DataFrame, row: str = "_row") -> DataFrame:
    """Add a number to each row that stays the same when ``df`` is read again.

    Rows of files are known by their file and their place in it, and nothing is stored; the files' names,
    which the driver lists for any scan, are numbered there. What has no such places, or has some of them
    more than once, is stored with its numbers.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        return cut_lineage(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    names = sorted(r[0] for r in placed.select("_file").distinct().collect())  # one row per input file
    if not names or len(set(df.columns) & {"_file", "_index"}):
        return cut_lineage(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    files = df.sparkSession.createDataFrame(list(enumerate(names)), "_number long, _file string")
    numbered = placed.join(F.broadcast(files), "_file").withColumn(row, F.shiftleft("_number", 40) + F.col("_index"))
    if not numbered.groupBy(row).count().filter("count > 1").isEmpty():
        return cut_lineage(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return numbered.select(*df.columns, row)
