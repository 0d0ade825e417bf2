"""Contiguous shards of nearly equal bytes from global prefix sums."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.llm.ordering import with_positions


def shard_by_bytes(df: DataFrame, order: list[Column], size: Column, shards: int) -> DataFrame:
    """Cut the ordered rows at equal byte targets; add ``shard`` and ``slot`` (gapless from 0).

    A row goes to the shard in which the middle of its bytes lies, so a shard differs from the target
    by at most one row at either end. Shards are contiguous in the order. A null size counts as 0, a
    row larger than a target fills shards alone (others then stay empty), rows that are equal in the
    order take neighbouring places, an empty table gives no rows. All input columns are kept; columns
    named ``shard`` or ``slot`` are replaced.

    Every group in here is a range of the sorted table or one of ``shards`` numbers.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = df.drop("shard", "slot")
    keys = [c.alias(f"_key{i}") for i, c in enumerate(order)]
    bare = kept.select(F.struct(*kept.columns).alias("_input"), size.cast("long").alias("_size"), *keys)
    placed = with_positions(bare, [F.col(f"_key{i}") for i in range(len(order))], F.col("_size"))
    # Twice the middle of the row against twice the total keeps the cut in whole numbers.
    middle = 2 * F.col("_before") + F.coalesce(F.col("_size"), F.lit(0))
    total = bare.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_total"))
    cut = F.expr(f"cast(least({shards - 1}, (_middle * {shards}) div greatest(1, 2 * _total)) as int)")
    sharded = placed.withColumn("_middle", middle).join(F.broadcast(total)).withColumn("shard", cut)
    firsts = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))
    slotted = sharded.join(F.broadcast(firsts), "shard")  # at most one row per shard
    return slotted.select("_input.*", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
