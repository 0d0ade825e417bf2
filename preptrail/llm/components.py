"""Connected components of a link table by repeated joins on the smallest label."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of ``links`` (``a, b`` long).

    Each round hangs every node's larger neighbours below its smallest one, then every node and its
    smaller neighbours below the smallest (alternating large and small stars): the links end as stars
    after a number of rounds that grows with the logarithm of the longest chain. A hot node's links
    are aggregated before and joined by key, never gathered in a row.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs, "links")
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: neighbours larger than the node link to the smallest of its neighbourhood.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large, "links")
        # Small star: the node and its smaller neighbours link to the smallest of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        small = cut_lineage(small.filter("a <> b").distinct(), "links")
        # Stars: no centre is linked to anything smaller and no node to two centres.
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(small.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.filter("up > 1 or (up = 1 and down = 1)").count():
            break
        pairs = small
    centres = small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
