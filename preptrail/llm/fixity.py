"""Fixity of archive replicas: Merkle trees over ordered offset ranges, compared from the roots down."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.llm.ordering import with_positions
from preptrail.session import cut_lineage

#: A leaf covers 2**LEAF_BITS bytes of an archive, a branch 2**FAN_BITS nodes of the level below, and
#: the root of LEVELS levels an archive of up to 2**(LEAF_BITS + FAN_BITS * LEVELS) bytes (256 TiB).
LEAF_BITS = 16
FAN_BITS = 8
LEVELS = 4
STATUS = ["altered", "missing", "extra"]


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as one WARC/1.0 resource record, in bytes. Null parts are empty."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def with_offsets(records: DataFrame, order: list[Column], size: Column, per_archive: int) -> DataFrame:
    """Add ``archive`` (``per_archive`` records each) and ``offset`` in it, in the order given."""
    placed = with_positions(records, order, size)
    placed = placed.withColumn("archive", F.floor(F.col("_row") / per_archive).cast("long"))
    firsts = placed.groupBy("archive").agg(F.min("_before").alias("_first"))
    out = placed.join(firsts, "archive").withColumn("offset", F.col("_before") - F.col("_first"))
    return out.drop("_row", "_before", "_first")


def record_hashes(records: DataFrame) -> DataFrame:
    """``archive, offset, digest, n``: one hash for all records (``digest``) at an offset, and their number.

    An offset of a sound archive has one record. More of them, up to any number, are folded by
    aggregates over their digests, so that no offset gathers rows.
    """
    typed = records.select(
        F.coalesce("archive", F.lit(-1)).cast("long").alias("archive"),
        F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"),
        F.coalesce("digest", F.lit("")).alias("digest"),
    )
    lane = lambda i: F.conv(F.substring(F.sha2(F.concat("digest", F.lit(i)), 256), 1, 12), 16, 10).cast("long")
    folded = typed.groupBy("archive", "offset").agg(
        F.count("*").alias("n"),
        F.min("digest").alias("_low"),
        F.max("digest").alias("_high"),
        *[F.sum(lane(str(i)).cast("decimal(38,0)")).alias(f"_sum{i}") for i in range(2)],
    )
    several = F.sha2(F.concat_ws(":", "_low", "_high", "n", "_sum0", "_sum1"), 256)
    return folded.select("archive", "offset", F.when(F.col("n") == 1, F.col("_low")).otherwise(several).alias("digest"), "n")


def merkle_levels(hashes: DataFrame) -> list[DataFrame]:
    """``archive, node, hash`` of every level, from the leaves (offset ranges) to the root (node 0 for
    offsets within its reach). A node's hash is over its children's numbers and hashes in order; a node
    has at most 2**FAN_BITS children, a leaf at most 2**LEAF_BITS."""
    below = hashes.select("archive", F.col("offset").alias("_child"), "digest")
    levels = []
    for level in range(LEVELS + 1):
        bits = LEAF_BITS if level == 0 else FAN_BITS
        children = F.array_sort(F.collect_list(F.struct("_child", "digest")))
        listed = F.transform(children, lambda c: F.concat_ws(":", c["_child"].cast("string"), c["digest"]))
        nodes = below.withColumn("node", F.shiftright("_child", bits)).groupBy("archive", "node").agg(
            F.sha2(F.concat_ws(",", listed), 256).alias("hash")
        )
        levels.append(nodes)
        below = nodes.select("archive", F.col("node").alias("_child"), F.col("hash").alias("digest"))
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """``archive, offset, status`` of the offsets at which two replicas differ.

    Both have ``archive, offset, digest`` for each record. Trees are built over the offsets; roots are
    compared, and only the children of nodes that differ are compared next, down to the records.
    ``status`` is altered, missing (only in the original) or extra (only in the replica).

    Null archives, offsets and digests are a value of their own; repeated rows at an offset count by
    their number and digests; equal or empty tables give no rows; other columns are ignored.
    """
    sides = [cut_lineage(record_hashes(side), "records") for side in (original, replica)]
    trees = [[cut_lineage(level, "merkle") for level in merkle_levels(side)] for side in sides]
    suspects: DataFrame | None = None
    for level in range(LEVELS, -1, -1):
        left, right = (tree[level] for tree in trees)
        if suspects is not None:
            left, right = (_below(side, suspects, "node", FAN_BITS) for side in (left, right))
        suspects = cut_lineage(_differing(left, right, "node", "hash").select("archive", "node"), "suspects")
    left, right = (_below(side, suspects, "offset", LEAF_BITS) for side in sides)
    found = _differing(left, right, "offset", "digest")
    status = F.when(F.col("_other").isNull(), "missing").when(F.col("_own").isNull(), "extra").otherwise("altered")
    return found.select("archive", "offset", status.alias("status"))


def _below(side: DataFrame, suspects: DataFrame, name: str, bits: int) -> DataFrame:
    parents = suspects.withColumnRenamed("node", "_parent")
    return side.withColumn("_parent", F.shiftright(name, bits)).join(parents, ["archive", "_parent"], "left_semi").drop("_parent")


def _differing(left: DataFrame, right: DataFrame, name: str, value: str) -> DataFrame:
    one = left.select("archive", name, F.col(value).alias("_own"))
    two = right.select("archive", name, F.col(value).alias("_other"))
    return one.join(two, ["archive", name], "full_outer").filter(~F.col("_own").eqNullSafe(F.col("_other")))
