"""Company names matched against a large registry, without comparing every name with every row.

Names that are part of a registry entry are found through an index of short character sequences, probed
with the rarest one of each name. Work grows with registry plus names and what they have in common, not
with their product.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.functions import clean
from preptrail.operators.grams import containing
from preptrail.operators.ranking import top_n
from preptrail.session import cut_lineage

# --- Fixed values -----------------------------------------------------------
MIN_PREFIX = 3
MIN_CONTAINED = 4
EXACT, PREFIX, CONTAINED = 1, 2, 3
# ---------------------------------------------------------------------------

def normalized_registry(registry: DataFrame) -> DataFrame:
    """First row number per normalised name, in registry order; names that normalise to nothing drop out."""
    named = registry.filter(F.col("name").isNotNull()).select(clean.normalize_company(F.col("name")).alias("norm"), "row_no")
    return named.filter(F.col("norm") != "").groupBy("norm").agg(F.min("row_no").alias("row_no"))


def match_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry row for each name: exact, else first prefix match, else first containing match.

    ``registry`` has row_no and name; the result adds the tier and registry columns, and names
    without a match are kept with nulls.
    """
    keyed_names = names.select("company").distinct().withColumn("key", clean.normalize_company(F.col("company")))
    asked = cut_lineage(keyed_names, "names")
    rows = cut_lineage(normalized_registry(registry), "registry")
    exact = asked.join(rows.withColumnRenamed("norm", "key"), "key")
    exact = cut_lineage(exact.select("company", "row_no", F.lit(EXACT).alias("tier")), "exact")

    left = asked.join(exact, "company", "left_anti")
    # Names too short to be contained only start an entry; the others are found inside it, at its start or later.
    starts = F.substr("norm", F.lit(1), F.lit(MIN_PREFIX)).alias("key")
    short = rows.select(starts, F.lit(PREFIX).alias("tier"), "row_no").filter(F.length("key") == MIN_PREFIX)
    short = short.groupBy("key").agg(F.min(F.struct("tier", "row_no")).alias("best"))
    tier = F.when(F.startswith("norm", "key"), PREFIX).otherwise(CONTAINED).alias("tier")
    inside = containing(left.filter(F.length("key") >= MIN_CONTAINED), rows, "key", "norm").select("key", tier, "row_no")
    inside = inside.groupBy("key").agg(F.min(F.struct("tier", "row_no")).alias("best"))
    few = left.filter(F.length("key") == MIN_PREFIX).join(short, "key")
    loose = few.unionByName(left.join(inside, "key")).select("company", "best.row_no", "best.tier")

    details = registry.drop("company")
    matched = exact.unionByName(loose).join(details, "row_no")
    return asked.select("company").join(matched, "company", "left")


def company_meta(matches: DataFrame) -> DataFrame:
    """Matched rows in the shape of the company metadata table; unmatched names drop out."""
    return matches.filter(F.col("row_no").isNotNull()).select(
        "company",
        F.col("industry"),
        F.col("size_range"),
        F.col("employee_count"),
        F.col("year_founded"),
        F.col("locality"),
    )


def lookup_names(queries: DataFrame, registry: DataFrame, first_n: int | None = None) -> DataFrame:
    """Registry row whose name contains the query: an equal name, else the shortest, else none.

    All containing rows compete. ``first_n`` lets only the first so many in registry order compete,
    so that an equal name further down is missed.
    """
    asked = queries.select("company").distinct().withColumn("key", F.lower(clean.strip_space(F.col("company"))))
    asked = cut_lineage(asked.filter(F.col("key") != ""), "names")
    named = registry.filter(F.col("name").isNotNull())
    rows = named.select(
        "row_no",
        F.length("name").alias("size"),
        F.lower(clean.strip_space(F.col("name"))).alias("whole"),
        F.lower("name").alias("lowered"),
    )
    keyed = containing(asked, rows, "key", "lowered").select("key", "row_no", "size", "whole")
    if first_n is not None:
        keyed = top_n(keyed.distinct(), ["key"], [F.col("row_no")], first_n)
    inexact = F.when(F.col("whole") == F.col("key"), 0).otherwise(1)
    size = F.when(inexact == 1, F.col("size")).otherwise(0)
    best = keyed.groupBy("key").agg(F.min(F.struct(inexact.alias("inexact"), size.alias("size"), "row_no")).alias("best"))
    hits = asked.join(best, "key").select("company", "best.row_no", (F.col("best.inexact") == 0).alias("exact"))
    return hits.join(named.drop("company"), "row_no").select(
        "company",
        "row_no",
        "name",
        "exact",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("industry", "size_range", "locality")],
        *[F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c) for c in ("employee_count", "year_founded")],
    )


def new_company_meta(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to append to the metadata table: companies resolved now that it does not hold yet."""
    columns = S.COMPANY_META.fieldNames()
    return found.select(*columns).join(known.select("company"), "company", "left_anti").select(*columns)
