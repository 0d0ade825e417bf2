"""Writers for distributions, metadata, feeds, tables and vector tables."""

from pyspark.sql import Column, DataFrame, SparkSession

from preptrail.schemas import PREFERENCE_PAIRS
from preptrail.session import cut_lineage
from preptrail.sources.readers import path_exists
from preptrail.sources.versions import KeyedTable


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path, compression=compression)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows as they are; each new file has its own header and no copy is removed."""
    write_csv(df, path, "append")


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines with non-ASCII text kept as it is and null fields kept as null; such as ``gzip`` packs them,
    at the price of one task a file for their reader."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path, compression=compression)


def write_registry(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_preference_pairs(pairs: DataFrame, path: str) -> None:
    write_jsonl(pairs.select(*PREFERENCE_PAIRS.names), path)


def load_table(df: DataFrame, path: str, force: bool = False) -> bool:
    """Load a table once; a table with rows stays unless ``force`` replaces it.

    The new rows are staged in full before anything is replaced, so a failing plan leaves the old
    table as it was.
    """
    spark = df.sparkSession
    if not force and path_exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    staged = cut_lineage(df, "load") if path_exists(spark, path) else df
    staged.write.mode("overwrite").parquet(path)
    return True


def vector_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ["id"])


def rebuild_vectors(vectors: DataFrame, path: str) -> None:
    """Replace a whole vector table at once; the rows may come from it."""
    vector_table(vectors.sparkSession, path).rebuild(vectors)


def upsert_vectors(vectors: DataFrame, path: str, order: Column | None = None) -> None:
    """Add rows to a vector table; an id already stored takes its new row.

    ``order`` picks the row kept when the new rows repeat an id. Stored rows are not written again; once
    reads merge too many upserts, the table is compacted.
    """
    table = vector_table(vectors.sparkSession, path)
    table.upsert(vectors, order)
    if table.crowded():
        table.compact()
