"""Readers for feeds, registries, distributions, metadata and stored tables."""

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.sources.versions import KeyedTable

log = logging.getLogger(__name__)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_problem_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Problem feed with a header; every column is text.

    ``multiline`` accepts line breaks inside quotes, at the price of one task per file.
    """
    options = {"header": True, "escape": '"', "multiLine": multiline}
    return _as_feed(spark.read.options(**options).csv(path))


def read_problem_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Problem feed with one JSON object per line; blank lines are ignored."""
    return spark.read.schema(S.RAW_FEED).json(path)


def _as_feed(df: DataFrame) -> DataFrame:
    empty = df.sparkSession.createDataFrame([], S.RAW_FEED)
    known = df.select(*[c for c in df.columns if c in S.RAW_FEED.names])
    return empty.unionByName(known, allowMissingColumns=True)


def read_problem_feed(spark: SparkSession, enriched: str, plain: str) -> DataFrame | None:
    """Enriched JSON lines if they exist, else the CSV feed (bodies may hold line breaks), else nothing."""
    if path_exists(spark, enriched):
        return read_problem_jsonl(spark, enriched)
    if path_exists(spark, plain):
        return read_problem_csv(spark, plain, multiline=True)
    log.warning("neither %s nor %s exists", enriched, plain)
    return None


def trim_registry(raw: DataFrame) -> DataFrame:
    """Wanted registry columns that are present, rows with a name only."""
    kept = [c for c in S.REGISTRY_COLUMNS if c in raw.columns]
    if not kept:
        raise ValueError(f"no registry column among {raw.columns}")
    missing = [c for c in S.REGISTRY_COLUMNS if c not in kept]
    if missing:
        log.warning("registry columns not found: %s", missing)
    return raw.select(*kept).filter(F.col("name").isNotNull())


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    return trim_registry(spark.read.option("header", True).option("escape", '"').csv(path))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Stored registry in the names used by the matchers, in the order of its rows.

    ``row_no`` grows with the file, by name, and the row's place in it, so it stays the same whenever the
    table is read, however it is split into tasks.
    """
    stored = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    names = sorted(r[0] for r in stored.select("file_name").distinct().collect())  # one row per file
    files = spark.createDataFrame(list(enumerate(names)), "_number long, file_name string")
    placed = stored.join(F.broadcast(files), "file_name")
    return registry_rows(placed, F.shiftleft("_number", 40) + F.col("row_index"))


def registry_rows(stored: DataFrame, row_no: Column) -> DataFrame:
    """Registry in the names used by the matchers; ``row_no`` is its order."""

    def text(name: str) -> Column:
        return (F.col(f"`{name}`") if name in stored.columns else F.lit(None)).cast("string")

    return stored.select(
        row_no.alias("row_no"),
        "name",
        text("industry").alias("industry"),
        text("size range").alias("size_range"),
        text("current employee estimate").alias("employee_count"),
        text("year founded").alias("year_founded"),
        text("locality").alias("locality"),
    )


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DISTRIBUTIONS).option("header", True).csv(path)


def read_company_meta(spark: SparkSession, path: str) -> DataFrame | None:
    """Metadata table, or nothing when it is missing or empty; appended copies are resolved later."""
    if not path_exists(spark, path):
        return None
    meta = spark.read.schema(S.COMPANY_META).option("header", True).option("escape", '"').csv(path)
    return None if meta.isEmpty() else meta


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SOLUTION_FEED).json(path)


def read_preference_pairs(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Preference pairs from JSON lines, or from a file that is one JSON array."""
    return spark.read.schema(S.PREFERENCE_PAIRS).option("multiLine", array).json(path)


def read_vectors(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Newest rows of a vector table."""
    df = KeyedTable(spark, path, ["id"]).read()
    return df if where is None else df.filter(where)


def read_table(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Stored table; a filter on it reaches the scan."""
    df = spark.read.parquet(path)
    return df if where is None else df.filter(where)
