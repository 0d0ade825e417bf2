"""Offline build: typed catalogue, distributions, metadata and vector table as stored tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.operators import catalogue, distributions, encode, registry
from preptrail.operators.encode import TextEncoder
from preptrail.session import cut_lineage
from preptrail.sources import readers, writers
from preptrail.sources.versions import read_set, write_set


def load_catalogue(feed: DataFrame, order: Column, path: str, force: bool = False) -> bool:
    """Store the companies and problems of a feed once; ``force`` replaces them, both at the same time.

    A load that fails on the way leaves both as they were.
    """
    companies = cut_lineage(catalogue.company_keys(feed, order), "companies")
    problems = catalogue.with_company_key(catalogue.typed_problems(feed), companies)
    return write_set({"companies": companies, "problems": problems}, path, force)


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored companies and problems."""
    return read_set(spark, path, "companies"), read_set(spark, path, "problems")


def store_distributions(feed: DataFrame, path: str) -> None:
    writers.write_csv(distributions.difficulty_distribution(feed), path)


def store_company_meta(names: DataFrame, registry_rows: DataFrame, path: str) -> None:
    writers.write_csv(registry.company_meta(registry.match_names(names, registry_rows)), path)


def append_company_meta(spark: SparkSession, found: DataFrame, path: str) -> None:
    """Append companies resolved at request time, unless the table already knows them."""
    known = readers.read_company_meta(spark, path)
    known = known if known is not None else spark.createDataFrame([], S.COMPANY_META)
    writers.append_csv(registry.new_company_meta(found, known), path)


def store_problem_vectors(problems: DataFrame, encoder: TextEncoder, path: str) -> None:
    writers.upsert_vectors(encode.problem_index(problems, encoder), path, F.col("title"))


def store_solution_vectors(solutions: DataFrame, encoder: TextEncoder, path: str) -> None:
    writers.rebuild_vectors(encode.solution_index(solutions, encoder), path)
