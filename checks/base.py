"""Registration of queries and their SQL twins, and the SQL pieces they share."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def with_ctes(*ctes: str) -> str:
    """``WITH`` clause of the given ``name AS (...)`` pieces, each once, in order."""
    return "WITH " + ",\n".join(dict.fromkeys(part for c in ctes for part in (c if isinstance(c, tuple) else (c,))))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sql_r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::DOUBLE)"
