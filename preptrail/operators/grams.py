"""Which texts contain which keys, through an inverted index of short character sequences.

A text that contains a key contains each of the key's grams. Every key therefore probes the index with
one gram, the one that fewest texts hold, and the texts found are verified. The index has a row per
character of a text at most for each gram length, however long the keys are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.session import cut_lineage

GRAM = 4


def gram_lengths(keys: DataFrame, key: str, gram: int = GRAM) -> Column:
    """The lengths of the keys below ``gram``, and ``gram`` for all others: a scalar array of few values."""
    return keys.agg(F.collect_set(F.least(F.length(key), F.lit(gram)))).scalar()


def with_grams(rows: DataFrame, text: str, lengths: Column) -> DataFrame:
    """One row per place and asked length, with the ``gram`` there. Both generators and the substring stay
    inside generated code, up to the join that drops the grams nobody asks for."""
    sized = rows.withColumn("_n", F.explode(lengths)).filter(F.col("_n") <= F.length(text))
    placed = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)))
    return placed.withColumn("gram", F.substr(F.col(text), F.col("_at"), F.col("_n"))).drop("_n", "_at")


def probes(keys: DataFrame, rows: DataFrame, key: str, text: str, gram: int = GRAM) -> DataFrame:
    """``key, gram``: for each distinct key the gram that occurs least often in ``rows``.

    A key shorter than ``gram`` is its own gram. Keys with a gram that no text holds drop out. Counts are
    combined before the shuffle, of the asked grams alone.
    """
    own = keys.select(F.col(key).alias("key")).distinct().withColumn("_length", F.least(F.length("key"), F.lit(gram)))
    places = F.explode(F.sequence(F.lit(1), F.length("key") - F.col("_length") + 1))
    asked = own.withColumn("_at", places).select("key", F.substr("key", F.col("_at"), F.col("_length")).alias("gram")).distinct()
    held = with_grams(rows.select(text), text, gram_lengths(keys, key, gram)).select("gram")
    counts = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rated = asked.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("key").agg(F.min(F.struct("n", "gram")).alias("_rarest")).filter("_rarest.n > 0")
    return rarest.select("key", F.col("_rarest.gram").alias("gram"))


def containing(keys: DataFrame, rows: DataFrame, key: str, text: str, gram: int = GRAM) -> DataFrame:
    """The rows whose ``text`` contains a key, as ``key`` and all columns of ``rows``.

    A row comes once for each place of the key's probe in its text. Empty and null keys find nothing.
    """
    stated = keys.filter(F.length(key) > 0)
    asked = cut_lineage(probes(stated, rows, key, text, gram), "probes")
    index = with_grams(rows, text, gram_lengths(stated, key, gram))
    return index.join(asked, "gram").filter(F.contains(F.col(text), F.col("key"))).select("key", *rows.columns)
