"""Numbers of rows that stay the same when files are read again."""

import pytest
from pyspark.sql import functions as F

from preptrail.llm.ordering import with_row_numbers


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.lit("x").alias("_index")).drop("_index").repartition(4).write.parquet(path)
    one = {r.id: r._row for r in with_row_numbers(spark.read.parquet(path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        some = with_row_numbers(spark.read.parquet(path).filter("id % 3 = 0"))
        two = {r.id: r._row for r in some.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(one.values())) == 1000 and two == {i: n for i, n in one.items() if i % 3 == 0}


def test_rows_without_places_of_their_own_are_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).write.parquet(path)
    files = spark.read.parquet(path)
    for df in (spark.range(50), files.union(files), files.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))), files.limit(0)):
        rows = with_row_numbers(df, "number")
        assert rows.columns == [*df.columns, "number"]
        assert rows.select("number").distinct().count() == rows.count() == df.count()
