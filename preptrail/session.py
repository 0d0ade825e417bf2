"""Session settings and the shared scratch folder used to cut lineage."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall back to a folder
    of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="preptrail-scratch-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def scratch_mark() -> int:
    """A point in the list of intermediate tables, for ``release_scratch``."""
    return len(_written)


def release_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the intermediate tables written so far, or after ``since``, a mark; their number.

    Call it once the results that were made from them are written. Results that are still to be
    computed read these tables and fail afterwards; those that ``keep`` reads stay. A mark holds until an
    earlier one is released.
    """
    read = keep.inputFiles() if keep is not None else []
    held = [p for p in _written[since:] if any(p.rpartition("/")[2] in file for file in read)]
    paths, _written[since:] = [p for p in _written[since:] if p not in held], held
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores when its files give fewer tasks than there are cores.

    Meant for a plain scan ahead of per-row work (parsing, encoding) that costs far more than
    moving the row once. A scan with enough tasks is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def few(df: DataFrame, at_most: int) -> DataFrame:
    """``df``, marked for broadcast if it has ``at_most`` rows: a count of rows where the optimizer only guesses bytes."""
    return F.broadcast(df) if df.limit(at_most + 1).count() <= at_most else df


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages then restart from files instead of recomputing the plan when an executor is
    lost, and the optimizer sees the measured size of the result.
    """
    path = scratch_path(df.sparkSession, label)
    # What was shuffled to make the table is of no use once it is written.
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
