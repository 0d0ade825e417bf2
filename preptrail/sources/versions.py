"""Tables that switch from one state to the next at once, and tables that take new rows without a rewrite.

A state is a small manifest that names data folders. Data folders are written in full before the manifest
that names them and never change afterwards, so a reader sees the old state or the new one, and a plan that
fails leaves the old one.
"""

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from preptrail.operators.ranking import first_per_key
from preptrail.session import settings

#: Parts of a keyed table that are compacted one by one.
BUCKETS = 16
#: Files that a task writes at once.
MAX_WRITERS = 64
#: Deltas that a read merges at most before the table is compacted.
DELTAS = 8


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, place = _files(spark, f"{path}/_states")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def state(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest, or nothing if there is none yet."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    files, place = _files(spark, f"{path}/_states/{numbers[-1]:012}.json")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, manifest: dict, after: int) -> None:
    """Make ``manifest`` the state that follows number ``after``; fails if another writer was first."""
    target = f"{path}/_states/{after + 1:012}.json"
    files, draft = _files(spark, f"{path}/_states/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps({**manifest, "number": after + 1}).encode()))
    stream.close()
    _, place = _files(spark, target)
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise RuntimeError(f"{path} was changed by another writer")


def _number(manifest: dict | None) -> int:
    return manifest["number"] if manifest else 0


def remove_unused(spark: SparkSession, path: str) -> int:
    """Delete the data folders that the newest state does not name; their number. Readers of older states and
    writers must be done."""
    manifest = state(spark, path)
    files, place = _files(spark, f"{path}/data")
    if manifest is None or not files.exists(place):
        return 0
    named = json.dumps(manifest)
    gone = [status.getPath() for status in files.listStatus(place) if status.getPath().getName() not in named]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


# --- Sets of tables that change together -------------------------------------


def write_set(tables: dict[str, DataFrame], path: str, force: bool = False) -> bool:
    """Store tables that belong together; readers see all of them or none.

    A set with rows in any of its tables stays unless ``force`` replaces it; the result says whether the
    tables were stored.
    """
    spark = next(iter(tables.values())).sparkSession
    old = state(spark, path)
    if old and not force and any(not read_set(spark, path, name).isEmpty() for name in old["tables"]):
        return False
    folders = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{folders[name]}")
    commit(spark, path, {"tables": folders}, _number(old))
    return True


def read_set(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the newest state of a set."""
    return spark.read.parquet(f"{path}/data/{state(spark, path)['tables'][name]}")


# --- Keyed tables: new versions are appended and merged when read ---------------


class KeyedTable:
    """Rows by key, in buckets. An upsert appends its rows as a delta; a read takes the newest row of a key.

    A bucket is compacted by itself: its rows and their newer versions become its new base, while the
    files of the other buckets stay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def _write(self, df: DataFrame, buckets: int) -> str:
        folder = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        # A task writes to all buckets at once, so wide rows are not sorted by bucket.
        writers = {"spark.sql.maxConcurrentOutputFileWriters": str(buckets), "spark.sql.optimizer.plannedWrite.enabled": "false"}
        with settings(self.spark, writers if buckets <= MAX_WRITERS else {}):
            df.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def _held(self, folder: str) -> list[int]:
        files, place = _files(self.spark, f"{self.path}/data/{folder}")
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return sorted(int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket="))

    def _read(self, folders: dict[str, list[int]], schema: StructType) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for folder, buckets in folders.items() for b in buckets]
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty

    def rebuild(self, df: DataFrame, buckets: int = BUCKETS) -> None:
        """Replace all rows; ``df`` may read the table itself."""
        old = state(self.spark, self.path)
        folder = self._write(df, buckets)
        base = {str(b): folder for b in self._held(folder)}
        schema = df.schema.json()
        commit(self.spark, self.path, {"schema": schema, "buckets": buckets, "base": base, "deltas": [], "batch": None}, _number(old))

    def upsert(self, df: DataFrame, order: Column | None = None, batch: int | None = None) -> bool:
        """Add rows; a key already stored takes its new row. ``order`` picks the row kept when keys repeat.

        With ``batch``, a number that grows, a batch that was stored before is not stored again; the result
        says whether it was. New columns are null in older rows, and the other way round.
        """
        old = state(self.spark, self.path)
        if old is None:
            self.rebuild(df.limit(0))
            old = state(self.spark, self.path)
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return False
        rows = first_per_key(df, self.keys, [order if order is not None else F.xxhash64(*df.columns)])
        schema = self._schema(old)
        fields = [f for f in rows.schema.fields if f.name not in schema.names]
        for field in fields:
            schema = schema.add(field.name, field.dataType)
        folder = self._write(rows, old["buckets"])
        delta = {"folder": folder, "buckets": self._held(folder), "number": old["number"] + 1}
        manifest = {**old, "schema": schema.json(), "deltas": [*old["deltas"], delta], "batch": batch if batch is not None else old["batch"]}
        commit(self.spark, self.path, manifest, old["number"])
        return True

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    def _merged(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self._schema(manifest)
        wanted = range(manifest["buckets"]) if buckets is None else buckets
        base: dict[str, list[int]] = {}
        for bucket, folder in manifest["base"].items():
            if int(bucket) in wanted:
                base.setdefault(folder, []).append(int(bucket))
        rows = self._read(base, schema)
        parts = [
            self._read({d["folder"]: [b for b in d["buckets"] if b in wanted]}, schema).withColumn("_number", F.lit(d["number"]))
            for d in manifest["deltas"]
        ]
        if not parts:
            return rows
        newer = parts[0]
        for part in parts[1:]:
            newer = newer.union(part)
        rest = [c for c in schema.names if c not in self.keys]
        newest = newer.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_number").alias("_row"))
        newest = newest.select(*self.keys, "_row.*").select(*schema.names)
        # Only the keys of the deltas meet the base, whose rows stay where they are if those are few.
        return rows.join(newer.select(*self.keys).distinct(), self.keys, "left_anti").select(*schema.names).union(newest)

    def read(self) -> DataFrame:
        """The newest row of each key."""
        return self._merged(state(self.spark, self.path))

    def compact(self, buckets: list[int] | None = None) -> None:
        """Fold the deltas of some buckets (all by default) into new base files of these buckets alone."""
        old = state(self.spark, self.path)
        wanted = list(range(old["buckets"])) if buckets is None else buckets
        changed = [b for b in wanted if any(b in d["buckets"] for d in old["deltas"])]
        if not changed:
            return
        folder = self._write(self._merged(old, changed), old["buckets"])
        base = {b: f for b, f in old["base"].items() if int(b) not in changed} | {str(b): folder for b in self._held(folder)}
        deltas = [{**d, "buckets": [b for b in d["buckets"] if b not in changed]} for d in old["deltas"]]
        commit(self.spark, self.path, {**old, "base": base, "deltas": [d for d in deltas if d["buckets"]]}, old["number"])

    def crowded(self, deltas: int = DELTAS) -> bool:
        """Whether a read merges more deltas than it should."""
        manifest = state(self.spark, self.path)
        return manifest is not None and len(manifest["deltas"]) > deltas
