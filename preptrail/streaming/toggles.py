"""Progress kept up to date from a stream of toggles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from preptrail.operators.tracks import progress_from_toggles
from preptrail.sources.versions import KeyedTable

#: Key of a stored state, and the column that tells one toggle from another.
KEYS = ["user_id", "item_id"]
TOGGLE_ID = "toggle_id"


def progress_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, KEYS)


def progress_stream(toggles: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of every (user, item) in a keyed table, micro-batch by micro-batch.

    Toggles with a ``toggle_id`` count once, however often and in whatever batch they are delivered: the
    stream's state remembers their ids. Update mode sends only keys touched by the batch, which the table
    takes as a delta; a batch that is retried after it was stored is not stored again. When reads would
    merge too many deltas the table is compacted, so what :func:`latest_progress` reads is bounded by the
    number of keys, not of batches.
    """
    once = toggles.dropDuplicates([TOGGLE_ID]) if TOGGLE_ID in toggles.columns else toggles

    def write(batch: DataFrame, batch_id: int) -> None:
        table = progress_table(batch.sparkSession, target)
        table.upsert(batch, batch=batch_id)
        if table.crowded():
            table.compact()

    return (
        progress_from_toggles(once)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """Newest state of every (user, item)."""
    return progress_table(spark, path).read().select(*KEYS, "n_toggles", "is_completed")
