"""Cells around pivots: which parts of an index a query can be answered from.

Rows of a large group are dealt to the nearest of the group's pivots, rows of the index themselves. A cell
knows how far its rows lie from its pivot, so by the triangle inequality no row of it scores better than a
bound. Queries first meet the cells next to them; the scores found there say which others they still need.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell on average, and the most cells in all, whose pivots and bounds are sent to the tasks.
CELL_ROWS = 64
MAX_CELLS = 4096
#: Rows of a block of cells that lie next to each other, which a query visits once for all of them.
BLOCK_ROWS = 50_000
#: Bounds that a task holds at a time.
STEP = 1_000_000
#: Rows of the nearest cells that a query meets first, as a multiple of the rows it asks for.
FIRST_ROWS = 2
#: Bounds and scores are compared with this much room for rounding.
SLACK = 1e-8


@dataclass
class Cells:
    """The pivots of each large group and, for each of them, its rows and how far from it they lie."""

    metric: str
    pivots: dict[tuple, np.ndarray]
    rows: dict[tuple, np.ndarray]
    reach: dict[tuple, np.ndarray]
    near: dict[tuple, np.ndarray]
    block_rows: int

    def blocks(self, key: tuple) -> np.ndarray:
        """The block of each cell, ascending."""
        held = self.rows[key]
        return ((np.cumsum(held) - held) // self.block_rows).astype(np.int32)

    def bounds(self, key: tuple, queries: np.ndarray) -> np.ndarray:
        """For each query and cell of a group the best score that a row of the cell can have."""
        pivots, reach, near = self.pivots[key], self.reach[key], self.near[key]
        if self.metric == "dot":
            best = queries @ pivots.T + np.linalg.norm(queries, axis=1)[:, None] * reach
        else:
            apart = distances(queries, pivots)
            # Rows of a cell are nearer to its pivot than to the query's, so they lie beyond the plane between both.
            home = apart.argmin(axis=1)
            between = distances(pivots, pivots)[home]
            ahead = apart**2 - apart[np.arange(len(queries)), home][:, None] ** 2
            beyond = np.divide(ahead, 2 * between, out=np.zeros_like(ahead), where=between > 0)
            best = -np.maximum(beyond, np.maximum(0.0, np.maximum(apart - reach, near - apart)))
        return np.where(self.rows[key] > 0, best, -np.inf)

    def first(self, key: tuple, queries: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The cells that each query meets first: the nearest ones that hold enough rows."""
        pivots = self.pivots[key]
        order = np.argsort(-(queries @ pivots.T) if self.metric == "dot" else distances(queries, pivots), axis=1, kind="stable")
        held = np.cumsum(self.rows[key][order], axis=1)
        before = held - self.rows[key][order]
        chosen = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < FIRST_ROWS * (k[:, None] + 1), axis=1)
        return chosen & (self.rows[key] > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        out += (a[:, axis, None] - b[None, :, axis]) ** 2
    return np.sqrt(out)


def unpacked(column: pa.BinaryArray, dim: int) -> np.ndarray:
    """Vectors that are stored as the bytes of their single-precision values; none is missing."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]] if len(column) else np.zeros(0, np.uint8)
    return held.view(np.float32).reshape(len(column), dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return unpacked(column, dim).astype(float)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), dim)


def plain(value: object) -> object:
    return value.item() if isinstance(value, np.generic) else value


def group_rows(batch: pa.RecordBatch, on: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key of each group in a batch and the places of its rows; rows with a null key are left out."""
    if not on:
        yield (), np.arange(len(batch))
        return
    keys = pd.DataFrame({c: batch.column(batch.schema.get_field_index(c)).to_pandas() for c in on})
    for key, places in keys.groupby(on, sort=False).indices.items():
        yield tuple(plain(v) for v in (key if isinstance(key, tuple) else (key,))), np.asarray(places)


def choose_pivots(index: DataFrame, id_col: str, vector: str, on: list[str]) -> dict[tuple, np.ndarray]:
    """About one row of each ``CELL_ROWS`` of the groups that need more than one cell, drawn by hashes of ids.

    There are at most ``MAX_CELLS`` in expectation; groups too small for one of them stay whole.
    """
    sizes = index.groupBy(*on).agg(F.count("*").alias("_n")) if on else index.agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    per_cell = max(CELL_ROWS, -(-total // MAX_CELLS))
    if on:
        large = sizes.filter(F.col("_n") >= 2 * per_cell).select(*on)
        some = index.join(F.broadcast(large), on, "left_semi")  # at most MAX_CELLS / 2 groups
    else:
        some = index if total >= 2 * per_cell else index.limit(0)
    luck = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(per_cell)) == 0
    pivots: dict[tuple, list] = {}
    for row in some.filter(luck).select(*on, vector).collect():
        point = np.frombuffer(row[-1], np.float32) if isinstance(row[-1], (bytes, bytearray)) else row[-1]
        pivots.setdefault(tuple(row[:-1]), []).append(point)
    distinct = {key: np.unique(np.array(rows, dtype=float), axis=0) for key, rows in pivots.items()}
    return {key: rows for key, rows in distinct.items() if len(rows) > 1}


def with_cells(index: DataFrame, vector: str, on: list[str], pivots: dict[tuple, np.ndarray], dim: int) -> DataFrame:
    """Add ``_cell``, the nearest pivot's number (0 in groups without pivots), and ``_apart``, its distance."""
    schema = T.StructType([*index.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_apart", T.DoubleType())])
    sent = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.schema.get_field_index(vector)), dim)
            cell, apart = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for key, places in group_rows(batch, on):
                if key in sent.value:
                    far = distances(rows[places], sent.value[key])
                    cell[places] = far.argmin(axis=1)
                    apart[places] = far[np.arange(len(places)), cell[places]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], names=schema.names)

    return index.mapInArrow(run, schema)


def measured(placed: DataFrame, on: list[str], pivots: dict[tuple, np.ndarray], metric: str, block_rows: int = BLOCK_ROWS) -> Cells:
    """The cells of the groups with pivots, with their rows' number and distances."""
    rows = {key: np.zeros(len(p), np.int64) for key, p in pivots.items()}
    reach, near = ({key: np.zeros(len(p)) for key, p in pivots.items()} for _ in range(2))
    if pivots:
        stats = placed.groupBy(*on, "_cell").agg(F.count("*"), F.max("_apart"), F.min("_apart"))
        wide = placed.groupBy(*on).agg(F.max("_cell").alias("_last")).filter("_last > 0") if on else None
        stats = stats.join(F.broadcast(wide.select(*on)), on, "left_semi") if on else stats
        for row in stats.collect():  # as many as there are cells
            key, cell = tuple(row[: len(on)]), row["_cell"]
            if key in pivots:
                rows[key][cell], reach[key][cell], near[key][cell] = row[len(on) + 1 :]
    return Cells(metric, pivots, rows, reach, near, block_rows)


def in_blocks(placed: DataFrame, on: list[str], cells: Cells) -> DataFrame:
    """Add ``_block`` to rows with cells, 0 in groups without pivots."""
    names = [*on, "_cell", "_block"]
    rows = [(*key, cell, int(block)) for key in cells.pivots for cell, block in enumerate(cells.blocks(key))]
    schema = T.StructType([*(placed.schema[c] for c in names[:-1]), T.StructField("_block", T.IntegerType())])
    known = F.broadcast(placed.sparkSession.createDataFrame(rows, schema))  # as many as there are cells
    return placed.join(known, names[:-1], "left").withColumn("_block", F.coalesce("_block", F.lit(0)))


def block_visits(asked: DataFrame, vector: str, on: list[str], cells: Cells, dim: int, least: Column | None = None) -> DataFrame:
    """A row of ``asked`` for each block that it is to visit, with the ``_block`` and the ``_cells`` it meets there.

    Without ``least`` these are the cells next to the query. With it, the least score that still counts, they
    are the others whose bound reaches it; it is returned as ``_least``.
    """
    sent, bounded = asked.sparkSession.sparkContext.broadcast(cells), least is not None
    rows = asked if least is None else asked.withColumn("_least", F.coalesce(least, F.lit(float("-inf"))))
    added = [T.StructField("_block", T.IntegerType()), T.StructField("_cells", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*rows.schema.fields, *added])

    def met(batch: pa.RecordBatch, places: np.ndarray, blocks: np.ndarray, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            part = chosen[:, first:last]
            row, cell = np.nonzero(part)
            wanted, counts = np.unique(row, return_counts=True)
            if len(wanted):
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(cell + first, pa.int32())
                )
                block = pa.array(np.full(len(wanted), blocks[first]), pa.int32())
                columns = batch.take(pa.array(places[wanted])).columns
                yield pa.RecordBatch.from_arrays([*columns, block, lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            points = matrix(batch.column(batch.schema.get_field_index(vector)), dim)
            k = batch.column(batch.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
            for key, every in group_rows(batch, on):
                if key not in known.pivots:
                    if not bounded:
                        yield from met(batch, every, np.zeros(1, np.int32), np.ones((len(every), 1), dtype=bool))
                    continue
                blocks, step = known.blocks(key), max(1, STEP // len(known.pivots[key]))
                for first in range(0, len(every), step):
                    places = every[first : first + step]
                    near = known.first(key, points[places], k[places])
                    if bounded:
                        wanted = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)[places]
                        near = ~near & (known.rows[key] > 0) & (known.bounds(key, points[places]) >= wanted[:, None] - SLACK)
                    yield from met(batch, places, blocks, near)

    return rows.mapInArrow(run, schema)


def visits(asked: DataFrame, vector: str, on: list[str], cells: Cells, dim: int, least: Column | None = None) -> DataFrame:
    """A row of ``asked`` for each cell that it is to meet, with the ``_cell``, as ``block_visits`` chooses them."""
    met = block_visits(asked, vector, on, cells, dim, least)
    return met.select(*asked.columns, F.explode("_cells").alias("_cell"))
