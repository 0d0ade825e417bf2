"""Vectors of one label that are alike in direction: a join in epsilon grid order."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.llm.components import components
from preptrail.llm.ordering import with_positions
from preptrail.session import cut_lineage

COSINE = 0.93
#: Leading principal dimensions that order and bound the vectors, and the coordinates they are sought in.
AXES = 8
COVERED = 256
#: Rows of a block, rows of a stretch that is compared at once, and blocks of an interval one level up.
BLOCK = 2048
LEAF = 128
FAN = 8
#: Added to squared distances of at most 4, and the room around the threshold where cosines are computed anew.
SLACK = 1e-9
PLACED = "node long, label {label}, size int, copies long, embedding array<{item}>, cell array<int>"
BLOCKS = "label {label}, size int, block long, low array<double>, high array<double>, nodes binary, copies binary, vectors binary"


def sound(vector: Column) -> Column:
    """Whether a vector has components, all finite numbers, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def principal_axes(classes: DataFrame, size: int, count: int = AXES) -> np.ndarray:
    """``size`` rows and up to ``count`` orthonormal columns: the directions of most variance of the unit
    vectors with ``size`` components, among their first ``COVERED`` coordinates.

    Each task sums products of its rows; the rows of the summed matrix are added by key, so the driver
    reads ``COVERED`` rows at most.
    """
    width = min(size, COVERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if len(batch):
                rows = units(matrix(batch.column(0), size))[:, :width]
                total[:width] += rows.T @ rows
                total[width] += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"]
        )

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(r) for r in group["row"]])
        return pd.DataFrame({"i": key, "row": [rows.sum(axis=0).tobytes()]})

    own = classes.filter(F.col("size") == size)
    sums = own.select("embedding").mapInArrow(run, "i int, row binary").groupBy("i").applyInPandas(add, "i int, row binary")
    summed = np.zeros((width + 1, width))
    for i, row in sums.collect():  # COVERED + 1 rows at most
        summed[i] = np.frombuffer(row)
    rows = max(1, own.count())
    mean = summed[width] / rows
    _, directions = np.linalg.eigh(summed[:width] / rows - np.outer(mean, mean))
    axes = np.zeros((size, min(count, width)))
    axes[:width] = directions[:, ::-1][:, : axes.shape[1]]
    return axes


def axes_of(size: int, known: np.ndarray) -> np.ndarray:
    """The known axes for vectors of their size, the first coordinates for others."""
    return known if len(known) == size else np.eye(size)[:, :AXES]


def coordinates(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Places of unit vectors on the axes and, last, the length of what the axes leave."""
    on = rows @ axes
    return np.column_stack((on, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", on, on)))))


def apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Least squared distance between points of two boxes."""
    gap = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that links ``i, j`` reach, for each of ``n`` indexes."""
    heads = np.arange(n)
    while True:
        least = np.minimum(heads[i], heads[j])
        reached = heads.copy()
        np.minimum.at(reached, heads[i], least)
        np.minimum.at(reached, heads[j], least)
        reached = reached[reached]
        if np.array_equal(reached, heads):
            return heads
        heads = reached


class Side:
    """A block's vectors in grid order, and the boxes of its stretches."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.vectors, self.rows = vectors, units(vectors)
        at = coordinates(self.rows, axes)
        cuts = np.arange(0, len(at), LEAF)
        self.low, self.high = np.minimum.reduceat(at, cuts), np.maximum.reduceat(at, cuts)

    def box(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        return self.low[first:last].min(axis=0), self.high[first:last].max(axis=0)


def near_stretches(one: Side, two: Side, reach: float) -> Iterator[tuple[int, int]]:
    """Stretches of two blocks that may hold links: intervals are halved until they are one stretch or
    their boxes are too far apart. Of a block with itself each pair of stretches comes once."""
    open_ = [(0, len(one.low), 0, len(two.low))]
    while open_:
        a, b, c, d = open_.pop()
        if (one is two and a >= d) or apart(*one.box(a, b), *two.box(c, d)) > reach:
            continue
        if b - a == 1 and d - c == 1:
            if one is not two or a <= c:
                yield a, c
        elif b - a >= d - c:
            middle = (a + b) // 2
            open_ += [(a, middle, c, d), (middle, b, c, d)]
        else:
            middle = (c + d) // 2
            open_ += [(a, b, c, middle), (a, b, middle, d)]


def linked(one: Side, two: Side, a: int, c: int, cosine: float) -> np.ndarray:
    """Which vectors of two stretches reach the cosine; a stretch with itself gives each pair both ways."""
    x, y = slice(a * LEAF, (a + 1) * LEAF), slice(c * LEAF, (c + 1) * LEAF)
    like = one.rows[x] @ two.rows[y].T
    found = like >= cosine
    for i, j in np.argwhere(np.abs(like - cosine) < SLACK):
        v, w = one.vectors[x][i], two.vectors[y][j]
        found[i, j] = float(v @ w) / (float(np.sqrt(v @ v)) * float(np.sqrt(w @ w))) >= cosine
    if one is two and a == c:
        np.fill_diagonal(found, False)
    return found


def compare(one: Side, two: Side, copies: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of ``one`` followed by those of ``two`` (once, if the same): how many vectors each is
    linked to, copies included, and the first row that links reach."""
    shift = 0 if one is two else len(one.rows)
    n = shift + len(two.rows)
    counts = np.zeros(n, np.int64)
    edges = []
    for a, c in near_stretches(one, two, 2.0 - 2.0 * cosine + SLACK):
        found = linked(one, two, a, c, cosine)
        i, j = np.nonzero(found)
        if not len(i):
            continue
        x, y = i + a * LEAF, j + c * LEAF
        np.add.at(counts, x, copies[1][y])
        if one is not two or a != c:
            np.add.at(counts, y + shift, copies[0][x])
        height = len(found)
        heads = stars(height + found.shape[1], i, j + height)
        places = np.concatenate((np.arange(height) + a * LEAF, np.arange(found.shape[1]) + c * LEAF + shift))
        edges.append(np.stack((places, places[heads]))[:, heads != np.arange(len(heads))])
    i, j = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    return counts, stars(n, i, j)


def box_gap(one: str, two: str) -> Column:
    """Least squared distance between the boxes in the columns ``low`` and ``high`` of two structs."""
    gap = (
        f"transform(sequence(0, size({one}.low) - 1), k -> greatest(0d, {one}.low[k] - {two}.high[k], {two}.low[k] - {one}.high[k]))"
    )
    return F.expr(f"aggregate({gap}, 0d, (s, g) -> s + g * g)")


def near_blocks(boxes: DataFrame, reach: float) -> DataFrame:
    """``label, size, a, b`` (a <= b) of the blocks whose boxes are within reach.

    Blocks are joined from above: intervals of ``FAN`` times as many blocks each level, of which only the
    parts of near pairs meet on the level below.
    """
    levels = [cut_lineage(boxes.withColumnRenamed("block", "at"), "boxes")]
    width = AXES + 1
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("label", "size", F.floor(F.col("at") / FAN).alias("at"))
        low = F.filter(F.array(*(F.min(F.get("low", F.lit(k))) for k in range(width))), lambda x: x.isNotNull())
        high = F.filter(F.array(*(F.max(F.get("high", F.lit(k))) for k in range(width))), lambda x: x.isNotNull())
        levels.append(cut_lineage(up.agg(low.alias("low"), high.alias("high")), "boxes"))
    top = levels.pop()
    pairs = top.select("label", "size", F.col("at").alias("a"), F.col("at").alias("b"))
    for level in reversed(levels):
        above = F.floor(F.col("at") / FAN)
        one, two = (level.select("label", "size", above.alias(up), F.struct("at", "low", "high").alias(name)) for up, name in (("a", "x"), ("b", "y")))
        met = pairs.join(one, ["label", "size", "a"]).join(two, ["label", "size", "b"]).filter("x.at <= y.at").filter(box_gap("x", "y") <= reach)
        pairs = cut_lineage(met.select("label", "size", F.col("x.at").alias("a"), F.col("y.at").alias("b")), "near")
    return pairs


def block_links(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, cosine: float) -> DataFrame:
    """``node, links, head`` from each near pair of blocks: vectors a node is linked to there, copies
    included, and a node that these links reach."""
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    met = sides.join(blocks.select("label", "size", "block", "nodes", "copies", "vectors"), ["label", "size", "block"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        size, own = key[1], axes_of(key[1], axes)
        group = group.sort_values("block")
        nodes = [np.frombuffer(v, np.int64) for v in group["nodes"]]
        copies = [np.frombuffer(v, np.int64) for v in group["copies"]]
        parts = [Side(np.frombuffer(v).reshape(-1, size), own) for v in group["vectors"]]
        counts, heads = compare(parts[0], parts[-1], (copies[0], copies[-1]), cosine)
        node = np.concatenate(nodes)
        at = np.flatnonzero(counts)
        return pd.DataFrame({"node": node[at], "links": counts[at], "head": node[heads[at]]})

    columns = ["label", "size", "a", "b", "block", "nodes", "copies", "vectors"]
    return met.select(*columns).groupBy("label", "size", "a", "b").applyInPandas(run, "node long, links long, head long")


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row of ``vectors`` (``vec_id, embedding, label``).

    Two rows are linked if their labels are equal and the cosine of their vectors, in double precision,
    is at least ``cosine`` (positive). ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id that links reach, the row's own included.

    Equal vectors of a label are one class. Classes are sorted by label and by the cells of a grid on the
    leading principal dimensions, whose width is the distance of unit vectors at the threshold, and cut
    into blocks of the sequence. Intervals of blocks are joined recursively, first as tables, then inside
    a task down to short stretches; boxes around their vectors on these dimensions, and around the length
    of the rest, prove those apart that are skipped. A task gives counts and one link per vector that spans
    its part of a component, never all pairs.

    A vector that is null, empty, zero or holds null or non-finite components, or whose label is null, is
    linked with nothing and its own component. Vectors of different sizes are not linked; axes come from
    the commonest size. Rows that repeat an id are rows of their own; a null id is never the smallest, and
    the component of a row is null if all ids in it are. An empty table gives no rows; other columns are
    ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    kinds = {"label": rows.schema["label"].dataType.simpleString(), "item": rows.schema["embedding"].dataType.elementType.simpleString()}
    clean = rows.filter(F.col("label").isNotNull() & sound(F.col("embedding")))
    classes = clean.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.withColumns({"node": F.monotonically_increasing_id(), "size": F.size("embedding")})
    classes = cut_lineage(classes, "classes")
    sizes = classes.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    axes = principal_axes(classes, sizes["size"])
    width = float(np.sqrt(2.0 - 2.0 * cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            cells: list = [None] * len(batch)
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                rows = units(matrix(batch.column("embedding").take(pa.array(at)), size))
                grid = np.floor(rows @ axes_of(size, axes) / width).astype(np.int32)
                for i, cell in zip(at.tolist(), grid.tolist(), strict=True):
                    cells[i] = cell
            columns = [batch.column(c) for c in ("node", "label", "size", "copies", "embedding")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cells, pa.list_(pa.int32()))], names=["node", "label", "size", "copies", "embedding", "cell"]
            )

    placed = classes.select("node", "label", "size", "copies", "embedding").mapInArrow(place, PLACED.format(**kinds))
    ordered = with_positions(placed, [F.col("label"), F.col("size"), F.col("cell")], F.lit(0), "place", "_none")
    ordered = cut_lineage(ordered.select("node", "label", "size", "copies", "embedding", "place"), "sequence")
    starts = ordered.groupBy("label", "size").agg(F.min("place").alias("start"))
    block = F.floor((F.col("place") - F.col("start")) / BLOCK).alias("block")
    dealt = ordered.join(starts, ["label", "size"]).select("label", "size", block, "place", "node", "copies", "embedding")

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        values = np.stack([np.asarray(v, np.float64) for v in group["embedding"]])
        at = coordinates(units(values), axes_of(key[1], axes))
        binary = {c: [group[n].to_numpy(np.int64).tobytes()] for c, n in (("nodes", "node"), ("copies", "copies"))}
        box = {"low": [at.min(axis=0).tolist()], "high": [at.max(axis=0).tolist()]}
        return pd.DataFrame({"label": key[0], "size": key[1], "block": key[2], **box, **binary, "vectors": [values.tobytes()]})

    blocks = cut_lineage(dealt.groupBy("label", "size", "block").applyInPandas(gather, BLOCKS.format(**kinds)), "blocks")
    pairs = near_blocks(blocks.select("label", "size", "block", "low", "high"), 2.0 - 2.0 * cosine + SLACK)
    links = cut_lineage(block_links(blocks, pairs, axes, cosine), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("node").alias("a"), F.col("head").alias("b")))
    named = classes.select("node", "label", "embedding", "first", "copies").join(reached, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(least, "component").join(counts, "node", "left")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = cut_lineage(known, "linked")
    out = rows.join(known, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
