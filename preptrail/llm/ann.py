"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.llm.columns import records
from preptrail.session import cut_lineage

#: The larger a shard, the smaller the share of it that a search meets.
SHARD_ROWS = 16_384
DEGREE = 32
ENTRIES = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
#: A candidate edge is dropped if a kept neighbour is this many times nearer to it than the node is.
RELAX = 1.2
BATCH = 256
QUERY_BLOCK = 4096
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _distances(vectors: np.ndarray, at: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each point to its own row of places; place -1 is far away."""
    apart = vectors[at] - points[:, None, :]
    return np.where(at < 0, np.float32(np.inf), np.einsum("bkd,bkd->bk", apart, apart))


def beam_search(
    vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, points: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met from ``entries`` on by always opening the nearest unopened node, for
    all ``points`` at once: their places (-1: none) and squared distances, nearest first."""
    rows = len(points)
    first = np.tile(entries, (rows, 1))
    start = _distances(vectors, first, points)
    order = np.argsort(start, axis=1, kind="stable")[:, :beam]
    places = np.full((rows, beam), -1, dtype=np.int32)
    near = np.full((rows, beam), np.inf, dtype=np.float32)
    places[:, : order.shape[1]] = np.take_along_axis(first, order, axis=1)
    near[:, : order.shape[1]] = np.take_along_axis(start, order, axis=1)
    opened = np.zeros((rows, beam), dtype=bool)
    seen = np.zeros((rows, len(vectors)), dtype=bool)
    seen[:, entries] = True
    active = np.arange(rows)
    while len(active):
        todo = ~opened[active] & (places[active] >= 0)
        first = todo.argmax(axis=1)
        has = todo[np.arange(len(active)), first]
        active, first = active[has], first[has]
        if not len(active):
            break
        opened[active, first] = True
        fresh = edges[places[active, first]]
        known = (fresh < 0) | seen[active[:, None], fresh]
        fresh = np.where(known, -1, fresh)
        seen[np.repeat(active, fresh.shape[1])[fresh.ravel() >= 0], fresh.ravel()[fresh.ravel() >= 0]] = True
        distance = _distances(vectors, fresh, points[active]).astype(np.float32)
        all_near = np.concatenate((near[active], distance), axis=1)
        order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(active))[:, None]
        near[active] = all_near[pick, order]
        places[active] = np.concatenate((places[active], fresh), axis=1)[pick, order]
        opened[active] = np.concatenate((opened[active], np.zeros(fresh.shape, bool)), axis=1)[pick, order]
    return places, near


def robust_prune(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node of ``own`` up to ``degree`` diverse neighbours of its row of candidates (-1: none).

    The nearest candidate is kept; others to which it is ``relax`` times nearer than the node are
    dropped; and so on.
    """
    rows = np.arange(len(own))
    candidates = np.where(candidates == own[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    far = _distances(vectors, candidates, vectors[own])
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = candidates[rows[:, None], order], far[rows[:, None], order]
    width = int((candidates >= 0).sum(axis=1).max(initial=1))
    candidates, far = candidates[:, : max(width, 1)], far[:, : max(width, 1)]
    near = vectors[candidates]
    squares = np.einsum("bkd,bkd->bk", near, near)
    between = squares[:, :, None] + squares[:, None, :] - 2 * (near @ near.transpose(0, 2, 1))
    alive = candidates >= 0
    kept = np.full((len(own), degree), -1, dtype=np.int32)
    count = np.zeros(len(own), dtype=np.int64)
    for _ in range(degree):
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        at = rows[has]
        kept[at, count[at]] = candidates[at, first[at]]
        count[at] += 1
        alive[at] &= relax * relax * between[at, first[at]] > far[at]
        alive[at, first[at]] = False
    return kept


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of every node, and the entry nodes: the one nearest to the mean and ``ENTRIES`` others,
    drawn evenly, so that a walk also starts in every large heap of near vectors.

    Nodes are inserted in batches: a greedy search proposes neighbours, pruning keeps diverse ones, and
    the nodes chosen link back, pruned again where they have too many. A second round refines with the
    relaxed rule.
    """
    n = len(vectors)
    edges = np.full((n, degree), -1, dtype=np.int32)
    centre = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(5).permutation(n)
    entries = np.unique(np.append(order[:ENTRIES], centre)).astype(np.int32)
    for factor in (1.0, relax):
        done, size = 0, 1
        while done < n:
            # The first batches are small, as they find next to nothing to link to.
            batch = order[done : done + size]
            done, size = done + size, min(BATCH, 2 * size) if factor == 1.0 else BATCH
            places, _ = beam_search(vectors, edges, entries, vectors[batch], beam)
            edges[batch] = robust_prune(vectors, batch, np.concatenate((places, edges[batch]), axis=1), degree, factor)
            source, target = np.repeat(batch, degree), edges[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(nodes), counts.max(initial=1)), -1, dtype=np.int32)
            back[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
            for lot in range(0, len(nodes), BATCH):
                own = nodes[lot : lot + BATCH]
                links = np.concatenate((edges[own], back[lot : lot + BATCH]), axis=1)
                edges[own] = robust_prune(vectors, own, links, degree, factor)
    return edges, entries


def sound(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows with an id and a vector of finite components that is not
    null or zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    typed = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return typed.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def usual_size(vectors: DataFrame) -> int:
    """The commonest size of the sound vectors, of equally common ones the largest; 0 if there is none."""
    sizes = sound(vectors).groupBy(F.size("vector").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).head()
    return top["size"] if top else 0


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """The sound vectors of ``dims`` components, each with a number of its own: rows that repeat an id are
    vectors of their own. Store the result before it is used twice."""
    return sound(vectors).filter(F.size("vector") == dims).withColumn("row", F.monotonically_increasing_id())


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: ``shard``, ``ids``, ``vectors`` and ``edges`` as bytes, and its ``entries``.

    ``vectors`` (``row, vec_id, vector``) are dealt to shards of about ``shard_rows`` by hashes of their
    numbers. Equal vectors of a shard are one node, so that no heap of copies closes in a walk.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        ids, rows = group["vec_id"].to_numpy(), group["row"].to_numpy()
        whole = np.array(group["vector"].tolist(), dtype=np.float64)
        nodes, node_of = np.unique(whole, axis=0, return_inverse=True)
        edges, entries = build_graph(nodes.astype(np.float32))
        by = np.argsort(node_of.ravel(), kind="stable")
        row = (key[0], ids[by].tobytes(), rows[by].tobytes(), np.bincount(node_of.ravel()).astype("<i8").tobytes(), nodes.tobytes(), edges.tobytes(), entries.tobytes())
        return pd.DataFrame([row], columns=["shard", "ids", "rows", "copies", "vectors", "edges", "entries"])

    schema = "shard int, ids binary, rows binary, copies binary, vectors binary, edges binary, entries binary"
    return dealt.groupBy("shard").applyInPandas(run, schema)


def search(index: DataFrame, queries: DataFrame, dims: int, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of each query (``row, vec_id, vector``), without the query's own row.

    Queries are put in blocks, every block visits every shard, and a beam search walks the shard's graph
    for the whole block; the best of all shards are merged.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group["vector"].tolist(), dtype=np.float64)
        row = (key[0], group["row"].to_numpy().tobytes(), group["vec_id"].to_numpy().tobytes(), points.tobytes())
        return pd.DataFrame([row], columns=["block", "query_rows", "query_ids", "points"])

    gathered = dealt.groupBy("block").applyInPandas(gather, "block int, query_rows binary, query_ids binary, points binary")
    # A row per shard and block, joined by the shard's number.
    numbers = index.select(F.collect_set("shard").alias("shards"))
    visits = gathered.join(F.broadcast(numbers)).withColumn("shard", F.explode("shards")).drop("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows, copies = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows", "copies"))
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dims)
                edges = np.frombuffer(row["edges"], "<i4").reshape(len(vectors), -1)
                query_rows, query_ids = (np.frombuffer(row[c], "<i8").tolist() for c in ("query_rows", "query_ids"))
                points = np.frombuffer(row["points"], "<f8").reshape(-1, dims)
                entries, ends = np.frombuffer(row["entries"], "<i4"), np.cumsum(copies)
                small = vectors.astype(np.float32)
                out: dict[str, list] = {name: [] for name in FOUND.names}
                for lot in range(0, len(points), BATCH):
                    places, _ = beam_search(small, edges, entries, points[lot : lot + BATCH].astype(np.float32), beam)
                    some = slice(lot, lot + BATCH)
                    for own, query, point, met in zip(query_rows[some], query_ids[some], points[some], places, strict=True):
                        met = met[met >= 0]
                        score = np.sqrt(((vectors[met] - point) ** 2).sum(axis=1))
                        # Ids ascend within a node: more than k + 1 of its copies cannot be among the k.
                        best = sorted(
                            (s, i)
                            for s, m in zip(score.tolist(), met.tolist(), strict=True)
                            for i, r in zip(*(x[ends[m] - copies[m] : ends[m]][: k + 1].tolist() for x in (ids, rows)), strict=True)
                            if r != own
                        )[:k]
                        out["query_row"] += [own] * len(best)
                        out["query_id"] += [query] * len(best)
                        out["vec_id"] += [i for _, i in best]
                        out["score"] += [s for s, _ in best]
                yield records(out, FOUND)

    found = visits.join(index, "shard").drop("shard", "block")
    found = found.select("ids", "rows", "copies", "vectors", "edges", "entries", "query_rows", "query_ids", "points")
    hits = found.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int, k: int = 10, dims: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for the ids divisible by ``every``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id. ``vectors`` has ``vec_id, embedding``; ``dims`` is by default the commonest size.
    Vectors that are null, zero, of another size or hold a null or non-finite component, and rows with a
    null id, take no part. Rows that repeat an id are vectors of their own: each is found, each is a query
    if its id is one, and only its own row is no candidate of a query. With fewer than ``k`` candidates all are given; an empty table gives no rows.
    """
    if dims is None:
        dims = usual_size(vectors)
    points = cut_lineage(usable(vectors, dims), "vectors")
    if points.isEmpty():
        return points.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "0.0D AS score")
    index = cut_lineage(build_index(points), "graph")
    return search(index, points.filter(F.col("vec_id") % every == 0), dims, k)
