"""Exact nearest-vector search: few queries go to the vectors in place, many meet the cells of an index.

Either way a task scores whole blocks with one matrix product and keeps only the best rows per
query, so the scored pairs are never materialised. Cells that cannot hold any of a query's best rows are
not visited (``cells``). Where keys leave a row few queries, each pair is scored in place and ranked by the JVM.
"""

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from preptrail.operators import cells
from preptrail.operators.ranking import SALTS, TASK_ROWS, first_per_key, top_n
from preptrail.session import cut_lineage

MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_VALUES = 4_000_000
BLOCK_ROWS = cells.BLOCK_ROWS
QUERY_CHUNK = 4_000
#: Results that a task holds for its queries, and how often an index is scanned for lots of queries with so many.
MAX_RESULTS = 250_000
MAX_SCANS = 16
SCORES_PER_STEP = 2_000_000
MATRIX_SCORES = 20_000
PAIR_STEP = 20_000
PENDING_ROWS = 200_000
#: Queries that a row meets on average where pairs are scored one by one, and values of their vectors in a scan.
PAIRS_PER_ROW = 4
MAX_PAIR_VALUES = 16_000_000


@dataclass(frozen=True)
class SearchSpec:
    """What is matched, how it is scored and how ties and duplicates are settled.

    ``on`` are columns equal on both sides; ``differ`` is a column that must differ (such as the
    own company); of rows sharing ``distinct`` only the best one per query counts; ``carry`` are
    further columns of the found rows, returned without another join. Scores that agree to
    ``precision`` digits tie and fall back to the id, so the result does not depend on the order
    of floating point sums.
    """

    id_col: str = "id"
    vector: str = "vector"
    on: tuple[str, ...] = ()
    differ: str | None = None
    distinct: str | None = None
    metric: str = "dot"
    precision: int = 9
    carry: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        names = [self.id_col, self.vector, *self.on, self.differ, *self.returned()]
        return list(dict.fromkeys(n for n in names if n))

    def returned(self) -> list[str]:
        """Candidate columns of the result besides id and score."""
        return [n for n in dict.fromkeys((self.distinct, *self.carry)) if n and n != self.id_col]

    def distinct_found(self) -> str:
        """The name of ``distinct`` among found rows."""
        return "id" if self.distinct == self.id_col else f"c:{self.distinct}"


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.full((len(vectors), dim), np.nan)
    for i, v in enumerate(vectors):
        if v is not None:
            out[i] = v
    return out


def _arrow_matrix(column: pa.ListArray | pa.BinaryArray, dim: int) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return cells.unpacked(column, dim).astype(float)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    if column.null_count == 0:
        return values.reshape(len(column), dim)
    out = np.full((len(column), dim), np.nan)
    out[np.asarray(column.is_valid())] = values.reshape(-1, dim)
    return out


def _scores(q: np.ndarray, c: np.ndarray, spec: SearchSpec) -> np.ndarray:
    """Scores of all queries against all candidates of one block."""
    if spec.metric == "dot":
        raw = q @ c.T
    else:
        raw = np.zeros((len(q), len(c)))
        for axis in range(q.shape[1]):
            raw -= (q[:, axis, None] - c[None, :, axis]) ** 2
        raw = -np.sqrt(-raw)
    return np.round(raw, spec.precision)


def _pair_scores(q: np.ndarray, c: np.ndarray, spec: SearchSpec) -> np.ndarray:
    """Scores of aligned rows."""
    raw = np.einsum("ij,ij->i", q, c) if spec.metric == "dot" else -np.sqrt(((q - c) ** 2).sum(axis=1))
    return np.round(raw, spec.precision)


def _best(found: pd.DataFrame, limits: np.ndarray, spec: SearchSpec) -> pd.DataFrame:
    found = found.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
    if spec.distinct:
        found = found.drop_duplicates(["q", spec.distinct_found()])
    return found[found.groupby("q").cumcount().to_numpy() < limits[found["q"].to_numpy()]]


def _found(q_pos, c_pos, score, cands, spec: SearchSpec) -> pd.DataFrame:
    columns = {"q": q_pos, "score": score, "id": cands["id"][c_pos]}
    columns.update({f"c:{name}": cands["returned"][name][c_pos] for name in spec.returned()})
    return pd.DataFrame(columns)


def _block_best(q_pos, queries, cands, c_pos, limits, spec: SearchSpec) -> list[pd.DataFrame]:
    """Best candidates of one large matching group for each of its queries, by matrix products."""
    out, vectors = [], cands["matrix"][c_pos]
    step = max(1, SCORES_PER_STEP // max(1, len(c_pos)))
    least, single = queries.get("least"), None
    if least is not None and spec.metric == "dot":
        single = vectors.astype(np.float32)
        longest = np.sqrt(np.square(vectors).sum(axis=1).max(initial=0.0))
    for start in range(0, len(q_pos), step):
        rows = q_pos[start : start + step]
        if single is not None and np.isfinite(longest) and np.isfinite(least[rows]).all():
            # Single precision, with room for its rounding, tells which pairs are worth a score.
            points = queries["matrix"][rows]
            room = np.sqrt(np.square(points).sum(axis=1)) * longest * (points.shape[1] * 2.0**-22) + 10.0**-spec.precision
            qi, ci = np.nonzero(points.astype(np.float32) @ single.T >= (least[rows] - room).astype(np.float32)[:, None])
            if len(qi) <= max(PAIR_STEP, 2 * int(limits[rows].sum())):
                score = _pair_scores(points[qi], vectors[ci], spec)
                kept = score >= least[rows][qi]
                if spec.differ:
                    kept &= queries["differ"][rows[qi]] != cands["differ"][c_pos[ci]]
                out.append(_found(rows[qi[kept]], c_pos[ci[kept]], score[kept], cands, spec))
                continue
        score = _scores(queries["matrix"][rows], vectors, spec)
        dropped = np.isnan(score)
        if spec.differ:
            dropped |= queries["differ"][rows][:, None] == cands["differ"][c_pos][None, :]
        wanted = int(limits[rows].max())
        if least is not None:
            dropped |= score < least[rows][:, None]
            qi, ci = np.nonzero(~dropped)
            if len(qi) <= wanted * len(rows):
                out.append(_found(rows[qi], c_pos[ci], score[qi, ci], cands, spec))
                continue
        score[dropped] = -np.inf
        take = wanted if not spec.distinct else 2 * wanted
        while True:
            take = min(take, len(c_pos))
            cut = -np.partition(-score, take - 1, axis=1)[:, take - 1]
            qi, ci = np.nonzero((score >= cut[:, None]) & ~dropped)
            best = _best(_found(rows[qi], c_pos[ci], score[qi, ci], cands, spec), limits, spec)
            counts = np.bincount(best["q"], minlength=len(limits))[rows]
            if not spec.distinct or take == len(c_pos) or (counts >= limits[rows]).all():
                break
            take *= 4
        out.append(best)
    return out


def _pairs_found(c_pos, groups, queries, cands, spec: SearchSpec) -> list[pd.DataFrame]:
    """Scores for candidates of many small groups at once, pair by pair."""
    out, per_candidate = [], queries["count"][groups]
    for first in range(0, len(c_pos), PAIR_STEP):
        part = slice(first, first + PAIR_STEP)
        n = per_candidate[part]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q_pos = queries["order"][np.repeat(queries["start"][groups[part]], n) + within]
        pos = np.repeat(c_pos[part], n)
        score = _pair_scores(queries["matrix"][q_pos], cands["matrix"][pos], spec)
        kept = ~np.isnan(score)
        if spec.differ:
            kept &= queries["differ"][q_pos] != cands["differ"][pos]
        if queries.get("least") is not None:
            kept &= score >= queries["least"][q_pos]
        out.append(_found(q_pos[kept], pos[kept], score[kept], cands, spec))
    return out


def _search_block(queries: dict, cands: dict, limits: np.ndarray, spec: SearchSpec) -> list[pd.DataFrame]:
    """Candidates worth keeping from one block: large groups by matrix, small groups by pair."""
    n = len(cands["id"])
    if not spec.on:
        return _block_best(np.arange(len(limits)), queries, cands, np.arange(n), limits, spec)
    keys = pd.DataFrame({str(i): k for i, k in enumerate(cands["on"])})
    groups = keys.merge(queries["keys"], how="left", on=list(keys.columns))["group"].to_numpy()
    c_pos = np.flatnonzero(~np.isnan(groups))
    groups = groups[c_pos].astype(int)
    work = np.bincount(groups, minlength=len(queries["count"])) * queries["count"]
    large = work[groups] >= MATRIX_SCORES
    out = _pairs_found(c_pos[~large], groups[~large], queries, cands, spec)
    for group in np.unique(groups[large]):
        start = queries["start"][group]
        q_pos = queries["order"][start : start + queries["count"][group]]
        out += _block_best(q_pos, queries, cands, c_pos[groups == group], limits, spec)
        if sum(map(len, out[1:])) > max(PENDING_ROWS, len(out[0])):
            out = [_best(pd.concat(out, ignore_index=True), limits, spec)]
    return out


def _query_side(frame: pd.DataFrame, spec: SearchSpec, matrix: np.ndarray, cells: pa.ListArray | None = None) -> dict:
    """Queries as arrays, with their positions listed group by group; ``cells`` lists the cells each of them meets."""
    side = {
        "query_id": frame["query_id"].to_numpy(),
        "matrix": matrix,
        "differ": frame[spec.differ].to_numpy() if spec.differ else None,
        "least": frame["_least"].to_numpy() if "_least" in frame else None,
    }
    if spec.on:
        place, keys = np.arange(len(frame)), {c: frame[c].to_numpy() for c in spec.on if c in frame}
        if cells is not None:
            place = np.repeat(place, cells.value_lengths().to_numpy())
            keys = {**{c: values[place] for c, values in keys.items()}, "_cell": cells.flatten().to_numpy()}
        keys = pd.DataFrame({str(i): keys[c] for i, c in enumerate(spec.on)})
        group = keys.groupby(list(keys.columns), sort=False).ngroup().to_numpy()
        valid = np.flatnonzero(group >= 0)
        side["order"] = place[valid[np.argsort(group[valid], kind="stable")]]
        side["count"] = np.bincount(group[valid])
        side["start"] = np.cumsum(side["count"]) - side["count"]
        side["keys"] = keys.assign(group=group).iloc[valid].drop_duplicates("group")
    return side


def _result(best: pd.DataFrame, queries: dict, spec: SearchSpec) -> pd.DataFrame:
    columns = {
        "query_id": queries["query_id"][best["q"].to_numpy()],
        spec.id_col: best["id"].to_numpy(),
        "score": best["score"].to_numpy(),
    }
    columns.update({name: best[f"c:{name}"].to_numpy() for name in spec.returned()})
    return pd.DataFrame(columns)


def _result_schema(index: DataFrame, queries: DataFrame, spec: SearchSpec) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField(spec.id_col, index.schema[spec.id_col].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    fields += [T.StructField(name, index.schema[name].dataType) for name in spec.returned()]
    return T.StructType(fields)


def _with_asked_keys(index: DataFrame, rows: pd.DataFrame, spec: SearchSpec) -> DataFrame:
    """Rows some query can match, kept before they leave the JVM; the keys are as few as the queries."""
    fields = [index.schema[c] for c in spec.on]
    distinct = rows[list(spec.on)].dropna().drop_duplicates()

    def plain(value, kind):
        return int(value) if isinstance(kind, T.IntegralType) else value

    keys = [tuple(plain(v, f.dataType) for v, f in zip(row, fields)) for row in distinct.itertuples(index=False)]
    asked = index.sparkSession.createDataFrame(keys, T.StructType(fields))
    return index.join(F.broadcast(asked), list(spec.on), "left_semi")


def _broadcast_search(index: DataFrame, rows: pd.DataFrame, dim: int, spec: SearchSpec, schema) -> DataFrame:
    """Scan the vectors once, in place; every task holds the few queries and its running best.

    A task returns its best rows of every query, so there are no more tasks than keep all cores busy. What it has
    found tells the least score that later rows must reach.
    """
    own, side = None, _query_side(rows, spec, _matrix(rows[spec.vector].tolist(), dim))
    if spec.differ:
        codes, own = pd.factorize(side["differ"], use_na_sentinel=False)
        side["differ"], own = codes, pd.Index(own)
    shared = index.sparkSession.sparkContext.broadcast((side, rows["k"].to_numpy(), own))
    arrow_schema = to_arrow_schema(schema)

    def scan(batches):
        queries, limits, own = shared.value
        best, pending, n_pending = [], [], 0

        def compact() -> list[pd.DataFrame]:
            kept = _best(pd.concat([*best, *pending], ignore_index=True), limits, spec)
            # Rows of a query come in descending order, so its last one is the least that counts once it is full.
            q, score = kept["q"].to_numpy(), kept["score"].to_numpy()
            last = np.flatnonzero(np.diff(q, append=-1))
            full = last[np.bincount(q, minlength=len(limits))[q[last]] >= limits[q[last]]]
            least = np.full(len(limits), -np.inf) if queries["least"] is None else queries["least"].copy()
            least[q[full]] = np.maximum(least[q[full]], score[full])
            queries["least"] = least  # it also holds for the next task of this worker
            return [kept]

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cands = {
                "id": column[spec.id_col].to_pandas().to_numpy(),
                "matrix": _arrow_matrix(column[spec.vector], dim),
                "on": [column[c].to_pandas().to_numpy() for c in spec.on],
            }
            if spec.differ:
                cands["differ"] = own.get_indexer(column[spec.differ].to_pandas().to_numpy())
            cands["returned"] = {name: column[name].to_pandas().to_numpy() for name in spec.returned()}
            found = _search_block(queries, cands, limits, spec)
            pending += found
            n_pending += sum(map(len, found))
            if n_pending > max(PENDING_ROWS if queries["least"] is not None else len(limits), 2 * sum(map(len, best))):
                best, pending, n_pending = compact(), [], 0
        if n_pending:
            best = compact()
        if best and len(best[0]):
            frame = _result(best[0], queries, spec)
            yield pa.RecordBatch.from_pandas(frame, schema=arrow_schema, preserve_index=False)

    asked = _with_asked_keys(index, rows, spec) if spec.on else index
    return asked.coalesce(2 * index.sparkSession.sparkContext.defaultParallelism).mapInArrow(scan, schema)


def _few_pairs(index: DataFrame, asked: DataFrame, spec: SearchSpec) -> bool:
    """Whether a row meets few queries by its keys, and a query no more rows than a task may rank."""
    on = list(spec.on)
    held = index.groupBy(*on).agg(F.count("*").alias("_rows"))
    wanted = asked.groupBy(*on).agg(F.count("*").alias("_asked"))
    if not asked.groupBy("query_id").count().filter("count > 1 or query_id is null").isEmpty():
        return False
    pairs = F.sum(F.col("_rows") * F.coalesce("_asked", F.lit(0)))
    most = F.max(F.when(F.col("_asked").isNotNull(), F.col("_rows")))
    rows, pairs, most = held.join(wanted, on, "left").agg(F.sum("_rows"), pairs, most).first()
    return (pairs or 0) <= PAIRS_PER_ROW * (rows or 0) and (most or 0) <= TASK_ROWS


def _pair_search(index: DataFrame, asked: DataFrame, dim: int, spec: SearchSpec) -> DataFrame:
    """Ranked rows of queries whose keys leave each row few of them: every pair is scored where the row lies.

    Rows get the numbers of their queries by a join on the keys; only number, id, score and the carried columns
    are shuffled, once. The vectors of ``MAX_PAIR_VALUES`` values of queries are sent to the tasks at a time.
    """
    spark, on = index.sparkSession, list(spec.on)
    names = list(dict.fromkeys([*on, *([spec.differ] if spec.differ else [])]))
    queries = asked.dropna(subset=on).select("query_id", F.col("k").cast("int").alias("_k"), spec.vector, *names).toArrow().combine_chunks()
    id_type = index.schema[spec.id_col].dataType
    fields = [T.StructField("_q", T.IntegerType()), T.StructField(spec.id_col, id_type), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*fields, *(index.schema[name] for name in spec.returned())])
    arrow_schema = to_arrow_schema(schema)

    def numbered(table: pa.Table, start: int, columns: list[str]) -> DataFrame:
        numbers = pa.array(np.arange(start, start + len(table), dtype=np.int32))
        return spark.createDataFrame(table.select(columns).append_column("_q", numbers))

    def scored(start: int, table: pa.Table) -> DataFrame:
        kind = np.float32 if pa.types.is_float32(table[spec.vector].type.value_type) else float
        points = _arrow_matrix(table[spec.vector].combine_chunks(), dim).astype(kind)
        shared = spark.sparkContext.broadcast(points)
        known = numbered(table, start, names)
        if spec.differ:
            known = known.withColumnRenamed(spec.differ, "_differs")
        met = index.join(F.broadcast(known), on)
        if spec.differ:
            met = met.filter(~F.col(spec.differ).eqNullSafe(F.col("_differs")))

        def score(batches):
            points = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                rows = _arrow_matrix(column[spec.vector], dim)
                found = _pair_scores(points[column["_q"].to_numpy() - start].astype(float), rows, spec)
                column["score"] = pa.array(found)
                out = pa.RecordBatch.from_arrays([column[n].cast(t) for n, t in zip(arrow_schema.names, arrow_schema.types)], schema=arrow_schema)
                yield out.filter(pa.array(~np.isnan(found)))

        return met.select("_q", spec.vector, spec.id_col, *spec.returned()).mapInArrow(score, schema)

    step = max(1, MAX_PAIR_VALUES // dim)
    parts = [scored(start, queries.slice(start, step)) for start in range(0, max(1, len(queries)), step)]
    best = [F.col("score").desc(), F.col(spec.id_col)]
    dealt = reduce(DataFrame.union, parts).repartition("_q")
    if spec.distinct:
        dealt = dealt.withColumn("_nth", F.row_number().over(W.partitionBy("_q", spec.distinct).orderBy(*best))).filter("_nth = 1").drop("_nth")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(*best)))
    asking = numbered(queries, 0, ["query_id", "_k"])
    found = ranked.join(F.broadcast(asking), "_q").filter(F.col("rank") <= F.col("_k"))
    return found.select("query_id", spec.id_col, "score", *spec.returned(), "rank")


def _grid_search(index: DataFrame, queries: DataFrame, dim: int, k_max: int, spec: SearchSpec, schema) -> DataFrame:
    """Shuffle both sides into parts of bounded size that hold all matching pairs.

    Rows have a ``_block`` and a ``_cell``, queries a ``_block`` and the ``_cells`` they meet there. Small blocks
    share a part, picked by a hash of their keys. A block with more rows or queries than a part should hold is
    split: its rows into pieces, its queries into chunks, with one part for every piece and chunk.
    """
    keys = [*spec.on, "_block"]
    spec, chunk = replace(spec, on=(*spec.on, "_cell")), max(1, min(QUERY_CHUNK, MAX_RESULTS // k_max))
    n_parts = max(1, -(-index.count() // BLOCK_ROWS), -(-queries.count() // chunk))

    def pieces(df: DataFrame, rows: int, name: str) -> DataFrame:
        sized = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
        return sized.filter(F.col(name) > 1)

    hot = pieces(index, 2 * BLOCK_ROWS, "_blocks").join(pieces(queries, chunk, "_chunks"), keys, "full_outer").fillna(1)
    # Parts are few bytes and much work: as many tasks as keep all cores busy.
    n_tasks = 2 * max(n_parts, index.sparkSession.sparkContext.defaultParallelism)
    own_part = F.pmod(F.xxhash64(*keys), F.lit(n_parts)).cast("int")

    def dealt(df: DataFrame, id_col: str, own: str, own_count: str, other: str, other_count: str):
        placed = df.join(hot, keys, "left").fillna(1, ["_blocks", "_chunks"])
        placed = placed.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(own_count)).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
        placed = placed.withColumn("_part", own_part).repartition(n_tasks, "_part", "_b", "_c")
        return placed.groupBy("_part", "_b", "_c")

    left = dealt(index, spec.id_col, "_b", "_blocks", "_c", "_chunks")
    right = dealt(queries, "query_id", "_c", "_chunks", "_b", "_blocks")
    arrow_schema = to_arrow_schema(schema)
    nothing = arrow_schema.empty_table()

    def part(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(block) or not len(asked):
            return nothing
        block, asked = block.combine_chunks(), asked.combine_chunks()
        points = _arrow_matrix(asked.column(spec.vector).combine_chunks(), dim)
        frame = asked.drop_columns([spec.vector, "_cells"]).to_pandas()
        side, limits = _query_side(frame, spec, points, asked.column("_cells").combine_chunks()), frame["k"].to_numpy()

        def values(name: str) -> np.ndarray:
            return block.column(name).to_pandas().to_numpy()

        cands = {
            "id": values(spec.id_col),
            "matrix": _arrow_matrix(block.column(spec.vector).combine_chunks(), dim),
            "on": [values(c) for c in spec.on],
            "differ": values(spec.differ) if spec.differ else None,
            "returned": {name: values(name) for name in spec.returned()},
        }
        found = [f for f in _search_block(side, cands, limits, spec) if len(f)]
        if not found:
            return nothing
        best = _result(_best(pd.concat(found, ignore_index=True), limits, spec), side, spec)
        return pa.Table.from_pandas(best, schema=arrow_schema, preserve_index=False)

    return left.cogroup(right).applyInArrow(part, schema)


def _ranked(partial: DataFrame, k_max: int, spec: SearchSpec, salts: int = SALTS) -> DataFrame:
    """The best rows of each query among those that tasks found; few cells a query need no ``salts``."""
    if spec.distinct:
        partial = first_per_key(partial, ["query_id", spec.distinct], [-F.col("score"), F.col(spec.id_col)])
    return top_n(partial, ["query_id"], [F.col("score").desc(), F.col(spec.id_col)], k_max, salts=salts)


def _cell_search(index: DataFrame, queries: DataFrame, dim: int, k_max: int, spec: SearchSpec, schema) -> DataFrame:
    """Deal the index to cells around pivots; each query meets the cells next to it and then those whose bound
    reaches its ``k``-th best score so far. A query with fewer rows found meets all cells of its group.
    """
    on = list(spec.on)
    matched = index.dropna(subset=on) if on else index
    asked = cut_lineage(queries, "asked")
    pivots = cells.choose_pivots(matched, spec.id_col, spec.vector, on)
    placed = cut_lineage(cells.with_cells(matched, spec.vector, on, pivots, dim), "cells")
    known = cells.measured(placed, on, pivots, spec.metric, BLOCK_ROWS)
    placed = cells.in_blocks(placed, on, known)
    first = cut_lineage(cells.block_visits(asked, spec.vector, on, known, dim), "visits")
    near = cut_lineage(_grid_search(placed, first, dim, k_max, spec, schema), "near")
    if not pivots:
        return near
    limits = asked.groupBy("query_id").agg(F.max("k").alias("k"))
    counted = _ranked(near, k_max, spec, 1) if spec.distinct else top_n(near.select("query_id", "score"), ["query_id"], [F.col("score").desc()], k_max, salts=1)
    ranked = counted.select("query_id", "score", "rank").join(limits, "query_id").filter("rank = k")
    least = asked.join(ranked.select("query_id", F.col("score").alias("_reached")), "query_id", "left")
    rest = cells.block_visits(least, spec.vector, on, known, dim, F.col("_reached")).drop("_reached")
    rest = cut_lineage(rest, "visits")
    return near.unionByName(_grid_search(placed, rest, dim, k_max, spec, schema))


def _lots(rows: pd.DataFrame, spec: SearchSpec) -> list[pd.DataFrame]:
    """Queries in lots that ask for at most ``MAX_RESULTS`` rows each (or are one query), those of a group together."""
    rows = rows.sort_values(list(spec.on), kind="stable", ignore_index=True) if spec.on else rows
    asked = rows["k"].to_numpy(dtype=np.int64)
    lot = (np.cumsum(asked) - asked) // MAX_RESULTS
    return [part.reset_index(drop=True) for _, part in rows.groupby(lot, sort=True)]


def search(
    index: DataFrame, queries: DataFrame, k: int | Column, spec: SearchSpec, max_broadcast: int = MAX_BROADCAST_QUERIES
) -> DataFrame:
    """Best ``k`` rows of ``index`` for each query: query_id, id, score, carried columns, rank.

    ``queries`` has ``query_id``, the vector and the columns of ``spec.on`` and ``spec.differ``;
    several rows may share a ``query_id`` (one per peer, say). ``k`` may differ per query. Rows and queries
    without a vector take no part. The vectors of ``index`` may be packed (``TextEncoder.packed``). Queries are read by several jobs that run at once when this is called;
    store them first where they are costly to make.

    Up to ``max_broadcast`` queries are sent to the vectors, which stay where they are; with more the
    vectors are dealt to cells, unless the keys leave a row few queries. The result is the same.
    """
    present = F.col(spec.vector).isNotNull()
    wanted = list(dict.fromkeys(c for c in (spec.vector, *spec.on, spec.differ) if c))
    asked = queries.filter(present).select("query_id", F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), *wanted)
    asked = asked.filter(F.col("k") > 0)
    vectors = index.filter(present).select(*spec.columns())
    schema = _result_schema(index, queries, spec)

    first = asked.select(F.size(spec.vector)).first()
    if first is None:
        return index.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    dim = first[0]
    fitting = min(max_broadcast, MAX_BROADCAST_VALUES // dim)
    rows = asked.limit(fitting + 1).toPandas()
    results = rows["k"].sum()
    if spec.on and max_broadcast and (len(rows) > fitting or results > MAX_RESULTS) and _few_pairs(vectors, asked, spec):
        return _pair_search(vectors, asked, dim, spec)
    if len(rows) <= fitting and results <= MAX_SCANS * MAX_RESULTS:
        k_max = int(rows["k"].max())
        found = [_broadcast_search(vectors, lot, dim, spec, schema) for lot in _lots(rows, spec)]
        ranked = _ranked(reduce(DataFrame.union, found), k_max, spec)
    else:
        k_max = asked.agg(F.max("k")).first()[0]
        ranked = _ranked(_cell_search(vectors, asked, dim, k_max, spec, schema), k_max, spec, 1)

    if isinstance(k, int):
        return ranked
    limits = asked.groupBy("query_id").agg(F.max("k").alias("k"))
    return ranked.join(limits, "query_id").filter(F.col("rank") <= F.col("k")).drop("k")
