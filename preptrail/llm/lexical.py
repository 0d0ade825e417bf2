"""Ranked lexical search over posting lists that are cut into blocks of similar documents."""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.llm.terms import LETTERS_AND_DIGITS, splitter, texts
from preptrail.session import cut_lineage

BEST = 50
#: Bytes of item texts whose terms are searched in one scan of the documents.
QUERY_BYTES = 8 << 20
#: Impacts (rows times columns) of a shard, its most documents, and the terms of items searched together.
SHARD_CELLS = 32 << 20
SHARD_DOCUMENTS = 8192
GROUP_TERMS = 8192
#: Documents of a block, dimensions in which documents are compared, and rounds of moving block centres.
BLOCK = 64
DIRECTIONS = 16
ROUNDS = 2
HELD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def held_terms(documents: DataFrame, asked: dict[bytes, int], letters: str) -> DataFrame:
    """``doc_id, n`` (terms with repeats), ``terms`` (numbers of the asked ones), ``counts`` of each row."""
    numbers = documents.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known = splitter(letters), numbers.value
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in texts(batch.column(1)):
                words = terms(text)
                tf = Counter(words)
                own = tf.keys() & known.keys()
                sizes.append(len(words))
                found.append([known[w] for w in own])
                counts.append([tf[w] for w in own])
            columns = [batch.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, found, counts), list(HELD)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=HELD)

    schema = "doc_id long, n long, terms array<int>, counts array<long>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Share of a term's weight that a document gets, in parts of a million, rounded down."""
    m = 50 + 50 * n * documents // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard:
    """The impacts of some documents for the terms of some items, and blocks of each term's postings."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        self.ids, self.impacts = ids, impacts
        draw = np.random.default_rng(11)
        signs = draw.choice(np.array([-1.0, 1.0], np.float32), (impacts.shape[1], DIRECTIONS))
        lots = [impacts[a : a + BLOCK].astype(np.float32) @ signs for a in range(0, len(impacts), BLOCK)]
        at = np.concatenate(lots) if lots else np.zeros((0, DIRECTIONS), np.float32)
        self.at = at / np.maximum(np.sqrt((at * at).sum(axis=1, keepdims=True)), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The term's documents, clustered by the directions of their impacts, and where blocks start."""
        rows = np.flatnonzero(self.impacts[:, term])
        parts = -(-len(rows) // BLOCK)
        if parts <= 1:
            return rows, np.zeros(min(1, len(rows)), np.int64)
        at = self.at[rows]
        centres = at[np.linspace(0, len(rows) - 1, parts).astype(np.int64)]
        for _ in range(ROUNDS):
            nearest = (at @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, at)
            centres = np.where(np.bincount(nearest, minlength=parts)[:, None] > 0, sums, centres)
            centres = centres / np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-9)
        order = np.argsort(nearest, kind="stable")
        cluster = nearest[order]
        starts = np.flatnonzero(np.diff(cluster, prepend=-1))
        # A cluster of many documents is several blocks.
        lengths = np.diff(np.append(starts, len(rows)))
        cuts = [np.arange(s, s + n, 2 * BLOCK) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        return rows[order], np.concatenate(cuts)


class Best:
    """The highest scores of one item so far, equal scores by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A document below this score is not among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(shard: Shard, items: list[tuple[np.ndarray, np.ndarray]], best: list[Best], visits: Counter) -> None:
    """Add the shard's documents to each item's best. ``items`` holds columns, by descending weight, and weights.

    A document is met in the list of the first of the item's terms that it holds. From a list on, what an
    item can still find is bounded by the largest impacts of the terms from there on; where that is below the
    item's least, its lists end. A block is skipped where the same bound over its own summary (the largest
    impact of each term among its documents) is below.
    """
    most = shard.impacts.max(axis=0, initial=0).astype(np.int64)
    asking: dict[int, list[tuple[int, int]]] = {}
    bounds = []
    for q, (columns, weights) in enumerate(items):
        bounds.append(np.cumsum((most[columns] * weights)[::-1])[::-1])
        for place, column in enumerate(columns.tolist()):
            asking.setdefault(column, []).append((q, place))
    heaviest: dict[int, int] = {}
    for columns, weights in items:
        heaviest.update(zip(columns.tolist(), weights.tolist(), strict=True))
    for term in sorted(asking, key=lambda t: (-heaviest[t], t)):
        open_ = [(q, place) for q, place in asking[term] if bounds[q][place] >= best[q].least()]
        visits["lists"] += len(asking[term])
        visits["lists_open"] += len(open_)
        if not open_ or not most[term]:
            continue
        rows, starts = shard.blocks(term)
        ends = np.append(starts[1:], len(rows))
        # The summaries that this list's items ask for; they serve all of them.
        wanted = np.unique(np.concatenate([items[q][0] for q, _ in open_]))
        held = shard.impacts[np.ix_(rows, wanted)]
        summary = np.maximum.reduceat(held, starts, axis=0).astype(np.int64)
        for q, place in open_:
            columns, weights = items[q]
            at = np.searchsorted(wanted, columns)
            bound = summary[:, at[place:]] @ weights[place:]
            near = np.flatnonzero(bound >= best[q].least())
            visits["blocks"] += len(starts)
            for b in near[np.argsort(-bound[near], kind="stable")].tolist():
                if bound[b] < best[q].least():
                    break
                visits["blocks_open"] += 1
                own = held[starts[b] : ends[b]][:, at].astype(np.int64)
                first = ~own[:, :place].any(axis=1)
                scores = own[first] @ weights
                visits["scored"] += len(scores)
                good = scores >= best[q].least()
                best[q].add(scores[good], shard.ids[rows[starts[b] : ends[b]][first][good]])


def grouped(items: dict[int, list[int]], limit: int = GROUP_TERMS) -> Iterator[list[int]]:
    """Items in lots whose distinct terms stay below a limit, one item at least."""
    lot: list[int] = []
    terms: set[int] = set()
    for item, own in items.items():
        if lot and len(terms | set(own)) > limit:
            yield lot
            lot, terms = [], set()
        lot.append(item)
        terms |= set(own)
    if lot:
        yield lot


def best_of_tasks(held: DataFrame, items: dict[int, list[int]], weights: dict[int, int], documents: int, length: int, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best documents of each item.

    A task gathers its rows in shards of bounded impacts, indexes one after the other and keeps the best of
    all of them, so that later shards start with the scores found before.
    """
    sent = held.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        lots = []
        for lot in grouped(items):
            terms = np.unique(np.concatenate([np.asarray(items[i], np.int64) for i in lot]))
            own = []
            for item in lot:
                numbers = sorted(items[item], key=lambda t: (-weights[t], t))
                columns = np.searchsorted(terms, np.asarray(numbers, np.int64))
                own.append((columns, np.array([weights[t] for t in numbers], np.int64)))
            lots.append((lot, terms, own))
        best = {item: Best(k) for item in items}
        widest = max((len(terms) for _, terms, _ in lots), default=1)
        rows = max(BLOCK, min(SHARD_DOCUMENTS, SHARD_CELLS // max(1, widest)))

        def index(batch: pa.RecordBatch) -> None:
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            parts = impact(tf, n[owner], documents, length)
            for lot, terms, own in lots:
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                mine = terms[at] == term
                impacts = np.zeros((len(batch), len(terms)), np.int32)
                impacts[owner[mine], at[mine]] = parts[mine]
                search_shard(Shard(ids, impacts), own, [best[i] for i in lot], Counter())

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = rows - sum(map(len, waiting))
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, waiting)) == rows:
                    index(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    waiting = []
        if waiting:
            index(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
        for item, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found.ids), item, np.int64)), pa.array(found.ids), pa.array(found.scores)], schema=FOUND
            )

    return held.mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(documents: DataFrame, items: DataFrame, k: int = BEST, letters: str = LETTERS_AND_DIGITS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` highest-scoring rows of ``documents`` for each item.

    Terms are the runs of ``letters`` and characters outside ASCII, A-Z as a-z. Over the ``N`` documents with a term, ``L`` terms in
    all, a term held by ``df`` documents weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``, and a document of
    ``n`` terms scores ``weight * (10**9 tf div (1000 tf + 20 m))``, ``m = 50 + (50 n N) div L``, for each
    distinct term of the item, in 64-bit integers. Only scores above 0 are listed; equal ones by ``doc_id``.

    Each term's posting list is cut into blocks of documents with alike impacts, and a block keeps the
    largest impact of every term among its documents. A block is read only if its bound reaches the item's
    least score so far; bounds and scores are whole numbers, so nothing is lost.

    The stated items are dealt to lots of at most about ``QUERY_BYTES`` of text, whose terms are sent to
    the tasks; each lot scans the documents once. Null and empty texts have no terms. Items of one id
    (null included) are one item with the terms of all its texts. Each row of ``documents`` is a document,
    also where ids repeat; rows without an id count for ``N``, ``L`` and ``df`` and are not listed. An
    empty table gives no rows; other columns are ignored.
    """
    stated = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = stated.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    lots = max(1, -(-size // QUERY_BYTES))
    found = None
    for lot in range(lots):
        part = stated.filter(F.pmod(F.xxhash64("item_id"), F.lit(lots)) == lot) if lots > 1 else stated
        one = _rank_lot(documents, part, k, letters)
        found = one if found is None else found.union(one)
    return found


def _rank_lot(documents: DataFrame, items: DataFrame, k: int, letters: str) -> DataFrame:
    terms = splitter(letters)
    numbers: dict[bytes, int] = {}
    asked: dict[object, set[int]] = {}
    for item, text in items.collect():  # bounded by QUERY_BYTES
        asked.setdefault(item, set()).update(numbers.setdefault(t, len(numbers)) for t in terms(text.encode()))
    held = cut_lineage(held_terms(documents, numbers, letters), "postings")
    totals = held.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    holding = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # the asked terms at most
    weights = {t: math.floor(1000 * math.log((2 * totals["documents"] + 2) / (2 * df + 1))) for t, df in holding}
    names = list(asked)
    wanted = {i: own for i, name in enumerate(names) if (own := [t for t in asked[name] if weights.get(t, 0) > 0])}
    found = best_of_tasks(held.filter("doc_id is not null"), wanted, weights, totals["documents"], totals["length"] or 0, k)
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    spark = documents.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
