"""Near copies of texts: min-max hashing, banding, and confirmation on full shingle sets."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail.llm.columns import chunks, records, text_buffers
from preptrail.llm.components import components
from preptrail.llm.ordering import with_positions
from preptrail.llm.words import LANES, LOWER, Windows, mix, spans
from preptrail.session import cut_lineage

SHINGLE = 5
PERCENT = 80
#: Each permutation gives its minimum and its maximum: two values of 32 bits. Bands of four values find
#: a pair of similarity 0.8 but for (1 - 0.8**4)**32, 5 in 10**8.
PERMUTATIONS = 64
BAND_BYTES = 16
BANDS = PERMUTATIONS * 8 // BAND_BYTES
#: A pair at 0.8 agrees in fewer than 0.64 of the 128 values in about 4 of 10**6 cases.
LIKELY = 0.64
#: A block of the residual comparison: at most as many nodes and about as many bytes of sets.
BLOCK_NODES = 512
BLOCK_BYTES = 16 << 20
#: Ids that are sent to every task; more of them are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Parts into which the copies of one text are dealt to meet their class.
SALTS = 32
SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())]
)
SETS = pa.schema([("node", pa.int64()), ("members", pa.binary())])


def shingle_sets(text: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and the texts' bounds among them.

    Texts of 1 to ``width - 1`` words have one shingle, all their words; A-Z count as a-z.
    """
    text = LOWER[text]
    starts, ends, before = spans(text, bounds)
    lane = LANES[0]
    windows = Windows(lane, lane.words(text, starts, ends))
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(starts)
    at = np.flatnonzero(owner[: max(0, n - width + 1)] == owner[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    hashes = np.concatenate((windows.at(at, width), windows.at(before[short], counts[short])))
    owners = np.concatenate((owner[at], short))
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], np.searchsorted(owners[fresh], np.arange(len(counts) + 1))


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    masks = draw.integers(0, 2**64, count, dtype=np.uint64, endpoint=False)
    return masks, draw.integers(0, 2**64, count, dtype=np.uint64, endpoint=False) | np.uint64(1)


def min_max(hashes: np.ndarray, bounds: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, a row per non-empty range of ``bounds``."""
    out = np.empty((len(bounds) - 1, 2 * len(masks)), dtype="<u4")
    for p, (mask, factor) in enumerate(zip(masks, factors, strict=True)):
        values = (((hashes ^ mask) * factor) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(values, bounds[:-1])
        out[:, 2 * p + 1] = np.maximum.reduceat(values, bounds[:-1])
    return out


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` of the set (128 bits), ``signature``; both null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, factors = permutations()
        for batch in batches:
            text, bounds = text_buffers(batch.column(1))
            for a, b in chunks(bounds):
                hashes, edges = shingle_sets(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                sizes = np.diff(edges)
                full = np.flatnonzero(sizes)
                digests: list = [None] * (b - a)
                signed: list = [None] * (b - a)
                if len(full):
                    cuts = np.concatenate((edges[full], edges[-1:]))
                    rows = min_max(hashes, cuts, masks, factors)
                    data = memoryview(hashes.tobytes())
                    for i, row in zip(full.tolist(), rows, strict=True):
                        digests[i] = hashlib.blake2b(data[8 * edges[i] : 8 * edges[i + 1]], digest_size=16).digest()
                        signed[i] = row.tobytes()
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())],
                    schema=SIGNED,
                )

    return documents.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def full_sets(documents: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, members`` (ascending 64-bit hashes) of the documents in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bounds = text_buffers(batch.column(1))
            for a, b in chunks(bounds):
                hashes, edges = shingle_sets(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                data = hashes.astype("<u8").tobytes()
                sets = [data[8 * x : 8 * y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], schema=SETS)

    few = nodes.count() <= BROADCAST_IDS
    asked = documents.join(F.broadcast(nodes) if few else nodes, documents["doc_id"] == nodes["node"], "left_semi")
    return asked.mapInArrow(run, "node long, members binary")


def bands(signed: DataFrame) -> DataFrame:
    """A row ``key, node`` for each band of each signature."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substr("signature", i * BAND_BYTES + 1, F.lit(BAND_BYTES)), i)
    )
    return signed.select("node", F.explode(parts).alias("key"))


def reaches(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets share at least ``percent`` of their union."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.concatenate((one, two))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            ones, twos = ([np.frombuffer(v.as_buffer(), "<u8") for v in column] for column in (x, y))
            mask = pa.array([reaches(one, two, percent) for one, two in zip(ones, twos, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_buckets(banded: DataFrame) -> DataFrame:
    """``key, node, b, n`` of each node that shares a band bucket with a smaller one: the bucket's smallest
    node and the number of its rows."""
    stars = banded.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_most"), F.count("*").alias("n"))
    return banded.join(stars.filter("b < _most").drop("_most"), "key").filter("node <> b")


def heap_blocks(heads: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """``heap, block, node, component, n_shingles`` of the nodes that are still to be compared.

    A bucket is open if the nodes beside its smallest one lie in several components of ``found``; nodes
    that open buckets connect are a heap. Its nodes are ordered by component, where that fills a block,
    and by the size of their sets, and cut by prefix sums in blocks of bounded nodes and bytes.
    """
    crowded = shared.filter("n > 2").select("key", "node")
    named = crowded.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    opened = named.groupBy("key").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.min("node").alias("b")
    )
    edges = crowded.join(opened.filter("_low < _high").select("key", "b"), "key")
    heaps = components(edges.select(F.col("node").alias("a"), "b"))
    heaps = heaps.select("node", F.col("component").alias("heap")).join(found, "node", "left")
    heaps = heaps.withColumn("component", F.coalesce("component", "node"))
    weight = F.greatest(8 * F.col("n_shingles"), F.lit(BLOCK_BYTES // BLOCK_NODES)).alias("_weight")
    members = heaps.join(heads, "node").select("heap", "node", "component", "n_shingles", weight)
    members = cut_lineage(members, "heaps")
    wide = members.groupBy("heap", "component").agg(F.sum("_weight").alias("_all")).filter(F.col("_all") >= BLOCK_BYTES)
    members = members.join(wide.select("heap", "component", F.col("component").alias("_run")), ["heap", "component"], "left")
    order = [F.col(c) for c in ("heap", "_run", "n_shingles", "node")]
    placed = with_positions(members, order, F.col("_weight"))
    block = F.floor(F.col("_before") / BLOCK_BYTES).cast("long").alias("block")
    return placed.select("heap", block, "node", "component", "n_shingles")


def rest_links(heads: DataFrame, sets: DataFrame, shared: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that open buckets connect and that ``found`` has in different components.

    Two blocks of a heap meet in a task if sizes in them allow the similarity and they are not of one
    component; the task compares signatures and then full sets, and gives the links alone.
    """
    placed = cut_lineage(heap_blocks(heads, shared, found), "blocks")
    blocks = placed.groupBy("heap", "block").agg(
        F.min("n_shingles").alias("low"),
        F.max("n_shingles").alias("high"),
        F.min("component").alias("first"),
        F.max("component").alias("last"),
    )
    one, two = (blocks.select("heap", F.struct("block", "low", "high", "first", "last").alias(name)) for name in "ij")
    near = F.expr(f"100 * i.high >= {percent} * j.low and 100 * j.high >= {percent} * i.low")
    several = F.expr("least(i.first, j.first) < greatest(i.last, j.last)")
    meets = one.join(two, "heap").filter("i.block <= j.block").filter(near & several)
    meets = meets.select("heap", F.col("i.block").alias("i"), F.col("j.block").alias("j"))
    sides = meets.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    held = placed.join(heads, ["node", "n_shingles"]).join(sets, "node").drop("n_shingles")
    met = sides.join(held, ["heap", "block"])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        node, component, own = (group[c].to_numpy() for c in ("node", "component", "block"))
        values = np.frombuffer(b"".join(group["signature"]), "<u4").reshape(len(group), -1)
        full = [np.frombuffer(m, "<u8") for m in group["members"]]
        sizes = np.array([len(f) for f in full])
        links = []
        for r in range(len(group)):
            # In two different blocks only the pairs between them; within one block each pair once.
            ok = (node > node[r]) & (component != component[r])
            ok &= 100 * np.minimum(sizes, sizes[r]) >= percent * np.maximum(sizes, sizes[r])
            if key[1] != key[2]:
                ok &= own != own[r]
            at = np.flatnonzero(ok)
            at = at[(values[at] == values[r]).mean(axis=1) >= LIKELY]
            links += [(node[i], node[r]) for i in at.tolist() if reaches(full[i], full[r], percent)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    columns = ["heap", "i", "j", "block", "node", "component", "signature", "members"]
    return met.select(*columns).groupBy("heap", "i", "j").applyInPandas(run, "a long, b long")


def near_copies(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents`` (``doc_id, text``).

    Two documents are linked if their sets of ``width``-word shingles share at least ``percent`` of
    their union; ``component_id`` is the smallest doc_id that links reach.

    Equal sets are one class, known by its smallest doc_id. A signature keeps the minimum and the
    maximum under each permutation. In every band bucket all members are first checked against the
    smallest one; buckets whose other members these links leave in several components are then compared
    block by block, where sizes and signatures allow a link. Every link is confirmed on full sets; pairs that are none are never rows.

    A null or empty text has no shingles and no link. Rows with a null doc_id are not compared: their
    component is null. A repeated doc_id is one node, linked by any of its texts. An empty table gives
    no rows; other columns are ignored.
    """
    texts = documents.select("doc_id", "text")
    signed = cut_lineage(signatures(texts, width), "signatures")
    known = signed.filter("doc_id is not null and digest is not null")
    first = F.min_by(F.struct("n_shingles", "signature"), "doc_id").alias("_first")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), first)
    classes = cut_lineage(classes.select("digest", "node", "copies", "_first.*"), "classes")
    heads = classes.select("node", "n_shingles", "signature")
    shared = cut_lineage(shared_buckets(bands(heads)), "buckets")
    pairs = cut_lineage(shared.select(F.col("node").alias("a"), "b").distinct(), "pairs")
    nodes = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = cut_lineage(full_sets(texts, nodes, width), "sets")
    links = cut_lineage(confirmed(pairs, sets, percent), "links")
    rest = cut_lineage(rest_links(heads, sets, shared, components(links), percent), "rest")
    links = links.union(rest)
    # A doc_id with several texts links their classes.
    copied = classes.filter("copies > 1").select("digest", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = known.select("digest", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    members = salted.join(copied, ["digest", "salt"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    found = components(links.union(members))
    out = signed.select("doc_id", "n_shingles").join(found, signed["doc_id"] == found["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
