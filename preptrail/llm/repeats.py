"""Repeated word windows: a Count-Min sketch drops most windows, the rest are grouped exactly."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail.llm.columns import chunks, records, text_buffers
from preptrail.llm.ordering import with_row_numbers
from preptrail.llm.words import LANES, Windows, slide, spans
from preptrail.session import cut_lineage

WINDOW = 35
GRAM = 12
#: Rows of the sketch are first counted at this fineness and folded to the width that is used.
FINE_BITS = 30
SEGMENT_BITS = 6
#: Counters per counted gram, and the widest row that is sent to executors (2**28 bits, 32 MiB).
COUNTERS = 8
MAX_BITS = 28
FLUSH = 4_000_000
SKETCH = "lane int, segment int, grams long, once binary, more binary"
SKETCH_ARROW = pa.schema(
    [("lane", pa.int32()), ("segment", pa.int32()), ("grams", pa.int64()), ("once", pa.binary()), ("more", pa.binary())]
)
FOUND_ARROW = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
RESULT_ARROW = pa.schema(
    [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
)


class Chunk:
    """Words of some whole texts and the smallest gram of every window of words."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.before = spans(text, bounds)
        self.window = window
        self.hashes = [lane.words(text, self.starts, self.ends) for lane in LANES]
        self.sums = [Windows(lane, h) for lane, h in zip(LANES, self.hashes, strict=True)]
        n = len(self.starts)
        self.grams = np.maximum(self.sums[0].at(np.arange(max(0, n - gram + 1)), gram), np.uint64(1))
        self.smallest = slide(self.grams, window - gram + 1, np.minimum)
        # A window is within one text if its last word comes before the text's end.
        text_of = np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))
        self.text_of = text_of
        self.valid = text_of[: max(0, n - window + 1)] == text_of[window - 1 :]
        self.gram = gram

    def chosen(self) -> np.ndarray:
        """Places of the grams that are the smallest of some window."""
        if not self.valid.any():
            return np.zeros(0, dtype=np.int64)
        reach = self.window - self.gram
        least = np.where(self.valid, self.smallest, np.uint64(0))
        padded = np.concatenate((np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)))
        return np.flatnonzero(slide(padded, reach + 1, np.maximum) == self.grams)

    def buckets(self, places: np.ndarray) -> list[np.ndarray]:
        """Bucket of the gram at each place in either row of the sketch."""
        shift = np.uint64(64 - FINE_BITS)
        return [(s.at(places, self.gram) >> shift).astype(np.uint32) for s in self.sums]


def _sketch(window: int, gram: int):
    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows: dict[str, list] = {name: [] for name in SKETCH_ARROW.names}
        low = FINE_BITS - SEGMENT_BITS
        for lane, parts in enumerate(held):
            buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(buckets, np.arange((1 << SEGMENT_BITS) + 1, dtype=np.int64) << low)
            for segment in range(1 << SEGMENT_BITS):
                own = slice(edges[segment], edges[segment + 1])
                inside, times = buckets[own] - np.uint32(segment << low), counts[own]
                rows["lane"].append(lane)
                rows["segment"].append(segment)
                rows["grams"].append(int(times.sum()))
                rows["once"].append(inside[times == 1].astype("<u4").tobytes())
                rows["more"].append(inside[times > 1].astype("<u4").tobytes())
        return records(rows, SKETCH_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        count = 0
        for batch in batches:
            text, bounds = text_buffers(batch.column(0))
            for a, b in chunks(bounds):
                chunk = Chunk(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], window, gram)
                places = chunk.chosen()
                for lane, buckets in enumerate(chunk.buckets(places)):
                    held[lane].append(buckets)
                count += len(places)
                if count >= FLUSH:
                    yield flush(held)
                    held, count = [[], []], 0
        if count:
            yield flush(held)

    return run


def _merge(bits: int):
    """Merge the partial counts of sorted rows, segment after segment, to one bit for two or more."""
    fold = FINE_BITS - bits
    width = 1 << (bits - SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            done = {"lane": [key[0]], "segment": [key[1]], "bits": [np.packbits(counts > 1).tobytes()]}
            return records(done, pa.schema([("lane", pa.int32()), ("segment", pa.int32()), ("bits", pa.binary())]))

        key, counts = None, np.zeros(width, dtype=np.uint8)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["lane"], row["segment"]) != key:
                    if key is not None:
                        yield out()
                    key, counts = (row["lane"], row["segment"]), np.zeros(width, dtype=np.uint8)
                for name, weight in (("once", 1), ("more", 2)):
                    at, times = np.unique(np.frombuffer(row[name], "<u4") >> np.uint32(fold), return_counts=True)
                    counts[at] = np.minimum(2, counts[at] + np.minimum(2, times * weight).astype(np.uint8))
        if key is not None:
            yield out()

    return run


def build_sketch(texts: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """Bits (a row per lane) of the counters that reached two, and the width of a row in bits.

    The width follows the number of counted grams up to ``MAX_BITS``: what is sent to executors is at
    most ``len(LANES) * 2**MAX_BITS`` bits. Beyond that more windows pass the filter, none is lost.
    """
    partial = cut_lineage(texts.mapInArrow(_sketch(window, gram), SKETCH), "sketch")
    grams = partial.filter("lane = 0").agg(F.sum("grams")).head()[0] or 0
    bits = min(MAX_BITS, max(16, (COUNTERS * grams).bit_length()))
    dealt = partial.select("lane", "segment", "once", "more").repartition(16, "lane", "segment")
    merged = dealt.sortWithinPartitions("lane", "segment").mapInArrow(_merge(bits), "lane int, segment int, bits binary")
    rows = np.zeros((len(LANES), 1 << (bits - 3)), dtype=np.uint8)
    size = 1 << (bits - SEGMENT_BITS - 3)
    for row in merged.collect():  # a fixed number of segments, each of a bounded size
        rows[row["lane"], row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return rows, bits


def estimated_repeats(chunk: Chunk, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Places of the windows whose smallest gram the sketch counts at least twice."""
    places = np.flatnonzero(chunk.valid)
    if not len(places):
        return places
    chosen = chunk.chosen()
    seen = np.ones(len(chosen), dtype=bool)
    for row, buckets in zip(sketch, chunk.buckets(chosen), strict=True):
        at = buckets >> np.uint32(FINE_BITS - bits)
        seen &= (row[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) == 1
    return places[np.isin(chunk.smallest[places], chunk.grams[chosen[seen]])]


def repeated_windows(texts: DataFrame, window: int, gram: int, sketch, bits: int) -> DataFrame:
    """``row, place, h1, h2`` of every window estimated repeated; ``texts`` has ``text, row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bounds = text_buffers(batch.column(0))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(bounds):
                chunk = Chunk(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], window, gram)
                places = estimated_repeats(chunk, sketch.value, bits)
                if len(places):
                    own = chunk.text_of[places]
                    h1, h2 = (s.at(places, window).view(np.int64) for s in chunk.sums)
                    found = {"row": names[a:b][own], "place": places - chunk.before[own], "h1": h1, "h2": h2}
                    yield records(found, FOUND_ARROW)

    return texts.mapInArrow(run, "row long, place int, h1 long, h2 long")


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None, with_text: bool = True
) -> DataFrame:
    """Remove every word that is covered by a window of words which also starts anywhere else.

    Adds ``n_words``, ``n_removed``, ``kept_sha256`` and, ``with_text``, ``kept`` (the words left, joined
    by one space) to the columns ``carry`` of ``documents`` (all by default; columns with these names are
    replaced). Windows are judged on the input; the same document counts too.

    1. Each window of ``window`` words is stood for by the smallest of its ``gram``-word hashes, so equal
       windows share it. Partitions count the chosen grams in sparse Count-Min rows, which are merged
       and saturate at two: an estimate is never below the number of places at which a window starts.
    2. Only windows with an estimate of two or more are grouped, by 128-bit hashes of their words.
    3. Of these, the few that turn out to start once are handed back to their documents; all the others
       of step 2 cover the words that go.

    A null text has no words, a text shorter than a window loses none, rows repeated with the same id and
    text repeat each other's windows. Rows are told apart by numbers of their own (``with_row_numbers``), so
    ids may be null or repeat. An empty table gives an empty result.
    """
    if gram > window:
        raise ValueError("gram must not exceed window")
    spark = documents.sparkSession
    sketch_bits, bits = build_sketch(documents.select("text"), window, gram)
    sketch = spark.sparkContext.broadcast(sketch_bits)
    key = "_row"
    while key in map(str.lower, documents.columns):
        key += "_"
    numbered = with_row_numbers(documents, key)
    found = repeated_windows(numbered.select("text", F.col(key).alias("row")), window, gram, sketch, bits)
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("place").alias("place"))
    alone = groups.filter("n = 1").groupBy("row").agg(F.collect_list("place").alias("_alone"))

    schema = pa.schema([f for f in RESULT_ARROW if with_text or f.name != "kept"])
    rest = [c for c in (documents.columns if carry is None else carry) if c not in RESULT_ARROW.names]
    # Whatever the columns are called, inside the task they have names of their own; the text is among them once.
    inner = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*rest, "text"]))}
    wrapped = numbered.select(*(F.col(c).alias(name) for c, name in inner.items()), F.col(key).alias("row"))
    alone = alone.withColumnRenamed("_alone", "alone")
    joined = wrapped.join(alone, "row", "left").select(*inner.values(), "alone")
    fields = ", ".join(
        [f"{inner[c]} {documents.schema[c].dataType.simpleString()}" for c in rest]
        + [f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, bounds = text_buffers(batch.column(inner["text"]))
            alone_at = batch.column("alone")
            out: dict[str, list] = {name: [] for name in RESULT_ARROW.names}
            for a, b in chunks(bounds):
                part, edges = text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                chunk = Chunk(part, edges, window, gram)
                starts = np.zeros(len(chunk.starts) + 1, dtype=bool)
                starts[estimated_repeats(chunk, sketch.value, bits)] = True
                for i in np.flatnonzero(alone_at.slice(a, b - a).is_valid()).tolist():
                    starts[chunk.before[i] + np.array(alone_at[a + i].as_py())] = False
                change = np.zeros(len(starts), dtype=np.int32)
                at = np.flatnonzero(starts)
                change[at] += 1
                change[at + window] -= 1
                gone = np.cumsum(change[:-1]) > 0
                data = part.tobytes()
                for i in range(b - a):
                    lo, hi = int(chunk.before[i]), int(chunk.before[i + 1])
                    own = data[edges[i] : edges[i + 1]].split()
                    own_gone = gone[lo:hi]
                    removed = int(own_gone.sum())
                    if removed:
                        own = [w for w, g in zip(own, own_gone.tolist(), strict=True) if not g]
                    kept = b" ".join(own)
                    out["n_words"].append(hi - lo)
                    out["n_removed"].append(removed)
                    out["kept"].append(kept.decode() if with_text else None)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            made = [pa.array(out[f.name], type=f.type) for f in schema]
            names = [inner[c] for c in rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *schema.names])

    named = (F.col(inner[c]).alias(c) for c in rest)
    return joined.mapInArrow(run, fields).select(*named, *schema.names)
