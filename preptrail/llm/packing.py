"""Order-preserving packing of token streams into windows by dynamic programming."""

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preptrail.llm.columns import records

LENGTH = 1024
#: What a cut costs, in padding tokens: at a sentence end, and inside a sentence.
SENTENCE_CUT = 2
INNER_CUT = 64
#: Tokens that are cut together; a document is never dealt to two blocks.
BLOCK_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def cuts(places: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indexes of ``places`` at which sequences end, with the least padding plus cut costs.

    ``places`` are ascending token positions at which a cut is allowed, from 0 to the end, at most
    ``length`` apart. With f the best total up to a place, f(i) = min over the places j within reach
    of f(j) + place(j), plus length - place(i) + cost(i); the minimum slides, so a monotone queue holds it.
    """
    at, cost = places.tolist(), costs.tolist()
    came = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f + place, index), values ascending
    for i in range(1, len(at)):
        place = at[i]
        least = place - length
        while at[queue[0][1]] < least:
            queue.popleft()
        value, came[i] = queue[0]
        value += length + cost[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    ends, i = [], len(at) - 1
    while i > 0:
        ends.append(i)
        i = came[i]
    return ends[::-1]


def cut_places(ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and costs for ``cuts``: document ends are free, sentence ends cheap, and gaps of more
    than ``length`` tokens are divided at dear places, with the same least cost as if any token of
    a gap could be cut."""
    total = int(ends[-1])
    marks = np.union1d(np.concatenate(([0], ends)), sentence_ends[sentence_ends < total])
    costs = np.where(np.isin(marks, ends), 0, SENTENCE_CUT)
    wide = np.flatnonzero(np.diff(marks) > length)
    if len(wide):
        # Cuts inside a gap cost the same anywhere, so each may be moved back to where its sequence is full:
        # whole windows after the place, at most one window before the gap, at which a sequence begins.
        inner, late = [], np.zeros(0, dtype=marks.dtype)
        for g in wide.tolist():
            start, end = marks[g], marks[g + 1]
            late = late[late > start - length]
            begins = np.union1d(marks[np.searchsorted(marks, start - length, side="right") : g + 1], late)
            windows = length * np.arange(1, (end - start) // length + 2)
            grid = (begins[None, :] + windows[:, None]).ravel()  # ascending, as begins lie within one window
            inner.append(grid[grid < end])
            late = np.concatenate((late, inner[-1]))
        extra = np.concatenate(inner)
        places = np.concatenate((marks, extra))
        order = np.argsort(places, kind="stable")
        return places[order], np.concatenate((costs, np.full(len(extra), INNER_CUT)))[order]
    return marks, costs


def pack_block(
    doc_ids: list, tokens: list[np.ndarray], sentence_end: np.ndarray, first_sequence: int, length: int = LENGTH
) -> tuple[dict[str, list], int]:
    """Pieces of consecutive documents; the next free sequence number.

    ``sentence_end`` says of each token id whether a sentence ends after it.
    """
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    ends = np.cumsum(sizes)
    stream = np.concatenate(tokens).astype("<u4")
    places, costs = cut_places(ends, np.flatnonzero(sentence_end[stream]) + 1, length)
    bounds = places[cuts(places, costs, length)]
    # Pieces lie between neighbouring document ends and sequence ends.
    stops = np.union1d(ends, bounds)
    starts = np.concatenate(([0], stops[:-1]))
    doc = np.searchsorted(ends, starts, side="right")
    sequence = np.searchsorted(bounds, starts, side="right")
    doc_start, sequence_start = ends - sizes, np.concatenate(([0], bounds[:-1]))
    view = memoryview(stream.tobytes())
    pairs = zip(starts.tolist(), stops.tolist(), strict=True)
    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in pairs]
    return {
        "doc_id": [doc_ids[d] for d in doc.tolist()],
        "start": starts - doc_start[doc],
        "length": stops - starts,
        "ids_crc32": crcs,
        "doc_tokens": sizes[doc],
        "sequence_id": first_sequence + sequence,
        "offset": starts - sequence_start[sequence],
    }, first_sequence + len(bounds)


def pack(
    documents: DataFrame,
    encoder: Callable[[], tuple[Callable[[str], list[int]], np.ndarray]],
    length: int = LENGTH,
    block_tokens: int = BLOCK_TOKENS,
    end_id: int = 0,
) -> DataFrame:
    """Pack ``doc_id, text`` into sequences of at most ``length`` tokens, in the order of doc_id.

    ``encoder`` makes, once in each task, a function from a text to its ids and an array that says of
    each id whether it ends a sentence. Every document is its ids and then ``end_id``. Documents follow
    each other in ranges of doc_id; a range is cut in blocks of about ``block_tokens`` tokens, and each
    block is cut into sequences at document ends (free), sentence ends (cheap) or, in sentences that are
    longer than a sequence, elsewhere (dear), with the least sum of padding and cut costs. A block's
    last sequence may be short.

    A null text is empty (one piece with the end id). Rows with equal or null doc_id (first) are packed
    each on its own, in the order of their texts. An empty table gives no pieces. Other columns are
    ignored. A task holds one block of tokens, and at least one document.
    """
    spread = (F.col("doc_id"), F.xxhash64("text"))
    ordered = documents.select("doc_id", "text").repartitionByRange(*spread).sortWithinPartitions(*spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sentence_end = encoder()
        sequence = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for name, text in zip(names, texts, strict=True):
                got = encode(text.as_py() or "")
                got.append(end_id)
                ids.append(name)
                tokens.append(np.array(got, dtype=np.uint32))
                held += len(got)
                if held >= block_tokens:
                    pieces, sequence = pack_block(ids, tokens, sentence_end, sequence, length)
                    yield records(pieces, ARROW)
                    ids, tokens, held = [], [], 0
        if ids:
            pieces, sequence = pack_block(ids, tokens, sentence_end, sequence, length)
            yield records(pieces, ARROW)

    return ordered.mapInArrow(run, PIECES)
