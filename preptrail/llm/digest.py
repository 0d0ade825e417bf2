"""Quartile bucket digests: counts of hashed byte triplets, encoded by quartile, with a bounded score."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.llm.columns import chunks, records, text_buffers
from preptrail.session import cut_lineage

BUCKETS = 256
SLICE = 1 << 17
WIDTH = 5
#: Triplets of a window of five bytes: the last byte with two of the four before it.
TRIPLETS = [(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]
#: Mean difference of two independent buckets; a body that differs as much has likeness 0.
UNLIKE = 1.625
LENGTH_WEIGHT = 4
COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
FIELDS = (
    "range int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, text string"
)
ARROW = pa.schema(
    [
        ("range", pa.int32()),
        ("kind", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("text", pa.string()),
    ]
)
WHOLE, HEAD, TAIL = 0, 1, 2


class Digester:
    """Digests of many byte strings at once: the length's code, and each bucket's quartile."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        draw = np.random.default_rng(3)
        self.factors = draw.integers(0, 1 << 16, (len(TRIPLETS), 3), dtype=np.uint16) | np.uint16(1)
        self.shift = np.uint16(16 - (buckets.bit_length() - 1))

    def _counts(self, text: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        total = np.zeros(rows * self.buckets, dtype=np.int64)
        wide, base = text.astype(np.uint16), owner * self.buckets
        for factors, (i, j) in zip(self.factors, TRIPLETS, strict=True):
            if len(text) <= j:
                continue
            mixed = wide[j:] * factors[0] + wide[j - i : len(text) - i] * factors[1] + wide[: len(text) - j] * factors[2]
            mixed ^= mixed >> np.uint16(7)
            mixed *= np.uint16(0x9E35)
            keys = base[j:] + (mixed >> self.shift)
            total += np.bincount(keys[owner[j:] == owner[: len(text) - j]], minlength=len(total))
        return total.reshape(rows, self.buckets)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Triplets of each text in each bucket, over all its windows."""
        out = np.zeros((len(texts), self.buckets), dtype=np.int64)
        for row, text in enumerate(texts):
            # A long text is counted in slices that overlap by the reach of a window, without the overlap's own.
            if len(text) > SLICE:
                for first in range(0, len(text), SLICE):
                    head = max(0, first - WIDTH + 1)
                    for piece, sign in ((text[head : first + SLICE], 1), (text[head:first], -1)):
                        out[row] += sign * self._counts(np.frombuffer(piece, np.uint8), np.zeros(len(piece), np.int64), 1)[0]
        short = [i for i, text in enumerate(texts) if 0 < len(text) <= SLICE]
        sizes = np.array([len(texts[i]) for i in short], dtype=np.int64)
        for group in np.split(np.arange(len(short)), np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1):
            if len(group):
                joined = np.frombuffer(b"".join(texts[short[g]] for g in group), np.uint8)
                owner = np.repeat(np.arange(len(group)), sizes[group])
                out[[short[g] for g in group]] = self._counts(joined, owner, len(group))
        return out

    def digests(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length codes, and a row of quartile codes (0 to 3) for each text."""
        counts = self.counts(texts)
        ranked = np.sort(counts, axis=1)
        codes = np.zeros(counts.shape, dtype=np.uint8)
        for quarter in (1, 2, 3):
            codes += counts > ranked[:, quarter * self.buckets // 4 - 1, None]
        sizes = np.array([len(t) for t in texts], dtype=np.float64)
        return np.where(sizes > 0, np.minimum(255, np.round(8 * np.log2(np.maximum(sizes, 1)))), 0).astype(np.int64), codes

    def text(self, lengths: np.ndarray, codes: np.ndarray) -> list[str]:
        """Digests in hex."""
        four = codes.reshape(len(codes), -1, 4)
        packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
        return [bytes([n]).hex() + row.tobytes().hex() for n, row in zip(lengths.tolist(), packed, strict=True)]

    def likeness(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """1 for equal digests, 0 from the difference of unrelated ones on."""
        body = COST[a[1], b[1]].sum(axis=1)
        difference = body + LENGTH_WEIGHT * np.maximum(0, np.abs(a[0] - b[0]) - 1)
        return np.maximum(0.0, 1 - difference / (UNLIKE * self.buckets))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compare(digester: Digester, ranges: list, ids: list, texts: list[str]) -> pa.RecordBatch:
    """A row for each text that has another one after it."""
    rows = len(texts) - 1
    ranges, ids, following = ranges[:rows], ids[:rows], texts[1:]
    lengths, codes = digester.digests([t.encode() for t in texts])
    own, after = (lengths[:-1], codes[:-1]), (lengths[1:], codes[1:])
    changed = [edited(text, next_text).encode() for text, next_text in zip(texts[:-1], following, strict=True)]
    other = digester.digests(changed)
    columns = {
        "range": ranges,
        "kind": [WHOLE] * rows,
        "doc_id": ids,
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": digester.text(*own),
        "edited_fingerprint": digester.text(*other),
        "near_edited": digester.likeness(own, other),
        "near_next": digester.likeness(own, after),
        "text": [None] * rows,
    }
    return records(columns, ARROW)


def _edge(kind: int, range_id: int, doc_id, text: str) -> pa.RecordBatch:
    row = {"range": range_id, "kind": kind, "doc_id": doc_id, "text": text}
    return records({name: [row.get(name)] for name in ARROW.names}, ARROW)


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document with the next one of its range; the first and the last text go out, too."""
    digester, before = Digester(), None
    for batch in batches:
        _, bounds = text_buffers(batch.column(2))
        for a, b in chunks(bounds):
            ranges, ids, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in range(3))
            if before is None:
                yield _edge(HEAD, ranges[0], None, texts[0])
            else:
                ranges, ids, texts = [before[0], *ranges], [before[1], *ids], [before[2], *texts]
            before = ranges[-1], ids[-1], texts[-1]
            if len(texts) > 1:
                yield _compare(digester, ranges, ids, texts)
    if before:
        yield _edge(TAIL, *before)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digester = Digester()
    for batch in batches:
        for i in range(batch.num_rows):
            range_id, doc_id, text, following = (batch.column(c)[i].as_py() for c in range(4))
            yield _compare(digester, [range_id], [doc_id], [text, following])


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprint every whole text of ``doc_id, text``, and its edited text (see ``edited``).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``:
    the likeness, from 0 to 1, to the edited text's fingerprint and to that of the next document in the
    order of doc_id; the last document is followed by the first. Equal texts have equal fingerprints.

    A null text is empty; an empty or very short text has equal bucket counts. Equal ids follow each
    other in the order of their texts' hashes, null ids come first. A single document follows itself, an
    empty table gives no rows. Other columns are ignored.

    Texts are moved once, to ranges of doc_id; a task holds two texts. The last document of a range
    meets the first text of the next one by a join on the range's number.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().alias("range"), "doc_id", "text")
    compared = cut_lineage(ordered.mapInArrow(_in_ranges, FIELDS), "fingerprints")
    heads = compared.filter(F.col("kind") == HEAD).select(F.col("range").alias("next_range"), F.col("text").alias("following"))
    numbers = heads.select(F.col("next_range").alias("range"))
    # One number per range; the texts are joined afterwards.
    after = F.coalesce(F.lead("range").over(W.orderBy("range")), F.first("range").over(W.orderBy("range")))
    tails = compared.filter(F.col("kind") == TAIL).select("range", "doc_id", "text")
    edges = tails.join(numbers.withColumn("next_range", after), "range").join(heads, "next_range")
    finished = edges.select("range", "doc_id", "text", "following").mapInArrow(_at_edges, FIELDS)
    whole = compared.filter(F.col("kind") == WHOLE).union(finished)
    return whole.drop("range", "kind", "text")
