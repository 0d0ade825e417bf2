"""Byte-level BPE by a table of ranks: merges are folded over the byte arrays of distinct words."""

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from preptrail.llm.columns import chunks, records, text_buffers
from preptrail.llm.tokens import read_ranks

NONE = np.int32(2**31 - 1)
#: Longer words are merged one by one with a heap, so that a row of the arrays stays short.
ARRAY_BYTES = 64
KNOWN_WORDS = 400_000
#: White space, and the split pattern spelt with these classes.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same with the standard library's classes, which agree on the characters of Latin text below.
QUICK_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_QUICK = "[^\\t-\\r -~\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u20ac]"
RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


class Merges:
    """The rank map as arrays: a merge is a pair of token ids and the id (also the rank) it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.map = found
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[p] for p in self.pairs.tolist()], dtype=np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the two do not merge or one is no token (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (right >= 0), self.ranks[at], NONE)

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: in every step each word merges its pair of the lowest rank, the leftmost of
        equal ones, until none has any."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for lot in np.array_split(order, max(1, len(order) // 20_000)):
            lot = lot[sizes[lot] <= ARRAY_BYTES]
            if len(lot):
                for place, ids in zip(lot.tolist(), self._fold_arrays([words[i] for i in lot.tolist()], sizes[lot]), strict=True):
                    out[place] = ids
        for place in np.flatnonzero(sizes > ARRAY_BYTES).tolist():
            out[place] = self._fold_long(words[place])
        return out

    def _fold_arrays(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        width = int(sizes.max(initial=1)) + 1
        ids = np.full((len(words), width), -1, dtype=np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(ids.shape, NONE, dtype=np.int32)
        ranks[:, :-1] = self.of(ids[:, :-1], ids[:, 1:])
        left = sizes.copy()
        active = np.arange(len(words))
        column = np.arange(width)
        while len(active):
            at = ranks[active].argmin(axis=1)
            best = ranks[active, at]
            active, at, best = active[best != NONE], at[best != NONE], best[best != NONE]
            if not len(active):
                break
            # Close the gap that the merge leaves, in ids and in ranks.
            source = column + (column > at[:, None])
            source[:, -1] = width - 1
            own, own_ranks = ids[active], ranks[active]
            rows = np.arange(len(active))
            own[rows, at] = best
            own, own_ranks = np.take_along_axis(own, source, 1), np.take_along_axis(own_ranks, source, 1)
            own[:, -1], own_ranks[:, -1] = -1, NONE
            own_ranks[rows, at] = self.of(own[rows, at], own[rows, np.minimum(at + 1, width - 1)])
            before = np.maximum(at - 1, 0)
            joined = self.of(own[rows, before], own[rows, at])
            own_ranks[rows, before] = np.where(at > 0, joined, own_ranks[rows, before])
            ids[active], ranks[active] = own, own_ranks
            left[active] -= 1
        return [row[:n] for row, n in zip(ids.tolist(), left.tolist(), strict=True)]

    def _fold_long(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of ranks and places over linked pieces."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.map.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.map.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (r := self.map.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def splitter():
    """Function from a text to its words."""
    exact, quick, odd = regex.compile(SPLIT), re.compile(QUICK_SPLIT), re.compile(NOT_QUICK)
    return lambda text: (exact if odd.search(text) else quick).findall(text)


def encode_and_decode(documents: DataFrame, rank_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text of ``doc_id, text``.

    Texts are split into words, and each task folds the ranked merges over the distinct words of its
    rows, all at once; a text's ids are its words' ids in order, and its decoded bytes the pieces of
    these ids joined. ``ids_sha256`` is over the decimal ids joined by commas. No row moves.

    A null or empty text has no ids. Rows repeated with an id each give a row, a null id stays null, an
    empty table gives no rows, other columns are ignored. A task keeps at most ``KNOWN_WORDS`` words
    beside those of the rows at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = Merges(read_ranks(rank_path)), splitter()
        ids_of: dict[str, str] = {}
        bytes_of: dict[str, bytes] = {}
        for batch in batches:
            _, bounds = text_buffers(batch.column(1))
            for a, b in chunks(bounds):
                split_texts = [split(text or "") for text in batch.column(1).slice(a, b - a).to_pylist()]
                if len(ids_of) > KNOWN_WORDS:
                    ids_of, bytes_of = {}, {}
                fresh = list({w for words in split_texts for w in words if w not in ids_of})
                for word, ids in zip(fresh, merges.fold([w.encode() for w in fresh]), strict=True):
                    ids_of[word] = ",".join(map(str, ids))
                    bytes_of[word] = merges.decode(ids)
                out: dict[str, list] = {name: [] for name in RESULT.names}
                for words in split_texts:
                    ids_text = ",".join([ids_of[w] for w in words])
                    out["n_tokens"].append(ids_text.count(",") + 1 if ids_text else 0)
                    out["ids_sha256"].append(hashlib.sha256(ids_text.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join([bytes_of[w] for w in words])).hexdigest())
                out["doc_id"] = batch.column(0).slice(a, b - a).to_pylist()
                yield records(out, RESULT)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
