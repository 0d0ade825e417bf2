"""Text vectors and pooling."""

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preptrail.functions import clean, vectors

ENCODE_BATCH = 64
#: Texts and bytes of texts that an encoder of Arrow texts gets at a time, and buckets of tokens that it keeps.
ARROW_BATCH = 4096
ARROW_BYTES = 4 << 20
KNOWN_TOKENS = 100_000
Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Sum of one-hot token buckets; the bucket of a token comes from its MD5 digest.

    A stand-in for a trained model: any callable from texts to a matrix of token sums can take its
    place. Sum and mean give the same unit vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._token = re.compile(r"[^\W_]+")
        self._known: dict[str, int] = {}
        # Lower case of ASCII letters and digits, zero for what stands between tokens.
        self._folded = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 0 for i in range(256)], np.uint8)

    def _bucket(self, token: str) -> int:
        bucket = self._known.get(token)
        if bucket is None:
            bucket = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
            if len(self._known) < KNOWN_TOKENS:
                self._known[token] = bucket
        return bucket

    def arrow(self, texts: pa.Array) -> np.ndarray | None:
        """The same rows from the bytes of ASCII texts, without a Python string each; None for other texts."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.zeros(0, np.uint8)
        if len(data) and data.max() > 127:
            return None
        edges, folded = edges - edges[0], self._folded[data]
        within = folded != 0
        first = within.copy()
        first[1:] &= ~within[:-1]
        starts = edges[:-1][edges[:-1] < len(data)]
        first[starts] = within[starts]
        row = np.searchsorted(edges, np.flatnonzero(first), side="right") - 1
        places = np.append(np.flatnonzero(first[within]), np.count_nonzero(within))
        buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(folded[within])]
        tokens = pa.Array.from_buffers(pa.large_string(), len(row), buffers).dictionary_encode()
        buckets = np.array([self._bucket(t) for t in tokens.dictionary.to_pylist()], dtype=int)
        cells = row * self.dim + (buckets[tokens.indices.to_numpy()] if len(row) else np.zeros(0, dtype=int))
        return np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)

    def __call__(self, texts: list[str]) -> np.ndarray:
        tokens = [self._token.findall((t or "").lower()) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
        codes, seen = pd.factorize(np.array([t for ts in tokens for t in ts], dtype=object))
        buckets = np.array([self._bucket(t) for t in seen], dtype=int)
        cells = row * self.dim + (buckets[codes] if len(codes) else np.zeros(0, dtype=int))
        counts = np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        return counts.astype(float)


def normalize_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return (matrix / np.maximum(norms, vectors.MIN_NORM)).astype(np.float32)


class TextEncoder:
    """Column functions around an encoder, which is set up once per task and gets whole texts.

    They are marked nondeterministic, so that a filter on the vector reads it instead of encoding again.

    Calling it gives unit vectors. ``sums`` gives the encoder's own rows, which add up over the
    parts of a text, so that a text spread over many rows never has to be put together.
    """

    def __init__(self, encoder: Encoder | None = None, batch: int = ENCODE_BATCH):
        self.encoder = encoder or HashingEncoder()
        self.batch = batch

    def _column(self, finish: Callable[[np.ndarray], np.ndarray], element: T.DataType, packed: bool = False):
        model, batch = self.encoder, self.batch

        kind = pa.float32() if isinstance(element, T.FloatType) else pa.float64()

        def encoded(texts: pa.Array) -> Iterator[np.ndarray]:
            whole = getattr(model, "arrow", None)
            if whole is not None and len(texts):
                step = max(1, min(ARROW_BATCH, ARROW_BYTES * len(texts) // max(1, texts.nbytes)))
                for start in range(0, len(texts), step):
                    some = texts.slice(start, step)
                    part = whole(some) if some.nbytes <= 4 * ARROW_BYTES else None
                    yield from [part] if part is not None else strings(some)
            else:
                yield from strings(texts)

        def strings(texts: pa.Array) -> Iterator[np.ndarray]:
            # Only ``batch`` texts at a time become Python strings, however many Spark sends.
            for start in range(0, len(texts), batch):
                yield model(texts.slice(start, batch).to_pylist())

        def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in parts:
                rows = [finish(part) for part in encoded(texts)]
                values = pa.array(np.concatenate([np.asarray(r).ravel() for r in rows] or [np.zeros(0)]), kind)
                edges = np.arange(len(texts) + 1, dtype=np.int32) * (len(values) // max(1, len(texts)))
                if packed:
                    yield pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges * 4), values.buffers()[1]])
                else:
                    yield pa.ListArray.from_arrays(edges, values)

        encode.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(encode, T.BinaryType() if packed else T.ArrayType(element)).asNondeterministic()

    def __call__(self, text: Column) -> Column:
        return self._column(normalize_rows, T.FloatType())(text)

    def packed(self, text: Column) -> Column:
        """Unit vectors as the bytes of their single-precision values: one value to write and to read instead of one for
        each dimension. Searches read them as they are."""
        return self._column(normalize_rows, T.FloatType(), packed=True)(text)

    def sums(self, text: Column) -> Column:
        return self._column(lambda rows: np.asarray(rows, dtype=float), T.DoubleType())(text)


def add_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Sum of the vectors per key, added up by dimension on the map side."""
    by_dim = df.select(key, F.posexplode(vector).alias("_dim", "_x")).groupBy(key, "_dim").agg(F.sum("_x").alias("_x"))
    in_order = F.array_sort(F.collect_list(F.struct("_dim", "_x")))
    return by_dim.groupBy(key).agg(F.transform(in_order, lambda c: c["_x"]).alias(vector))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Masked mean over the token vectors of one row (array of arrays, array of 0/1)."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(vectors.MIN_NORM))
    masked = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m))
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(masked, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / weight)


def mean_pool_rows(df: DataFrame, keys: list[str], vector: str, mask: Column) -> DataFrame:
    """Masked mean of vectors stored one per row, combined on the map side."""
    weighted = F.transform(vector, lambda x: x.cast("double") * mask)
    pooled = df.groupBy(*keys).agg(
        Summarizer.sum(array_to_vector(weighted)).alias("_sum"),
        F.greatest(F.sum(mask.cast("double")), F.lit(vectors.MIN_NORM)).alias("_weight"),
    )
    mean = F.transform(vector_to_array("_sum"), lambda x: x / F.col("_weight"))
    return pooled.select(*keys, mean.alias(vector))


def problem_index(problems: DataFrame, encode: TextEncoder, packed: bool = False) -> DataFrame:
    """Vector table of problems: id, vector (``packed`` or an array), search metadata and the description, whole
    (``document``) and as the snippet that is shown.

    ``problems`` has id, company, title, topics, difficulty, url, frequency and description.
    """
    text = clean.search_text(F.col("company"), F.col("title"), F.col("topics"), F.col("difficulty"))
    return problems.select(
        "id",
        "company",
        "difficulty",
        F.coalesce("frequency", F.lit(0.0)).alias("frequency"),
        "title",
        "url",
        F.coalesce("description", F.lit("")).alias("document"),
        clean.snippet(F.col("description")).alias("snippet"),
        (encode.packed(text) if packed else encode(text)).alias("vector"),
    )


def solution_index(solutions: DataFrame, encode: TextEncoder) -> DataFrame:
    """Vector table of worked solutions, found by their prompt and returning the completion."""
    return solutions.select(
        F.concat(F.lit("sol_"), F.col("row_no").cast("string")).alias("id"),
        F.lit("reference_solution").alias("type"),
        F.col("completion").alias("document"),
        encode(F.col("prompt")).alias("vector"),
    )


