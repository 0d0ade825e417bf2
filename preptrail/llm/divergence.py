"""How far the sources of a language differ in their use of terms, from count-level bitmaps."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail.llm.ordering import with_positions
from preptrail.llm.terms import LETTERS, splitter, texts
from preptrail.session import cut_lineage

MIN_DOCUMENTS = 10
TOP_TERMS = 10
#: Partial counts that a task holds before it hands them on.
HELD_TERMS = 1_000_000
#: Terms of a bitset word, words of a segment, and sources of a block that one task compares.
WORD = 64
SEGMENT = 16
SOURCES = 256
COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def partial_counts(documents: DataFrame, letters: str) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``docs`` (documents with the term), summed within batches of a task."""

    def flush(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            group = [pa.repeat(pa.scalar(name, pa.string()), len(n)) for name in (lang, source)]
            counts = [pa.array(list(c), pa.int64()) for c in (n.values(), map(docs.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([*group, pa.array(list(n), pa.binary()).cast(pa.string()), *counts], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = splitter(letters)
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for name, text in zip(names, texts(batch.column(2)), strict=True):
                found = terms(text)
                if not found:
                    continue
                if name not in groups:
                    groups[name] = (Counter(), Counter())
                n, docs = groups[name]
                held -= len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n)
                if held > HELD_TERMS:
                    yield from flush(groups)
                    groups, held = {}, 0
        yield from flush(groups)

    return documents.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), in decimals, so that no product overflows."""
    scaled = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", scaled, (total + 2 * kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) in 64-bit integers: shares are at most 10**9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_cells(words: pd.DataFrame, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source pairs ``(i, j)``, i < j, and their summed values over one segment's words.

    ``words`` has a row per (source, level, word): ``code`` of the source, ``side`` of its block, ``p`` of
    the level, ``bits`` of the level's terms; the row of level zero holds all terms of the word, of which
    those on the source's other levels are taken away. AND of two levels and popcount give the size of
    a cell; it counts once with the distance of the levels' shares. With ``both`` only sources of
    different blocks are compared.
    """
    n = int(words["code"].max()) + 1
    sums = np.zeros(n * n, np.int64)
    words = words.sort_values(["word", "code"], kind="stable")
    edges = np.flatnonzero(np.diff(words["word"].to_numpy(), prepend=-1))
    cuts = np.append(edges, len(words))
    all_code, all_side, all_p = (words[c].to_numpy() for c in ("code", "side", "p"))
    all_zero, all_bits = words["zero"].to_numpy(), words["bits"].to_numpy().view(np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        code, side, p, zero, bits = (x[a:b] for x in (all_code, all_side, all_p, all_zero, all_bits.copy()))
        used = np.zeros(n, np.uint64)
        np.bitwise_or.at(used, code[~zero], bits[~zero])
        bits[zero] &= ~used[code[zero]]
        full = bits != 0
        code, side, p, bits = code[full], side[full], p[full], bits[full]
        for first in range(0, len(code), 512):  # bounded rows of the matrix at a time
            rows = slice(first, first + 512)
            cells = bits[rows, None] & bits[None, :]
            mask = (cells != 0) & (code[rows, None] < code[None, :])
            if both:
                mask &= side[rows, None] != side[None, :]
            i, j = np.nonzero(mask)
            gap, whole = p[rows][i] - p[j], p[rows][i] + p[j]
            np.add.at(sums, code[rows][i] * n + code[j], gap * gap // whole * np.bitwise_count(cells[i, j]).astype(np.int64))
    at = np.flatnonzero(sums)
    return at // n, at % n, sums[at]


def pair_values(levels: DataFrame, groups: DataFrame, live: DataFrame) -> DataFrame:
    """``lang, a, b`` (a < b), ``value`` of the pairs that differ, from the bitset words of all levels.

    A task holds one segment of a language's terms for two blocks of its sources. A language has as
    many blocks as its sources fill; each of its words goes to every pair of blocks with its own.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
    zeros = live.join(groups.select("lang", "source", "p0"), "lang")
    zeros = zeros.select("lang", "source", "word", F.col("p0").alias("p"), "bits", F.lit(True).alias("zero"))
    words = levels.select("lang", "source", "word", "p", "bits", F.lit(False).alias("zero")).union(zeros)
    words = words.join(blocks, "lang").withColumn("side", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    words = words.select("*", other).withColumns(
        {"i": F.least("side", "_other"), "j": F.greatest("side", "_other"), "segment": F.floor(F.col("word") / SEGMENT)}
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(group["source"].unique().astype(object))
        group["code"] = np.searchsorted(names, group["source"].to_numpy(object))
        i, j, value = joint_cells(group, key[2] != key[3])
        return pd.DataFrame({"lang": key[0], "a": names[i], "b": names[j], "value": value})

    columns = ["lang", "segment", "i", "j", "source", "side", "word", "p", "bits", "zero"]
    parts = words.select(*columns).groupBy("lang", "segment", "i", "j").applyInPandas(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(documents: DataFrame, letters: str = LETTERS, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of ``documents``.

    Terms are the runs of ``letters`` and characters outside ASCII in the whole text, A-Z as a-z; a language keeps those found in
    at least ``min_documents`` of its rows. A group's share of a term is ``1 + floor(10**9 * (count + 2) /
    (N + 2 * V))``. Part ``pair`` has a row for each other source of the language: the sum over all
    kept terms of ``floor((p - q)**2 / (p + q))`` of both shares. Part ``term`` has the ``top`` terms that
    the group uses more than its language, by the same distance to the language's share.

    Kept terms are numbered by descending count. For each group and count there is a bitset of the
    terms with it, in words of 64 terms; AND and popcount of two groups' levels give how many terms
    have both counts, and the terms on none of a group's levels have count zero (``pair_values``).

    Null text, lang and source count as ''. Texts without terms still make their group occur. In a
    language without kept terms all pairs are 0 and no term is listed; a language of one source has no
    pairs. Repeated rows count as often as they occur. Ties are ranked by the item's bytes. An empty
    table gives no rows; other columns are ignored.
    """
    rows = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = partial_counts(rows, letters).repartition("lang", "term")
    by_group = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    cells = by_group.withColumns({"all_n": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term)})
    cells = cut_lineage(cells.filter(F.col("docs") >= min_documents).drop("docs"), "cells")

    terms = cells.groupBy("lang", "term").agg(F.max("all_n").alias("all_n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = cut_lineage(groups.withColumn("p0", zero), "groups")

    numbered = with_positions(terms, [F.col("lang"), F.desc("all_n"), F.col("term")], F.lit(0), "place", "_none")
    place = {"word": F.floor(F.col("place") / WORD), "bit": F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")}
    numbered = cut_lineage(numbered.select("lang", "term", F.col("place")).withColumns(place), "terms")
    live = numbered.groupBy("lang", "word").agg(F.bit_or("bit").alias("bits"))
    placed = cells.join(numbered, ["lang", "term"])
    levels = placed.groupBy("lang", "source", "n", "word").agg(F.bit_or("bit").alias("bits"))
    known = groups.select("lang", "source", "total", "kept")
    levels = levels.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    one, two = groups.select("lang", F.col("source").alias("a")), groups.select("lang", F.col("source").alias("b"))
    found = pair_values(levels, groups.filter("kept > 0"), live)
    pairs = one.join(two, "lang").filter("a < b").join(found, ["lang", "a", "b"], "left").fillna(0, ["value"])
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    own, whole = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    used = cells.join(groups, ["lang", "source"]).withColumns({"p": own, "q": whole}).filter("p > q")
    listed = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(listed)
