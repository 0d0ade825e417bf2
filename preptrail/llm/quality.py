"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.llm.columns import chunks, text_buffers
from preptrail.llm.words import LANES, spans
from preptrail.session import cut_lineage

STATISTICS = [
    "bytes",
    "words",
    "word_bytes",
    "longest_word",
    "letters",
    "upper",
    "digits",
    "marks",
    "symbols",
    "sentence_ends",
    "lines",
    "line_repeats",
    "distinct_words",
    "top_word",
    "doubled_words",
]
TREES = 10
DEPTH = 3
LASSO = 0.002
MAX_ITERATIONS = 40


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    text = "".join(map(chr, code))
    is_in = lambda chars: np.isin(code, [ord(c) for c in chars])
    letters = np.array([c.isascii() and c.isalpha() for c in text]) | (code >= 0xC0)
    marks = np.array([33 <= i < 127 and not text[i].isalnum() for i in range(256)])
    return {
        "letters": letters,
        "upper": (code >= 65) & (code <= 90),
        "digits": is_in("0123456789"),
        "marks": marks,
        "symbols": marks & ~is_in(".,;:!?'\"()-"),
        "sentence_ends": is_in(".!?"),
    }


def _ranges(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each range."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def _distinct(hashes: np.ndarray, owners: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each row, and the count of its most frequent one."""
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(h))))
    return np.bincount(o[at], minlength=rows), most


def text_statistics(text: np.ndarray, bounds: np.ndarray, classes: dict[str, np.ndarray]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; counts are shares, so they hold for texts of any length."""
    rows, size = len(bounds) - 1, np.diff(bounds)
    starts, ends, before = spans(text, bounds)
    count = np.diff(before)
    owner = np.repeat(np.arange(rows), count)
    hashes = LANES[0].words(text, starts, ends)
    width = ends - starts
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, owner, width)
    found = {name: _ranges(table[text], bounds) for name, table in classes.items()}
    distinct, top = _distinct(hashes, owner, rows)
    doubled = np.zeros(len(hashes), dtype=bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    # Lines: from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(text == 10)
    line_starts = np.union1d(bounds[:-1][size > 0], feeds[feeds + 1 < len(text)] + 1)
    line_owner = np.searchsorted(bounds, line_starts, side="right") - 1
    line_ends = np.append(line_starts[1:], len(text))
    lines = np.bincount(line_owner, minlength=rows)
    line_kinds, _ = _distinct(LANES[0].words(text, line_starts, line_ends), line_owner, rows)
    some, some_words, some_lines = np.maximum(size, 1), np.maximum(count, 1), np.maximum(lines, 1)
    columns = {
        "bytes": size,
        "words": count,
        "word_bytes": np.bincount(owner, weights=width, minlength=rows) / some_words,
        "longest_word": longest,
        "letters": found["letters"] / some,
        "upper": found["upper"] / np.maximum(found["letters"], 1),
        "digits": found["digits"] / some,
        "marks": found["marks"] / some,
        "symbols": found["symbols"] / some,
        "sentence_ends": found["sentence_ends"] / some_words,
        "lines": lines / some_words,
        "line_repeats": 1 - line_kinds / some_lines * (lines > 0) - (lines == 0),
        "distinct_words": distinct / some_words,
        "top_word": top / some_words,
        "doubled_words": _ranges(doubled, before) / some_words,
    }
    return np.column_stack([np.asarray(columns[name], dtype=np.float64) for name in STATISTICS])


def with_statistics(documents: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``stats`` (array of ``STATISTICS``) of each whole ``text``, beside the columns ``carry`` in ``row``
    (all by default). A null text is empty; an empty text has zeros."""
    names = documents.columns if carry is None else carry
    wrapped = documents.select(F.struct(*names).alias("row"), F.col("text").alias("_text"))
    kind = wrapped.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            text, bounds = text_buffers(batch.column(1))
            if not batch.num_rows:
                continue
            parts = [text_statistics(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], classes) for a, b in chunks(bounds)]
            flat = np.concatenate(parts)
            offsets = np.arange(0, flat.size + 1, len(STATISTICS), dtype=np.int32)
            stats = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["row", "stats"])

    return wrapped.mapInArrow(run, f"row {kind}, stats array<double>")


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most or above, threshold), all of which hold


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; a score is the logistic function of their sum."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for index, at_most, threshold in rule:
        value = stats.getItem(index)
        out = out & (value <= threshold if at_most else value > threshold)
    return out


def tree_rules(debug: str) -> list[Rule]:
    """The path to every node of a tree, in the text form in which Spark shows trees."""
    rules, path = [], []
    for line in debug.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, int(found[2]), found[3] == "<=", float(found[4]))]
            tight: dict[tuple[int, bool], float] = {}
            for _, index, at_most, threshold in path:
                old = tight.get((index, at_most), threshold)
                tight[index, at_most] = min(old, threshold) if at_most else max(old, threshold)
            rules.append(tuple(sorted((i, low, t) for (i, low), t in tight.items())))
    return rules


def fit_rules(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fit to ``stats, label`` (0 or 1): paths of a random forest as rules, lasso weights by logistic
    regression. Both fits run on all labelled rows, distributed.

    Rows with a null label do not count. Without both labels there are no rules; the score is then the
    share of label 1, or one half without any label.
    """
    known = labelled.filter("label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"))
    known = cut_lineage(known, "labelled")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = {frozenset([0.0]): -6.0, frozenset([1.0]): 6.0}.get(frozenset(counts), 0.0)
        return RuleModel([], [], share)
    vectors = known.select("label", "stats", array_to_vector("stats").alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)})
    if not rules:
        return RuleModel([], [], float(np.log(counts[1.0] / counts[0.0])))
    flags = F.array(*[holds(rule, F.col("stats")).cast("double") for rule in rules])
    flagged = known.select("label", array_to_vector(flags).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=MAX_ITERATIONS).fit(flagged)
    used = [(rule, float(w)) for rule, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return RuleModel([r for r, _ in used], [w for _, w in used], float(fitted.intercept))


def held_out() -> Column:
    """Rows that labels are never learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """Fit on the labels of the rows ``doc_id, stats`` that are not held out."""
    asked = labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return fit_rules(stats.join(asked, "doc_id").select("stats", "label"))


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``documents``.

    Whole texts, each read once, give statistics; labels enter the fit alone. Empty and null texts have
    the score of empty texts, equal texts equal scores. A null doc_id is scored and never trained on.
    Other columns are ignored; an empty table gives no rows.
    """
    stats = with_statistics(documents, ["doc_id"]).select("row.doc_id", "stats")
    stats = cut_lineage(stats, "statistics")
    model = fit_on_labels(stats, labels)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` with a score of at least one half, all columns unchanged."""
    stats = with_statistics(documents.select("doc_id", "text"), ["doc_id"]).select("row.doc_id", "stats")
    model = fit_on_labels(stats.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels)
    return with_statistics(documents).filter(model.score(F.col("stats")) >= 0.5).select("row.*")
