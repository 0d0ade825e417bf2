"""From raw documents to packed sequences: quality, near copies, repeated passages, packing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preptrail.llm.base import table
from preptrail.llm.nearcopies import near_copies
from preptrail.llm.ordering import with_row_numbers
from preptrail.llm.quality import keep_good
from preptrail.llm.queries import pack_documents
from preptrail.llm.repeats import RESULT_ARROW, remove_repeats
from preptrail.session import cut_lineage, release_scratch, scratch_mark

#: Models and groups are no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least one half; labels of held-out rows are not read.

    Null and empty texts have the score of empty texts. Equal texts have equal scores and stay or go
    together, rows of equal or null ids one by one. An empty table gives no rows; all columns are kept.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near copies (five words, 0.8).

    Rows are compared by numbers of their own, so that rows with equal ids or without one are copies like
    any others; of a group a row without an id stays only if none has one. Null and empty texts and texts
    without words are no copies and stay. An empty table gives no rows; all columns are kept as they are.

    Only the numbers of the rows that go are kept; whole texts cross one shuffle, to meet them, at every size.
    """
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    numbered = with_row_numbers(docs, row)
    mark = scratch_mark()
    found = near_copies(numbered.select(F.col(row).alias("doc_id"), "text"))
    linked = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(row), "component_id")
    linked = cut_lineage(linked, "copies")
    members = linked.union(linked.select("component_id", "component_id").distinct())
    first = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    named = members.join(numbered.select(row, "doc_id"), row)
    kept = named.groupBy("component_id").agg(F.min(first)[row].alias(row)).select(row)
    copies = cut_lineage(members.select(row).join(kept, row, "left_anti"), "dropped")
    release_scratch(spark, mark, keep=copies)
    return numbered.join(copies.hint("merge"), row, "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that repeat; documents without such words are unchanged and
    documents that consist of them go.

    Null and empty texts stay as they are. Rows that are equal, or have equal or null ids, are rows of
    their own: their windows repeat each other's. An empty table gives no rows; other columns are kept.
    """
    # Columns of the input that are named like one of the result's are kept by other names meanwhile.
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    held = {c: prefix + c for c in docs.columns if c.lower() in RESULT_ARROW.names}
    cleaned = remove_repeats(docs.withColumnsRenamed(held))
    kept = cleaned.filter("n_removed = 0 or n_removed < n_words")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept")}
    own = {c: F.col(held.get(c, c)) for c in docs.columns}
    return kept.select(
        *(F.when(F.col("n_removed") > 0, changed[c]).otherwise(own[c]).alias(c) if c in changed else own[c].alias(c) for c in own)
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens of all documents, a row per piece.

    A null or empty text is one piece with the end token alone. Repeated rows and rows of equal or null
    ids are packed one by one. An empty table gives no rows; other columns are ignored.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
