"""The queries of this subpackage, each an operator applied to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preptrail.llm import twins
from preptrail.llm.ann import nearest_neighbours
from preptrail.llm.base import query, table
from preptrail.llm.bpe import encode_and_decode
from preptrail.llm.digest import fingerprints
from preptrail.llm.divergence import audit_sources
from preptrail.llm.extract import extract
from preptrail.llm.fixity import audit, warc_record, with_offsets
from preptrail.llm.gridjoin import link_vectors
from preptrail.llm.lexical import rank_documents
from preptrail.llm.nearcopies import near_copies
from preptrail.llm.packing import pack
from preptrail.llm.quality import score_quality
from preptrail.llm.repeats import remove_repeats
from preptrail.llm.shards import shard_by_bytes
from preptrail.llm.tokens import byte_encoder
from preptrail.session import cut_lineage

SHARDS = 24
RECORDS_PER_ARCHIVE = 1000

RECORD_SQL = """
WITH stored AS (
  SELECT page_id, 'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
      || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Type: text/html\r\nContent-Length: '
      || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n' AS record
  FROM pages
), placed AS (
  SELECT page_id, record, (row_number() OVER (ORDER BY page_id) - 1) // 1000 AS archive,
      sum(strlen(record)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(record) AS before
  FROM stored
), sized AS (
  SELECT *, before - min(before) OVER (PARTITION BY archive) AS offset_ FROM placed
)
SELECT archive::BIGINT AS archive, offset_::BIGINT AS "offset",
       CASE WHEN page_id % 97 = 11 THEN 'missing' ELSE 'altered' END AS status, page_id,
       strlen(record)::BIGINT AS length, sha256(record) AS expected_sha256
FROM sized WHERE page_id % 97 IN (5, 11)
"""


@query(RECORD_SQL.replace("\\r\\n", "\r\n"))
def op1_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, against a replica of the same records in which those with
    page_id % 97 = 5 have another last byte and those with page_id % 97 = 11 are lost."""
    pages = table(spark, sf_dir, "pages")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    body = F.substring(record, F.lit(1), F.octet_length(record) - 1)
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(body, F.lit("?").cast("binary"))).otherwise(record)
    stored = pages.select(
        "page_id",
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
        F.sha2(damaged, 256).alias("replica_digest"),
    )
    order = [F.col("page_id"), F.col("digest")]
    index = cut_lineage(with_offsets(stored, order, F.col("length"), RECORDS_PER_ARCHIVE), "index")
    replica = index.filter(~(F.coalesce(F.col("page_id") % 97, F.lit(0)) == 11))
    replica = replica.select("archive", "offset", F.col("replica_digest").alias("digest"))
    found = audit(index.select("archive", "offset", "digest"), replica)
    return found.join(index, ["archive", "offset"]).select(
        "archive", "offset", "status", "page_id", "length", F.col("digest").alias("expected_sha256")
    )


@query()
def op2_sparse_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query(twins.REMOVED)
def op4_count_min_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], with_text=False)


@query()
def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query(twins.NEAR_COPIES)
def op7_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"), width=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query(twins.SHARDS)
def op8_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    sharded = shard_by_bytes(documents, order, F.col("size"), SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def pack_documents(documents: DataFrame) -> DataFrame:
    encoder = byte_encoder(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return pack(documents, encoder)


@query()
def op9_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query()
def op10_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query(twins.DIVERGENCE)
def op11_count_level_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@query(twins.RANKED)
def op12_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(twins.LINKED)
def op13_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
