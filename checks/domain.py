"""Interview-preparation tables derived from the driver tables, in Spark and as SQL.

Every row of the driver tables is used; the modulo expressions below assign values, they never
filter.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preptrail.session import few, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Table ahead of costly per-row work."""
    return spread(table(spark, sf, name))


# --- Problems: one per line item, company = supplier -------------------------
PROBLEM_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT))"
PREPARATION_DAYS = """CASE WHEN l_suppkey % 5 = 0 THEN 360 WHEN l_linenumber <= 1 THEN 30
  WHEN l_linenumber <= 2 THEN 90 WHEN l_linenumber <= 4 THEN 180 ELSE 360 END"""
DIFFICULTY = "CASE l_returnflag WHEN 'A' THEN 'EASY' WHEN 'N' THEN 'MEDIUM' ELSE 'HARD' END"
LINK = "concat('https://ex.org/problems/', replace(p_name, ' ', '-'), '-', l_partkey, '/')"

PROBLEMS = f"""problems AS (
  SELECT {PROBLEM_ID} AS id, s_name AS company, l_suppkey AS company_id, {DIFFICULTY} AS difficulty,
    {PREPARATION_DAYS} AS preparation_days, p_name AS title, {LINK} AS url,
    concat(p_type, ', ', p_brand) AS topics, l_quantity AS frequency, l_discount AS acceptance_rate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


#: Rows of part and supplier that are sent to the line items, which else are shuffled to meet them.
MAX_ROWS_SENT = 2_000_000


def problems(spark: SparkSession, sf: str, read=table) -> DataFrame:
    part, supplier = (few(table(spark, sf, name), MAX_ROWS_SENT) for name in ("part", "supplier"))
    items = read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    items = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return items.select(
        F.expr(PROBLEM_ID).alias("id"),
        F.col("s_name").alias("company"),
        F.col("l_suppkey").alias("company_id"),
        F.expr(DIFFICULTY).alias("difficulty"),
        F.expr(PREPARATION_DAYS).alias("preparation_days"),
        F.col("p_name").alias("title"),
        F.expr(LINK).alias("url"),
        F.concat("p_type", F.lit(", "), "p_brand").alias("topics"),
        F.col("l_quantity").alias("frequency"),
        F.col("l_discount").alias("acceptance_rate"),
    )


# --- Company metadata -------------------------------------------------------
SIZE_RANGE = """CASE WHEN {b} < 0 THEN '1-10' WHEN {b} < 1000 THEN '11-50' WHEN {b} < 2000 THEN '51-200'
  WHEN {b} < 3000 THEN '201-500' WHEN {b} < 4500 THEN '501-1000' WHEN {b} < 6000 THEN '1001-5000'
  WHEN {b} < 8000 THEN '5001-10000' WHEN {b} < 9000 THEN '10001+' ELSE 'unlisted' END"""
FOUNDED = "CASE {k} % 9 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '0' ELSE CAST(1950 + {k} % 70 AS VARCHAR(8)) END"

SUPPLIER_META = f"""meta AS (
  SELECT s_name AS company, nullif(n_name, 'NATION_7') AS industry, {SIZE_RANGE.format(b='s_acctbal')} AS size_range,
    CAST(s_acctbal AS VARCHAR(20)) AS employee_count, {FOUNDED.format(k='s_suppkey')} AS year_founded, r_name AS locality
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CUSTOMER_META = f"""cmeta AS (
  SELECT c_name AS company, nullif(c_mktsegment, 'BUILDING') AS industry, {SIZE_RANGE.format(b='c_acctbal')} AS size_range,
    CAST(c_acctbal AS VARCHAR(20)) AS employee_count, {FOUNDED.format(k='c_custkey')} AS year_founded, r_name AS locality
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _located(df: DataFrame, spark: SparkSession, sf: str, nation_key: str) -> DataFrame:
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.join(places, F.col(nation_key) == F.col("n_nationkey"))


def supplier_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _located(table(spark, sf, "supplier"), spark, sf, "s_nationkey").select(
        F.col("s_name").alias("company"),
        F.expr("nullif(n_name, 'NATION_7')").alias("industry"),
        F.expr(SIZE_RANGE.format(b="s_acctbal")).alias("size_range"),
        F.col("s_acctbal").cast("string").alias("employee_count"),
        F.expr(FOUNDED.format(k="s_suppkey")).cast("string").alias("year_founded"),
        F.col("r_name").alias("locality"),
    )


def customer_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _located(table(spark, sf, "customer"), spark, sf, "c_nationkey").select(
        F.col("c_name").alias("company"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("industry"),
        F.expr(SIZE_RANGE.format(b="c_acctbal")).alias("size_range"),
        F.col("c_acctbal").cast("string").alias("employee_count"),
        F.expr(FOUNDED.format(k="c_custkey")).cast("string").alias("year_founded"),
        F.col("r_name").alias("locality"),
    )


# --- Fixed cluster labels: the region ---------------------------------------
SUPPLIER_REGION = """regions AS (
  SELECT s_name AS company, n_regionkey AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def supplier_region(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.col("s_name").alias("company"), F.col("n_regionkey").alias("cluster"))


# --- Requested interviews: one per customer ---------------------------------
INTERVIEWS = """interviews AS (
  SELECT c_custkey AS interview_id,
    CASE WHEN c_custkey % 50 = 7 THEN 'Unlisted' ELSE s_name END AS company,
    CAST(c_custkey * 37 % 400 AS INT) AS days_until
  FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier))"""


def interviews(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    n_suppliers = suppliers.agg(F.count("*")).scalar()
    keyed = table(spark, sf, "customer").withColumn("s_suppkey", F.col("c_custkey") % n_suppliers)
    return keyed.join(suppliers, "s_suppkey").select(
        F.col("c_custkey").alias("interview_id"),
        F.when(F.col("c_custkey") % 50 == 7, "Unlisted").otherwise(F.col("s_name")).alias("company"),
        (F.col("c_custkey") * 37 % 400).cast("int").alias("days_until"),
    )


# --- Problems with whole texts: one per document, company = nation ----------
DOC_DIFFICULTY = "CASE lang WHEN 'en' THEN 'EASY' WHEN 'fr' THEN 'MEDIUM' ELSE 'HARD' END"
DOC_LINK = "CASE WHEN n_chars % 11 = 0 THEN '' ELSE concat('https://ex.org/Docs/', n_chars % 400) END"
DOC_PROBLEMS = f"""dproblems AS (
  SELECT d.doc_id AS id, n_name AS company, {DOC_DIFFICULTY} AS difficulty, text AS title, source AS topics,
    {DOC_LINK} AS url, CASE WHEN quality IS NULL THEN NULL ELSE CAST(n_chars % 100 AS DOUBLE) END AS frequency,
    text AS description
  FROM documents d JOIN nation ON d.doc_id % 25 = n_nationkey LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
NATION_REGION = "dregions AS (SELECT n_name AS company, n_regionkey AS cluster FROM nation)"


def doc_problems(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents").withColumn("n_nationkey", (F.col("doc_id") % 25).cast("int"))
    docs = docs.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("n_name").alias("company"),
        F.expr(DOC_DIFFICULTY).alias("difficulty"),
        F.col("text").alias("title"),
        F.col("source").alias("topics"),
        F.expr(DOC_LINK).alias("url"),
        F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 100).cast("double")).alias("frequency"),
        F.col("text").alias("description"),
    )


def nation_region(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("company"), F.col("n_regionkey").alias("cluster"))


# --- Registry: one row per part, names with corporate suffixes --------------
REGISTRY_NAME = """concat(p_brand, ' ', p_name, CASE p_size % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Technologies LLC'
  WHEN 2 THEN ' Co., Ltd.' WHEN 3 THEN '  Group' WHEN 4 THEN '' ELSE ' Labs, Inc.' END)"""
REGISTRY = f"""registry AS (
  SELECT p_partkey AS row_no, {REGISTRY_NAME} AS name, p_type AS industry,
    {SIZE_RANGE.format(b='(p_retailprice * 5)')} AS size_range, CAST(p_size AS VARCHAR(8)) AS employee_count,
    CAST(1900 + p_size AS VARCHAR(8)) AS year_founded, p_brand AS locality
  FROM part)"""
REGISTRY_QUERIES = """wanted AS (
  SELECT p_brand AS company FROM part UNION SELECT p_name FROM part UNION SELECT concat(p_brand, ' ', p_name, ' Software') FROM part
  UNION SELECT concat(' ', p_type, ' ') FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT 'Software' FROM region
  UNION SELECT concat('#', p_size) FROM part UNION SELECT concat(substr(p_brand, 7), ' ', p_name) FROM part)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_no"),
        F.expr(REGISTRY_NAME).alias("name"),
        F.col("p_type").alias("industry"),
        F.expr(SIZE_RANGE.format(b="(p_retailprice * 5)")).alias("size_range"),
        F.col("p_size").cast("string").alias("employee_count"),
        (F.lit(1900) + F.col("p_size")).cast("string").alias("year_founded"),
        F.col("p_brand").alias("locality"),
    )


def registry_queries(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    names = [
        part.select(F.col("p_brand").alias("company")),
        part.select("p_name"),
        part.select(F.concat("p_brand", F.lit(" "), "p_name", F.lit(" Software"))),
        part.select(F.concat(F.lit(" "), "p_type", F.lit(" "))),
        table(spark, sf, "customer").select("c_mktsegment"),
        table(spark, sf, "region").select(F.lit("Software")),
        part.select(F.concat(F.lit("#"), "p_size")),
        part.select(F.concat(F.substring("p_brand", 7, 100), F.lit(" "), "p_name")),
    ]
    out = names[0]
    for more in names[1:]:
        out = out.union(more)
    return out.distinct()


# --- Tracks: users and items of the event log -------------------------------
EVENT_ITEM = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
TOGGLES = f"toggles AS (SELECT event_id, ts, user_id, {EVENT_ITEM} AS item_id FROM events)"
TODAY = "2024-02-01"
TRACKS = """tracks AS (
  SELECT user_id * 10 + item_id % 10 AS id, user_id, CAST(item_id % 10 AS BIGINT) AS company_id,
    CAST(min(event_id) % 40 AS INT) AS days_until,
    CASE WHEN min(event_id) % 7 = 0 THEN NULL ELSE CAST(min(ts) AS DATE) + CAST(min(event_id) % 60 AS INT) END AS interview_date
  FROM toggles GROUP BY user_id, item_id % 10)"""
TRACK_ITEMS = """items AS (
  SELECT user_id * 1000 + item_id AS id, user_id * 10 + item_id % 10 AS interview_id, CAST(item_id AS BIGINT) AS problem_id,
    count(*) % 2 = 1 AS is_completed
  FROM toggles GROUP BY user_id, item_id)"""
TRACK_COMPANIES = "tcompanies AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)"
TRACK_PROBLEMS = f"""tproblems AS (
  SELECT p_partkey AS id, p_name AS title, CASE p_size % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty,
    nullif(p_type, 'PROMO') AS topics FROM part)"""


def toggles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", F.expr(EVENT_ITEM).alias("item_id"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min("event_id")
    date = F.date_add(F.min("ts").cast("date"), (first % 60).cast("int"))
    return (
        toggles(spark, sf)
        .groupBy("user_id", (F.col("item_id") % 10).alias("_slot"))
        .agg((first % 40).cast("int").alias("days_until"), F.when(first % 7 != 0, date).alias("interview_date"))
        .select(
            (F.col("user_id") * 10 + F.col("_slot")).alias("id"),
            "days_until",
            "interview_date",
            "user_id",
            F.col("_slot").cast("bigint").alias("company_id"),
        )
    )


def track_items(spark: SparkSession, sf: str) -> DataFrame:
    return (
        toggles(spark, sf)
        .groupBy("user_id", "item_id")
        .agg((F.count("*") % 2 == 1).alias("is_completed"))
        .select(
            (F.col("user_id") * 1000 + F.col("item_id")).alias("id"),
            (F.col("user_id") * 10 + F.col("item_id") % 10).alias("interview_id"),
            F.col("item_id").cast("bigint").alias("problem_id"),
            "is_completed",
        )
    )


def track_companies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def track_problems(spark: SparkSession, sf: str) -> DataFrame:
    level = F.expr("CASE p_size % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        level.alias("difficulty"),
        F.expr("nullif(p_type, 'PROMO')").alias("topics"),
    )
