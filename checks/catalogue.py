"""Catalogue cleaning, links, bodies, topics and stored feeds."""

from pyspark.sql import functions as F

from checks import domain as D
from checks.base import query, with_ctes
from preptrail.functions import clean
from preptrail.operators import catalogue
from preptrail.plans.prepare import append_company_meta
from preptrail.session import scratch_path
from preptrail.sources import readers, versions, writers

# --- A raw text feed with untidy values, one row per problem ----------------
FEED = """feed AS (
  SELECT id, concat(' ', company, chr(9)) AS company, concat(title, chr(10)) AS title, difficulty, concat(url, ' ') AS link,
    CASE WHEN preparation_days = 30 THEN '  ' ELSE topics END AS topics,
    CASE WHEN frequency > 45 THEN '' WHEN frequency > 40 THEN 'often' WHEN frequency > 35 THEN '0' WHEN frequency > 34 THEN '1d' WHEN frequency > 33 THEN '0x1p3' WHEN frequency > 32 THEN 'inf' ELSE CAST(CAST(frequency AS INT) AS VARCHAR(8)) END AS frequency,
    CASE WHEN acceptance_rate = 0 THEN NULL ELSE '0.5' END AS acceptance_rate,
    CASE WHEN difficulty = 'EASY' THEN ' ' ELSE CAST(preparation_days AS VARCHAR(8)) END AS preparation_days,
    CASE WHEN difficulty = 'HARD' THEN concat(chr(10), title, ' ') WHEN difficulty = 'EASY' THEN '' END AS body
  FROM problems)"""


def feed(spark, sf):
    return D.problems(spark, sf, D.spread_table).selectExpr(
        "id",
        "concat(' ', company, chr(9)) AS company",
        "concat(title, chr(10)) AS title",
        "difficulty",
        "concat(url, ' ') AS link",
        "CASE WHEN preparation_days = 30 THEN '  ' ELSE topics END AS topics",
        "CASE WHEN frequency > 45 THEN '' WHEN frequency > 40 THEN 'often' WHEN frequency > 35 THEN '0' WHEN frequency > 34 THEN '1d' WHEN frequency > 33 THEN '0x1p3' WHEN frequency > 32 THEN 'inf' "
        "ELSE CAST(CAST(frequency AS INT) AS STRING) END AS frequency",
        "CASE WHEN acceptance_rate = 0 THEN NULL ELSE '0.5' END AS acceptance_rate",
        "CASE WHEN difficulty = 'EASY' THEN ' ' ELSE CAST(preparation_days AS STRING) END AS preparation_days",
        "CASE WHEN difficulty = 'HARD' THEN concat(chr(10), title, ' ') WHEN difficulty = 'EASY' THEN '' END AS body",
    )


TYPED = r"""typed AS (
  SELECT id, regexp_replace(company, '^\s+|\s+$', '', 'g') AS company, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, difficulty,
    nullif(regexp_replace(body, '^\s+|\s+$', '', 'g'), '') AS description, trim(link) AS url, nullif(trim(topics), '') AS topics,
    try_cast(acceptance_rate AS DOUBLE) AS acceptance_rate, CASE WHEN regexp_full_match(trim(frequency), '[0-9.]+') THEN try_cast(trim(frequency) AS DOUBLE) END AS frequency,
    try_cast(nullif(trim(preparation_days), '') AS INT) AS preparation_days
  FROM feed)"""


@query(with_ctes(D.PROBLEMS, FEED, TYPED) + " SELECT * FROM typed")
def typed_cleaning(spark, sf):
    return catalogue.typed_problems(feed(spark, sf))


@query(with_ctes(D.PROBLEMS, FEED, TYPED) + " SELECT * FROM typed")
def jsonl_feed_roundtrip(spark, sf):
    path = scratch_path(spark, "feed-jsonl")
    writers.write_jsonl(feed(spark, sf), path)
    stored = spark.read.schema("id string, " + ", ".join(f"{c} string" for c in feed(spark, sf).columns if c != "id")).json(path)
    return catalogue.typed_problems(stored)


NO_ID = "company, title, difficulty, description, url, topics, acceptance_rate, frequency, preparation_days"


@query(with_ctes(D.PROBLEMS, FEED, TYPED) + f" SELECT {NO_ID}, count(*) AS n FROM typed GROUP BY ALL")
def csv_feed_roundtrip(spark, sf):
    path = scratch_path(spark, "feed-csv")
    writers.write_csv(feed(spark, sf).drop("id"), path)
    stored = readers.read_problem_feed(spark, f"{path}-enriched", path)
    typed = catalogue.typed_problems(stored)
    return typed.groupBy(*NO_ID.split(", ")).agg(F.count("*").alias("n"))


@query(with_ctes(D.PROBLEMS, FEED, TYPED) + f" SELECT {NO_ID}, count(*) AS n FROM typed GROUP BY ALL")
def enriched_feed_preferred(spark, sf):
    """Both feeds are there; the enriched one is read."""
    enriched, plain = scratch_path(spark, "feed-enriched"), scratch_path(spark, "feed-plain")
    writers.write_jsonl(feed(spark, sf).drop("id"), enriched, "gzip")
    writers.write_csv(feed(spark, sf).drop("id").withColumn("title", F.lit("plain")), plain, compression="gzip")
    typed = catalogue.typed_problems(readers.read_problem_feed(spark, enriched, plain))
    return typed.groupBy(*NO_ID.split(", ")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name, true AS loaded, false AS loaded_again FROM supplier")
def table_loaded_once(spark, sf):
    """A second load of another table leaves the first one as it is."""
    path = scratch_path(spark, "companies")
    loaded = writers.load_table(D.track_companies(spark, sf), path)
    others = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    again = writers.load_table(others, path)
    return readers.read_table(spark, path).withColumns({"loaded": F.lit(loaded), "loaded_again": F.lit(again)})


@query(
    with_ctes(D.SUPPLIER_META, D.CUSTOMER_META)
    + " SELECT *, 1 AS n FROM meta UNION ALL SELECT *, 1 FROM cmeta WHERE company NOT IN (SELECT company FROM meta)"
)
def company_meta_appended(spark, sf):
    """Suppliers first (no table is there yet), then customers and the suppliers once more."""
    path = scratch_path(spark, "company-meta")
    suppliers = D.supplier_meta(spark, sf)
    append_company_meta(spark, suppliers, path)
    append_company_meta(spark, D.customer_meta(spark, sf).unionByName(suppliers), path)
    stored = readers.read_company_meta(spark, path)
    return stored.groupBy(*stored.columns).agg(F.count("*").cast("int").alias("n"))


@query(
    """SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'third' WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS title,
      CASE WHEN vec_id % 7 = 0 THEN 4 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END * embedding[1]::DOUBLE AS first FROM embeddings
    UNION ALL SELECT -1 - vec_id, 'new', 2 * embedding[1]::DOUBLE FROM embeddings WHERE vec_id % 3 <> 0"""
)
def vectors_upserted(spark, sf):
    """New rows for a third of the stored ids and under ids that were not there, each new row twice; some buckets
    are compacted; then a seventh of the stored ids twice more."""
    path = scratch_path(spark, "vectors")
    stored = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("old").alias("title"), F.col("embedding").alias("vector"))
    writers.rebuild_vectors(stored, path)
    target = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1 - F.col("id"))

    def times(factor):
        return F.transform("vector", lambda x: (x * factor).cast("float"))

    new = stored.select(target.alias("id"), F.lit("new").alias("title"), times(2).alias("vector"))
    writers.upsert_vectors(new.unionByName(new.withColumn("title", F.lit("newer"))), path, F.col("title"))
    writers.vector_table(spark, path).compact(list(range(0, 16, 2)))
    for title, factor in (("second", 8), ("third", 4)):
        part = stored.filter("id % 7 = 0").select("id", F.lit(title).alias("title"), times(factor).alias("vector"))
        writers.upsert_vectors(part, path)
    writers.vector_table(spark, path).compact([0, 1, 2])
    return readers.read_vectors(spark, path).select("id", "title", F.col("vector")[0].cast("double").alias("first"))


@query(
    """SELECT 'companies' AS part, s_suppkey::BIGINT AS id, s_name AS name FROM supplier
    UNION ALL SELECT 'problems', n_nationkey::BIGINT, n_name FROM nation"""
)
def catalogue_survives_a_failed_load(spark, sf):
    """Two tables that are stored together; a forced load whose second table fails leaves both."""
    path = scratch_path(spark, "catalogue")
    companies = D.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    problems = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    versions.write_set({"companies": companies, "problems": problems}, path)
    broken = problems.withColumn("name", F.raise_error(F.lit("broken on purpose")).cast("string"))
    try:
        versions.write_set({"companies": companies.limit(1), "problems": broken}, path, force=True)
    except Exception as failed:
        if "broken on purpose" not in str(failed):
            raise
    parts = [versions.read_set(spark, path, name).withColumn("part", F.lit(name)) for name in ("companies", "problems")]
    return parts[0].union(parts[1]).select("part", "id", "name")


@query(
    with_ctes(D.PROBLEMS, "dist AS (SELECT company, preparation_days AS days_until, count(*) FILTER (difficulty = 'EASY') AS easycount, "
              "count(*) FILTER (difficulty = 'HARD') AS hardcount, count(*) FILTER (difficulty = 'MEDIUM') AS mediumcount FROM problems GROUP BY 1, 2)")
    + " SELECT * FROM dist"
)
def distribution_csv_roundtrip(spark, sf):
    from preptrail.plans.prepare import store_distributions

    path = scratch_path(spark, "distributions")
    store_distributions(D.problems(spark, sf), path)
    return readers.read_distributions(spark, path)


@query(with_ctes(D.REGISTRY) + " SELECT name, industry, size_range, employee_count, year_founded, locality, count(*) AS n FROM registry GROUP BY ALL")
def registry_parquet_roundtrip(spark, sf):
    raw = D.registry(spark, sf).select(
        "name", "industry", F.col("size_range").alias("size range"), F.col("employee_count").alias("current employee estimate"),
        F.col("year_founded").alias("year founded"), "locality", F.lit("x").alias("linkedin url"),
    )
    source, target = scratch_path(spark, "registry-csv"), scratch_path(spark, "registry")
    writers.write_csv(raw, source)
    writers.write_registry(readers.read_registry_csv(spark, source), target)
    stored = readers.read_registry(spark, target).drop("row_no")
    return stored.groupBy(*stored.columns).agg(F.count("*").alias("n"))


@query(
    with_ctes(D.PROBLEMS)
    + " SELECT row_number() OVER (ORDER BY min(id), company) AS id, company AS name FROM problems GROUP BY company"
)
def company_keys(spark, sf):
    return catalogue.company_keys(feed(spark, sf), F.col("id"))


@query(
    with_ctes(D.PROBLEMS, "keys AS (SELECT row_number() OVER (ORDER BY min(id), company) AS company_id, company FROM problems GROUP BY company)")
    + " SELECT k.company_id, count(*) AS n_problems FROM problems p JOIN keys k ON p.company = k.company GROUP BY 1"
)
def problems_per_company(spark, sf):
    companies = catalogue.company_keys(feed(spark, sf), F.col("id"))
    keyed = catalogue.with_company_key(catalogue.typed_problems(feed(spark, sf)), companies)
    return keyed.groupBy("company_id").agg(F.count("*").alias("n_problems"))


@query(with_ctes(D.PROBLEMS) + " SELECT DISTINCT company FROM problems")
def company_names(spark, sf):
    return catalogue.company_names(D.problems(spark, sf))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def companies_with_problems(spark, sf):
    return catalogue.companies_with_problems(D.track_companies(spark, sf), D.problems(spark, sf).select("company_id"))


SLUG = "list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1)"


@query(f"SELECT page_id, {SLUG} AS slug FROM pages UNION ALL SELECT l_partkey, {SLUG.replace('url', D.LINK)} FROM lineitem JOIN part ON l_partkey = p_partkey")
def slug_extract(spark, sf):
    links = D.table(spark, sf, "lineitem").join(D.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    links = links.select(F.col("l_partkey").alias("page_id"), F.expr(D.LINK).alias("url"))
    both = D.table(spark, sf, "pages").select("page_id", "url").unionByName(links)
    return both.select("page_id", clean.slug(F.col("url")).alias("slug"))


def _text_sql(html: str) -> str:
    """The markup of the pages holds no nested super- or subscript, so plain replacements suffice."""
    out = rf"regexp_replace({html}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>', '<x>', 'g')"
    out = rf"regexp_replace({out}, '(?is)<sup\b[^>]*>\s*([^<]*?)\s*</sup>', '<x>^\1<x>', 'g')"
    out = rf"regexp_replace({out}, '(?is)<sub\b[^>]*>\s*([^<]*?)\s*</sub>', '<x>_\1<x>', 'g')"
    tag = r"""<[a-zA-Z/][^>=]*(=\s*("[^"]*"|''[^'']*'')?[^>=]*)*>"""
    out = rf"regexp_replace({out}, '({tag})+', chr(10), 'g')"
    for entity, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{entity}', '{char}', 'g')"
    out = rf"regexp_replace({out}, '\n+([\^_])', '\1', 'g')"
    out = rf"regexp_replace({out}, '([\^_])\n+', '\1', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


TAIL = '<p>1 &lt; n <= 10<sup class="e"> 5 </sup> and a<sub>i</sub><br> ok</p><p title="2>1" id = x>end</p>'
MARKED = f"concat(html, '{TAIL}')"


@query(f"SELECT page_id, regexp_replace({_text_sql(MARKED)}, '&lt;', '<', 'g') AS body FROM pages")
def html_to_text(spark, sf):
    marked = F.concat("html", F.lit(TAIL))
    return D.spread_table(spark, sf, "pages").select("page_id", clean.html_to_text(marked).alias("body"))


PART_LINK = D.LINK.replace("l_partkey", "p_partkey")

# --- Bodies fetched so far: documents, some spoiled, keyed by the slug of a link
BODIES = f"""bfeed AS (
  SELECT l_orderkey * 100 + l_linenumber AS row_no, {D.LINK} AS link, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
bodies AS (
  SELECT regexp_extract({PART_LINK}, '([^/]+)/$', 1) AS slug, CASE p_size % 4 WHEN 0 THEN concat(text, ' up to 10 5') WHEN 1 THEN concat(text, chr(10), '^2')
    WHEN 2 THEN '' ELSE text END AS body
  FROM part JOIN documents ON doc_id = p_partkey)"""
SPOILED = r"(body = '' OR regexp_matches(body, '10\s+[459]') OR contains(body, chr(10) || '^') OR contains(body, chr(10) || '_'))"


def _body_feed(spark, sf):
    items = D.table(spark, sf, "lineitem").join(D.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"), F.expr(D.LINK).alias("link"), F.lit("").alias("body"))


def _enriched(spark, sf):
    spoiled = F.expr(
        "CASE p_size % 4 WHEN 0 THEN concat(text, ' up to 10 5') WHEN 1 THEN concat(text, chr(10), '^2') WHEN 2 THEN '' ELSE text END"
    )
    docs = D.table(spark, sf, "part").join(D.table(spark, sf, "documents"), F.col("doc_id") == F.col("p_partkey"))
    return docs.select(F.col("p_partkey").alias("row_no"), F.expr(PART_LINK).alias("link"), spoiled.alias("body"))


@query(
    with_ctes(BODIES)
    + rf""" SELECT DISTINCT regexp_extract(link, '([^/]+)/$', 1) AS slug FROM bfeed WHERE regexp_extract(link, '([^/]+)/$', 1) NOT IN
    (SELECT slug FROM bodies WHERE NOT {SPOILED})"""
)
def repair_queue(spark, sf):
    return catalogue.fetch_queue(_body_feed(spark, sf), catalogue.fetched_bodies(_enriched(spark, sf)))


@query(
    with_ctes(BODIES)
    + r""" SELECT link, md5(coalesce(body, '')) AS body_hash, count(*) AS n FROM bfeed
    LEFT JOIN bodies ON slug = regexp_extract(link, '([^/]+)/$', 1) GROUP BY 1, 2"""
)
def description_join(spark, sf):
    joined = catalogue.with_bodies(_body_feed(spark, sf), catalogue.fetched_bodies(_enriched(spark, sf)))
    return joined.groupBy("link", F.md5("body").alias("body_hash")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(coalesce(nullif(s_name, 'Supplier#000000003'), 'Unknown'), ' | ', p_name, ' | ',
      coalesce(nullif(p_type, 'PROMO'), ''), ' | ', {D.DIFFICULTY}) AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
)
def search_text(spark, sf):
    items = D.table(spark, sf, "lineitem").join(D.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.join(D.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    text = clean.search_text(F.expr("nullif(s_name, 'Supplier#000000003')"), F.col("p_name"), F.expr("nullif(p_type, 'PROMO')"), F.expr(D.DIFFICULTY))
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


@query(with_ctes(D.PROBLEMS) + " SELECT topic, count(*) AS n_problems FROM (SELECT unnest(string_split(topics, ', ')) AS topic FROM problems) GROUP BY 1")
def topic_explode(spark, sf):
    return catalogue.topics(D.problems(spark, sf)).groupBy("topic").agg(F.count("*").alias("n_problems"))


DESCRIPTION = "CASE n_chars % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END"


@query(
    rf"""SELECT doc_id, coalesce(nullif({DESCRIPTION}, ''), concat(source, ' (', lang, ')')) AS description,
      regexp_replace(coalesce(nullif({DESCRIPTION}, ''), concat(source, ' (', lang, ')')), '\n{{2,}}', '</br>', 'g') AS shown,
      coalesce(substring({DESCRIPTION}, 1, 1000), '') AS snippet FROM documents"""
)
def description_fallback(spark, sf):
    docs = D.table(spark, sf, "documents").withColumn("d", F.expr(DESCRIPTION))
    full = clean.description_or_title(F.col("d"), F.col("source"), F.col("lang"))
    return docs.select(
        "doc_id", full.alias("description"), clean.break_paragraphs(full).alias("shown"), clean.snippet(F.col("d")).alias("snippet")
    )
