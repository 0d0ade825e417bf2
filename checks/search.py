"""Vectors, search, waterfall retrieval, roadmaps and their reports."""

from pyspark.sql import functions as F

from checks import companies as C
from checks import domain as D
from checks.base import query, r6, rounded, sql_r6, with_ctes
from preptrail.functions import vectors
from preptrail.operators import encode, retrieval, roadmap
from preptrail.operators.ranking import top_n
from preptrail.operators.search import SearchSpec, search
from preptrail.plans import reports
from preptrail.session import cut_lineage, release_scratch, scratch_mark, scratch_path
from preptrail.sources import readers, writers

DIM = 64
ENCODE = encode.TextEncoder(encode.HashingEncoder(DIM))
N_RESULTS = 20

# --- Shared SQL: hashed token vectors, kept sparse --------------------------
BUCKET = f"(('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM})"


def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name`` (key, d, w): unit vectors of a text column as dimension/weight rows."""
    return f"""{name}_tok AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {source}),
{name}_cnt AS (SELECT {key}, {BUCKET} AS d, count(*) AS c FROM {name}_tok GROUP BY ALL),
{name} AS (SELECT {key}, d, (c / greatest(sqrt(sum(c * c) OVER (PARTITION BY {key})), 1e-9))::FLOAT::DOUBLE AS w FROM {name}_cnt)"""


# --- Vectors ----------------------------------------------------------------
@query(
    f"""SELECT vec_id, i::INT AS dim, {sql_r6('(x / greatest(norm, 1e-9))::FLOAT::DOUBLE')} AS w
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE * 3 AS x,
      sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * 3 AS norm FROM embeddings)"""
)
def l2_normalize(spark, sf):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = D.table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(tripled)).alias("dim", "x"))
    return unit.select("vec_id", "dim", r6(F.col("x").cast("double")).alias("w"))


@query(
    f"""SELECT label, i::INT AS dim, {sql_r6('sum(x * m) / greatest(sum(m), 1e-9)')} AS w
    FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x, (embedding[1] > 0)::INT AS m FROM embeddings) GROUP BY 1, 2"""
)
def mean_pool(spark, sf):
    mask = (F.col("embedding")[0] > 0).cast("int")
    pooled = encode.mean_pool_rows(D.table(spark, sf, "embeddings"), ["label"], "embedding", mask)
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", "dim", r6("x").alias("w"))


@query(
    with_ctes(vectors_sql("v", "documents", "doc_id", "text"))
    + f""" SELECT g.doc_id, i::INT AS dim, {sql_r6('coalesce(w, 0)')} AS w
    FROM (SELECT doc_id, unnest(range({DIM})) AS i FROM documents) g LEFT JOIN v ON v.doc_id = g.doc_id AND v.d = g.i"""
)
def text_vectorize(spark, sf):
    docs = D.spread_table(spark, sf, "documents").select("doc_id", F.posexplode(ENCODE(F.col("text"))).alias("dim", "x"))
    return docs.select("doc_id", "dim", r6(F.col("x").cast("double")).alias("w"))


DOC_TEXT = "concat(company, ' | ', title, ' | ', topics, ' | ', difficulty)"


@query(
    with_ctes(D.DOC_PROBLEMS, vectors_sql("v", "dproblems", "id", DOC_TEXT))
    + f""" SELECT p.id, company, difficulty, coalesce(frequency, 0) AS frequency, url, description AS document,
      {sql_r6('sum(w)')} AS vector_sum, {sql_r6('sum(w * (d + 1))')} AS vector_moment
    FROM dproblems p JOIN v USING (id) GROUP BY ALL"""
)
def vector_table(spark, sf):
    def weigh(by):
        return F.aggregate(F.transform("vector", by), F.lit(0.0), lambda a, x: a + x)

    index = encode.problem_index(D.doc_problems(spark, sf), ENCODE)
    return index.select(
        "id", "company", "difficulty", "frequency", "url", "document",
        r6(weigh(lambda x: x.cast("double"))).alias("vector_sum"),
        r6(weigh(lambda x, i: x.cast("double") * (i + 1))).alias("vector_moment"),
    )


# --- Search over the given vectors: one pooled query per label --------------
QUERY_VECTORS = """qdim AS (
  SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
qvec AS (SELECT label AS query_id, list(round(x, 6) ORDER BY i) AS q FROM qdim GROUP BY 1),
item AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, vec_id % 10 AS company, CASE label % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty FROM embeddings)"""


def _items(spark, sf):
    level = F.expr("CASE label % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END")
    return D.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 10).alias("company"), level.alias("difficulty"), "label"
    )


def _label_queries(spark, sf):
    pooled = encode.mean_pool_rows(D.table(spark, sf, "embeddings"), ["label"], "embedding", F.lit(1))
    return pooled.select(F.col("label").alias("query_id"), F.transform("embedding", lambda x: F.round(x, 6)).alias("vector"))


def _topk_sql(pairs: str, k: int, extra: str = "") -> str:
    return f""" SELECT query_id, id, score, rank::INT AS rank {extra} FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT *, round(list_inner_product(q, v), 9) AS score FROM {pairs})) WHERE rank <= {k}"""


@query(with_ctes(QUERY_VECTORS) + _topk_sql("qvec, item", 5))
def vector_topk(spark, sf):
    return search(_items(spark, sf), _label_queries(spark, sf), 5, SearchSpec())


NEIGHBOURS = "(SELECT a.id AS query_id, a.v AS q, b.id, b.v FROM item a JOIN item b ON a.difficulty = b.difficulty AND a.company <> b.company)"


@query(with_ctes(QUERY_VECTORS) + _topk_sql(NEIGHBOURS, 5))
def vector_topk_by_cells(spark, sf):
    """The nearest vectors of the same difficulty and another company for every vector, from cells around pivots."""
    asked = _items(spark, sf).withColumn("query_id", F.col("id"))
    return search(_items(spark, sf), asked, 5, SearchSpec(on=("difficulty",), differ="company"), max_broadcast=0)


PAIR_QUERIES = """pairq AS (
  SELECT company || '|' || difficulty AS query_id, company, difficulty, list(round(x, 6) ORDER BY i) AS q
  FROM (SELECT company, difficulty, i, avg(x) AS x FROM (SELECT company, difficulty, unnest(range(len(v))) AS i, unnest(v) AS x FROM item) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"""


def _pair_queries(spark, sf):
    pooled = encode.mean_pool_rows(_items(spark, sf), ["company", "difficulty"], "vector", F.lit(1))
    return pooled.withColumn("query_id", F.concat_ws("|", "company", "difficulty")).withColumn(
        "vector", F.transform("vector", lambda x: F.round(x, 6))
    )


@query(with_ctes(QUERY_VECTORS, PAIR_QUERIES) + _topk_sql("pairq JOIN item USING (company, difficulty)", 5))
def filtered_topk(spark, sf):
    asked = _pair_queries(spark, sf).withColumn("n", F.lit(5))
    return retrieval.own_top(_items(spark, sf), asked)


PEER_PAIRS = """(SELECT p.query_id, p.q, i.* FROM pairq p JOIN item i ON p.difficulty = i.difficulty AND p.company <> i.company AND p.company // 4 = i.company // 4)"""


@query(with_ctes(QUERY_VECTORS, PAIR_QUERIES) + _topk_sql(PEER_PAIRS, 7))
def peer_topk(spark, sf):
    items, asked = _items(spark, sf), _pair_queries(spark, sf)
    labels = items.select("company").distinct().withColumn("cluster", F.floor(F.col("company") / 4))
    return retrieval.peer_top(items, asked, F.lit(7), labels=labels)


TWO_PEERS = """two AS (
  SELECT company, peer FROM (
    SELECT a.company, b.company AS peer, row_number() OVER (PARTITION BY a.company ORDER BY b.company) AS nth
    FROM (SELECT DISTINCT company FROM item) a JOIN (SELECT DISTINCT company FROM item) b ON a.company <> b.company AND a.company // 4 = b.company // 4)
  WHERE nth <= 2)"""
CAPPED_PAIRS = "(SELECT p.query_id, p.q, i.* FROM pairq p JOIN two USING (company) JOIN item i ON i.company = peer AND i.difficulty = p.difficulty)"


@query(with_ctes(QUERY_VECTORS, PAIR_QUERIES, TWO_PEERS) + _topk_sql(CAPPED_PAIRS, 7))
def capped_peer_topk(spark, sf):
    items, asked = _items(spark, sf), _pair_queries(spark, sf)
    names = items.select("company").distinct()
    peers = names.withColumn("peer", F.explode(F.sequence(F.floor(F.col("company") / 4) * 4, F.floor(F.col("company") / 4) * 4 + 3)))
    peers = top_n(peers.filter("peer <> company"), ["company"], [F.col("peer")], 2).drop("rank")
    return retrieval.peer_top(items, asked, F.lit(7), peers=peers)


@query(
    with_ctes(vectors_sql("sv", "documents", "doc_id", "text"), vectors_sql("qv", "benchmark", "item_id", "text"))
    + f""" SELECT item_id AS query_id, 'sol_' || doc_id AS id, score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, 'sol_' || doc_id) AS rank FROM (
        SELECT item_id, doc_id, round(sum(s.w * q.w), 9) AS score FROM sv s JOIN qv q USING (d) GROUP BY 1, 2)) WHERE rank <= 2"""
)
def similar_solutions(spark, sf):
    return _found_solutions(spark, sf)


def _stored(index):
    """Vector table as it is served: written once, then searched."""
    path = scratch_path(index.sparkSession, "vectors")
    writers.rebuild_vectors(index, path)
    return readers.read_vectors(index.sparkSession, path)


def _solution_index(spark, sf):
    docs = D.spread_table(spark, sf, "documents").select(F.col("doc_id").alias("row_no"), F.col("text").alias("prompt"), F.col("text").alias("completion"))
    return encode.solution_index(docs, ENCODE)


def _asked_items(spark, sf):
    asked = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), ENCODE(F.col("text")).alias("vector"))
    return cut_lineage(asked, "queries")


def _found_solutions(spark, sf):
    return search(_solution_index(spark, sf), _asked_items(spark, sf), 2, SearchSpec())


@query(
    with_ctes(D.DOC_PROBLEMS, vectors_sql("pv", "dproblems", "id", "concat(company, ' | ', title, ' | ', topics, ' | ', difficulty)"), vectors_sql("qv", "benchmark", "item_id", "text"))
    + """ SELECT item_id AS query_id, id, score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM (
        SELECT item_id, id, round(sum(p.w * q.w), 9) AS score FROM pv p JOIN qv q USING (d) GROUP BY 1, 2)) WHERE rank <= 3"""
)
def similar_problems(spark, sf):
    return search(encode.problem_index(D.doc_problems(spark, sf), ENCODE), _asked_items(spark, sf), 3, SearchSpec())


# --- Waterfall over documents: every nation and difficulty ------------------
DEDUP = "CASE WHEN coalesce(url, '') <> '' THEN 'u:' || lower(url) ELSE 'i:' || id END"


def waterfall_sql(problems: str, labels: str, requests: str, text: str, document: str) -> str:
    """CTEs up to ``merged`` (qid, company, difficulty, id, tier, rank, score, dedup): all three tiers."""
    return f"""{vectors_sql('pv', problems, 'id', text)},
base AS (SELECT p.*, {DEDUP} AS dedup, l.cluster FROM {problems} p LEFT JOIN {labels} l ON p.company = l.company),
req AS (SELECT r.*, r.company || '|' || r.difficulty AS qid, l.cluster FROM {requests} r LEFT JOIN {labels} l ON r.company = l.company),
{vectors_sql('qv', 'req', 'qid', "concat(company, ' | ', difficulty)")},
own AS (
  SELECT * FROM (SELECT qid, n, id, dedup, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, n, b.id, dedup, round(coalesce(sum(q.w * p.w), 0), 9) AS score
    FROM req r JOIN base b ON b.company = r.company AND b.difficulty = r.difficulty LEFT JOIN qv q USING (qid) LEFT JOIN pv p ON p.id = b.id AND p.d = q.d GROUP BY ALL)) WHERE rank <= n),
short1 AS (SELECT *, n - have AS open FROM (SELECT r.*, (SELECT count(*) FROM own o WHERE o.qid = r.qid) AS have FROM req r) WHERE have < n),
peer_pairs AS (
  SELECT qid, open, b.id, dedup FROM short1 s JOIN base b ON b.cluster = s.cluster AND b.difficulty = s.difficulty AND b.company <> s.company
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = s.qid AND o.dedup = b.dedup)),
peer_scored AS (SELECT x.qid, open, x.id, dedup, round(coalesce(sum(q.w * p.w), 0), 9) AS score FROM peer_pairs x LEFT JOIN qv q USING (qid) LEFT JOIN pv p ON p.id = x.id AND p.d = q.d GROUP BY ALL),
peer_first AS (SELECT *, row_number() OVER (PARTITION BY qid, dedup ORDER BY score DESC, id) AS nth FROM peer_scored),
peer AS (SELECT * FROM (SELECT qid, open, id, dedup, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM peer_first WHERE nth = 1) WHERE rank <= open),
found2 AS (SELECT qid, id, dedup, score, 1 AS tier, rank FROM own UNION ALL SELECT qid, id, dedup, score, 2, rank FROM peer),
short2 AS (SELECT *, n - have AS open FROM (SELECT r.*, (SELECT count(*) FROM found2 f WHERE f.qid = r.qid) AS have FROM req r) WHERE have < n),
seeds AS (SELECT qid, company || ' | ' || difficulty || coalesce(max(docs), '') AS seed FROM short2 LEFT JOIN (
  SELECT qid, ' | ' || string_agg({document}, ' | ' ORDER BY tier, rank) AS docs FROM found2 JOIN {problems} USING (id) GROUP BY 1) USING (qid) GROUP BY qid, company, difficulty),
{vectors_sql('xv', 'seeds', 'qid', 'seed')},
global_pairs AS (
  SELECT qid, open, b.id, dedup FROM short2 s JOIN base b ON b.difficulty = s.difficulty WHERE NOT EXISTS (SELECT 1 FROM found2 o WHERE o.qid = s.qid AND o.dedup = b.dedup)),
global_scored AS (SELECT x.qid, open, x.id, dedup, round(coalesce(sum(q.w * p.w), 0), 9) AS score FROM global_pairs x LEFT JOIN xv q USING (qid) LEFT JOIN pv p ON p.id = x.id AND p.d = q.d GROUP BY ALL),
global_first AS (SELECT *, row_number() OVER (PARTITION BY qid, dedup ORDER BY score DESC, id) AS nth FROM global_scored),
global_top AS (SELECT * FROM (SELECT qid, open, id, dedup, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM global_first WHERE nth = 1) WHERE rank <= open),
merged AS (
  SELECT r.qid, r.company, r.difficulty, m.id, m.tier, m.rank, m.score, m.dedup, b.company AS found_company, b.url, coalesce(b.frequency, 0) AS frequency
  FROM (SELECT * FROM found2 UNION ALL SELECT qid, id, dedup, score, 3, rank FROM global_top) m JOIN req r USING (qid) JOIN base b ON b.id = m.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY frequency DESC, tier, rank) AS position FROM merged)"""


DOC_REQUESTS = f"dreq AS (SELECT DISTINCT company, difficulty, {N_RESULTS} AS n FROM (SELECT company FROM dregions) a, (SELECT difficulty FROM dproblems) b)"
WATERFALL = (D.DOC_PROBLEMS, D.NATION_REGION, DOC_REQUESTS, waterfall_sql("dproblems", "dregions", "dreq", DOC_TEXT, "description"))


def _waterfall(spark, sf):
    problems = D.doc_problems(spark, sf)
    index = _stored(encode.problem_index(problems, ENCODE))
    levels = F.explode(F.array(*[F.lit(d) for d in ("EASY", "MEDIUM", "HARD")]))
    requests = D.nation_region(spark, sf).select("company", levels.alias("difficulty"), F.lit(N_RESULTS).alias("n"))
    requests = requests.withColumn("query_id", F.concat_ws("|", "company", "difficulty"))
    return retrieval.retrieve(index, requests, ENCODE, labels=D.nation_region(spark, sf))


@query(
    with_ctes(*WATERFALL)
    + f""" SELECT qid AS query_id, company, difficulty, position::INT AS position, id, found_company, url, frequency, tier::INT AS tier, rank::INT AS rank,
      score FROM ranked"""
)
def waterfall(spark, sf):
    return _waterfall(spark, sf)


@query(
    with_ctes(D.DOC_PROBLEMS, D.NATION_REGION, "dreq AS (SELECT DISTINCT company, difficulty FROM dproblems)",
              "seed AS (SELECT company || '|' || difficulty AS qid, company || ' | ' || difficulty || ' | ' || string_agg(description, ' | ' ORDER BY id) AS t FROM dproblems GROUP BY company, difficulty)",
              vectors_sql("xv", "seed", "qid", "t"), vectors_sql("pv", "dproblems", "id", DOC_TEXT))
    + f""" SELECT qid AS query_id, id, score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT qid, b.id, round(sum(q.w * p.w), 9) AS score FROM dproblems b JOIN dreq r USING (difficulty) JOIN xv q ON q.qid = r.company || '|' || r.difficulty
        JOIN pv p ON p.id = b.id AND p.d = q.d GROUP BY 1, 2)) WHERE rank <= 5"""
)
def expanded_query_topk(spark, sf):
    index = _stored(encode.problem_index(D.doc_problems(spark, sf), ENCODE))
    requests = index.select("company", "difficulty").distinct()
    requests = requests.withColumn("query_id", F.concat_ws("|", "company", "difficulty"))
    requests = requests.withColumn("text", retrieval.query_text(F.col("company"), F.col("difficulty")))
    found = index.select(F.concat_ws("|", "company", "difficulty").alias("query_id"), "id", F.lit(1).alias("tier"), F.col("id").alias("rank"))
    expanded = retrieval.expanded_requests(requests, found, index, ENCODE)
    return retrieval.global_top(index, expanded, F.lit(5))


# --- Roadmaps over line items -----------------------------------------------
ITEM_TEXT = "concat(company, ' | ', title, ' | ', topics, ' | ', difficulty)"
ROADMAP = (
    *C.BASE, C.CURVES, C.ALL_LABELS, D.INTERVIEWS, C.predicted("interviews"),
    """parts_asked AS (
  SELECT interview_id, company, total, unnest([{'part': 0, 'difficulty': 'EASY', 'n': easy}, {'part': 1, 'difficulty': 'MEDIUM', 'n': medium}, {'part': 2, 'difficulty': 'HARD', 'n': hard}], recursive := true) FROM counts)""",
    "rreq AS (SELECT company, difficulty, max(n) AS n FROM parts_asked WHERE n > 0 GROUP BY 1, 2)",
    waterfall_sql("problems", "clusters", "rreq", ITEM_TEXT, "''"),
    "picks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, rank) AS pick FROM ranked)",
    """chosen AS (
  SELECT interview_id, id, dedup, row_number() OVER (PARTITION BY interview_id ORDER BY part, frequency DESC, pick) AS position FROM (
    SELECT a.interview_id, a.part, p.id, p.dedup, p.frequency, p.pick, row_number() OVER (PARTITION BY a.interview_id, p.dedup ORDER BY a.part, p.frequency DESC, p.pick) AS nth
    FROM parts_asked a JOIN picks p ON a.company = p.company AND a.difficulty = p.difficulty AND p.pick <= a.n) WHERE nth = 1)""",
    "have AS (SELECT * FROM (SELECT c.interview_id, c.company, c.total, (SELECT count(*) FROM chosen x WHERE x.interview_id = c.interview_id) AS have FROM counts c) WHERE have < total)",
    f"""pool AS (SELECT p.id, p.company, p.frequency, {DEDUP} AS dedup, coalesce('c:' || l.cluster, 'o:' || p.company) AS grp FROM problems p LEFT JOIN clusters l ON l.company = p.company)""",
    """lists AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY frequency DESC NULLS LAST, id) AS fill_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY grp, dedup ORDER BY frequency DESC NULLS LAST, id) AS nth FROM pool) WHERE nth = 1)""",
    """fills AS (SELECT * FROM (SELECT h.interview_id, h.have, h.total, l.id, row_number() OVER (PARTITION BY h.interview_id ORDER BY fill_rank) AS pos
    FROM have h LEFT JOIN clusters k ON k.company = h.company JOIN lists l ON l.grp = coalesce('c:' || k.cluster, 'o:' || h.company)
    WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.interview_id = h.interview_id AND c.dedup = l.dedup)) WHERE pos <= total - have)""",
    """roadmap AS (SELECT interview_id, position::INT AS position, id AS problem_id, false AS filled FROM chosen
    UNION ALL SELECT interview_id, (have + pos)::INT, id, true FROM fills)""",
)


def _roadmap(spark, sf, plan=roadmap.recommend, **options):
    base, fits, labels = C.fitted(spark, sf)
    counts = cut_lineage(C.predict(D.interviews(spark, sf), base, fits, labels), "predicted")
    problems = D.problems(spark, sf)
    described = D.problems(spark, sf, D.spread_table).withColumn("description", F.lit(None).cast("string"))
    mark = scratch_mark()
    index = _stored(encode.problem_index(described, ENCODE, packed=True))
    roads = plan(counts, index, problems, labels, ENCODE, **options)
    release_scratch(spark, mark, keep=roads)  # all searches are done
    return counts, problems, roads


@query(with_ctes(*ROADMAP) + " SELECT * FROM roadmap")
def roadmap_recommend(spark, sf):
    return _roadmap(spark, sf)[2]


@query(
    with_ctes(*ROADMAP)
    + """ SELECT interview_id, count(*) AS n_problems, count(nullif(url, '')) AS n_links, count(DISTINCT lower(nullif(url, ''))) AS n_distinct,
      count(nullif(url, '')) = count(DISTINCT lower(nullif(url, ''))) AS passed FROM roadmap JOIN problems ON problem_id = id GROUP BY 1"""
)
def report_duplicate_links(spark, sf):
    _, problems, roads = _roadmap(spark, sf, roadmap.routes, carry=("url",))
    return reports.duplicate_links(roads, problems)


@query(
    with_ctes(*ROADMAP)
    + """, got AS (SELECT interview_id, count(*) AS got_total, count(*) FILTER (difficulty = 'EASY') AS got_easy, count(*) FILTER (difficulty = 'MEDIUM') AS got_medium,
      count(*) FILTER (difficulty = 'HARD') AS got_hard FROM roadmap JOIN problems ON problem_id = id GROUP BY 1)
    SELECT interview_id, total, easy, medium, hard, coalesce(got_total, 0) AS got_total, coalesce(got_easy, 0) AS got_easy, coalesce(got_medium, 0) AS got_medium,
      coalesce(got_hard, 0) AS got_hard, total = coalesce(got_total, 0) AS passed FROM counts LEFT JOIN got USING (interview_id)"""
)
def report_roadmap_counts(spark, sf):
    counts, problems, roads = _roadmap(spark, sf, roadmap.routes, carry=("difficulty",))
    return reports.roadmap_counts(counts, roads, problems)


@query(with_ctes(D.PROBLEMS) + " SELECT company, difficulty, frequency, id, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY frequency DESC NULLS LAST, id) AS position FROM problems) WHERE position <= 10")
def frequent_problems(spark, sf):
    ranked = top_n(D.problems(spark, sf).select("company", "difficulty", "frequency", "id"), ["company"], [F.col("frequency").desc_nulls_last(), F.col("id")], 10)
    return roadmap.ordered_fetch(D.problems(spark, sf).select("id", "company", "difficulty", "frequency"), ranked.select("id", F.col("rank").alias("position")))


# --- Reports on retrieval ---------------------------------------------------
@query(
    with_ctes(*WATERFALL)
    + f""", kind AS (SELECT r.company = r.found_company AS target, coalesce(a.cluster = b.cluster, false) AS same FROM ranked r
      LEFT JOIN dregions a ON a.company = r.company LEFT JOIN dregions b ON b.company = r.found_company)
    SELECT count(*) AS total, count(*) FILTER (target) AS target_hits, count(*) FILTER (NOT target AND same) AS peer_hits,
      count(*) FILTER (NOT target AND NOT same) AS global_hits, {sql_r6('100.0::DOUBLE * count(*) FILTER (target OR same) / count(*)')} AS cluster_percent,
      100.0 * count(*) FILTER (target OR same) / count(*) > 50 AS passed FROM kind"""
)
def report_hit_rate(spark, sf):
    return rounded(reports.source_shares(_waterfall(spark, sf), D.nation_region(spark, sf)), "cluster_percent")


def _accuracy_sql(difficulty: str) -> str:
    right = f"count(*) FILTER (upper({difficulty}) = ranked.difficulty)"
    share = sql_r6(f"100.0::DOUBLE * {right} / count(*)")
    return f" SELECT count(*) AS total, {right} AS correct, {share} AS accuracy, {right} = count(*) AS passed FROM ranked JOIN dproblems p USING (id)"


RELABELLED = "CASE WHEN id % 7 = 0 THEN 'Hard' ELSE lower(difficulty) END"


@query(with_ctes(*WATERFALL) + _accuracy_sql("p.difficulty"))
def report_difficulty_accuracy(spark, sf):
    return rounded(reports.difficulty_accuracy(_waterfall(spark, sf), D.doc_problems(spark, sf).select("id", "difficulty")), "accuracy")


@query(with_ctes(*WATERFALL) + _accuracy_sql(RELABELLED.replace("difficulty", "p.difficulty")))
def report_difficulty_accuracy_relabelled(spark, sf):
    """A seventh of the catalogue has another difficulty than the one it was found by."""
    relabelled = D.doc_problems(spark, sf).select("id", F.expr(RELABELLED).alias("difficulty"))
    return rounded(reports.difficulty_accuracy(_waterfall(spark, sf), relabelled), "accuracy")


def _order_sql(position: str) -> str:
    return f""", steps AS (SELECT qid, coalesce(frequency <= lag(frequency) OVER (PARTITION BY qid ORDER BY {position}), true) AS falls FROM ranked),
    sorted AS (SELECT qid, bool_and(falls) AS ok FROM steps GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (ok) AS n_sorted, {sql_r6('100.0::DOUBLE * count(*) FILTER (ok) / count(*)')} AS sorted_percent,
      bool_and(ok) AS passed FROM sorted"""


@query(with_ctes(*WATERFALL) + _order_sql("position"))
def report_frequency_order(spark, sf):
    return rounded(reports.frequency_order(_waterfall(spark, sf)), "sorted_percent")


@query(with_ctes(*WATERFALL) + _order_sql("tier, rank"))
def report_frequency_order_by_tier(spark, sf):
    """The rows in the order in which they were found, which is rarely that of their frequency."""
    by_tier = F.col("tier") * 1000 + F.col("rank")  # ranks are at most N_RESULTS
    return rounded(reports.frequency_order(_waterfall(spark, sf).withColumn("position", by_tier)), "sorted_percent")
