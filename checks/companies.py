"""Distributions, features, clusters, curves, predictions, peers and registry."""

from pyspark.sql import functions as F

from checks import domain as D
from checks.base import query, r6, rounded, sql_r6, with_ctes
from preptrail import schemas as S
from preptrail.functions import clean
from preptrail.operators import clustering, curves, distributions, features, peers, registry
from preptrail.operators.ranking import numbered
from preptrail.plans import predictor, reports
from preptrail.session import cut_lineage

# --- Shared SQL -------------------------------------------------------------
DIST = """dist AS (
  SELECT company, preparation_days AS days_until, count(title) FILTER (difficulty = 'EASY') AS easycount,
    count(title) FILTER (difficulty = 'HARD') AS hardcount, count(title) FILTER (difficulty = 'MEDIUM') AS mediumcount
  FROM problems WHERE company IS NOT NULL AND preparation_days IS NOT NULL AND difficulty IS NOT NULL GROUP BY 1, 2)"""
SHARES = """shares AS (
  SELECT *, total / greatest(1, max(total) OVER (PARTITION BY company)) AS proportion,
    easycount / greatest(1, total) AS easy_pct, mediumcount / greatest(1, total) AS medium_pct, hardcount / greatest(1, total) AS hard_pct
  FROM (SELECT *, easycount + hardcount + mediumcount AS total FROM dist))"""
PIVOT = """pivoted AS (
  SELECT company, max(proportion) FILTER (days_until = 30) AS d30, max(proportion) FILTER (days_until = 90) AS d90,
    max(proportion) FILTER (days_until = 180) AS d180, max(proportion) FILTER (days_until = 360) AS d360
  FROM shares GROUP BY company)"""
KNOWN = "(CASE WHEN d30 IS NULL THEN 0 ELSE 1 END + CASE WHEN d90 IS NULL THEN 0 ELSE 1 END + CASE WHEN d180 IS NULL THEN 0 ELSE 1 END + CASE WHEN d360 IS NULL THEN 0 ELSE 1 END)"
DENSE = f"""dense AS (SELECT r.* FROM regions r JOIN pivoted p ON r.company = p.company WHERE {KNOWN} >= 2),
sparse AS (SELECT company FROM pivoted WHERE {KNOWN} < 2)"""
BASE = (D.PROBLEMS, DIST, SHARES, PIVOT, D.SUPPLIER_REGION, DENSE)

KNOTS = [0, 30, 90, 180, 360]
STEPS = [30.0, 60.0, 90.0, 180.0]


def _interior(k: int) -> str:
    w1, w2 = 2 * STEPS[k] + STEPS[k - 1], STEPS[k] + 2 * STEPS[k - 1]
    return f"CASE WHEN s{k-1} * s{k} <= 0 THEN 0 ELSE {w1 + w2}::DOUBLE / ({w1}::DOUBLE / s{k-1} + {w2}::DOUBLE / s{k}) END AS d{k}"


def _end(name: str, h0: float, h1: float, s0: str, s1: str) -> str:
    raw = f"(({2 * h0 + h1}::DOUBLE * {s0} - {h0}::DOUBLE * {s1}) / {h0 + h1}::DOUBLE)"
    return f"""CASE WHEN sign({raw}) <> sign({s0}) THEN 0 WHEN sign({s0}) <> sign({s1}) AND abs({raw}) > 3 * abs({s0})
      THEN 3 * {s0} ELSE {raw} END AS {name}"""


def at(day: str, a: str) -> str:
    """Value of the curve in alias ``a`` at a day."""

    def segment(k: int) -> str:
        h = STEPS[k]
        t = f"(({day} - {KNOTS[k]})::DOUBLE / {h}::DOUBLE)"
        return (
            f"({a}.y{k} * (1 + 2 * {t}) * (1 - {t}) * (1 - {t}) + {a}.d{k} * {h}::DOUBLE * {t} * (1 - {t}) * (1 - {t})"
            f" + {a}.y{k+1} * {t} * {t} * (3 - 2 * {t}) + {a}.d{k+1} * {h}::DOUBLE * {t} * {t} * ({t} - 1))"
        )

    return (
        f"(CASE WHEN {day} <= 30 THEN {segment(0)} WHEN {day} <= 90 THEN {segment(1)}"
        f" WHEN {day} <= 180 THEN {segment(2)} ELSE {segment(3)} END)"
    )


CURVES = f"""daymeans AS (
  SELECT cluster, days_until, avg(proportion) AS prop, avg(easy_pct) AS easy, avg(medium_pct) AS medium, avg(hard_pct) AS hard
  FROM shares JOIN dense USING (company) GROUP BY 1, 2),
series AS (UNPIVOT daymeans ON prop, easy, medium, hard INTO NAME s VALUE v),
knots AS (
  SELECT cluster, s, 0.0::DOUBLE AS y0, coalesce(max(v) FILTER (days_until = 30), 0) AS y1, coalesce(max(v) FILTER (days_until = 90), 0) AS y2,
    coalesce(max(v) FILTER (days_until = 180), 0) AS y3, coalesce(max(v) FILTER (days_until = 360), 0) AS y4
  FROM series GROUP BY 1, 2),
raised AS (SELECT * REPLACE (CASE WHEN s = 'prop' THEN greatest(y0, y1, y2, y3, y4) ELSE y4 END AS y4) FROM knots),
secants AS (SELECT *, (y1 - y0) / 30 AS s0, (y2 - y1) / 60 AS s1, (y3 - y2) / 90 AS s2, (y4 - y3) / 180 AS s3 FROM raised),
curve AS (
  SELECT *, {_end('d0', 30.0, 60.0, 's0', 's1')}, {_interior(1)}, {_interior(2)}, {_interior(3)}, {_end('d4', 180.0, 90.0, 's3', 's2')}
  FROM secants),
sizes AS (SELECT cluster, count(DISTINCT company) AS n_companies FROM shares JOIN dense USING (company) GROUP BY 1)"""
ALL_LABELS = f"""assigned AS (
  SELECT company, min_by(cluster, (dist, days_until, cluster)) AS cluster FROM (
    SELECT s.company, s.days_until, c.cluster, abs(s.proportion - {at('s.days_until', 'c')}) AS dist
    FROM shares s JOIN sparse USING (company), curve c WHERE c.s = 'prop') GROUP BY 1),
clusters AS (SELECT company, cluster FROM dense UNION ALL SELECT company, cluster FROM assigned)"""
DAY = "greatest(1, least(q.days_until, 360))"


def predicted(requests: str) -> str:
    """CTE ``counts``: predictions for the rows of a CTE with company and days_until."""

    def clip(alias: str) -> str:
        return f"least(greatest({at(DAY, alias)}, 0), 1)"

    return f"""raw AS (
  SELECT q.*, l.cluster, m.max_total, p.cluster IS NOT NULL AS fitted, {clip('p')} AS prop, {clip('e')} AS pe, {clip('m2')} AS pm, {clip('h')} AS ph
  FROM {requests} q LEFT JOIN clusters l ON q.company = l.company
    LEFT JOIN (SELECT company, max(total) AS max_total FROM shares GROUP BY 1) m ON q.company = m.company
    LEFT JOIN curve p ON p.cluster = l.cluster AND p.s = 'prop' LEFT JOIN curve e ON e.cluster = l.cluster AND e.s = 'easy'
    LEFT JOIN curve m2 ON m2.cluster = l.cluster AND m2.s = 'medium' LEFT JOIN curve h ON h.cluster = l.cluster AND h.s = 'hard'),
sized AS (SELECT *, greatest(1, round_even(prop * coalesce(max_total, 10), 0)::BIGINT) AS t, pe + pm + ph AS ps FROM raw),
parts AS (
  SELECT *, round_even(t * CASE WHEN ps > 0 THEN pe / ps ELSE 0.3 END, 0)::BIGINT AS e, round_even(t * CASE WHEN ps > 0 THEN ph / ps ELSE 0.2 END, 0)::BIGINT AS h
  FROM sized),
counts AS (
  SELECT * EXCLUDE (max_total, fitted, prop, pe, pm, ph, t, ps, e, h), CASE WHEN fitted THEN greatest(e, 0) ELSE 3 END AS easy,
    CASE WHEN fitted THEN greatest(t - e - h, 0) ELSE 5 END AS medium, CASE WHEN fitted THEN greatest(h, 0) ELSE 2 END AS hard,
    CASE WHEN fitted THEN t ELSE 10 END AS total
  FROM parts)"""


def horizon_grid(days: str) -> str:
    return f"grid AS (SELECT company, unnest([{days}]) AS days_until FROM clusters)"


def _feature_sql(meta: str) -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SIZE_RANKS.items())
    return f"""feat AS (
  SELECT company, (dense_rank() OVER (ORDER BY coalesce(industry, 'unknown')) - 1)::DOUBLE AS industry_enc,
    (CASE size_range {ranks} ELSE 4 END)::DOUBLE AS size_rank,
    ln(1 + greatest(coalesce(try_cast(employee_count AS DOUBLE), 1), 1)) AS log_employees,
    coalesce(try_cast(year_founded AS DOUBLE), 2000) AS year_founded
  FROM {meta})"""


SCALED = """stats AS (
  SELECT avg(industry_enc) AS mi, coalesce(nullif(stddev_pop(industry_enc), 0), 1) AS si, avg(size_rank) AS ms, coalesce(nullif(stddev_pop(size_rank), 0), 1) AS ss,
    avg(log_employees) AS ml, coalesce(nullif(stddev_pop(log_employees), 0), 1) AS sl, avg(year_founded) AS my, coalesce(nullif(stddev_pop(year_founded), 0), 1) AS sy
  FROM feat),
scaled AS (
  SELECT company, (industry_enc - mi) / si * 2 AS industry_enc, (size_rank - ms) / ss AS size_rank, (log_employees - ml) / sl AS log_employees,
    (year_founded - my) / sy AS year_founded FROM feat, stats)"""


# --- Spark side of the shared pieces ----------------------------------------
def dist(spark, sf):
    return distributions.difficulty_distribution(D.problems(spark, sf))


def shares(spark, sf):
    return distributions.normalized_shares(dist(spark, sf))


def stored_shares(spark, sf):
    """Shares as the small table that later steps start from, so the problems are read once."""
    return cut_lineage(shares(spark, sf), "shares")


def stored_features(meta):
    return cut_lineage(features.company_features(meta), "features")


def split(spark, sf, base):
    """Labels of the companies clustered directly, and the sparse companies."""
    dense, sparse, _ = features.split_clusterable(distributions.volume_pivot(base))
    return D.supplier_region(spark, sf).join(dense.select("company"), "company", "left_semi"), sparse


def fitted(spark, sf):
    """Shares, curves and labels of all companies, from fixed labels of the clusterable ones."""
    base = stored_shares(spark, sf)
    labels, sparse = split(spark, sf, base)
    fits = cut_lineage(curves.fit_curves(base, labels), "curves")
    everyone = curves.merge_labels(labels, curves.assign_sparse(sparse, base, fits))
    return base, fits, cut_lineage(everyone, "labels")


def counts(spark, sf, requests):
    return predict(requests, *fitted(spark, sf))


def predict(requests, base, fits, labels):
    return curves.predict_counts(requests, labels, fits, distributions.max_totals(base))


# --- Queries ----------------------------------------------------------------
@query(with_ctes(D.PROBLEMS, DIST) + " SELECT * FROM dist")
def difficulty_distribution(spark, sf):
    return dist(spark, sf)


SHARE_COLUMNS = ["proportion", "easy_pct", "medium_pct", "hard_pct"]
SHARE_SQL = ", ".join(f"{sql_r6(c)} AS {c}" for c in SHARE_COLUMNS)


@query(with_ctes(D.PROBLEMS, DIST, SHARES) + f" SELECT company, days_until, easycount, hardcount, mediumcount, total, {SHARE_SQL} FROM shares")
def normalized_shares(spark, sf):
    return rounded(shares(spark, sf), *SHARE_COLUMNS)


@query(with_ctes(D.PROBLEMS, DIST, SHARES) + " SELECT company, max(total) AS max_total FROM shares GROUP BY 1")
def company_max_totals(spark, sf):
    return distributions.max_totals(shares(spark, sf))


VOLUME_SQL = ", ".join(f"{sql_r6(c)} AS {c}" for c in S.VOLUME_COLUMNS)


@query(with_ctes(D.PROBLEMS, DIST, SHARES, PIVOT) + f" SELECT company, {VOLUME_SQL} FROM pivoted")
def volume_pivot(spark, sf):
    return rounded(distributions.volume_pivot(shares(spark, sf)), *S.VOLUME_COLUMNS)


@query(with_ctes(D.PROBLEMS, DIST, SHARES, PIVOT) + f" SELECT company, {KNOWN} >= 2 AS clusterable FROM pivoted")
def clusterable_split(spark, sf):
    dense, sparse, _ = features.split_clusterable(distributions.volume_pivot(shares(spark, sf)))
    return dense.select("company", F.lit(True).alias("clusterable")).unionByName(
        sparse.select("company", F.lit(False).alias("clusterable"))
    )


@query(
    with_ctes(D.PROBLEMS, DIST, SHARES, PIVOT, D.SUPPLIER_META, _feature_sql("(SELECT * FROM meta WHERE industry IS NOT NULL)"))
    + """ SELECT p.company, f.company IS NOT NULL AS clusterable, """
    + ", ".join(f"{sql_r6(c)} AS {c}" for c in S.FEATURE_COLUMNS)
    + " FROM pivoted p LEFT JOIN feat f USING (company)"
)
def clusterable_split_by_metadata(spark, sf):
    """Companies with metadata are clustered on it alone, the others count as sparse."""
    meta = D.supplier_meta(spark, sf).filter("industry IS NOT NULL")
    usable, sparse, names = features.split_clusterable(distributions.volume_pivot(shares(spark, sf)), features.company_features(meta))
    none = [F.lit(None).cast("double").alias(c) for c in names]
    both = usable.select("company", F.lit(True).alias("clusterable"), *names).unionByName(
        sparse.select("company", F.lit(False).alias("clusterable"), *none)
    )
    return rounded(both, *names)


FEATURE_SQL = ", ".join(f"{sql_r6(c)} AS {c}" for c in S.FEATURE_COLUMNS)


@query(with_ctes(D.CUSTOMER_META, _feature_sql("cmeta")) + f" SELECT company, {FEATURE_SQL} FROM feat")
def company_features(spark, sf):
    return rounded(features.company_features(D.customer_meta(spark, sf)), *S.FEATURE_COLUMNS)


@query(
    with_ctes(
        D.CUSTOMER_META,
        _feature_sql("cmeta"),
        "gaps AS (SELECT company, nullif(industry_enc, 3) AS industry_enc, nullif(size_rank, 4) AS size_rank FROM feat)",
    )
    + """ SELECT company, coalesce(industry_enc, (SELECT quantile_cont(industry_enc, 0.5) FROM gaps)) AS industry_enc,
      coalesce(size_rank, (SELECT quantile_cont(size_rank, 0.5) FROM gaps)) AS size_rank FROM gaps"""
)
def imputed_features(spark, sf):
    feats = stored_features(D.customer_meta(spark, sf))
    gaps = feats.select(
        "company", F.nullif("industry_enc", F.lit(3.0)).alias("industry_enc"), F.nullif("size_rank", F.lit(4.0)).alias("size_rank")
    )
    return features.impute_median(gaps, ["industry_enc", "size_rank"])


@query(with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED) + f" SELECT company, {FEATURE_SQL} FROM scaled")
def standardized_features(spark, sf):
    feats = stored_features(D.customer_meta(spark, sf))
    return rounded(features.standardize(feats, S.FEATURE_COLUMNS), *S.FEATURE_COLUMNS)


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    sums AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM e a, e b GROUP BY 1, 2, 3),
    sizes AS (SELECT label AS other, count(*) AS n FROM e GROUP BY 1),
    ab AS (SELECT vec_id, own, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a,
      min(CASE WHEN own <> other THEN total / n END) AS b FROM sums JOIN sizes USING (other) GROUP BY 1, 2)
    SELECT vec_id, own AS cluster, """
    + sql_r6("coalesce(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0)")
    + " AS silhouette FROM ab"
)
def silhouette_by_label(spark, sf):
    points = D.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    return rounded(clustering.silhouette_samples(points, "vec_id", ["label"]).drop("labelling"), "silhouette")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    sums AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS total FROM e a, e b GROUP BY 1, 2, 3),
    sizes AS (SELECT label AS other, count(*) AS n FROM e GROUP BY 1),
    ab AS (SELECT vec_id, own, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a,
      min(CASE WHEN own <> other THEN total / n END) AS b FROM sums JOIN sizes USING (other) GROUP BY 1, 2)
    SELECT vec_id, own AS cluster, """
    + sql_r6("coalesce(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0)")
    + " AS silhouette FROM ab"
)
def squared_silhouette_by_label(spark, sf):
    points = D.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    return rounded(clustering.squared_silhouette_samples(points, "vec_id", ["label"]).drop("labelling"), "silhouette")


KMEANS_ROUNDS = 12

#: k-means from given centres: for each k, vectors evenly spaced in the order of ids. A row of ``fits`` is a
#: coordinate of a centre after a round; the last round's centres give labels, inertia and silhouettes.
KMEANS_SQL = f"""WITH RECURSIVE ordered AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
cells AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM ordered),
ks AS (SELECT unnest(range({S.K_MIN}, {S.K_MAX + 1})) AS k),
fits AS (
  SELECT 0 AS step, k, j AS c, i, x FROM ks, range({S.K_MAX}) r(j) JOIN ordered ON place = (j * n) // k JOIN cells USING (vec_id) WHERE j < k
  UNION ALL
  SELECT step + 1, k, c, i, avg(cells.x) FROM (
    SELECT step, k, vec_id, min({{'d': d, 'c': c}}).c AS c FROM (
      SELECT step, k, c, vec_id, sum((cells.x - fits.x) ** 2) AS d FROM fits JOIN cells USING (i) WHERE step < {KMEANS_ROUNDS} GROUP BY 1, 2, 3, 4)
    GROUP BY 1, 2, 3) JOIN cells USING (vec_id) GROUP BY 1, 2, 3, 4),
apart AS (
  SELECT k, c, vec_id, sum((cells.x - fits.x) ** 2) AS d FROM fits JOIN cells USING (i) WHERE step = {KMEANS_ROUNDS} GROUP BY 1, 2, 3),
labels AS (SELECT k, vec_id, min({{'d': d, 'c': c}}).c::INTEGER AS cluster, min(d) AS d FROM apart GROUP BY 1, 2),
far AS (SELECT a.vec_id AS one, b.vec_id AS two, list_distance(a.v, b.v) AS far FROM ordered a, ordered b),
sums AS (
  SELECT a.k, one, a.cluster AS own, b.cluster AS other, sum(far) AS total, count(*) AS n
  FROM far JOIN labels a ON a.vec_id = one JOIN labels b ON b.vec_id = two AND b.k = a.k GROUP BY 1, 2, 3, 4),
ab AS (
  SELECT k, one, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a,
    min(CASE WHEN own <> other THEN total / n END) AS b FROM sums GROUP BY 1, 2),
scores AS (SELECT k, avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab GROUP BY 1),
costs AS (SELECT k, sum(d) AS inertia FROM labels GROUP BY 1),
chosen AS (SELECT min(k) AS k FROM scores WHERE silhouette = (SELECT max(silhouette) FROM scores))
"""


def _kmeans_from_given_centers(spark, sf) -> clustering.KSelection:
    vectors = cut_lineage(D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vectors")
    ks, n = range(S.K_MIN, S.K_MAX + 1), vectors.count()
    asked = {k: [j * n // k for j in range(k)] for k in ks}
    placed = numbered(vectors, [F.col("vec_id")], "place", start=0)
    found = placed.filter(F.col("place").isin(sorted({p for places in asked.values() for p in places})))
    at = {r.place: r.vector for r in found.collect()}
    starts = {k: [at[p] for p in places] for k, places in asked.items()}
    return clustering.select_k(vectors, "vec_id", starts=starts, iterations=KMEANS_ROUNDS, tolerance=0.0)


@query(
    KMEANS_SQL
    + f"SELECT k::INTEGER AS k, {sql_r6('silhouette')} AS silhouette, {sql_r6('inertia')} AS inertia, k = (SELECT k FROM chosen) AS chosen "
    "FROM scores JOIN costs USING (k)"
)
def kmeans_from_given_centers(spark, sf):
    """Inertia and silhouette of every k after a fixed number of rounds, and the k that is chosen."""
    chosen = _kmeans_from_given_centers(spark, sf)
    rows = [(k, s, i, k == chosen.best_k) for k, s, i in chosen.scores]
    return rounded(spark.createDataFrame(rows, "k int, silhouette double, inertia double, chosen boolean"), "silhouette", "inertia")


@query(KMEANS_SQL + "SELECT vec_id, cluster FROM labels WHERE k = (SELECT k FROM chosen)")
def kmeans_labels_from_given_centers(spark, sf):
    return _kmeans_from_given_centers(spark, sf).labels


def _supplier_fit(spark, sf):
    return predictor.fit(dist(spark, sf), D.supplier_meta(spark, sf))


@query()
def kmeans_select_k(spark, sf):
    feats = stored_features(D.supplier_meta(spark, sf))
    scaler = features.fit_scaler(feats, S.FEATURE_COLUMNS)
    chosen = clustering.select_k(feats.select("company", scaler.vector().alias("vector")), "company")
    rows = [(k, s, i, k == chosen.best_k) for k, s, i in chosen.scores]
    return spark.createDataFrame(rows, "k int, silhouette double, inertia double, chosen boolean")


@query()
def fit_predictor(spark, sf):
    return _supplier_fit(spark, sf).labels


def _axis_sql(n: int, matrix: str) -> str:
    """CTEs for the leading axis of a covariance: squaring the matrix again and again leaves only that axis."""
    return f"""power{n} AS (
  SELECT 0 AS step, i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix}
  UNION ALL
  SELECT step + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.step, a.i, b.j, sum(a.v * b.v) AS v FROM power{n} a JOIN power{n} b ON a.j = b.i WHERE a.step < 36 GROUP BY 1, 2, 3)),
column{n} AS (SELECT i, v FROM power{n} WHERE step = 36 AND j = (SELECT arg_max(i, v) FROM power{n} WHERE step = 36 AND i = j)),
axis{n} AS (SELECT i, v / sqrt((SELECT sum(v * v) FROM column{n})) * sign((SELECT arg_max(v, abs(v)) FROM column{n})) AS v FROM column{n}),
size{n} AS (SELECT sum(a.v * m.v * b.v) AS s FROM axis{n} a JOIN {matrix} m USING (i) JOIN axis{n} b ON b.i = m.j)"""


PCA_SQL = f"""WITH RECURSIVE cells AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT i, avg(x) AS m FROM cells GROUP BY 1),
centred AS (SELECT vec_id, i, x - m AS x FROM cells JOIN means USING (i)),
cov AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY 1, 2),
{_axis_sql(1, 'cov')},
rest AS (SELECT c.i, c.j, c.v - (SELECT s FROM size1) * a.v * b.v AS v FROM cov c JOIN axis1 a ON a.i = c.i JOIN axis1 b ON b.i = c.j),
{_axis_sql(2, 'rest')},
shown AS (
  SELECT 'point' AS kind, vec_id::VARCHAR AS name, i, x FROM centred UNION ALL
  SELECT 'centroid', (dense_rank() OVER (ORDER BY label) - 1)::VARCHAR, i, x - m FROM (SELECT label, i, avg(x) AS x FROM cells GROUP BY 1, 2) JOIN means USING (i)),
total AS (SELECT sum(v) AS t FROM cov WHERE i = j)
SELECT kind, name, {sql_r6('sum(x * p.v)')} AS pc1, {sql_r6('sum(x * q.v)')} AS pc2,
  {sql_r6('any_value(size1.s / t)')} AS explained1, {sql_r6('any_value(size2.s / t)')} AS explained2
FROM shown JOIN axis1 p USING (i) JOIN axis2 q USING (i), size1, size2, total GROUP BY 1, 2"""


@query(PCA_SQL)
def pca_projection(spark, sf):
    points = D.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    centers = points.groupBy("label").agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(64)]).alias("c"))
    found = clustering.pca_projection(points, "vec_id", [r["c"] for r in centers.orderBy("label").collect()])
    return rounded(found, "pc1", "pc2", "explained1", "explained2")


@query(
    with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED)
    + """, centers AS (SELECT n_regionkey, avg(industry_enc) AS industry_enc, avg(size_rank) AS size_rank, avg(log_employees) AS log_employees,
      avg(year_founded) AS year_founded FROM scaled JOIN customer ON company = c_name JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT feature, """
    + sql_r6("spread")
    + """ AS spread FROM (UNPIVOT (SELECT stddev_pop(industry_enc) AS industry_enc, stddev_pop(size_rank) AS size_rank,
      stddev_pop(log_employees) AS log_employees, stddev_pop(year_founded) AS year_founded FROM centers)
      ON industry_enc, size_rank, log_employees, year_founded INTO NAME feature VALUE spread)"""
)
def centroid_spread(spark, sf):
    scaled = features.standardize(stored_features(D.customer_meta(spark, sf)), S.FEATURE_COLUMNS)
    centers = scaled.join(_customer_region(spark, sf), "company").groupBy("cluster")
    centers = centers.agg(*[F.avg(c).alias(c) for c in S.FEATURE_COLUMNS])
    return rounded(clustering.centroid_spread(centers, S.FEATURE_COLUMNS), "spread")


def _customer_region(spark, sf):
    return D.table(spark, sf, "customer").join(
        D.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_name").alias("company"), F.col("n_regionkey").alias("cluster"))


MEAN_SQL = f"{sql_r6('prop')} AS proportion, {sql_r6('easy')} AS easy_pct, {sql_r6('medium')} AS medium_pct, {sql_r6('hard')} AS hard_pct"


@query(with_ctes(*BASE, CURVES) + f" SELECT cluster, days_until, {MEAN_SQL} FROM daymeans")
def cluster_day_means(spark, sf):
    base = stored_shares(spark, sf)
    return rounded(curves.cluster_day_means(base, split(spark, sf, base)[0]), *SHARE_COLUMNS)


KNOT_SQL = ", ".join(f"{sql_r6(f'{v}{k}')} AS {v}{k}" for v in "yd" for k in range(5))


@query(with_ctes(*BASE, CURVES) + f" SELECT cluster, s AS series, n_companies, {KNOT_SQL} FROM curve JOIN sizes USING (cluster)")
def cluster_curves(spark, sf):
    base = stored_shares(spark, sf)
    fits = curves.fit_curves(base, split(spark, sf, base)[0])
    series = F.explode(
        F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"{s}_y").alias("y"), F.col(f"{s}_d").alias("d")) for s in curves.SERIES])
    )
    knots = [r6(F.col("c")[v][k]).alias(f"{v}{k}") for v in "yd" for k in range(5)]
    return fits.select("cluster", "n_companies", series.alias("c")).select("cluster", F.col("c.s").alias("series"), "n_companies", *knots)


def _grid_value(alias: str, name: str) -> str:
    clipped = f"least(greatest({at('g.day', alias)}, 0), 1)"
    return f"{sql_r6(clipped)} AS {name}"


GRID_DAY = "least(1 + i * (359.0::DOUBLE / 299), 360::DOUBLE)"


@query(
    with_ctes(*BASE, CURVES)
    + f""" SELECT p.cluster, g.i::INT AS point, {sql_r6('g.day')} AS day, {_grid_value('p', 'proportion')}, {_grid_value('e', 'easy_pct')},
      {_grid_value('m', 'medium_pct')}, {_grid_value('h', 'hard_pct')}
    FROM (SELECT i, {GRID_DAY} AS day FROM range(300) t(i)) g, curve p JOIN curve e USING (cluster) JOIN curve m USING (cluster) JOIN curve h USING (cluster)
    WHERE p.s = 'prop' AND e.s = 'easy' AND m.s = 'medium' AND h.s = 'hard'"""
)
def curve_grid(spark, sf):
    base = stored_shares(spark, sf)
    fits = curves.fit_curves(base, split(spark, sf, base)[0])
    return rounded(curves.curve_grid(fits), "day", *SHARE_COLUMNS)


@query(with_ctes(*BASE, CURVES, ALL_LABELS) + " SELECT company, cluster FROM clusters")
def sparse_assignment(spark, sf):
    return fitted(spark, sf)[2]


@query(with_ctes(*BASE, CURVES, ALL_LABELS, D.INTERVIEWS, predicted("interviews")) + " SELECT * FROM counts")
def predict_counts(spark, sf):
    return counts(spark, sf, D.interviews(spark, sf))


COLD = """cold AS (
  SELECT company, (SELECT quantile_cont(industry_enc, 0.5) FROM feat) AS industry_enc, (CASE size_range {ranks} ELSE 4 END)::DOUBLE AS size_rank,
    ln(1 + greatest(coalesce(try_cast(employee_count AS DOUBLE), 1), 1)) AS log_employees,
    coalesce(nullif(try_cast(year_founded AS DOUBLE), 0), 2000) AS year_founded FROM cmeta)""".format(
    ranks=" ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SIZE_RANKS.items())
)


@query(
    with_ctes(D.SUPPLIER_META, D.CUSTOMER_META, D.SUPPLIER_REGION, _feature_sql("meta"), SCALED, COLD)
    + """, centers AS (SELECT cluster, avg(industry_enc) AS ci, avg(size_rank) AS cs, avg(log_employees) AS cl, avg(year_founded) AS cy
      FROM scaled JOIN regions USING (company) GROUP BY 1),
    z AS (SELECT company, (industry_enc - mi) / si * 2 AS zi, (size_rank - ms) / ss AS zs, (log_employees - ml) / sl AS zl, (year_founded - my) / sy AS zy FROM cold, stats)
    SELECT company, min_by(cluster, ((zi - ci) ** 2 + (zs - cs) ** 2 + (zl - cl) ** 2 + (zy - cy) ** 2, cluster)) AS cluster FROM z, centers GROUP BY 1"""
)
def cold_start_cluster(spark, sf):
    feats = stored_features(D.supplier_meta(spark, sf))
    scaler = features.fit_scaler(feats, S.FEATURE_COLUMNS)
    scaled = feats.select("company", *[scaler.scaled(c).alias(c) for c in S.FEATURE_COLUMNS])
    centers = scaled.join(D.supplier_region(spark, sf), "company").groupBy("cluster")
    centers = centers.agg(F.array(*[F.avg(c) for c in S.FEATURE_COLUMNS]).alias("center"))
    encoded = curves.encode_cold_start(D.customer_meta(spark, sf), S.FEATURE_COLUMNS, feats)
    return curves.nearest_centroid(encoded, centers, scaler.vector()).select("company", "cluster")


CUSTOMER_MEMBERS = """members AS (
  SELECT company, n_regionkey AS cluster, industry_enc AS a, size_rank AS b, log_employees AS c, year_founded AS d
  FROM scaled JOIN customer ON company = c_name JOIN nation ON c_nationkey = n_nationkey)"""
PEERS = """peers AS (
  SELECT * FROM (SELECT x.company, y.company AS peer, dist, row_number() OVER (PARTITION BY x.company ORDER BY dist, y.company) AS rank
    FROM members x JOIN members y ON x.cluster = y.cluster AND x.company <> y.company,
      LATERAL (SELECT round(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2), 9) AS dist)) WHERE rank <= 50)"""


def _customer_peers(spark, sf):
    feats = stored_features(D.customer_meta(spark, sf))
    vectors = feats.select("company", features.fit_scaler(feats, S.FEATURE_COLUMNS).vector().alias("vector"))
    labels = _customer_region(spark, sf)
    return peers.nearest_peers(vectors.join(labels, "company"), k=S.PEER_CAP), labels


@query(
    with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED, CUSTOMER_MEMBERS, PEERS)
    + " SELECT company, peer, dist AS distance, rank::INT AS rank FROM peers"
)
def nearest_peers(spark, sf):
    return _customer_peers(spark, sf)[0]


@query(
    with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED, CUSTOMER_MEMBERS, PEERS.replace("JOIN members y", "JOIN customer ON x.company = c_name AND c_custkey % 50 = 0 JOIN members y").replace(" WHERE rank <= 50", ""))
    + " SELECT company, peer, dist AS distance, rank::INT AS rank FROM peers"
)
def all_peers(spark, sf):
    """Every peer of every fiftieth customer, closest first."""
    feats = stored_features(D.customer_meta(spark, sf))
    vectors = feats.select("company", features.fit_scaler(feats, S.FEATURE_COLUMNS).vector().alias("vector"))
    members = cut_lineage(vectors.join(_customer_region(spark, sf), "company"), "members")
    asked = D.table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(F.col("c_name").alias("company"))
    return peers.nearest_peers(members, members.join(asked, "company", "left_semi"))


@query(
    with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED, CUSTOMER_MEMBERS, PEERS)
    + " SELECT company, c_custkey AS peer_id, rank::INT AS rank FROM peers JOIN customer ON peer = c_name"
)
def peer_ids(spark, sf):
    companies = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return peers.peer_ids(_customer_peers(spark, sf)[0], companies)


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS, D.INTERVIEWS)
    + """ SELECT q.company, l.cluster, coalesce(n_companies, 0) AS n_companies_in_cluster
    FROM (SELECT DISTINCT company FROM interviews) q LEFT JOIN clusters l ON q.company = l.company LEFT JOIN sizes USING (cluster)"""
)
def cluster_info(spark, sf):
    _, fits, labels = fitted(spark, sf)
    return curves.cluster_info(D.interviews(spark, sf).select("company").distinct(), labels, fits)


# --- Registry ---------------------------------------------------------------
def _normalized_sql(expr: str) -> str:
    """Suffix removal spelled out for an engine whose replace takes the first match only."""
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    out = strip.format(f"lower({expr})")
    for _ in range(clean.SUFFIX_PASSES):
        out = strip.format(f"regexp_replace({out}, '{clean.SUFFIX_PATTERN}', '', 'gi')")
    return rf"regexp_replace({out}, '\s+', ' ', 'g')"


NORMALIZED = f"""normed AS (SELECT *, {_normalized_sql('name')} AS norm FROM registry),
firsts AS (SELECT norm, min(row_no) AS row_no FROM normed WHERE norm <> '' GROUP BY 1),
asked AS (SELECT company, {_normalized_sql('company')} AS k FROM wanted)"""


@query(with_ctes(D.REGISTRY, D.REGISTRY_QUERIES, NORMALIZED) + " SELECT company AS name, k AS norm FROM asked UNION ALL SELECT name, norm FROM normed")
def normalized_names(spark, sf):
    names = D.registry_queries(spark, sf).select(F.col("company").alias("name")).unionByName(D.registry(spark, sf).select("name"))
    return names.withColumn("norm", clean.normalize_company(F.col("name")))


@query(with_ctes(D.REGISTRY, D.REGISTRY_QUERIES, NORMALIZED) + " SELECT norm, row_no FROM firsts")
def registry_first_rows(spark, sf):
    return registry.normalized_registry(D.registry(spark, sf)).select("norm", "row_no")


MATCHED = """hits AS (
  SELECT company, min(CASE WHEN k = norm THEN row_no END) AS r1, min(CASE WHEN length(k) >= 3 AND starts_with(norm, k) THEN row_no END) AS r2,
    min(CASE WHEN length(k) >= 4 AND contains(norm, k) THEN row_no END) AS r3 FROM asked, firsts GROUP BY 1),
picked AS (SELECT company, coalesce(r1, r2, r3) AS row_no, CASE WHEN r1 IS NOT NULL THEN 1 WHEN r2 IS NOT NULL THEN 2 WHEN r3 IS NOT NULL THEN 3 END AS tier FROM hits)"""


@query(
    with_ctes(D.REGISTRY, D.REGISTRY_QUERIES, NORMALIZED, MATCHED)
    + """ SELECT p.company, p.row_no, p.tier::INT AS tier, r.name, r.industry, r.size_range, r.employee_count, r.year_founded, r.locality
    FROM picked p LEFT JOIN registry r USING (row_no)"""
)
def registry_match(spark, sf):
    return registry.match_names(D.registry_queries(spark, sf), D.registry(spark, sf))


@query(
    with_ctes(D.REGISTRY, D.REGISTRY_QUERIES, NORMALIZED, MATCHED)
    + """ SELECT p.company, r.industry, r.size_range, r.employee_count, r.year_founded, r.locality FROM picked p JOIN registry r USING (row_no)"""
)
def company_meta(spark, sf):
    return registry.company_meta(registry.match_names(D.registry_queries(spark, sf), D.registry(spark, sf)))


def _lookup_sql(candidates: str) -> str:
    return f"""{with_ctes(D.REGISTRY, D.REGISTRY_QUERIES)}, q AS (SELECT company, lower(trim(company)) AS k FROM wanted),
    found AS (SELECT company, k, r.*, row_number() OVER (PARTITION BY company ORDER BY row_no) AS nth FROM q JOIN registry r ON contains(lower(name), k)),
    best AS (SELECT company, min_by(row_no, (lower(trim(name)) <> k, CASE WHEN lower(trim(name)) = k THEN 0 ELSE length(name) END, row_no)) AS row_no
      FROM found {candidates} GROUP BY 1)
    SELECT b.company, b.row_no, name, lower(trim(name)) = lower(trim(b.company)) AS exact, industry, size_range, locality, employee_count, year_founded
    FROM best b JOIN registry USING (row_no)"""


@query(_lookup_sql(""))
def registry_lookup(spark, sf):
    return registry.lookup_names(D.registry_queries(spark, sf), D.registry(spark, sf))


@query(_lookup_sql("WHERE nth <= 50"))
def registry_lookup_first_50(spark, sf):
    return registry.lookup_names(D.registry_queries(spark, sf), D.registry(spark, sf), first_n=50)


# --- Reports on clusters and predictions ------------------------------------
GRID4 = horizon_grid("30, 90, 180, 360")


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS)
    + """ SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_companies, min(n) AS min_size, max(n) AS max_size, """
    + sql_r6("avg(n)")
    + """ AS mean_size, 5 - count(*) AS empty_clusters, count(*) = 5 AND min(n) >= 2 AS passed FROM (SELECT cluster, count(*) AS n FROM clusters GROUP BY 1)"""
)
def report_cluster_balance(spark, sf):
    return rounded(clustering.cluster_balance(fitted(spark, sf)[2], 5), "mean_size")


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS, GRID4, predicted("grid"))
    + """ SELECT company, string_agg(total::VARCHAR, ',' ORDER BY days_until) AS totals, bool_and(ok) AS passed
    FROM (SELECT *, coalesce(total >= lag(total) OVER (PARTITION BY company ORDER BY days_until), true) AS ok FROM counts) GROUP BY 1"""
)
def report_monotone_totals(spark, sf):
    base, fits, labels = fitted(spark, sf)
    grid = reports.horizon_requests(labels, S.HORIZONS)
    return reports.monotone_totals(curves.predict_counts(grid, labels, fits, distributions.max_totals(base)))


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS, GRID4, predicted("grid"))
    + """ SELECT company, days_until, easy, medium, hard, total, least(easy, medium, hard) >= 0 AND total > 0 AS positive,
      least(easy, medium, hard) >= 0 AND total > 0 AND easy + medium + hard = total AS passed FROM counts"""
)
def report_valid_predictions(spark, sf):
    base, fits, labels = fitted(spark, sf)
    grid = reports.horizon_requests(labels, S.HORIZONS)
    return reports.valid_predictions(curves.predict_counts(grid, labels, fits, distributions.max_totals(base)))


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS, D.CUSTOMER_META, "grid AS (SELECT company, 90 AS days_until FROM cmeta)", predicted("grid"))
    + """ SELECT company, days_until, easy, medium, hard, total, least(easy, medium, hard) >= 0 AND total > 0 AS positive,
      least(easy, medium, hard) >= 0 AND total > 0 AND easy + medium + hard = total AS passed FROM counts"""
)
def report_cold_start(spark, sf):
    base, fits, labels = fitted(spark, sf)
    unknown = reports.horizon_requests(D.customer_meta(spark, sf), [90])
    return reports.valid_predictions(curves.predict_counts(unknown, labels, fits, distributions.max_totals(base)))


# --- Companies known to the registry only: looked up, placed, predicted -------
FOUND_META = f"cmeta AS ({_lookup_sql('')})"
PLACED = """centers AS (
  SELECT cluster, avg(industry_enc) AS ci, avg(size_rank) AS cs, avg(log_employees) AS cl, avg(year_founded) AS cy FROM scaled JOIN regions USING (company) GROUP BY 1),
z AS (SELECT company, (industry_enc - mi) / si * 2 AS zi, (size_rank - ms) / ss AS zs, (log_employees - ml) / sl AS zl, (year_founded - my) / sy AS zy FROM cold, stats),
clusters AS (
  SELECT company, cluster FROM known UNION ALL
  SELECT company, min_by(cluster, ((zi - ci) ** 2 + (zs - cs) ** 2 + (zl - cl) ** 2 + (zy - cy) ** 2, cluster)) FROM z, centers GROUP BY 1)"""
COLD_START = (
    *BASE, CURVES, ALL_LABELS.replace("clusters AS", "known AS"), D.SUPPLIER_META, D.REGISTRY, D.REGISTRY_QUERIES, FOUND_META,
    _feature_sql("meta"), SCALED, COLD, PLACED, "requests AS (SELECT company, unnest([30, 90, 180, 360]) AS days_until FROM wanted)", predicted("requests"),
)


def _cold_start(spark, sf):
    """Counts for names that only the registry knows, by the predictor's own way, from fixed centres."""
    base, fits, labels = fitted(spark, sf)
    feats = stored_features(D.supplier_meta(spark, sf))
    scaler = features.fit_scaler(feats, S.FEATURE_COLUMNS)
    regions = D.supplier_region(spark, sf)
    scaled = feats.select("company", *[scaler.scaled(c).alias(c) for c in S.FEATURE_COLUMNS]).join(regions, "company")
    centers = scaled.groupBy("cluster").agg(F.array(*[F.avg(c) for c in S.FEATURE_COLUMNS]).alias("center"))
    centers = [r["center"] for r in centers.orderBy("cluster").collect()]  # one per region
    vectors = feats.select("company", scaler.vector().alias("vector"))
    model = predictor.Predictor(
        base, feats, scaler, clustering.KSelection(len(centers), regions, centers, []), fits, labels,
        labels.join(vectors, "company", "left"), distributions.max_totals(base),
    )
    requests = reports.horizon_requests(D.registry_queries(spark, sf), S.HORIZONS)
    return predictor.resolve_unknown(model, requests, D.registry(spark, sf)).predict(requests)


@query(with_ctes(*COLD_START) + " SELECT company, days_until, cluster, easy, medium, hard FROM counts")
def cold_start_counts(spark, sf):
    return _cold_start(spark, sf).select("company", "days_until", "cluster", "easy", "medium", "hard")


@query(
    with_ctes(*COLD_START)
    + """ SELECT company, days_until, easy, medium, hard, total, least(easy, medium, hard) >= 0 AND total > 0 AS positive,
      least(easy, medium, hard) >= 0 AND total > 0 AND easy + medium + hard = total AS passed FROM counts"""
)
def report_cold_start_found(spark, sf):
    return reports.valid_predictions(_cold_start(spark, sf))


@query(
    with_ctes(D.CUSTOMER_META, _feature_sql("cmeta"), SCALED, CUSTOMER_MEMBERS, PEERS)
    + """ SELECT p.company, a.cluster, count(*) AS n_peers, count(*) FILTER (a.cluster <> b.cluster) AS n_mismatched, bool_and(a.cluster = b.cluster) AS passed
    FROM peers p JOIN members a ON p.company = a.company JOIN members b ON p.peer = b.company GROUP BY 1, 2"""
)
def report_peers_share_cluster(spark, sf):
    found, labels = _customer_peers(spark, sf)
    return reports.peers_share_cluster(found, labels)


def _mix(alias: str, name: str) -> str:
    return f"round_even(least(greatest({at('30', alias)}, 0), 1) * 100, 0)::INT AS {name}_percent"


@query(
    with_ctes(*BASE, CURVES, ALL_LABELS)
    + f""" SELECT n.cluster, n.n AS n_companies, {_mix('e', 'easy')}, {_mix('m', 'medium')}, {_mix('h', 'hard')},
      concat(array_to_string(names[1:6], ', '), CASE WHEN n.n > 6 THEN '...' ELSE '' END) AS top_companies
    FROM (SELECT cluster, count(*) AS n, list(company ORDER BY company) AS names FROM clusters GROUP BY 1) n
      JOIN curve e USING (cluster) JOIN curve m USING (cluster) JOIN curve h USING (cluster) WHERE e.s = 'easy' AND m.s = 'medium' AND h.s = 'hard'"""
)
def report_cluster_summary(spark, sf):
    _, fits, labels = fitted(spark, sf)
    return clustering.cluster_summary(labels, fits)


@query(with_ctes(*BASE, CURVES, ALL_LABELS) + " SELECT cluster, company FROM clusters")
def report_cluster_members(spark, sf):
    return reports.cluster_members(fitted(spark, sf)[2])
