"""Interview tracks: dashboard, detail, insertion, deletion and progress, batch and streaming."""

from pyspark.sql import functions as F

from checks import domain as D
from checks.base import query, rounded, sql_r6, with_ctes
from preptrail.operators import tracks
from preptrail.session import cut_lineage, scratch_path
from preptrail.streaming.toggles import latest_progress, progress_stream



def today():
    return F.lit(D.TODAY).cast("date")


STATE = (D.TOGGLES, D.TRACKS, D.TRACK_ITEMS, D.TRACK_COMPANIES, D.TRACK_PROBLEMS)
DONE = "done AS (SELECT interview_id, count(*) AS total, count(*) FILTER (is_completed) AS done FROM items GROUP BY 1)"


def _state(spark, sf):
    return D.tracks(spark, sf), D.track_items(spark, sf), D.track_companies(spark, sf)


@query(
    with_ctes(*STATE, DONE)
    + f""", shown AS (SELECT t.*, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(date_diff('day', DATE '{D.TODAY}', interview_date)::INT, days_until) AS days_remaining,
      coalesce(done = total AND total > 0, false) AS is_finished FROM tracks t LEFT JOIN done ON interview_id = t.id)
    SELECT user_id, s.id AS interview_id, c.name AS company, days_remaining, is_finished,
      CASE WHEN is_finished THEN 'FINISHED' WHEN days_remaining <= 3 THEN 'URGENT' WHEN days_remaining <= 7 THEN 'SOON' ELSE 'ON TRACK' END AS status,
      done, CASE WHEN total > 0 THEN total ELSE 10 END AS shown_total, {sql_r6('CASE WHEN total > 0 THEN done / total * 100 ELSE 0 END')} AS percent
    FROM shown s LEFT JOIN tcompanies c ON c.id = s.company_id"""
)
def dashboard(spark, sf):
    interviews, items, companies = _state(spark, sf)
    return rounded(tracks.dashboard(interviews, items, companies, today()), "percent")


@query(
    with_ctes(*STATE, DONE)
    + """ SELECT t.user_id, i.interview_id, c.name AS company, i.id AS roadmap_id, i.problem_id, title, difficulty, coalesce(topics, 'Algorithm & Data Structures') AS topics,
      is_completed, floor(done / total * 100)::INT AS percent
    FROM items i JOIN tracks t ON t.id = i.interview_id LEFT JOIN tcompanies c ON c.id = t.company_id JOIN tproblems p ON p.id = i.problem_id JOIN done d USING (interview_id)"""
)
def roadmap_detail(spark, sf):
    interviews, items, companies = _state(spark, sf)
    return tracks.roadmap_detail(interviews, items, D.track_problems(spark, sf), companies)


# Track requests: every customer asks for a company; customers stand for users.
REQUESTS = "asks AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderkey % 10 AS company_id, CAST(o_orderkey % 90 AS INT) AS days_until FROM orders)"


def _requests(spark, sf):
    return D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_orderkey") % 10).alias("company_id"),
        (F.col("o_orderkey") % 90).cast("int").alias("days_until"),
    )


@query(
    with_ctes(*STATE, REQUESTS)
    + f""" SELECT user_id, company_id, min(request_id) AS request_id, arg_min(days_until, request_id) AS days_until,
      DATE '{D.TODAY}' + arg_min(days_until, request_id) AS interview_date
    FROM asks a WHERE NOT EXISTS (SELECT 1 FROM tracks t WHERE t.user_id = a.user_id AND t.company_id = a.company_id) GROUP BY 1, 2"""
)
def track_insert(spark, sf):
    return tracks.new_tracks(_requests(spark, sf), D.tracks(spark, sf), today())


# Deletions: a user asks to drop the track of their first order; only owners succeed.
DELETIONS = "deletions AS (SELECT DISTINCT o_custkey AS user_id, o_custkey * 10 + o_orderkey % 7 AS interview_id FROM orders UNION SELECT o_custkey, o_orderkey FROM orders)"
GONE = "gone AS (SELECT t.id FROM tracks t JOIN deletions d ON d.interview_id = t.id AND d.user_id = t.user_id)"


def _deletions(spark, sf):
    orders = D.table(spark, sf, "orders")
    own = orders.select(F.col("o_custkey").alias("user_id"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 7).alias("interview_id"))
    return own.union(orders.select("o_custkey", "o_orderkey")).distinct()


@query(with_ctes(*STATE, DELETIONS, GONE) + " SELECT id, user_id, company_id FROM tracks WHERE id NOT IN (SELECT id FROM gone)")
def track_delete(spark, sf):
    interviews, items, _ = _state(spark, sf)
    return tracks.delete_tracks(interviews, items, _deletions(spark, sf))[0].select("id", "user_id", "company_id")


@query(with_ctes(*STATE, DELETIONS, GONE) + " SELECT id, interview_id, problem_id, is_completed FROM items WHERE interview_id NOT IN (SELECT id FROM gone)")
def track_delete_roadmaps(spark, sf):
    interviews, items, _ = _state(spark, sf)
    return tracks.delete_tracks(interviews, items, _deletions(spark, sf))[1]


@query(
    with_ctes(*STATE)
    + """, log AS (SELECT user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS user_id, user_id * 1000 + item_id AS roadmap_id
      FROM toggles JOIN events USING (event_id, user_id)),
    flips AS (SELECT roadmap_id, count(*) AS n FROM log l JOIN items i ON i.id = l.roadmap_id JOIN tracks t ON t.id = i.interview_id AND t.user_id = l.user_id GROUP BY 1)
    SELECT id, interview_id, problem_id, is_completed <> (coalesce(n, 0) % 2 = 1) AS is_completed FROM items LEFT JOIN flips ON roadmap_id = id"""
)
def roadmap_toggle(spark, sf):
    interviews, items, _ = _state(spark, sf)
    kinds = D.table(spark, sf, "events").select("event_id", "event_type")
    log = D.toggles(spark, sf).join(kinds, "event_id").select(
        (F.col("user_id") + (F.col("event_type") == "error").cast("int")).alias("user_id"),
        (F.col("user_id") * 1000 + F.col("item_id")).alias("roadmap_id"),
    )
    return tracks.toggle(items, interviews, log)


PROGRESS = " SELECT user_id, item_id, count(*) AS n_toggles, count(*) % 2 = 1 AS is_completed FROM toggles GROUP BY 1, 2"


@query(with_ctes(D.TOGGLES) + PROGRESS)
def progress_from_toggles(spark, sf):
    return tracks.progress_from_toggles(D.toggles(spark, sf))


@query(with_ctes(D.TOGGLES) + PROGRESS)
def progress_stream_from_toggles(spark, sf):
    """The event log replayed as a stream of files, folded batch by batch. Every third toggle is delivered twice,
    half of the log before a restart and all of it, the first half again, after it."""
    log, target, states = (scratch_path(spark, name) for name in ("toggle-log", "progress", "progress-state"))
    toggles = cut_lineage(D.toggles(spark, sf).withColumn("toggle_id", F.monotonically_increasing_id()), "toggles")
    twice = toggles.union(toggles.filter("toggle_id % 3 = 0"))
    for part in (twice.filter("toggle_id % 2 = 0"), twice):
        part.repartition(2).write.mode("append").parquet(log)
        stream = spark.readStream.schema(toggles.schema).option("maxFilesPerTrigger", 2).parquet(log)
        progress_stream(stream, target, states).awaitTermination()
    return latest_progress(spark, target)
