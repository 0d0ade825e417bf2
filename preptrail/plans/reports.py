"""Evaluation reports, each a DataFrame of metric rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.functions import code
from preptrail.operators import curation
from preptrail.session import cut_lineage

# --- Fixed values -----------------------------------------------------------
HIT_RATE_BAR = 50.0
MEAN_SCORE_BAR = 0.6
ROADMAP_DAYS = [30, 90, 180]
# ---------------------------------------------------------------------------


def percent(part, whole):
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def horizon_requests(companies: DataFrame, days: list[int]) -> DataFrame:
    return companies.select("company", F.explode(F.array(*[F.lit(d) for d in days])).alias("days_until"))


def monotone_totals(predicted: DataFrame) -> DataFrame:
    """Per company: predicted totals over the horizons and whether they never fall."""
    earlier = F.lag("total").over(W.partitionBy("company").orderBy("days_until"))
    steps = predicted.withColumn("_rises", F.coalesce(F.col("total") >= earlier, F.lit(True)))
    totals = F.transform(F.array_sort(F.collect_list(F.struct("days_until", "total"))), lambda t: t["total"].cast("string"))
    return steps.groupBy("company").agg(
        F.array_join(totals, ",").alias("totals"), F.bool_and("_rises").alias("passed")
    )


def valid_predictions(predicted: DataFrame) -> DataFrame:
    """Per prediction: counts are not negative, the total is positive and the parts add up to it."""
    parts = F.col("easy") + F.col("medium") + F.col("hard")
    positive = (F.least("easy", "medium", "hard") >= 0) & (F.col("total") > 0)
    return predicted.select(
        "company", "days_until", "easy", "medium", "hard", "total",
        positive.alias("positive"), (positive & (parts == F.col("total"))).alias("passed"),
    )


def peers_share_cluster(peers: DataFrame, labels: DataFrame) -> DataFrame:
    """Per company: peers listed and peers whose cluster differs."""
    own = labels.select("company", "cluster")
    theirs = labels.select(F.col("company").alias("peer"), F.col("cluster").alias("peer_cluster"))
    joined = peers.join(own, "company").join(theirs, "peer", "left")
    differs = ~F.col("cluster").eqNullSafe(F.col("peer_cluster"))
    return joined.groupBy("company", "cluster").agg(
        F.count("*").alias("n_peers"), F.count_if(differs).alias("n_mismatched"), (F.count_if(differs) == 0).alias("passed")
    )


def source_shares(retrieved: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows from the requested company, its peers and elsewhere, and the cluster hit rate."""
    own = labels.select("company", "cluster")
    theirs = labels.select(F.col("company").alias("found_company"), F.col("cluster").alias("found_cluster"))
    joined = retrieved.join(own, "company", "left").join(theirs, "found_company", "left")
    target = F.col("company") == F.col("found_company")
    peer = F.coalesce(~target & (F.col("cluster") == F.col("found_cluster")), F.lit(False))
    shares = joined.agg(
        F.count("*").alias("total"),
        F.count_if(target).alias("target_hits"),
        F.count_if(peer).alias("peer_hits"),
        F.count_if(~target & ~peer).alias("global_hits"),
    )
    rate = percent(F.col("target_hits") + F.col("peer_hits"), F.col("total"))
    return shares.withColumn("cluster_percent", rate).withColumn("passed", F.col("cluster_percent") > HIT_RATE_BAR)


def difficulty_accuracy(retrieved: DataFrame, problems: DataFrame) -> DataFrame:
    found = problems.select("id", F.upper("difficulty").alias("found_difficulty"))
    joined = retrieved.join(found, "id")
    right = F.count_if(F.col("difficulty") == F.col("found_difficulty"))
    out = joined.agg(F.count("*").alias("total"), right.alias("correct"))
    return out.withColumn("accuracy", percent(F.col("correct"), F.col("total"))).withColumn("passed", F.col("accuracy") == 100)


def frequency_order(retrieved: DataFrame) -> DataFrame:
    """Share of requests whose rows come in descending frequency."""
    before = F.lag("frequency").over(W.partitionBy("query_id").orderBy("position"))
    falling = retrieved.withColumn("_ok", F.coalesce(F.col("frequency") <= before, F.lit(True)))
    per_query = falling.groupBy("query_id").agg(F.bool_and("_ok").alias("sorted"))
    out = per_query.agg(F.count("*").alias("total"), F.count_if("sorted").alias("n_sorted"))
    return out.withColumn("sorted_percent", percent(F.col("n_sorted"), F.col("total"))).withColumn(
        "passed", F.col("sorted_percent") == 100
    )


def _links() -> Column:
    return F.filter(F.transform("values", lambda v: F.lower(v)), lambda v: v != "")


def _with_copies(routes: DataFrame, problems: DataFrame, column: str) -> DataFrame:
    """Routes that carry ``column`` of these problems, as ``values``: that of every row of ``problems`` with a stop's id.

    Ids that repeat are few or none; only their rows meet the stops. Hashes find them.
    """
    stops = F.transform("route", lambda s: s[column])
    hashed = problems.select(F.xxhash64("id").alias("_hash"))
    again = cut_lineage(hashed.groupBy("_hash").count().filter("count > 1").select("_hash"), "again")
    if again.isEmpty():
        return routes.select("interview_id", stops.alias("values"))
    rows = problems.withColumn("_hash", F.xxhash64("id")).join(again, "_hash", "left_semi").filter("id is not null")
    copies = rows.groupBy(F.col("id").alias("problem_id")).agg(F.collect_list(F.struct(column)).alias("_copies"))
    met = routes.select("interview_id", F.posexplode("route").alias("_pos", "_stop")).join(
        copies, F.col("_stop.problem_id") == F.col("problem_id"), "left"
    )
    value = F.coalesce("_copies", F.array(F.struct(F.col(f"_stop.{column}").alias(column))))
    values = met.groupBy("interview_id").agg(F.flatten(F.collect_list(value)).alias("_values"))
    return values.select("interview_id", F.transform("_values", lambda v: v[column]).alias("values"))


def duplicate_links(roadmaps: DataFrame, problems: DataFrame) -> DataFrame:
    """Per interview: problems, links, distinct links regardless of case.

    Roadmaps are rows, or routes that carry the ``url`` of these problems, whose stops meet no other table.
    """
    if "route" in roadmaps.columns:
        known = _with_copies(roadmaps, problems, "url").select("interview_id", F.size("values").cast("bigint").alias("n_problems"), _links().alias("links"))
        counted = known.select(
            "interview_id", "n_problems", F.size("links").cast("bigint").alias("n_links"), F.size(F.array_distinct("links")).cast("bigint").alias("n_distinct")
        )
        return counted.withColumn("passed", F.col("n_links") == F.col("n_distinct"))
    links = problems.select(F.col("id").alias("problem_id"), F.nullif("url", F.lit("")).alias("url"))
    counted = roadmaps.join(links, "problem_id").groupBy("interview_id").agg(
        F.count("*").alias("n_problems"), F.count("url").alias("n_links"), F.count_distinct(F.lower("url")).alias("n_distinct")
    )
    return counted.withColumn("passed", F.col("n_links") == F.col("n_distinct"))


def _delivered(roadmaps: DataFrame, problems: DataFrame) -> DataFrame:
    if "route" in roadmaps.columns:
        known = _with_copies(roadmaps, problems, "difficulty").withColumn("values", F.transform("values", lambda v: F.upper(v)))

        def number(level: str) -> Column:
            return F.size(F.filter("values", lambda v: v == level)).cast("bigint").alias(f"got_{level.lower()}")

        sizes = [number(d) for d in S.DIFFICULTIES]
        return known.select("interview_id", F.size("values").cast("bigint").alias("got_total"), *sizes)
    levels = problems.select(F.col("id").alias("problem_id"), F.upper("difficulty").alias("level"))
    return roadmaps.join(levels, "problem_id").groupBy("interview_id").agg(
        F.count("*").alias("got_total"),
        *[F.count_if(F.col("level") == d).alias(f"got_{d.lower()}") for d in S.DIFFICULTIES],
    )


def roadmap_counts(counts: DataFrame, roadmaps: DataFrame, problems: DataFrame) -> DataFrame:
    """Per interview: predicted and delivered number of problems, in total and per difficulty.

    Roadmaps are rows, or routes that carry the ``difficulty`` of these problems.
    """
    got = _delivered(roadmaps, problems)
    names = ["got_total", *[f"got_{d.lower()}" for d in S.DIFFICULTIES]]
    wanted = counts.select("interview_id", "total", "easy", "medium", "hard")
    joined = wanted.join(got, "interview_id", "left").fillna(0, names)
    return joined.withColumn("passed", F.col("total") == F.col("got_total"))


def extraction_report(answers: DataFrame) -> DataFrame:
    """Cases whose extracted code starts with the expected text (or is empty where none is expected)."""
    extracted = code.extract_code(F.col("answer"))
    ok = F.when(F.col("expected") == "", extracted == "").otherwise(F.startswith(extracted, F.col("expected")))
    return answers.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))


def leak_report(replies: DataFrame) -> DataFrame:
    """Leaked replies and mean score; ``replies`` is (reply, solution, score)."""
    leaked = curation.leaks_solution(F.col("reply"), F.col("solution"))
    out = replies.select("score", leaked.alias("leaked")).agg(
        F.count("*").alias("total"), F.count_if("leaked").alias("leaked"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score")
    )
    return out.withColumn("leak_percent", percent(F.col("leaked"), F.col("total"))).withColumn(
        "passed", F.col("mean_score") >= MEAN_SCORE_BAR
    )


def cluster_members(labels: DataFrame) -> DataFrame:
    """Companies by cluster and name, as one sorted table."""
    return labels.select("cluster", "company").orderBy("cluster", "company")
