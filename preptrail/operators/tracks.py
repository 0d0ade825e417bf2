"""Interview tracks: dashboard, roadmap detail, insertion, deletion and progress."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.functions import progress


def progress_from_toggles(toggles: DataFrame) -> DataFrame:
    """State per (user, item): completed after an odd number of toggles, starting from open.

    ``toggles`` may be a batch or a stream; counts combine on the map side.
    """
    return (
        toggles.groupBy("user_id", "item_id")
        .agg(F.count("*").alias("n_toggles"))
        .withColumn("is_completed", F.col("n_toggles") % 2 == 1)
    )


def toggle(roadmaps: DataFrame, interviews: DataFrame, toggles: DataFrame) -> DataFrame:
    """Roadmap rows after a log of (user_id, roadmap_id) toggles; only the owner's toggles count."""
    counted = toggles.groupBy("user_id", "roadmap_id").agg(F.count("*").alias("_n"))
    owned = counted.join(roadmaps.select(F.col("id").alias("roadmap_id"), "interview_id"), "roadmap_id").join(
        interviews.select(F.col("id").alias("interview_id"), "user_id"), ["interview_id", "user_id"], "left_semi"
    )
    flips = owned.groupBy(F.col("roadmap_id").alias("id")).agg((F.sum("_n") % 2 == 1).alias("_flip"))
    flipped = F.col("is_completed") != F.coalesce("_flip", F.lit(False))
    return roadmaps.join(flips, "id", "left").withColumn("is_completed", flipped).drop("_flip").select(*roadmaps.columns)


def completion(roadmaps: DataFrame) -> DataFrame:
    return roadmaps.groupBy("interview_id").agg(
        F.count("*").alias("total"), F.count_if("is_completed").alias("done")
    )


def dashboard(interviews: DataFrame, roadmaps: DataFrame, companies: DataFrame, today: Column) -> DataFrame:
    """Tracks of all users: open ones first, then by days left, with status and progress."""
    counted = interviews.join(
        completion(roadmaps).withColumnRenamed("interview_id", "id"), "id", "left"
    ).fillna(0, ["total", "done"])
    named = counted.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id", "left")
    total, done = F.col("total"), F.col("done")
    return (
        named.withColumn("is_finished", progress.is_finished(done, total))
        .withColumn(
            "days_remaining", progress.days_remaining(F.col("interview_date"), today, F.col("days_until"))
        )
        .select(
            "user_id",
            F.col("id").alias("interview_id"),
            "company",
            "days_remaining",
            "is_finished",
            progress.status(F.col("is_finished"), F.col("days_remaining")).alias("status"),
            "done",
            progress.shown_total(total).alias("shown_total"),
            progress.percent(done, total).alias("percent"),
        )
        .orderBy("user_id", "is_finished", "days_remaining", "interview_id")
    )


def roadmap_detail(interviews: DataFrame, roadmaps: DataFrame, problems: DataFrame, companies: DataFrame) -> DataFrame:
    """Roadmap rows with problem and company, and the completion percent cut to a whole number.

    Rows whose owner, problem or interview does not exist drop out.
    """
    share = completion(roadmaps).select(
        "interview_id", progress.percent(F.col("done"), F.col("total")).cast("int").alias("percent")
    )
    owned = interviews.select(F.col("id").alias("interview_id"), "user_id", "company_id")
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    shown = problems.select(
        F.col("id").alias("problem_id"), "title", "difficulty", F.coalesce("topics", F.lit(progress.NO_TOPICS)).alias("topics")
    )
    return (
        roadmaps.join(owned, "interview_id")
        .join(named, "company_id", "left")
        .join(shown, "problem_id")
        .join(share, "interview_id")
        .select("user_id", "interview_id", "company", F.col("id").alias("roadmap_id"), "problem_id", "title", "difficulty", "topics", "is_completed", "percent")
    )


def new_tracks(requests: DataFrame, interviews: DataFrame, today: Column) -> DataFrame:
    """Requested tracks whose (user, company) pair has none yet, with their date.

    Of several requests for one pair the earliest ``request_id`` wins.
    """
    pair = ["user_id", "company_id"]
    first = requests.groupBy(*pair).agg(
        F.min_by(F.struct("request_id", "days_until"), "request_id").alias("r")
    )
    fresh = first.join(interviews.select(*pair), pair, "left_anti")
    return fresh.select(*pair, "r.request_id", "r.days_until").withColumn(
        "interview_date", progress.interview_date(today, F.col("days_until"))
    )


def delete_tracks(interviews: DataFrame, roadmaps: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interviews and roadmaps left after owners deleted tracks (user_id, interview_id)."""
    gone = interviews.select(F.col("id").alias("interview_id"), "user_id").join(
        deletions, ["interview_id", "user_id"], "left_semi"
    )
    kept = interviews.join(gone.select(F.col("interview_id").alias("id")), "id", "left_anti")
    return kept, roadmaps.join(gone.select("interview_id"), "interview_id", "left_anti")


def append_roadmaps(roadmaps: DataFrame, recommended: DataFrame) -> DataFrame:
    """New open roadmap rows for recommended problems, with a key made of interview and position."""
    rows = recommended.select(
        F.xxhash64("interview_id", "position").alias("id"), "interview_id", "problem_id", F.lit(False).alias("is_completed")
    )
    return roadmaps.unionByName(rows)
