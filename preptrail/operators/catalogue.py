"""Problem catalogue: typed rows, company keys, bodies and the queue of bodies to fetch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.functions import clean
from preptrail.operators.ranking import numbered


def typed_problems(feed: DataFrame) -> DataFrame:
    """Trimmed and typed problem rows; blank or unreadable optional values become null."""
    trimmed = {c: clean.strip_space(F.col(c)) for c in ("company", "title", "difficulty")}
    numbers = {c: clean.number(clean.blank_to_null(F.col(c))) for c in ("acceptance_rate", "frequency")}
    return feed.select(
        *[c for c in feed.columns if c == "id"],
        *[v.alias(k) for k, v in trimmed.items()],
        clean.blank_to_null(F.col("body")).alias("description"),
        clean.strip_space(F.col("link")).alias("url"),
        clean.blank_to_null(F.col("topics")).alias("topics"),
        *[v.alias(k) for k, v in numbers.items()],
        clean.blank_to_null(F.col("preparation_days")).try_cast("int").alias("preparation_days"),
    )


def company_keys(problems: DataFrame, order: Column, existing: DataFrame | None = None) -> DataFrame:
    """Key per trimmed company name in first-seen order; names in ``existing`` keep theirs."""
    names = problems.select(clean.strip_space(F.col("company")).alias("name"), order.alias("_order"))
    first_seen = names.groupBy("name").agg(F.min("_order").alias("_order"))
    if existing is None:
        return numbered(first_seen, [F.col("_order"), F.col("name")], "id", start=1).select("id", "name")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = first_seen.join(existing.select("name"), "name", "left_anti")
    added = numbered(fresh, [F.col("_order"), F.col("name")], "id", start=last + 1)
    return existing.select("id", "name").unionByName(added.select("id", "name"))


def company_names(problems: DataFrame) -> DataFrame:
    return problems.select("company").distinct().orderBy("company")


def with_company_key(problems: DataFrame, companies: DataFrame) -> DataFrame:
    keys = companies.select(F.col("name").alias("company"), F.col("id").alias("company_id"))
    return problems.join(keys, "company", "left")


def companies_with_problems(companies: DataFrame, problems: DataFrame) -> DataFrame:
    return companies.join(problems.select(F.col("company_id").alias("id")).distinct(), "id", "left_semi")


def fetched_bodies(enriched: DataFrame) -> DataFrame:
    """Last non-empty body per slug, by row number of the enriched feed."""
    bodies = enriched.filter(F.col("body") != "").select(clean.slug(F.col("link")).alias("slug"), "row_no", "body")
    return bodies.groupBy("slug").agg(F.max_by("body", "row_no").alias("body"))


def fetch_queue(feed: DataFrame, bodies: DataFrame) -> DataFrame:
    """Distinct slugs without a clean body, sorted."""
    slugs = feed.select(clean.slug(F.col("link")).alias("slug")).distinct()
    clean_bodies = bodies.filter(~clean.needs_refetch(F.col("body"))).select("slug")
    return slugs.join(clean_bodies, "slug", "left_anti").orderBy("slug")


def with_bodies(feed: DataFrame, bodies: DataFrame) -> DataFrame:
    """Feed with the body of its slug, empty where none was fetched."""
    keyed = feed.drop("body").withColumn("slug", clean.slug(F.col("link")))
    return keyed.join(bodies, "slug", "left").withColumn("body", F.coalesce("body", F.lit(""))).drop("slug")


def topics(problems: DataFrame) -> DataFrame:
    """One row per problem and topic."""
    return problems.select("id", F.explode(clean.topic_list(F.col("topics"))).alias("topic"))
