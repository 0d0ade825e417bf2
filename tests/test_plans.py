import numpy as np
import pytest
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.operators import clustering, encode
from preptrail.plans import predictor, reports, roadmaps


@pytest.fixture(scope="module")
def distributions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(24):
        for h, share in zip(S.HORIZONS, (0.2, 0.5, 0.8, 1.0)):
            if i % 6 == 5 and h != 360:
                continue
            n = int((20 + 10 * (i % 3)) * share)
            rows.append((f"c{i:02}", h, n // 2, n // 4, n - n // 2 - n // 4 + int(rng.integers(0, 2))))
    return spark.createDataFrame(rows, S.DISTRIBUTIONS)


@pytest.fixture(scope="module")
def meta(spark):
    kinds = [("bank", "1-10", "5", "1900"), ("web", "10001+", "50000", "2010"), ("chips", "201-500", "300", "1980")]
    return spark.createDataFrame([(f"c{i:02}", *kinds[i % 3], "x") for i in range(22)], S.COMPANY_META)


@pytest.fixture(scope="module")
def fitted(distributions, meta):
    return predictor.fit(distributions, meta, restarts=2)


def test_fit_with_metadata(fitted):
    assert fitted.selection.best_k == 3
    labels = {r.company: r.cluster for r in fitted.labels.collect()}
    assert len(labels) == 24
    assert all(labels[f"c{i:02}"] == labels[f"c{i % 3:02}"] for i in range(22))
    assert {r.company for r in fitted.members.filter("vector IS NULL").collect()} == {"c22", "c23"}


def test_fit_without_metadata(distributions):
    fitted = predictor.fit(distributions, restarts=1)
    assert fitted.scaler.columns == S.VOLUME_COLUMNS
    assert fitted.labels.count() == 24


def test_reports_hold_for_the_fit(spark, fitted):
    assert clustering.cluster_balance(fitted.labels, 3).first().passed
    predicted = fitted.predict(reports.horizon_requests(fitted.labels, S.HORIZONS))
    assert reports.monotone_totals(predicted).filter("NOT passed").isEmpty()
    assert reports.valid_predictions(predicted).filter("NOT positive").isEmpty()
    unknown = spark.createDataFrame([("TotallyFake", 90)], "company string, days_until int")
    assert reports.valid_predictions(fitted.predict(unknown)).first().passed


def test_unknown_company_is_resolved_through_the_registry(spark, fitted):
    registry = spark.createDataFrame(
        [(0, "Newbank Inc", "bank", "1-10", "5", "1900", "x"), (1, "Other", "web", "10001+", "1", "2000", "x")],
        "row_no long, name string, industry string, size_range string, employee_count string, year_founded string, locality string",
    )
    asked = spark.createDataFrame([("newbank", 90), ("c00", 90), ("nobody", 90)], "company string, days_until int")
    known = predictor.resolve_unknown(fitted, asked, registry)
    labels = {r.company: r.cluster for r in known.labels.collect()}
    assert labels["newbank"] in {0, 1, 2} and "nobody" not in labels
    got = {r.company: r.total for r in known.predict(asked).collect()}
    assert got["nobody"] == 10 and got["newbank"] >= 1
    assert known.members.filter("company = 'newbank' AND vector IS NOT NULL").count() == 1


def test_roadmaps_end_to_end(spark, fitted):
    levels = ["EASY", "MEDIUM", "HARD"]
    problems = spark.createDataFrame(
        [(i, f"c{i % 24:02}", levels[i % 3], f"title {i}", "t", f"u{i % 90}", float(i % 17), "d") for i in range(240)],
        "id long, company string, difficulty string, title string, topics string, url string, frequency double, description string",
    )
    encoder = encode.TextEncoder(encode.HashingEncoder(16))
    index = encode.problem_index(problems, encoder)
    asked = spark.createDataFrame([(1, "c00", 90), (2, "c05", 360), (3, "new", 30)], "interview_id long, company string, days_until int")
    roads = roadmaps.interview_roadmaps(asked, fitted, index, problems, encoder)
    counts = fitted.predict(asked)
    assert reports.duplicate_links(roads, problems).filter("NOT passed").isEmpty()
    report = reports.roadmap_counts(counts, roads, problems).collect()
    assert all(r.got_total >= min(r.total, 60) for r in report if r.interview_id != 3)
    positions = roads.groupBy("interview_id").agg(F.max("position").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n for r in positions)


def test_report_arithmetic(spark):
    retrieved = spark.createDataFrame(
        [("q", "A", "EASY", 1, 1, "A", 5.0), ("q", "A", "EASY", 2, 2, "B", 3.0), ("q", "A", "EASY", 3, 3, "C", 4.0)],
        "query_id string, company string, difficulty string, position int, id int, found_company string, frequency double",
    )
    labels = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "company string, cluster int")
    hits = reports.source_shares(retrieved, labels).first()
    assert (hits.target_hits, hits.peer_hits, hits.global_hits, round(hits.cluster_percent, 2), hits.passed) == (1, 1, 1, 66.67, True)
    order = reports.frequency_order(retrieved).first()
    assert (order.total, order.n_sorted, order.passed) == (1, 0, False)
    found = spark.createDataFrame([(1, "easy"), (2, "HARD"), (3, "EASY")], "id int, difficulty string")
    accuracy = reports.difficulty_accuracy(retrieved, found).first()
    assert (accuracy.total, accuracy.correct, accuracy.passed) == (3, 2, False)
    predicted = spark.createDataFrame([("A", 30, 2, 0, 2, 3), ("A", 90, 1, 1, 0, 2)], "company string, days_until int, easy long, medium long, hard long, total long")
    assert [r.passed for r in reports.valid_predictions(predicted).orderBy("days_until").collect()] == [False, True]
    assert reports.monotone_totals(predicted).first().asDict() == {"company": "A", "totals": "3,2", "passed": False}


def _routes(spark):
    problems = spark.createDataFrame([(1, "a", "u1", "EASY"), (2, "a", "U1", "HARD"), (2, "a", "u2", "hard"), (3, "b", "", "EASY"), (4, "b", None, "MEDIUM")], "id int, company string, url string, difficulty string")
    roads = spark.createDataFrame([(7, 1, 1, False), (7, 2, 2, False), (7, 3, 3, True), (8, 1, 4, False), (8, 2, 1, True)], "interview_id int, position int, problem_id int, filled boolean")
    return problems, roads


def _carrying(roads, problems, column):
    known = roads.join(problems.dropDuplicates(["id"]).select(F.col("id").alias("problem_id"), column), "problem_id")
    return known.groupBy("interview_id").agg(F.collect_list(F.struct("problem_id", "filled", column)).alias("route"))


def test_links_of_routes_are_counted_without_a_join(spark):
    problems, roads = _routes(spark)
    for some in (problems, problems.filter("url is null or url <> 'u2'")):
        rows = sorted(map(tuple, reports.duplicate_links(roads, some).collect()))
        assert sorted(map(tuple, reports.duplicate_links(_carrying(roads, some, "url"), some).collect())) == rows
    assert rows == [(7, 3, 2, 1, False), (8, 2, 1, 1, True)]


def test_levels_of_routes_are_counted_without_a_join(spark):
    problems, roads = _routes(spark)
    counts = spark.createDataFrame([(7, 4, 1, 1, 1), (8, 2, 1, 1, 0), (9, 1, 1, 0, 0)], "interview_id int, total long, easy long, medium long, hard long")
    rows = sorted(map(tuple, reports.roadmap_counts(counts, roads, problems).collect()))
    assert sorted(map(tuple, reports.roadmap_counts(counts, _carrying(roads, problems, "difficulty"), problems).collect())) == rows
    assert rows[0] == (7, 4, 1, 1, 1, 4, 2, 0, 2, True)
