import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.functions import clean
from preptrail.operators import catalogue, cells, clustering, curation, curves, distributions, encode, features, grams, kmeans, peers, ranking, registry, retrieval, roadmap, search, selection, tracks
from preptrail.operators.ranking import first_per_key, numbered, ranked, top_n


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_ranking_helpers(spark):
    data = [("hot", i, i % 7) for i in range(500)] + [("cold", 1, 1)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    top = top_n(df, ["k"], [F.col("v").desc(), F.col("i")], 3)
    assert rows(top, "k", "rank") == [("cold", 1, 1, 1), ("hot", 6, 6, 1), ("hot", 13, 6, 2), ("hot", 20, 6, 3)]
    assert rows(first_per_key(df, ["k"], [F.col("v"), -F.col("i")]), "k") == [("cold", 1, 1), ("hot", 497, 0)]
    assert rows(numbered(df.select("k").distinct(), [F.col("k")], "n", start=5)) == [("cold", 5), ("hot", 6)]


def test_large_groups_are_ranked_by_ranges(spark, monkeypatch):
    data = [("hot", (i * 37) % 1000, i) for i in range(1000)] + [("cold", 5, 5000)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(5)
    order = [F.col("v").desc(), F.col("i")]
    few = rows(top_n(df, ["k"], order, 40)), rows(ranked(df, ["k"], order, "r", 1000))
    monkeypatch.setattr(ranking, "TASK_ROWS", 10)
    many = rows(top_n(df, ["k"], order, 40)), rows(ranked(df, ["k"], order, "r", 1000))
    assert many == few and len(many[0]) == 41 and len(many[1]) == 1001


def test_difficulty_distribution_skips_null_keys(spark):
    data = [
        ("A", 30, "EASY", "x"), ("A", 30, "EASY", None), ("A", 30, "HARD", "y"), ("A", None, "EASY", "x"), (None, 30, "EASY", "x"),
        ("B", 90, None, "x"), ("C", 360, "MEDIUM", "m"),
    ]
    out = distributions.difficulty_distribution(spark.createDataFrame(data, "company string, preparation_days int, difficulty string, title string"))
    assert rows(out) == [("A", 30, 1, 1, 0), ("C", 360, 0, 0, 1)]


def test_shares_and_pivot(spark):
    dist = spark.createDataFrame([("A", 30, 1, 0, 1), ("A", 360, 2, 1, 1), ("Z", 90, 0, 0, 0)], S.DISTRIBUTIONS)
    shares = distributions.normalized_shares(dist)
    got = {(r.company, r.days_until): (r.total, r.proportion, r.easy_pct) for r in shares.collect()}
    assert got == {("A", 30): (2, 0.5, 0.5), ("A", 360): (4, 1.0, 0.5), ("Z", 90): (0, 0.0, 0.0)}
    assert rows(distributions.volume_pivot(shares)) == [("A", 0.5, None, None, 1.0), ("Z", None, 0.0, None, None)]
    dense, sparse, _ = features.split_clusterable(distributions.volume_pivot(shares))
    assert rows(dense) == [("A", 0.5, 0.0, 0.0, 1.0)] and [r.company for r in sparse.collect()] == ["Z"]


def test_company_features(spark):
    meta = spark.createDataFrame(
        [("A", "tech", "11-50", "99", "1990", "x"), ("B", None, None, None, None, None), ("C", "bank", "1-10", "x", "0", None), ("A", "tech", "11-50", "99", "1990", "x")],
        S.COMPANY_META,
    )
    got = {r.company: (r.industry_enc, r.size_rank, r.year_founded) for r in features.company_features(meta).collect()}
    assert got == {"A": (1.0, 1.0, 1990.0), "B": (2.0, 4.0, 2000.0), "C": (0.0, 0.0, 0.0)}
    scaled = features.standardize(features.company_features(meta), S.FEATURE_COLUMNS)
    codes = {r.company: r.industry_enc for r in scaled.collect()}
    assert codes["B"] == pytest.approx(2 * 1 / np.std([0, 1, 2]))


@pytest.mark.parametrize("parts", [2, 4096])
def test_exact_medians_by_counting(spark, monkeypatch, parts):
    monkeypatch.setattr(selection, "PARTS", parts)
    draw, inf, nan = random.Random(4), float("inf"), float("nan")
    columns = {
        "one": [1.0], "two": [3.0, 1.0], "gap": [5.0, 1.0, None, 2.0], "even": list(range(40)), "tied": [2.0] * 31 + [9.0] * 30, "none": [None, nan],
        "wide": [10.0 ** draw.randint(-300, 300) * draw.choice([-1, 1]) for _ in range(61)], "far": [1e308, -1e308, 1.0, 2.0], "tiny": [5e-324, 1e-323, 0.0, 1.5e-323],
        "ends": [inf, -inf, inf, 1.0, 2.0, 3.0], "odd": [inf, -inf, -inf], "random": [draw.gauss(0, 1) for _ in range(80)],
    }
    longest = max(map(len, columns.values()))
    table = [tuple(float(v[i]) if i < len(v) and v[i] is not None else None for v in columns.values()) for i in range(longest)]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in columns)).repartition(3)

    def median(values):
        known = sorted(float(v) for v in values if v is not None and v == v)
        low, high = known[(len(known) - 1) // 2], known[len(known) // 2]
        return low if low == high else low / 2 + high / 2

    wanted = {c: median(v) if any(x is not None and x == x for x in v) else None for c, v in columns.items()}
    got = selection.medians(df, list(columns))
    assert got == wanted
    assert selection.medians(df.limit(0), ["one"]) == {"one": None}


def _silhouette(points, labels):
    out = []
    for i, p in enumerate(points):
        d = np.linalg.norm(points - p, axis=1)
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return out


def test_silhouette_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 3))
    one, two = rng.integers(0, 3, 60), np.r_[0, np.ones(59, dtype=int)]
    df = spark.createDataFrame(
        [(i, p.tolist(), int(a), int(b)) for i, (p, a, b) in enumerate(zip(points, one, two))], "id int, vector array<double>, one int, two int"
    )
    out = clustering.silhouette_samples(df, "id", ["one", "two"], block_rows=17).collect()
    for name, labels in (("one", one), ("two", two)):
        got = {r.id: r.silhouette for r in out if r.labelling == name}
        assert [got[i] for i in range(60)] == pytest.approx(_silhouette(points, labels))


def test_select_k_finds_three_groups(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    data = [(f"c{i}", (centers[i % 3] + rng.normal(scale=0.2, size=2)).tolist()) for i in range(30)]
    chosen = clustering.select_k(spark.createDataFrame(data, "company string, vector array<double>"), "company", restarts=3)
    assert chosen.best_k == 3 and [s[0] for s in chosen.scores] == list(range(2, 9))
    groups = {}
    for r in chosen.labels.collect():
        groups.setdefault(r.cluster, set()).add(int(r.company[1:]) % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]
    balance = clustering.cluster_balance(chosen.labels, 3).first()
    assert balance.passed and balance.min_size == 10
    tiny = clustering.select_k(spark.createDataFrame(data[:5], "company string, vector array<double>"), "company", restarts=1)
    assert [s[0] for s in tiny.scores] == [2, 3, 4]


def plain_lloyd(points, centers, rounds):
    for _ in range(rounds):
        own = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([points[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))])
    return centers, ((points[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_models_advance_together(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, vector array<double>").repartition(5)
    starts = [points[:2], points[5:9], np.vstack((points[:3], [[50.0, 50.0, 50.0]])), np.zeros((2, 3))]
    for start, fit in zip(starts, kmeans.lloyd(df, starts, iterations=9, tolerance=0.0), strict=True):
        centers, inertia = plain_lloyd(points, start, 9)
        assert np.allclose(fit.centers, centers) and fit.inertia == pytest.approx(inertia)  # a far centre without points stays
    assert len(kmeans.lloyd(df, starts[:1], iterations=0)) == 1


def test_drawn_starts_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(10)
    points = np.repeat(rng.normal(size=(6, 2)) * 20, 50, axis=0) + rng.normal(size=(300, 2)) * 0.1
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, vector array<double>").withColumn("hash", F.xxhash64("i"))
    one, two = (kmeans.seeds(df.repartition(n), range(2, 7), 3, 42) for n in (1, 7))
    assert all(np.array_equal(a, b) for k in one for a, b in zip(one[k], two[k], strict=True))
    assert [len(s) for s in one[6]] == [6, 6, 6]
    fits = kmeans.lloyd(df, one[6])
    assert min(f.inertia for f in fits) < 300 * 2 * 0.1**2 * 1.5  # all six groups are found
    same = spark.createDataFrame([(i, [1.0, 2.0], i) for i in range(9)], "i int, vector array<double>, hash long")
    assert all(f.inertia == 0 for f in kmeans.lloyd(same, kmeans.seeds(same, range(2, 4), 2, 42)[3]))


def test_squared_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SILHOUETTE_STEP", 100)
    rng = np.random.default_rng(11)
    points, labels = rng.normal(size=(60, 4)), np.array([0] * 20 + [1] * 39 + [7])
    df = spark.createDataFrame([(i, p.tolist(), int(c), 3) for i, (p, c) in enumerate(zip(points, labels, strict=True))], "i int, vector array<double>, c int, one int")

    def plain(far):
        out = []
        for i, own in enumerate(labels):
            means = {c: far[i, labels == c].sum() / ((labels == c).sum() - (c == own) or 1) for c in (0, 1, 7)}
            a, b = means.pop(own), min(means.values())
            out.append((b - a) / max(a, b) if (labels == own).sum() > 1 else 0.0)
        return out

    squared = ((points[:, None] - points) ** 2).sum(axis=2)
    for samples, far in ((clustering.squared_silhouette_samples, squared), (clustering.silhouette_samples, np.sqrt(squared))):
        got = {r.i: r.silhouette for r in samples(df, "i", ["c", "one"]).filter("labelling = 'c'").collect()}
        assert [got[i] for i in range(60)] == pytest.approx(plain(far))
    assert clustering.mean_squared_silhouette(df, "i", ["one"]) == {"one": 0.0}


def test_pca_keeps_the_main_axis(spark):
    data = [(i, [float(i), 0.1 * (-1) ** i, 0.0]) for i in range(10)]
    out = clustering.pca_projection(spark.createDataFrame(data, "id int, vector array<double>"), "id", [[4.5, 0.0, 0.0]]).collect()
    points = {r.name: r.pc1 for r in out if r.kind == "point"}
    assert [points[str(i)] for i in range(10)] == pytest.approx([i - 4.5 for i in range(10)], abs=0.02)
    assert [r.pc1 for r in out if r.kind == "centroid"] == pytest.approx([0.0], abs=0.02)
    assert out[0].explained1 > 0.99


def _shares(spark, data):
    return distributions.normalized_shares(spark.createDataFrame(data, S.DISTRIBUTIONS))


def test_curves_counts_and_sparse(spark):
    shares = _shares(spark, [
        ("A", 30, 1, 0, 1), ("A", 360, 2, 4, 2), ("B", 90, 3, 0, 0), ("B", 360, 3, 0, 0), ("S", 90, 0, 0, 4), ("T", 360, 1, 1, 1),
    ])
    labels = spark.createDataFrame([("A", 0), ("B", 1)], "company string, cluster int")
    fits = curves.fit_curves(shares, labels)
    got = {r.cluster: (r.n_companies, r.prop_y, r.easy_y) for r in fits.collect()}
    assert got[0] == (1, [0.0, 0.25, 0.0, 0.0, 1.0], [0.0, 0.5, 0.0, 0.0, 0.25])
    assert got[1] == (1, [0.0, 0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 1.0, 0.0, 1.0])
    sparse = spark.createDataFrame([("S",), ("T",), ("none",)], "company string")
    assert rows(curves.assign_sparse(sparse, shares, fits)) == [("S", 1), ("T", 0), ("none", 0)]
    merged = curves.merge_labels(labels, curves.assign_sparse(sparse, shares, fits))
    asked = spark.createDataFrame([("A", 360), ("A", 999), ("A", 0), ("B", 90), ("S", 90), ("new", 30)], "company string, days_until int")
    out = {(r.company, r.days_until): (r.easy, r.medium, r.hard, r.total) for r in curves.predict_counts(asked, merged, fits, distributions.max_totals(shares)).collect()}
    assert out[("A", 360)] == out[("A", 999)] == (2, 2, 4, 8)
    assert out[("A", 0)][3] == 1
    assert out[("B", 90)] == (3, 0, 0, 3) and out[("S", 90)] == (4, 0, 0, 4)
    assert out[("new", 30)] == (3, 5, 2, 10)
    info = rows(curves.cluster_info(asked.select("company").distinct(), merged, fits))
    assert info == [("A", 0, 1), ("B", 1, 1), ("S", 1, 1), ("new", None, 0)]


def test_counts_round_half_to_even_and_floor_medium(spark):
    fits = spark.createDataFrame(
        [(0, 1, [0.0, 1.0, 1.0, 1.0, 1.0], [0.0] * 5, [0.0] + [0.5] * 4, [0.0] * 5, [0.0] * 5, [0.0] * 5, [0.0] + [0.5] * 4, [0.0] * 5)],
        "cluster int, n_companies long, prop_y array<double>, prop_d array<double>, easy_y array<double>, easy_d array<double>,"
        "medium_y array<double>, medium_d array<double>, hard_y array<double>, hard_d array<double>",
    )
    labels = spark.createDataFrame([(c, 0) for c in "abcd"], "company string, cluster int")
    totals = spark.createDataFrame([("a", 3), ("b", 5), ("c", 1)], "company string, max_total long")
    asked = spark.createDataFrame([(c, 90) for c in "abcd"], "company string, days_until int")
    out = {r.company: (r.easy, r.medium, r.hard, r.total) for r in curves.predict_counts(asked, labels, fits, totals).collect()}
    assert out == {"a": (2, 0, 2, 3), "b": (2, 1, 2, 5), "c": (0, 1, 0, 1), "d": (5, 0, 5, 10)}


def test_cold_start(spark):
    meta = spark.createDataFrame([("N", "bank", "1-10", "0", "0", ""), ("M", "zzz", "10001+", None, "2010", None)], S.COMPANY_META)
    fitted = spark.createDataFrame([("A", 2.0), ("B", 4.0)], "company string, industry_enc double")
    out = curves.encode_cold_start(meta, ["d30", *S.FEATURE_COLUMNS], fitted)
    assert {r.company: (r.d30, r.industry_enc, r.size_rank, r.year_founded) for r in out.collect()} == {
        "N": (0.0, 3.0, 0.0, 2000.0), "M": (0.0, 3.0, 7.0, 2010.0)
    }
    known = spark.createDataFrame([(" Bank ", 9.0)], "industry string, industry_enc double")
    by_name = curves.encode_cold_start(meta, ["industry_enc"], fitted, known)
    assert rows(by_name) == [("M", 3.0), ("N", 9.0)]


def _brute(index, queries, spec, k):
    out = []
    for q in queries:
        scored = []
        for c in index:
            if any(c[x] != q[x] for x in spec.on) or (spec.differ and c[spec.differ] == q[spec.differ]):
                continue
            a, b = np.array(q["vector"]), np.array(c["vector"])
            value = a @ b if spec.metric == "dot" else -np.linalg.norm(a - b)
            scored.append((-round(float(value), 9), c["id"], c["link"]))
        seen, kept = set(), []
        for s, i, link in sorted(scored):
            if spec.distinct and link in seen:
                continue
            seen.add(link)
            kept.append((q["query_id"], i, -s))
        out += [(*row, n + 1) for n, row in enumerate(kept[:k])]
    return sorted(out)


@pytest.fixture
def small_search(monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "QUERY_CHUNK", 4)
    monkeypatch.setattr(search, "MATRIX_SCORES", 60)
    monkeypatch.setattr(search, "PAIR_STEP", 7)


@pytest.mark.parametrize("max_broadcast", [1000, 0])
@pytest.mark.parametrize(
    "spec",
    [
        search.SearchSpec(),
        search.SearchSpec(on=("level",)),
        search.SearchSpec(on=("company", "level")),
        search.SearchSpec(on=("level",), differ="company", distinct="link"),
        search.SearchSpec(on=("level",), differ="company", metric="l2"),
        search.SearchSpec(distinct="link", metric="l2"),
    ],
)
def test_search_equals_brute_force(spark, small_search, spec, max_broadcast):
    rng = np.random.default_rng(3)
    make = lambda i: {
        "id": i, "vector": np.round(rng.normal(size=4), 1).tolist(), "company": int(rng.integers(0, 4)),
        "level": "hot" if rng.random() < 0.6 else f"l{rng.integers(0, 5)}", "link": f"u{rng.integers(0, 60)}",
    }
    index = [make(i) for i in range(300)]
    queries = [{**make(i), "query_id": f"q{i:02}"} for i in range(20)]
    schema = "id int, vector array<double>, company int, level string, link string"
    found = search.search(
        spark.createDataFrame(index, schema).repartition(5), spark.createDataFrame(queries, schema + ", query_id string").drop("id", "link"),
        6, spec, max_broadcast=max_broadcast,
    )
    got = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect())
    want = _brute(index, queries, spec, 6)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-8)


@pytest.mark.parametrize("cell_rows", [4, 30])
@pytest.mark.parametrize(
    "spec",
    [
        search.SearchSpec(),
        search.SearchSpec(metric="l2"),
        search.SearchSpec(on=("level",), metric="l2", differ="company"),
        search.SearchSpec(on=("level",), differ="company", distinct="link"),
    ],
)
def test_search_by_cells_equals_brute_force(spark, small_search, monkeypatch, spec, cell_rows):
    monkeypatch.setattr(cells, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(cell_rows)
    centres = rng.normal(size=(8, 3)) * 6

    def make(i):
        return {
            "id": i, "vector": np.round(centres[i % 8] + rng.normal(size=3), 2).tolist(), "company": int(rng.integers(0, 4)),
            "level": [None, "hot", "hot", "hot", "small"][rng.integers(0, 5)], "link": f"u{rng.integers(0, 60)}",
        }

    index = [make(i) for i in range(500)]
    queries = [{**make(i), "query_id": f"q{i:02}", "k": 1 + i % 7} for i in range(25)]
    queries[3]["vector"] = [0.0, 0.0, 0.0]
    schema = "id int, vector array<double>, company int, level string, link string"
    asked = spark.createDataFrame(queries, schema + ", query_id string, k int").drop("id", "link")
    found = search.search(spark.createDataFrame(index, schema).repartition(5), asked, F.col("k"), spec, max_broadcast=0)
    got = sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect())
    stated = [q for q in queries if "level" not in spec.on or q["level"]]
    assert got == sorted((w[0], w[1], w[3]) for q in stated for w in _brute(index, [q], spec, q["k"]))


def test_queries_skip_distant_cells(spark, monkeypatch):
    """Members of a clustered group compare fewer than a fifth of all pairs."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 4)) * 10
    members = spark.createDataFrame(
        [(f"c{i:04}", i % 2, (centres[i % 40] + rng.normal(size=4)).tolist()) for i in range(4000)], "company string, cluster int, vector array<double>"
    ).withColumns({"query_id": F.col("company"), "k": F.lit(10)})
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    on = ["cluster"]
    pivots = cells.choose_pivots(members, "company", "vector", on)
    placed = cells.with_cells(members, "vector", on, pivots, 4).cache()
    known = cells.measured(placed, on, pivots, "l2")
    spec = search.SearchSpec(id_col="company", on=("cluster",), differ="company", metric="l2")
    exact = search.search(members, members.sample(0.05, 3), 10, spec)
    least = exact.filter("rank = 10").select("query_id", "score")
    asked = members.join(least, "query_id")
    first = cells.visits(asked, "vector", on, known, 4)
    rest = cells.visits(asked, "vector", on, known, 4, F.col("score"))
    sizes = placed.groupBy("cluster", "_cell").count()
    visits_ = first.select("query_id", "cluster", "_cell").union(rest.select("query_id", "cluster", "_cell"))
    met = visits_.join(sizes, ["cluster", "_cell"]).agg(F.sum("count")).first()[0]
    every = asked.count() * 2000
    skipped = asked.count() * sum(len(p) for p in pivots.values()) / 2 - visits_.count()
    assert met < every / 5 and skipped > 0
    placed.unpersist()


def test_search_skips_missing_vectors_and_formats_hits(spark):
    index = spark.createDataFrame([(0, [0.1]), (1, [0.5]), (2, None)], "id int, vector array<float>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<float>")
    hits = search.search(index, asked, 5, search.SearchSpec()).orderBy("rank").collect()
    assert [(h.id, round(h.score, 6)) for h in hits] == [(1, 0.5), (0, 0.1)]
    nothing = search.search(index, asked.filter("query_id = ''"), 5, search.SearchSpec())
    assert nothing.count() == 0


def test_peers(spark):
    members = spark.createDataFrame(
        [("a", 0, [0.0]), ("b", 0, [3.0]), ("c", 0, [1.0]), ("d", 1, [0.0]), ("x", 0, None), ("w", 0, None)], "company string, cluster int, vector array<double>"
    )
    near = peers.nearest_peers(members, k=4)
    got = [(r.company, r.peer, r.distance) for r in near.orderBy("company", "rank").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", "c", 1.0), ("a", "b", 3.0), ("a", "w", None), ("a", "x", None)]
    assert [g[1] for g in got if g[0] == "x"] == ["a", "b", "c", "w"]
    assert not [g for g in got if g[0] == "d"]
    assert [r.peer for r in peers.ranked_peers(members, "a").collect()] == ["c", "b", "w", "x"]
    capped = peers.nearest_peers(members, k=1)
    keys = spark.createDataFrame([(7, "c"), (8, "a")], "id long, name string")
    assert rows(peers.peer_ids(capped, keys)) == [("a", 7, 1), ("b", 7, 1), ("c", 8, 1), ("w", 8, 1), ("x", 8, 1)]


REGISTRY = "row_no long, name string, industry string, size_range string, employee_count string, year_founded string, locality string"


def _registry(spark, names):
    return spark.createDataFrame([(i, n, f"ind{i}", "1-10", "5", "1999", "here") for i, n in enumerate(names)], REGISTRY)


def test_registry_match(spark):
    reg = _registry(spark, ["Zeta Foo Inc.", "Foobar LLC", "Foo Labs", "FOO", None, "Software", "my Acme Works", "Acme Group"])
    names = spark.createDataFrame([("Foo",), ("foob",), ("ac",), ("acme w",), ("my",), ("Software",), ("ta foo",), ("nowhere",), ("Acme",)], "company string")
    got = {r.company: (r.row_no, r.tier) for r in registry.match_names(names, reg).collect()}
    assert got == {
        "Foo": (2, 1), "foob": (1, 2), "ac": (None, None), "acme w": (6, 3), "my": (None, None), "Software": (None, None),
        "ta foo": (0, 3), "nowhere": (None, None), "Acme": (7, 1),
    }
    assert registry.company_meta(registry.match_names(names, reg)).count() == 5


def test_registry_match_equals_comparing_every_pair(spark):
    draw = random.Random(5)
    names = ["".join(draw.choice("ab é") for _ in range(draw.randint(0, 14))) for _ in range(400)]
    asked = ["".join(draw.choice("ab é") for _ in range(draw.randint(0, 7))) for _ in range(150)]
    reg = _registry(spark, names)
    norm = dict(spark.createDataFrame([(n,) for n in {*names, *asked}], "n string").select("n", clean.normalize_company(F.col("n"))).collect())

    def best(key):
        def first(ok):
            return next((i for i, n in enumerate(names) if norm[n] and ok(norm[n])), None)

        tiers = [(1, lambda n: n == key, 1), (2, lambda n: n.startswith(key), 3), (3, lambda n: key in n, 4)]
        found = [(first(ok), tier) for tier, ok, least in tiers if len(key) >= least]
        return next((f for f in found if f[0] is not None), (None, None))

    got = {r.company: (r.row_no, r.tier) for r in registry.match_names(spark.createDataFrame([(a,) for a in asked], "company string"), reg).collect()}
    assert got == {a: best(norm[a]) for a in asked}


@pytest.mark.parametrize("gram", [1, 3, 4])
def test_containing_texts(spark, gram):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcé東") for _ in range(draw.randint(0, 30))) for _ in range(300)] + [None, "", "a" * 2000]
    keys = ["".join(draw.choice("abcé東") for _ in range(draw.randint(0, 6))) for _ in range(80)] + [None, "a" * 300, "zz"]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "row_no long, name string")
    asked = spark.createDataFrame([(k,) for k in keys], "company string")
    got = {(r.key, r.row_no) for r in grams.containing(asked, rows_, "company", "name", gram).collect()}
    assert got == {(k, i) for k in keys if k for i, t in enumerate(texts) if t and k in t}


def test_gram_index_grows_with_the_length_of_a_name(spark):
    rows_ = spark.createDataFrame([(0, "x" * 50), (1, "x" * 500), (2, "x" * 5000)], "row_no long, name string")
    asked = spark.createDataFrame([("y" * n,) for n in range(4, 60)], "company string")
    index = grams.with_grams(rows_, "name", grams.gram_lengths(asked, "company"))
    assert rows(index.groupBy("row_no").count(), "row_no") == [(0, 47), (1, 497), (2, 4997)]


def test_registry_lookup(spark):
    reg = _registry(spark, ["Big Acme Holdings", "Acme Works", "xx"] + [f"acme {i:03}" for i in range(60)] + ["ACME ", "Void"])
    asked = spark.createDataFrame([(" Acme",), ("void",), ("",), ("none",), ("acme w",)], "company string")
    got = {r.company: (r.name, r.exact) for r in registry.lookup_names(asked, reg).collect()}
    assert got == {" Acme": ("ACME ", True), "void": ("Void", True), "acme w": ("Acme Works", False)}
    first = {r.company: (r.name, r.exact) for r in registry.lookup_names(asked, reg, first_n=50).collect()}
    assert first[" Acme"] == ("acme 000", False)


def test_catalogue(spark):
    feed = spark.createDataFrame(
        [
            (" B ", "t1", "EASY", "https://x/p/one/", " ", "0", "0.5", "30", "body"),
            ("A", " t2\n", "HARD", "https://x/p/two", "a, b", None, "often", "", " "),
            ("B", "t3", "HARD", "https://x/p/one", None, "1", "", "x", None),
        ],
        S.RAW_FEED,
    ).withColumn("row_no", F.monotonically_increasing_id())
    typed = {r.title: r for r in catalogue.typed_problems(feed).collect()}
    assert (typed["t1"].company, typed["t1"].topics, typed["t1"].acceptance_rate, typed["t1"].preparation_days) == ("B", None, 0.0, 30)
    assert (typed["t2"].description, typed["t2"].frequency, typed["t2"].preparation_days) == (None, None, None)
    keys = catalogue.company_keys(feed, F.col("row_no"))
    assert rows(keys, "id") == [(1, "B"), (2, "A")]
    more = catalogue.company_keys(feed.withColumn("company", F.lit("C")).union(feed), F.lit(1), existing=keys)
    assert rows(more, "id") == [(1, "B"), (2, "A"), (3, "C")]
    bodies = spark.createDataFrame([(0, "https://x/p/one", "old"), (1, "https://x/p/one/", "new"), (2, "https://x/p/two", "10 5"), (3, "https://x/p/one", "")], "row_no int, link string, body string")
    fetched = catalogue.fetched_bodies(bodies)
    assert rows(fetched) == [("one", "new"), ("two", "10 5")]
    assert rows(catalogue.fetch_queue(feed, fetched)) == [("two",)]
    assert sorted(r.body for r in catalogue.with_bodies(feed, fetched).collect()) == ["10 5", "new", "new"]
    topics = spark.createDataFrame([(1, "a, b"), (2, None)], "id int, topics string")
    assert rows(catalogue.topics(topics)) == [(1, "a"), (1, "b")]


def test_mean_pool_by_hand(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], [1, 0])], "t array<array<float>>, m array<int>")
    assert df.select(encode.mean_pool(F.col("t"), F.col("m"))).first()[0] == [1.0, 2.0, 3.0, 4.0]
    long = spark.createDataFrame([("d", [1.0, 2.0], 1), ("d", [3.0, 6.0], 1), ("d", [9.0, 9.0], 0), ("e", [4.0, 4.0], 0)], "k string, v array<float>, m int")
    assert rows(encode.mean_pool_rows(long, ["k"], "v", F.col("m"))) == [("d", [2.0, 4.0]), ("e", [0.0, 0.0])]


def test_encoder_shapes_and_replacement(spark):
    df = spark.createDataFrame([("a b b",), ("",), (None,)], "t string")
    unit = [r[0] for r in df.select(encode.TextEncoder(encode.HashingEncoder(16))(F.col("t"))).collect()]
    assert [len(v) for v in unit] == [16, 16, 16]
    assert np.linalg.norm(unit[0]) == pytest.approx(1.0, abs=1e-6) and sum(unit[1]) == 0
    fixed = encode.TextEncoder(lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    assert df.select(fixed(F.col("t"))).first()[0] == pytest.approx([0.6, 0.8])


def _index(spark, data):
    """(id, company, difficulty, url, frequency, document); the vector holds the id's closeness."""
    schema = "id int, company string, difficulty string, url string, frequency double, document string, vector array<float>"
    return spark.createDataFrame([(*d, [float(100 - d[0]), 0.0]) for d in data], schema)


ONES = encode.TextEncoder(lambda texts: np.array([[1.0, 0.0]] * len(texts)))


def test_waterfall_tiers_and_link_rules(spark):
    index = _index(spark, [
        (1, "A", "EASY", "u1", 1.0, "d1"), (2, "A", "EASY", "U1", 5.0, "d2"), (3, "B", "EASY", "u1", 9.0, ""), (4, "B", "EASY", "u4", None, ""),
        (5, "B", "EASY", "U4", 9.0, ""), (6, "B", "HARD", "u6", 9.0, ""), (7, "C", "EASY", "u4", 9.0, ""), (8, "C", "EASY", "", 2.0, ""), (9, "C", "EASY", "", 3.0, ""),
    ])
    labels = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "company string, cluster int")
    asked = spark.createDataFrame([("q", "A", "EASY", 5), ("one", "A", "EASY", 1)], "query_id string, company string, difficulty string, n int")
    out = retrieval.retrieve(index, asked, ONES, labels=labels)
    got = [(r.id, r.tier) for r in out.filter("query_id = 'q'").orderBy("position").collect()]
    assert got == [(2, 1), (9, 3), (8, 3), (1, 1), (4, 2)]
    assert [(r.id, r.tier) for r in out.filter("query_id = 'one'").collect()] == [(1, 1)]
    named = spark.createDataFrame([("A", "C")], "company string, peer string")
    by_name = retrieval.retrieve(index, asked.filter("query_id = 'q'"), ONES, peers=named)
    assert {(r.id, r.tier) for r in by_name.collect()} == {(1, 1), (2, 1), (7, 2), (8, 2), (9, 2)}
    alone = retrieval.retrieve(index, asked.filter("query_id = 'q'"), ONES)
    assert {(r.id, r.tier) for r in alone.collect()} == {(1, 1), (2, 1), (4, 3), (8, 3), (9, 3)}


def test_expanded_vector_covers_request_and_documents(spark):
    encoder = encode.TextEncoder(encode.HashingEncoder(32))
    index = spark.createDataFrame([(1, "red red blue"), (2, "green")], "id int, document string")
    asked = spark.createDataFrame([("q", "A | EASY"), ("r", "B | EASY")], "query_id string, text string").withColumn("vector", encoder(F.col("text")))
    found = spark.createDataFrame([("q", 2, 1, 1), ("q", 1, 2, 1), ("other", 1, 1, 1)], "query_id string, id int, tier int, rank int")
    got = {r.query_id: r.vector for r in retrieval.expanded_requests(asked, found, index, encoder).collect()}
    whole = spark.createDataFrame([("A | EASY | green | red red blue",), ("B | EASY",)], "t string").select(encoder(F.col("t"))).collect()
    assert got == {"q": whole[0][0], "r": whole[1][0]}


def test_recommend_dedups_links_and_fills_by_frequency(spark):
    index = _index(spark, [
        (1, "A", "EASY", "u1", 1.0, ""), (2, "A", "HARD", "U1", 9.0, ""), (3, "A", "HARD", "u3", 2.0, ""), (4, "B", "MEDIUM", "u4", 8.0, ""),
        (5, "B", "MEDIUM", "u3", 7.0, ""), (6, "B", "MEDIUM", "", None, ""), (7, "C", "EASY", "u7", 99.0, ""), (8, "A", "MEDIUM", "u8", 3.0, ""),
    ])
    labels = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1)], "company string, cluster int")
    counts = spark.createDataFrame(
        [(10, "A", 1, 0, 2, 5), (11, "A", 1, 0, 0, 1), (12, "A", 2, 0, 2, 3), (13, "Solo", 0, 0, 0, 1)],
        "interview_id int, company string, easy long, medium long, hard long, total long",
    )
    out = roadmap.recommend(counts, index, index, labels, ONES)
    got = {}
    for r in out.orderBy("interview_id", "position").collect():
        got.setdefault(r.interview_id, []).append((r.problem_id, r.filled))
    assert got[10] == [(1, False), (3, False), (4, True), (8, True), (6, True)]
    assert got[11] == [(1, False)]
    # The second easy problem comes from outside the cluster; nothing is cut or added at the total.
    assert got[12] == [(7, False), (1, False), (3, False)]
    assert 13 not in got


def test_gate_pairs_and_attempts(spark):
    answers = spark.createDataFrame(
        [
            (1, 1, "p1", "x = 1"), (1, 2, "p1", "def ("), (2, 1, "p2", "x = 11"), (2, 2, "p2", "```python\nx = 1\n```"),
            (3, 1, "p3", "x = 1"), (3, 2, "p3", "y = 2"), (4, 1, "p4", "def ("), (4, 2, "p4", "(("), (5, 1, None, "x = 1"), (5, 2, None, "def ("),
            (6, 1, "p6", "x = 1"),
        ],
        "prompt_id int, candidate int, prompt string, answer string",
    )
    pairs = curation.preference_pairs(answers)
    assert rows(pairs) == [(1, "p1", "x = 1", "def ("), (2, "p2", "```python\nx = 1\n```", "x = 11")]
    attempts = spark.createDataFrame(
        [(1, 1, "a", 0.3), (1, 2, "b", 0.9), (1, 3, "c", 0.95), (2, 1, "a", 0.3), (2, 2, "b", 0.5), (2, 3, "c", 0.5), (3, 1, "a", -1.0), (4, 1, "a", 0.1), (4, 4, "late", 0.9)],
        "problem_id int, attempt int, solution string, score double",
    )
    best = [(r.problem_id, r.solution, r.score, r.reached_target) for r in curation.best_attempt(attempts).orderBy("problem_id").collect()]
    assert best == [(1, "b", 0.9, True), (2, "b", 0.5, False), (3, "", -1.0, False), (4, "late", 0.9, True)]
    assert curation.best_attempt(attempts, at_most=3).filter("problem_id = 4").first()["solution"] == "a"
    many = spark.createDataFrame([(9, 3, "p", "def ("), (9, 4, "p", "x = 1")], "prompt_id int, candidate int, prompt string, answer string")
    assert [(r.chosen, r.rejected) for r in curation.preference_pairs(many).collect()] == [("x = 1", "def (")]
    gate = spark.createDataFrame([(True, 0.7), (True, None), (False, 0.9)], "c boolean, j double")
    assert [r[0] for r in gate.select(curation.gated_score(F.col("c"), F.col("j"))).collect()] == [0.7, 1.0, 0.0]


def test_prompts_and_leaks(spark):
    found = spark.createDataFrame([("q", 2, " second "), ("q", 1, "first\n")], "query_id string, rank int, document string")
    context = curation.few_shot_context(found).first()["context"]
    assert context.endswith("reference:\n--- Reference Solution 1 ---\nfirst\n\n--- Reference Solution 2 ---\nsecond")
    system = spark.createDataFrame([(1, "desc", "code"), (2, None, ""), (3, "", None)], "i int, p string, s string")
    texts = [r[0] for r in system.orderBy("i").select(curation.system_message(F.lit("S"), F.col("p"), F.col("s"))).collect()]
    assert texts == ["S\n--- PROBLEM ---\ndesc\n\n--- GROUND TRUTH SOLUTION (INTERNAL ONLY) ---\ncode\n", "S", "S"]
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id int, turn int, role string, text string")
    systems = spark.createDataFrame([(1, "S"), (2, "T")], "conv_id int, system string")
    assert rows(curation.prompt_messages(turns, systems), "conv_id", "turn") == [
        (1, -1, "system", "S"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, -1, "system", "T")
    ]
    assert rows(curation.last_message(systems, turns)) == [(1, "yo"), (2, "Start of conversation")]
    line = "result = left + right"
    replies = spark.createDataFrame([(f"try {line} ok", f"x\n  {line}  "), ("short", "short\n"), ("", "")], "r string, s string")
    assert [r[0] for r in replies.select(curation.leaks_solution(F.col("r"), F.col("s"))).collect()] == [True, False, False]
    log = spark.createDataFrame([(0.2, "bad", "r", "s"), (0.4, "ok", "r", "s"), (0.1, "bad", "", "s"), (0.1, "bad", "r", "")], "score double, reason string, reply string, solution string")
    assert [r.failure for r in curation.failure_log(log).collect()] == ["Score: 0.2\nReason: bad\nAssistant Response: r\n"]
    empty = spark.createDataFrame([], "score double")
    assert curation.mean_score(empty).first().mean_score == 0.0


def test_tracks(spark):
    interviews = spark.createDataFrame([(1, 9, None, 5, 2), (2, 9, None, 6, 2)], S.INTERVIEWS)
    roadmaps = spark.createDataFrame([(10, 1, 100, False), (11, 1, 101, True), (12, 2, 100, False)], S.ROADMAPS)
    log = spark.createDataFrame([(5, 10), (5, 11), (5, 11), (6, 10), (6, 12), (6, 12), (6, 12)], "user_id long, roadmap_id long")
    assert rows(tracks.toggle(roadmaps, interviews, log), "id") == [(10, 1, 100, True), (11, 1, 101, True), (12, 2, 100, True)]
    wishes = spark.createDataFrame([(1, 5, 2, 30), (2, 5, 3, 30), (3, 5, 3, 60)], "request_id long, user_id long, company_id long, days_until int")
    new = tracks.new_tracks(wishes, interviews, F.lit("2024-01-01").cast("date")).collect()
    assert [(r.company_id, r.request_id, str(r.interview_date)) for r in new] == [(3, 2, "2024-01-31")]
    kept, left = tracks.delete_tracks(interviews, roadmaps, spark.createDataFrame([(5, 1), (5, 2)], "user_id long, interview_id long"))
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in left.collect()] == [12]
    grown = tracks.append_roadmaps(roadmaps, spark.createDataFrame([(2, 1, 500)], "interview_id long, position int, problem_id long"))
    assert grown.count() == 4 and grown.filter("problem_id = 500 AND NOT is_completed").count() == 1


def test_toggle_fold_matches_parity(spark):
    log = [(u, i) for u, i in itertools.product(range(3), range(4)) for _ in range(u + i)]
    out = tracks.progress_from_toggles(spark.createDataFrame(log, "user_id int, item_id int"))
    assert {(r.user_id, r.item_id): r.is_completed for r in out.collect()} == {(u, i): (u + i) % 2 == 1 for u, i in set(log)}


def test_silhouette_of_many_axes_far_from_the_origin_with_copies_and_missing_labels(spark):
    rng = np.random.default_rng(8)
    points = 1000 + rng.normal(size=(70, 24))
    points[40:] = points[39]
    labels = [None if i % 23 == 5 else i % 3 for i in range(70)]
    df = spark.createDataFrame([(i, p.tolist(), c, 4 if i >= 40 else None) for i, (p, c) in enumerate(zip(points, labels))], "i int, vector array<double>, c int, one int")
    out = clustering.silhouette_samples(df, "i", ["c", "one"], block_rows=16).collect()
    far = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    have = np.array([-1 if c is None else c for c in labels])
    got = {r.i: (r.cluster, r.silhouette) for r in out if r.labelling == "c"}
    for i, own in enumerate(labels):
        expected = 0.0
        if own is not None:
            a = far[i, have == own].sum() / ((have == own).sum() - 1)
            b = min(far[i, have == c].mean() for c in range(3) if c != own)
            expected = (b - a) / max(a, b)
        assert got[i][0] == own and got[i][1] == pytest.approx(expected, abs=1e-9)
    assert {(r.cluster, r.silhouette) for r in out if r.labelling == "one"} == {(None, 0.0), (4, 0.0)}


def test_two_blocks_of_points_meet_once(spark):
    sums = clustering._distance_sums
    points = np.random.default_rng(3).normal(size=(50, 12))
    halves = [(points[:20], [np.eye(2)[np.arange(20) % 2]]), (points[20:], [np.eye(2)[np.arange(30) % 2]])]
    rows, columns = sums(*halves, False)
    far = np.sqrt(((points[:20, None] - points[20:]) ** 2).sum(axis=2))
    assert rows[0] == pytest.approx(far @ halves[1][1][0]) and columns[0] == pytest.approx(far.T @ halves[0][1][0])
    itself = sums(halves[0], halves[0], True)[1][0]
    assert not itself.any()


def test_all_peers_are_listed_without_a_search(spark, monkeypatch):
    rng = np.random.default_rng(21)
    points = rng.integers(0, 4, size=(90, 3)).astype(float)  # many ties
    members = spark.createDataFrame([(f"c{i:02}", i % 3, p.tolist()) for i, p in enumerate(points)], "company string, cluster int, vector array<double>")
    targets = members.filter(F.col("company") < "c40")
    monkeypatch.setattr(peers, "LIST_ROWS", 0)
    searched = sorted(map(tuple, peers.nearest_peers(members, targets).collect()))
    monkeypatch.setattr(peers, "LIST_ROWS", 30)
    monkeypatch.setattr(peers, "search", None)
    listed = sorted(map(tuple, peers.nearest_peers(members, targets).collect()))
    assert len(listed) == 40 * 29 and listed == searched


def test_a_broadcast_search_deals_queries_to_lots(spark, monkeypatch):
    rng = np.random.default_rng(22)
    rows = spark.createDataFrame([(i, i % 4, rng.normal(size=3).tolist()) for i in range(80)], "id int, g int, vector array<double>")
    asked = rows.filter("id < 20").withColumn("query_id", F.col("id"))
    spec = search.SearchSpec(on=("g",))
    whole = sorted(map(tuple, search.search(rows, asked, 5, spec).collect()))
    monkeypatch.setattr(search, "MAX_RESULTS", 30)
    frame = asked.select("query_id", F.lit(5).alias("k"), "vector", "g").toPandas()
    assert [len(lot) for lot in search._lots(frame, spec)] == [6, 6, 6, 2]
    assert sorted(map(tuple, search.search(rows, asked, 5, spec).collect())) == whole


def test_a_query_visits_a_block_of_cells_once(spark, monkeypatch):
    rng = np.random.default_rng(23)
    monkeypatch.setattr(cells, "CELL_ROWS", 8)
    rows = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(600)], "id int, vector array<double>").withColumn("k", F.lit(3))
    pivots = cells.choose_pivots(rows, "id", "vector", [])
    known = cells.measured(cells.with_cells(rows, "vector", [], pivots, 12), [], pivots, "dot", 200)
    met = cells.block_visits(rows, "vector", [], known, 12, F.lit(-100.0))
    assert met.count() == met.select("id", "_block").distinct().count() <= 4 * 600
    assert met.agg(F.sum(F.size("_cells"))).first()[0] > 20 * met.count() / 2


def test_an_encoder_gets_few_texts_at_a_time_and_none_for_a_missing_one(spark):
    def lengths(texts):
        return np.array([[len(t or ""), len(texts), t is None] for t in texts], dtype=float)

    df = spark.range(10, numPartitions=1).select("id", F.when(F.col("id") != 3, F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("t"))
    rows = df.select("id", encode.TextEncoder(lengths, batch=4).sums(F.col("t")).alias("v")).collect()
    assert {r.id: r.v for r in rows} == {i: [0.0 if i == 3 else i, 2.0 if i > 7 else 4.0, float(i == 3)] for i in range(10)}
    assert df.filter("id < 0").select(encode.TextEncoder(lengths)(F.col("t"))).collect() == []


def _interviews(spark):
    rng = np.random.default_rng(31)
    problems = [(i, f"c{rng.integers(0, 6)}", S.DIFFICULTIES[i % 3], f"u{rng.integers(0, 70)}" if i % 9 else "", float(rng.integers(0, 5)), "") for i in range(150)]
    counts = [(i, f"c{i % 7}", *map(int, n), int(n.sum()) + i % 4) for i, n in enumerate(rng.integers(0, 12, size=(30, 3)))]
    labels = spark.createDataFrame([(f"c{i}", i % 2) for i in range(5)], "company string, cluster int")
    return _index(spark, problems), spark.createDataFrame(counts, "interview_id int, company string, easy long, medium long, hard long, total long"), labels


def test_interviews_meet_their_lists_where_these_lie(spark, monkeypatch):
    index, counts, labels = _interviews(spark)
    made = {}

    def kept(name, plain):
        return lambda *args, **options: made.setdefault(name, plain(*args, **options))

    for name in ("retrieve", "_fill_lists"):
        monkeypatch.setattr(roadmap, name, kept(name, getattr(roadmap, name)))
    monkeypatch.setattr(roadmap, "LOT_ROWS", 40)
    monkeypatch.setattr(roadmap, "SLICE_INTERVIEWS", 2)
    out = sorted(map(tuple, roadmap.recommend(counts, index, index, labels, ONES).collect()))
    found, lists = made["retrieve"], made["_fill_lists"]
    found = found.withColumn("dedup", clean.dedup_key(F.col("url"), F.col("id")))
    assert out == sorted(map(tuple, roadmap._merged(counts, found, lists, labels, ()).collect()))
    assert len(out) > 400 and any(r[3] for r in out)


def test_fill_lists_look_below_the_highest_frequencies_where_links_repeat(spark, monkeypatch):
    rows = [(i, "A", "EASY", f"u{i % 4 if i < 60 else i}", float(100 - i), "") for i in range(80)] + [(99, "B", "EASY", "u9", None, "")]
    monkeypatch.setattr(roadmap, "LIST_ROOM", 1)
    labels = spark.createDataFrame([("A", 0)], "company string, cluster int")
    lists = roadmap._fill_lists(_index(spark, rows), labels, 6).orderBy("group", "fill_rank").collect()
    assert [(r.group, r.id) for r in lists] == [*(("c:0", i) for i in (0, 1, 2, 3, 60, 61)), ("o:B", 99)]


def test_keys_that_leave_rows_few_queries_are_scored_in_place(spark, monkeypatch):
    rng = np.random.default_rng(32)
    rows = [(i, i % 9, "x" if i % 2 else "y", [float(v) for v in rng.integers(0, 3, size=4)]) for i in range(120)]
    rows = spark.createDataFrame([*rows, *rows[:30]], "id int, g int, w string, vector array<float>")
    asked = rows.dropDuplicates(["id"]).filter("id < 20").select(F.concat(F.lit("q"), F.col("id")).alias("query_id"), "g", "w", "vector", (F.col("id") % 5 + 1).alias("n"))
    spec = search.SearchSpec(on=("g",), differ="w", distinct="id", carry=("w",))
    whole = sorted(map(tuple, search.search(rows, asked, F.col("n"), spec).select("query_id", "id", "score", "w", "rank").collect()))
    monkeypatch.setattr(search, "MAX_RESULTS", 1)
    monkeypatch.setattr(search, "_broadcast_search", None)
    monkeypatch.setattr(search, "MAX_PAIR_VALUES", 28)
    packed = F.udf(lambda v: np.asarray(v, np.float32).tobytes(), "binary")
    for index in (rows, rows.withColumn("vector", packed("vector"))):
        got = search.search(index, asked, F.col("n"), spec).select("query_id", "id", "score", "w", "rank")
        assert sorted(map(tuple, got.collect())) == whole
    assert whole


def test_ascii_texts_are_encoded_from_their_bytes():
    texts = ["Aa_b", None, "", "-- x9 ", "b\x00c", "Z"]
    plain = encode.HashingEncoder(8)
    assert (plain.arrow(pa.array(["cut", *texts])[1:]) == plain(texts)).all()
    assert plain.arrow(pa.array(["é"])) is None
