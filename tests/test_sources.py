import json

import pytest
from pyspark.sql import functions as F

from preptrail import schemas as S
from preptrail.plans import prepare
from preptrail.operators.encode import HashingEncoder, TextEncoder
from preptrail import session
from preptrail.session import cut_lineage, scratch_dir
from preptrail.sources import readers, versions, writers
from preptrail.streaming.toggles import latest_progress, progress_stream


def test_feed_preference(spark, tmp_path):
    csv, jsonl = tmp_path / "feed.csv", tmp_path / "feed.jsonl"
    assert readers.read_problem_feed(spark, str(jsonl), str(csv)) is None
    csv.write_text('company,title,difficulty,link,topics,extra\nA,"t, ""x""",EASY,u,"a, b",1\n')
    (row,) = readers.read_problem_feed(spark, str(jsonl), str(csv)).collect()
    assert row.title == 't, "x"' and row.topics == "a, b" and row.body is None
    jsonl.write_text(json.dumps({"company": "B", "title": "é", "frequency": 1.5, "preparation_days": 30}) + "\n\n")
    (row,) = readers.read_problem_feed(spark, str(jsonl), str(csv)).collect()
    assert (row.company, row.title, row.frequency, row.preparation_days) == ("B", "é", "1.5", "30")


def test_tolerant_registry(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text("name,industry,other\nA,x,1\n,y,2\n")
    out = readers.read_registry_csv(spark, str(csv))
    assert out.columns == ["name", "industry"] and out.count() == 1
    with pytest.raises(ValueError):
        readers.trim_registry(spark.createDataFrame([(1,)], "other int"))
    stored = str(tmp_path / "r.parquet")
    writers.write_registry(out, stored)
    rows = readers.registry_rows(readers.read_table(spark, stored), F.lit(0))
    assert rows.first().asDict() == {
        "row_no": 0, "name": "A", "industry": "x", "size_range": None, "employee_count": None, "year_founded": None, "locality": None
    }


def test_csv_append_and_optional_meta(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert readers.read_company_meta(spark, path) is None
    found = spark.createDataFrame([("A", "x", "1-10", "5", "2000", 'say "hi", you')], S.COMPANY_META)
    prepare.append_company_meta(spark, found, path)
    prepare.append_company_meta(spark, found, path)
    writers.append_csv(found, path)
    meta = readers.read_company_meta(spark, path)
    assert meta.count() == 2 and meta.first().locality == 'say "hi", you'


def test_load_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(3), spark.range(5)
    assert writers.load_table(one, path) and not writers.load_table(two, path)
    assert readers.read_table(spark, path).count() == 3
    broken = spark.range(5).withColumn("id", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception):
        writers.load_table(broken, path, force=True)
    assert readers.read_table(spark, path, F.col("id") > 0).count() == 2
    assert writers.load_table(two, path, force=True) and readers.read_table(spark, path).count() == 5


def test_vector_upsert(spark, tmp_path):
    path = str(tmp_path / "v")
    first = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id int, document string, vector array<float>")
    writers.upsert_vectors(first, path)
    writers.upsert_vectors(spark.createDataFrame([(2, "z", [3.0]), (2, "y", [4.0]), (3, "c", [5.0])], first.schema), path, F.col("document"))
    got = [(r.id, r.document) for r in readers.read_vectors(spark, path).orderBy("id").collect()]
    assert got == [(1, "a"), (2, "y"), (3, "c")]


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "v")
    wanted = {i: ("v0", None) for i in range(400)}
    writers.rebuild_vectors(spark.createDataFrame([(i, "v0") for i in wanted], "id int, document string"), path)
    for turn, ids in enumerate((range(50, 60), range(55, 500, 9), range(0, 3)), 1):
        new = spark.createDataFrame([(i, f"v{turn}", turn) for i in ids], "id int, document string, turn int")
        writers.upsert_vectors(new, path)  # with a column the first rows do not have
        wanted.update({i: (f"v{turn}", turn) for i in ids})
    table = writers.vector_table(spark, path)

    def stored():
        return {r.id: (r.document, r.turn) for r in table.read().collect()}

    def files(folder=tmp_path / "v" / "data"):
        return {str(f) for f in folder.rglob("*.parquet")}

    before = files()
    assert stored() == wanted and len(versions.state(spark, path)["deltas"]) == 3
    table.compact([3])
    kept = versions.state(spark, path)
    assert stored() == wanted and files() > before and all(f in kept["base"].values() for f in [kept["base"]["3"], kept["base"]["4"]])
    assert kept["base"]["3"] != kept["base"]["4"] and all("_bucket=3" in f for f in files() - before)
    table.compact()
    assert stored() == wanted and not versions.state(spark, path)["deltas"]
    assert versions.remove_unused(spark, path) > 0 and stored() == wanted
    for turn in range(12):  # crowded tables are compacted on the way
        writers.upsert_vectors(spark.createDataFrame([(turn, "late")], "id int, document string"), path)
    assert len(versions.state(spark, path)["deltas"]) <= versions.DELTAS and stored()[11] == ("late", None)
    table.rebuild(table.read().filter("id < 2"))
    assert sorted(stored()) == [0, 1]


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "v")
    table = versions.KeyedTable(spark, path, ["id"])
    table.rebuild(spark.range(3))
    old = versions.state(spark, path)
    table.upsert(spark.range(2, 5))
    with pytest.raises(RuntimeError):
        versions.commit(spark, path, old, old["number"])
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    assert table.upsert(spark.range(9, 10), batch=4) and not table.upsert(spark.range(20, 30), batch=4)
    assert table.read().count() == 6


def test_a_failed_load_leaves_both_tables(spark, tmp_path):
    path = str(tmp_path / "set")
    one, two = spark.range(3), spark.range(4)
    assert versions.write_set({"a": one, "b": two}, path) and not versions.write_set({"a": two, "b": one}, path)
    broken = spark.range(5).withColumn("id", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        versions.write_set({"a": two, "b": broken}, path, force=True)
    assert [versions.read_set(spark, path, n).count() for n in "ab"] == [3, 4]
    assert versions.write_set({"a": two, "b": one}, path, force=True)
    assert [versions.read_set(spark, path, n).count() for n in "ab"] == [4, 3]


def test_registry_order_does_not_depend_on_splits(spark, tmp_path):
    names = [(f"n{i:03}",) for i in range(300)]
    spark.createDataFrame(names, "name string").repartitionByRange(3, "name").sortWithinPartitions("name").write.parquet(str(tmp_path / "r"))
    first = [r.name for r in readers.read_registry(spark, str(tmp_path / "r")).orderBy("row_no").collect()]
    assert first == [n for n, in names]


def test_pairs_as_lines_and_as_array(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "é\n", None)], S.PREFERENCE_PAIRS)
    writers.write_preference_pairs(pairs, str(tmp_path / "pairs"))
    assert readers.read_preference_pairs(spark, str(tmp_path / "pairs")).collect() == pairs.collect()
    text = "".join(p.read_text() for p in (tmp_path / "pairs").glob("part-*"))
    assert "é" in text
    array = tmp_path / "pairs.json"
    array.write_text(json.dumps([{"prompt": "p", "chosen": "c", "rejected": "r"}] * 2, indent=1))
    assert readers.read_preference_pairs(spark, str(array), array=True).count() == 2


def test_offline_build(spark, tmp_path):
    feed = spark.createDataFrame([("B", "t", "EASY", "u", None, None, "2", "30", "x"), ("A", "s", "HARD", "v", None, None, None, "90", None)], S.RAW_FEED)
    base = str(tmp_path / "catalogue")
    assert prepare.load_catalogue(feed, F.col("title"), base)
    assert not prepare.load_catalogue(feed, F.col("title"), base)
    companies, problems = prepare.read_catalogue(spark, base)
    assert companies.count() == 2
    assert {(r.company, r.company_id) for r in problems.collect()} == {("A", 1), ("B", 2)}
    prepare.store_distributions(feed, str(tmp_path / "dist"))
    assert readers.read_distributions(spark, str(tmp_path / "dist")).count() == 2
    encoder = TextEncoder(HashingEncoder(8))
    prepare.store_problem_vectors(problems.withColumn("id", F.xxhash64("title")), encoder, str(tmp_path / "vectors"))
    assert readers.read_vectors(spark, str(tmp_path / "vectors")).count() == 2
    (tmp_path / "train.jsonl").write_text('{"prompt": "p", "completion": "c"}\n')
    solutions = readers.read_solutions(spark, str(tmp_path / "train.jsonl")).withColumn("row_no", F.monotonically_increasing_id())
    prepare.store_solution_vectors(solutions, encoder, str(tmp_path / "sol"))
    assert readers.read_vectors(spark, str(tmp_path / "sol")).first().id == "sol_0"


def test_lineage_is_cut_in_the_named_folder(spark):
    out = cut_lineage(spark.range(4).withColumn("x", F.col("id") * 2))
    assert out.agg(F.sum("x")).first()[0] == 12
    assert out.inputFiles()[0].replace("file://", "").startswith(scratch_dir(spark).replace("file:", ""))


def test_progress_stream_equals_batch(spark, tmp_path):
    log = [(u, i) for u in range(4) for i in range(5) for _ in range((u * i) % 4 + 1)]
    path = str(tmp_path / "log")
    spark.createDataFrame(log, "user_id long, item_id int").repartition(5).write.parquet(path)
    stream = spark.readStream.schema("user_id long, item_id int").option("maxFilesPerTrigger", 1).parquet(path)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    progress_stream(stream, target, state).awaitTermination()
    spark.createDataFrame([(0, 0), (9, 9)], "user_id long, item_id int").write.mode("append").parquet(path)
    progress_stream(stream, target, state).awaitTermination()
    got = {(r.user_id, r.item_id): (r.n_toggles, r.is_completed) for r in latest_progress(spark, target).collect()}
    want = {}
    for key in [*log, (0, 0), (9, 9)]:
        want[key] = want.get(key, 0) + 1
    assert got == {k: (n, n % 2 == 1) for k, n in want.items()}


def test_toggles_delivered_twice_count_once(spark, tmp_path):
    schema = "toggle_id long, user_id long, item_id int"
    path, target, state = (str(tmp_path / name) for name in ("log", "out", "state"))

    def deliver(toggles):
        for part in toggles:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        progress_stream(stream, target, state).awaitTermination()
        return {(r.user_id, r.item_id): r.n_toggles for r in latest_progress(spark, target).collect()}

    assert deliver([[(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1)]]) == {(1, 1): 2, (2, 1): 1}
    assert deliver([[(1, 1, 1), (4, 1, 1)], [(3, 2, 1), (4, 1, 1), (5, 3, 9)]]) == {(1, 1): 3, (2, 1): 1, (3, 9): 1}
    many = [[(100 + i, 7, i % 2)] for i in range(12)]
    assert deliver(many) == {(1, 1): 3, (2, 1): 1, (3, 9): 1, (7, 0): 6, (7, 1): 6}
    assert len(versions.state(spark, target)["deltas"]) <= versions.DELTAS


def test_release_scratch(spark):
    session._written.clear()  # other tests still read theirs
    stored = cut_lineage(spark.range(3), "kept")
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    assert stored.count() == 3 and readers.path_exists(spark, path)
    assert session.release_scratch(spark) == 1 and not readers.path_exists(spark, path) and session.release_scratch(spark) == 0
