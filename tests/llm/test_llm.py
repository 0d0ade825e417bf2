"""Operators against plain versions, and their defined results on odd input."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from preptrail.llm import ann, base, bpe, digest, extract, fixity, nearcopies, packing, quality, queries, repeats, shards, tokens
from preptrail.llm.components import components
from preptrail.llm.words import spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def sentences(seed, count):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(count))


def odd_texts():
    base, passage = sentences(1, 120), sentences(2, 60)
    edited = base.split()
    edited[50] = "changed"
    return [
        (0, base),
        (1, base),
        (2, " ".join(edited)),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "one two"),
        (7, "ONE two"),
        (8, sentences(3, 40) + " " + passage + "\n" + sentences(4, 30)),
        (9, passage + " " + sentences(5, 50)),
        (10, " ".join(["same"] * 90)),
        (11, sentences(6, 5000)),
        (12, "naïve café 東京  x"),
        (13, "x" * 3000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "score": F.lit("x"), "_row": F.lit(2), "shard": F.lit(9)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}


def test_spans_end_at_texts():
    data = np.frombuffer(b"abcd ef", np.uint8)
    starts, ends, before = spans(data, np.array([0, 2, 2, 7]))
    assert starts.tolist() == [0, 2, 5] and ends.tolist() == [2, 4, 7] and before.tolist() == [0, 1, 1, 3]


@pytest.mark.parametrize("window, gram", [(35, 12), (4, 2), (5, 5)])
def test_remove_repeats(docs, empty, window, gram):
    got = repeats.remove_repeats(docs, window, gram)
    rows = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())
    assert rows == sorted(brute.remove_repeats(odd_texts(), window))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_survive_a_crowded_sketch(docs, monkeypatch):
    monkeypatch.setattr(repeats, "MAX_BITS", 10)  # nearly every counter reaches two
    got = repeats.remove_repeats(docs, 4, 2, carry=["doc_id"], with_text=False)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.remove_repeats(odd_texts(), 4))


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies(docs, empty, width):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearcopies.near_copies(docs, width).collect()}
    assert got == brute.near_copies(odd_texts(), width)
    assert nearcopies.near_copies(empty).count() == 0


@pytest.mark.parametrize("block", [None, 2000, 8000])
def test_near_copies_of_a_family(spark, monkeypatch, block):
    """Copies of one text with own edits, so that links need the comparison beyond the smallest node."""
    if block:  # a few nodes each, so that many blocks meet
        monkeypatch.setattr(nearcopies, "BLOCK_BYTES", block)
    base, rows = sentences(8, 200).split(), []
    for i in range(60):
        draw, words = random.Random(i), list(base)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(200)] = f"w{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += rows[5:9] + [(None, rows[0][1])]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute.near_copies(rows[:60], 4)
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == 65


def test_shards(docs, empty, spark):
    size = F.octet_length("text") + 8
    got = shards.shard_by_bytes(docs, [F.col("doc_id")], size, 3)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    rows = [(r.shard, r.slot, r.doc_id) for r in got.collect()]
    assert [d for *_, d in sorted(rows)] == list(range(14))
    assert all([s for k, s, _ in sorted(rows) if k == shard] == list(range(sum(k == shard for k, *_ in rows))) for shard in range(3))
    assert shards.shard_by_bytes(empty, [F.col("doc_id")], size, 3).count() == 0
    same = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 10, "doc_id long, text string")
    counts = shards.shard_by_bytes(same, [F.col("doc_id")], size, 5).groupBy("shard").count().collect()
    assert len(counts) == 5 and sum(r["count"] for r in counts) == 60


def pieces_hold(pieces, rows, length):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    for d, own in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(own)
            assert zlib.crc32(own[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(own)
    for sequence in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length


def test_pack(docs, empty):
    rows = odd_texts()
    rows[6] = (6, "<|endoftext|> two")
    pieces_hold(queries.pack_documents(docs.replace({"one two": "<|endoftext|> two"}, subset="text")).collect(), rows, 1024)
    assert queries.pack_documents(empty).count() == 0


def test_texts_with_the_name_of_an_added_token(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext| >", "東京<|endoftext|>é.", "x<|endoftext|><|endoftext|>"]
    rows = list(enumerate(texts))
    pieces = queries.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pieces_hold(pieces, rows, 1024)
    assert {p.doc_id: p.doc_tokens for p in pieces}[0] == 5


def test_cuts_are_the_cheapest():
    for seed in range(30):
        draw = np.random.default_rng(seed)
        ends = np.cumsum(draw.integers(1, 30, 8))
        places, costs = packing.cut_places(ends, draw.integers(1, int(ends[-1]) + 1, 10), 16)
        best = [0.0] + [np.inf] * (len(places) - 1)
        for i in range(1, len(places)):
            best[i] = min(best[j] + 16 - (places[i] - places[j]) + costs[i] for j in range(i) if places[i] - places[j] <= 16)
        bounds = packing.cuts(places, costs, 16)
        got, before = 0, 0
        for i in bounds:
            assert 0 < places[i] - places[before] <= 16
            got, before = got + 16 - (places[i] - places[before]) + costs[i], i
        assert before == len(places) - 1 and got == best[-1]


@pytest.mark.parametrize("length, longest", [(16, 120), (16, 400), (7, 60), (3, 20)])
def test_long_stretches_are_cut_as_if_anywhere(length, longest):
    for seed in range(60):
        draw = np.random.default_rng(seed)
        ends = np.cumsum(draw.integers(1, longest, 8))
        total = int(ends[-1])
        marks = draw.integers(1, total + 1, draw.integers(0, 12))
        places, costs = packing.cut_places(ends, marks, length)
        assert places[0] == 0 and places[-1] == total and (np.diff(places) > 0).all() and (np.diff(places) <= length).all()
        bounds = packing.cuts(places, costs, length)
        got = sum(length + int(costs[i]) for i in bounds) - total
        known = {**{int(m): packing.SENTENCE_CUT for m in (*marks, 0)}, **{int(e): 0 for e in ends}}
        stops = sorted(known)
        cost = dict(known)
        for a, b in zip(stops, stops[1:], strict=False):
            if b - a > length:
                cost.update({t: packing.INNER_CUT for t in range(a + 1, b)})
        best = {0: 0}
        for t in sorted(cost)[1:]:
            best[t] = min(best[j] + length - (t - j) + cost[t] for j in range(max(0, t - length), t) if j in best)
        assert got == best[total]


def test_both_libraries_split_alike():
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    quick = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"ab{c}cd 1{c}2 {c} {c}{c}x\n{c} '{c}" for c in map(chr, range(0x3000))]
    for text, got in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert quick.encode_ordinary(text) == got.ids


def test_byte_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_and_decode(docs, path).collect()}
    for doc_id, text in odd_texts():
        ids = known.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_and_decode(empty, path).count() == 0
    merges, split = bpe.Merges(tokens.read_ranks(path)), bpe.splitter()
    for text in (*(f"a{c}1{c}{c} {c}" for c in map(chr, range(0x3000))), "ab" * 700, " \n\n x  "):
        assert [i for ids in merges.fold([w.encode() for w in split(text)]) for i in ids] == known.encode_ordinary(text)


def test_fingerprints(docs, empty):
    rows = sorted(odd_texts())
    got = {r.doc_id: r for r in digest.fingerprints(docs).collect()}
    digester = digest.Digester()
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = digest.edited(text, after)
        assert len(changed) <= len(text) and got[doc_id].n_chars == len(text)
        assert got[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, other, following = (digester.digests([t.encode()]) for t in (text, changed, after))
        assert got[doc_id].fingerprint == digester.text(*own)[0] and got[doc_id].edited_fingerprint == digester.text(*other)[0]
        assert got[doc_id].near_edited == digester.likeness(own, other)[0]
        assert got[doc_id].near_next == digester.likeness(own, following)[0]
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1
    assert digest.fingerprints(empty).count() == 0
    alone = digest.fingerprints(docs.filter("doc_id = 11")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_long_texts_count_in_slices(monkeypatch):
    data = sentences(9, 2000).encode()
    whole = digest.Digester().counts([data])
    monkeypatch.setattr(digest, "SLICE", 1000)
    assert (digest.Digester().counts([data, b"abc"])[0] == whole[0]).all()


def test_quality(spark, empty):
    rows = []
    for i in range(240):
        good = sentences(i, 60).capitalize() + "."
        rows.append((i, good if i % 2 else " ".join(f"{w}%%%" for w in good.split()), i % 2))
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(documents, labels).collect()}
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    held = [got[i].predicted == q for i, _, q in rows if got[i].held_out]
    assert held and all(held)
    assert got[900].score == got[901].score
    one_kind = quality.fit_rules(spark.createDataFrame([([0.0] * 15, 1)], "stats array<double>, label int"))
    assert one_kind.rules == [] and one_kind.intercept > 0
    assert quality.score_quality(empty, labels.limit(0)).count() == 0


def test_tree_rules_keep_the_tightest_bounds():
    shown = "x\n  If (feature 1 <= 2.0)\n   If (feature 1 <= 1.0)\n    Predict: 0.0\n   Else (feature 1 > 1.0)\n    Predict: 1.0\n  Else (feature 1 > 2.0)\n   Predict: 1.0"
    assert quality.tree_rules(shown) == [((1, True, 2.0),), ((1, True, 1.0),), ((1, False, 1.0), (1, True, 2.0)), ((1, False, 2.0),)]


def test_extract(spark):
    def page(i, extra=""):
        return (
            f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='<p>no</p>';</script></head><body><nav><a href=x>Menu</a></nav>"
            f"<div id=box><span>Buy now</span></div><div class=text><p>Fresh &amp; new{i}<br>line <b>bold</b>ly"
            f"<p>Second&nbsp;&lt;p&gt; {i}</div>{extra}<!-- c --><footer>End</footer></body></html>"
        )

    comments = "<section class='comments'><p>Reader</p></section><aside>Side</aside><form><p>Mail</p></form>"
    rows = [(i, "http://a.org/x", page(i, comments)) for i in range(60)]
    rows += [(100, "http://b.org/", "<article><h1>A</h1><p title='a>b'>t</p><article>Comment</article></article><p>Other"), (101, None, None), (102, "x", "")]
    rows += [(103, "http://c.org", "plain text")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Fresh & new{i} line boldly Second <p> {i}" for i in range(60))
    assert [got[i].text for i in (100, 101, 102, 103)] == ["A t", "", "", "plain text"]
    assert got[0].n_chars == len(got[0].text)
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ("<main><article><p>text</p></article></main>", "text"),
        ("<main><h1>A</h1><article><p>text</p><article>Comment</article></article></main>", "A text"),
        ("<main><article>one</article><aside><article>Teaser</article></aside><article>two</article></main>", "one two"),
        ("<form id=f><div>Bar</div><article><p>text</p></article></form>", "text"),
        ("<div class='page no-sidebar'>Top<main><p>text</p><nav>Menu</nav></main></div><article>Teaser</article>", "text Teaser"),
        ("<div class=has-header id=search-results><article>one</article><article>two</article></div>", "one two"),
        ("<div class=has-header><article>text</article><section id=comments><article>Comment</article></section></div>", "text"),
        ("<article>text</article><section id=comments><article>Comment</article></section>", "text"),
        ("<main><div class=search-results><article>one</article><article>two</article></div></main>", "one two"),
        ("<main>text</main><aside><article>Teaser</article></aside>", "text"),
        ("<template><article>unseen</article></template><p>text</p>", "text"),
    ],
)
def test_main_texts_stay(html, text):
    assert extract.main_text("http://a.org", html, set()) == text


def test_a_low_branch_around_an_article_in_main_stays(spark):
    rows = [(i, "http://a.org", f"<main><div><div><article><p>text {i}</p></article></div></div><div><p>Same</p></div></main>") for i in range(60)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"text {r.page_id}" in r.text for r in got) and len(got) == 60


def test_a_host_of_copies_keeps_its_text(spark):
    rows = [(i, "http://a.org", "<div><p>One text</p></div><div><p>of two</p></div>") for i in range(40)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"One text of two"}


def test_fixity(spark):
    draw = random.Random(2)
    rows = [(a, o * 700, f"{draw.random()}") for a in range(3) for o in range(400)]
    rows += [(7, 0, "d")] * 30 + [(None, None, None)]
    replica = [r for r in rows if r[:2] != (0, 1400)]
    replica = [(a, o, "bad" if (a, o) in {(1, 0), (2, 279300)} else d) for a, o, d in replica] + [(5, 1, "new"), (7, 0, "d")]
    schema = "archive long, offset long, digest string"
    got = fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(replica, schema))
    expected = {(0, 1400, "missing"), (1, 0, "altered"), (2, 279300, "altered"), (5, 1, "extra"), (7, 0, "altered")}
    assert {tuple(r) for r in got.collect()} == expected
    same = spark.createDataFrame(rows, schema)
    assert fixity.audit(same, same).count() == 0
    none = spark.createDataFrame([], schema)
    assert fixity.audit(none, none).count() == 0 and fixity.audit(none, same).count() == 1202


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 400)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(1500, 16)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a heap of copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1600, None), (1601, [0.0] * 16), (1602, [float("nan")] * 16), (1603, [1.0] * 3), (None, rows[1][1]), (1604, [None] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(table, 50, dims=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 50))
    hits = 0
    for query, found in got.items():
        exact = np.sqrt(((vectors.astype(float) - vectors[query].astype(float)) ** 2).sum(axis=1))
        exact[query] = np.inf
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        assert found == [(k + 1, i, s) for k, (s, i) in enumerate(sorted((s, i) for _, i, s in found))]
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(1500), exact))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert ann.nearest_neighbours(table.limit(0), 50).count() == 0
    assert ann.nearest_neighbours(table.filter("vec_id < 3"), 2).count() == 4


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rows = [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (3, 3.25), (3, 3.25), (4, 4.0), (5, 5.0), (5, 9.0)]
    table = spark.createDataFrame([(i, [v, 1.0], "r") for i, v in rows], "vec_id long, embedding array<float>, row string")
    got = sorted(tuple(r) for r in ann.nearest_neighbours(table, 5, k=4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(
        [(0, 1, 1, 1.0), (0, 2, 2, 2.0), (0, 3, 3, 3.0), (0, 4, 3, 3.25)]
        + [(5, 1, 4, 1.0), (5, 2, 3, 1.75), (5, 3, 3, 1.75), (5, 4, 3, 2.0)]
        + [(5, 1, 5, 4.0), (5, 2, 4, 5.0), (5, 3, 3, 5.75), (5, 4, 3, 5.75)]
    )


def test_a_search_meets_a_part_of_its_shard(monkeypatch):
    """Vectors around many centres: few distances, nearly all neighbours."""
    draw = np.random.default_rng(3)
    vectors = (np.repeat(draw.normal(size=(150, 12)), 40, axis=0) + 0.4 * draw.normal(size=(6000, 12))).astype(np.float32)
    edges, entries = ann.build_graph(vectors, 16, 32)
    met, plain = [0], ann._distances

    def counted(vectors, at, points):
        met[0] += int((at >= 0).sum())
        return plain(vectors, at, points)

    monkeypatch.setattr(ann, "_distances", counted)
    points = vectors[::60]
    places, _ = ann.beam_search(vectors, edges, entries, points, 32)
    hits = 0
    for point, row in zip(points, places, strict=True):
        nearest = np.argsort(((vectors - point) ** 2).sum(axis=1), kind="stable")[:10]
        hits += len(set(nearest.tolist()) & set(row.tolist()))
    assert hits >= 0.95 * 10 * len(points) and met[0] < 0.1 * len(points) * len(vectors)


def test_odd_sizes_do_not_set_the_dimension(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)]
    odd = [(10, [1.0, 2.0, 3.0]), *[(11 + i, [None] * 5) for i in range(9)], *[(None, [1.0] * 4)] * 9, *[(30 + i, [0.0] * 3) for i in range(9)]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(table, 5, k=2).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 2.0), (5, 1, 4, 1.0), (5, 2, 3, 2.0)]
    assert ann.nearest_neighbours(table.filter("vec_id between 11 and 19"), 5).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    passage = sentences(70, 60)
    texts = {i: sentences(100 + i, 80).capitalize() + "." for i in range(90)}
    texts[40] = texts[41]
    texts[50], texts[51] = texts[50] + "\n" + passage, passage + "\n" + texts[51]
    junk = {200 + i: " ".join(f"{w}%%%" for w in sentences(300 + i, 40).split()) for i in range(60)}
    rows = [(d, t, "en", "s", len(t)) for d, t in {**texts, **junk}.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int(d < 200), 0) for d in (*texts, *junk)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, good), (_, near), (_, passages), _ = corpus_pipeline.STAGES
    kept = good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts)
    single = near(spark, kept, str(tmp_path))
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == set(texts) - {41}
    cleaned = {r.doc_id: r for r in passages(spark, single, str(tmp_path)).collect()}
    assert cleaned[50].text == " ".join(texts[50].split()[:80]) and cleaned[51].n_chars == len(cleaned[51].text)
    assert all(cleaned[d].text == texts[d] for d in cleaned if d not in (50, 51))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces_hold(pieces, [(d, r.text) for d, r in cleaned.items()], 1024)
    assert {p.doc_id for p in pieces} == set(cleaned)


def test_pipeline_stages_on_repeated_rows_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    def good_text(i):
        return sentences(500 + i, 80).capitalize() + "."

    rows = [(d, good_text(d)) for d in range(80)]
    rows += [(1, good_text(1))]  # a row twice
    rows += [(None, good_text(90))] * 3  # three times without an id
    rows += [(None, good_text(2))]  # once with and once without
    rows += [(3, good_text(91))]  # one id, two texts
    near = good_text(4).split()
    near[40] = "changed"
    rows += [(4, " ".join(near)), (-7, good_text(5)), (None, None), (94, None)]
    junk = [(200 + i, " ".join(f"{w}%%%" for w in sentences(700 + i, 40).split())) for i in range(60)]
    schema = f"{DOCS}, _row string, n_removed string, kept string"
    table = [(d, t, "en", "s", None if t is None else len(t), "r", "n", "k") for d, t in rows + junk]
    spark.createDataFrame(table, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, int(d < 200), 0) for d in (*range(80), *(d for d, _ in junk))] + [(None, 1, 0), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def pairs(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    (_, good), (_, near), (_, passages), (_, packing_stage) = corpus_pipeline.STAGES
    kept = good(spark, docs, str(tmp_path))
    assert [p for p in pairs(kept) if p[1]] == sorted((p for p in rows if p[1]), key=repr)
    single = near(spark, docs.filter("doc_id is null or doc_id < 200"), str(tmp_path))
    wanted = {t: d for d, t in rows if t and t != rows[86][1]}
    wanted.update({good_text(d): d for d in range(80) if d != 5})
    got = pairs(single)
    by_id = [(d, t) for d, t in got if t is not None and d != 4]
    assert by_id == sorted(((d, t) for t, d in wanted.items() if d != 4), key=repr)
    assert [d for d, _ in got].count(4) == 1 and [p for p in got if p[1] is None] == [(94, None), (None, None)]
    cleaned = passages(spark, single, str(tmp_path))
    assert cleaned.columns == docs.columns and pairs(cleaned) == got
    assert {(r._row, r.n_removed, r.kept) for r in cleaned.collect()} == {("r", "n", "k")}
    pieces = packing_stage(spark, cleaned, str(tmp_path)).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"})
    assert {r.doc_id for r in pieces.collect()} == {d for d, _ in got}
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed >= {None, 1, 2, 3, -7, *range(6, 80)} and 5 not in packed
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op4_count_min_prefilter", "op7_min_max_hashing", "op8_byte_prefix_shards"])
def test_sql_twins(docs, spark, tmp_path, name):
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = base.QUERIES[name](spark, str(tmp_path))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = database.execute(f"SELECT {', '.join(got.columns)} FROM ({base.ORACLES[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == wanted
