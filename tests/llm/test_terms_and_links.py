"""Source divergence, ranked search and the grid join against plain versions and on odd input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from preptrail.llm import divergence, gridjoin, lexical, terms

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, n long, place long"
WORD = {terms.LETTERS: r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", terms.LETTERS_AND_DIGITS: r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def words(text, letters):
    return re.findall(WORD[letters], (text or "").translate(UPPER))


@pytest.mark.parametrize("letters", [terms.LETTERS, terms.LETTERS_AND_DIGITS])
def test_terms(letters):
    split = terms.splitter(letters)
    everything = "".join(chr(c) for c in range(1, 0x250)) + " Ünï cÖde É1x\x0b2Y\x1cz 東京 42 İI"
    for text in (None, "", " \t\n", "plain Words", "don't-stop", everything, everything[::-1], "x" * 100_000):
        assert [t.decode() for t in split(text.encode() if text is not None else None)] == words(text, letters)


def plain_audit(rows, min_documents, top):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        own = words(text, terms.LETTERS)
        n.update((lang, source, w) for w in own)
        docs.update((lang, w) for w in set(own))
    kept = defaultdict(set)
    for (lang, word), count in docs.items():
        if count >= min_documents:
            kept[lang].add(word)
    totals = Counter()
    for (lang, source, word), count in n.items():
        if word in kept[lang]:
            totals[lang, source] += count
            totals[lang, None, word] += count
            totals[lang,] += count

    def share(count, total, lang):
        return 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept[lang]))

    def value(p, q):
        return (p - q) * (p - q) // (p + q)

    out = []
    for lang, source in groups:
        own = {w: share(n[lang, source, w], totals[lang, source], lang) for w in kept[lang]}
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                them = {w: share(n[lang, other, w], totals[lang, other], lang) for w in kept[lang]}
                pairs.append((sum(value(own[w], them[w]) for w in own), other))
        used = []
        for w in kept[lang]:
            q = share(totals[lang, None, w], totals[lang,], lang)
            if n[lang, source, w] and own[w] > q:
                used.append((value(own[w], q), w))
        for part, found in (("pair", pairs), ("term", used)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            found = found if part == "pair" else found[:top]
            out += [(lang, source, part, item, v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdéß東") for _ in range(draw.randint(1, 4))) for _ in range(150)]
    rows = []
    for d in range(260):
        lang = draw.choice(["en", "en", "en", "de", None])
        source = draw.choice(["s1", "s1", "s1", "s2", "s3", "s4", None, "Ü"])
        picked = [vocabulary[min(int(draw.expovariate(0.03)), 149)] for _ in range(draw.randint(0, 60))]
        text = draw.choice([" ", "-", "\n", "1"]).join(w.upper() if draw.random() < 0.1 else w for w in picked)
        rows.append((d, text, lang, source, len(text), "x", 1, 2))
    rows += [rows[0]] * 12  # repeated rows
    rows += [(900, None, "en", "silent", None, "x", 1, 2), (901, "", "xx", "a", 0, "x", 1, 2), (902, "rare", "xx", "b", 4, "x", 1, 2)]
    rows += [(903, "lone " * 3000, "yy", "only", 15_000, "x", 1, 2)]
    return rows


@pytest.mark.parametrize(("sources", "held"), [(256, 1_000_000), (2, 40)])
def test_audit_sources(spark, monkeypatch, sources, held):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = audit_rows()
    found = divergence.audit_sources(spark.createDataFrame(rows, DOCS), min_documents=3, top=5)
    got = sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, 3, 5)
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    counts = [(10**13, 10**14, 10**6), (0, 0, 1), (7, 9, 3)]
    df = spark.createDataFrame(counts, "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * kept) for n, total, kept in counts]


def plain_ranking(rows, items, k):
    own = [(d, Counter(words(t, terms.LETTERS_AND_DIGITS))) for d, t, *_ in rows]
    sizes = [sum(c.values()) for _, c in own]
    documents, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(words(text, terms.LETTERS_AND_DIGITS))
    out = []
    for item, wanted in asked.items():
        scores = []
        for (d, c), size in zip(own, sizes, strict=True):
            m = 50 + 50 * size * documents // max(length, 1)
            score = 0
            for w in wanted & c.keys():
                weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1)))
                score += weight * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "shard", "group", "lot"), [(64, 8192, 8192, 8 << 20), (3, 40, 12, 300)])
def test_rank_documents(spark, monkeypatch, block, shard, group, lot):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(lexical, "GROUP_TERMS", group)
    monkeypatch.setattr(lexical, "QUERY_BYTES", lot)
    rows = audit_rows()
    rows += [(None, rows[5][1], "en", "s", 1, "x", 1, 2), (5, rows[6][1], "en", "s", 1, "x", 1, 2)]
    items = [(i, rows[i * 7][1][:60]) for i in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (None, "a b c"), (3, "lone"), (4, rows[28][1])]
    found = lexical.rank_documents(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7)
    got = sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_ranking(rows, items, 7)


def test_rank_documents_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    empty = spark.createDataFrame([], DOCS)
    assert lexical.rank_documents(empty, items).count() == 0
    assert lexical.rank_documents(spark.createDataFrame(audit_rows(), DOCS), items.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, "en", "s", 0, "x", 1, 2), (2, " ", "en", "s", 1, "x", 1, 2)], DOCS)
    assert lexical.rank_documents(only, items).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    """Clustered postings: most lists end and most blocks are skipped, and the best are those of all documents."""
    draw = np.random.default_rng(2)
    impacts = np.zeros((4000, 60), np.int32)
    for topic in range(20):
        rows = np.arange(topic * 200, topic * 200 + 200)
        impacts[np.ix_(rows, range(topic * 2, topic * 2 + 3))] = draw.integers(1, 900_000, (200, 3))
    impacts[:, 50:] = draw.integers(0, 300_000, (4000, 10))
    ids = draw.permutation(4000).astype(np.int64)
    weights = np.concatenate((np.full(50, 5000), np.full(10, 400)))
    items = [(np.array([t * 2, t * 2 + 1, 51, 55]), weights[[t * 2, t * 2 + 1, 51, 55]]) for t in range(20)]
    best, visits = [lexical.Best(10) for _ in items], Counter()
    lexical.search_shard(lexical.Shard(ids, impacts), items, best, visits)
    for (columns, w), got in zip(items, best, strict=True):
        scores = impacts[:, columns].astype(np.int64) @ w
        wanted = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:10]
        assert [(-s, i) for s, i in wanted] == list(zip(got.scores.tolist(), got.ids.tolist(), strict=True))
    assert visits["blocks_open"] < visits["blocks"] / 2 and visits["scored"] < 20 * 4000 / 10


def plain_links(rows, cosine):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = defaultdict(set)
    for i, (_, v, lab) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if lab is not None and lab == other and good(v) and good(w) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec_id, len(links[i]), min(ids, default=None)))
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, node long, block string"


@pytest.mark.parametrize(("block", "leaf", "fan"), [(2048, 128, 8), (16, 4, 2)])
def test_link_vectors(spark, monkeypatch, block, leaf, fan):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FAN", fan)):
        monkeypatch.setattr(gridjoin, name, value)
    draw = np.random.default_rng(4)
    rows = []
    for i in range(220):
        base = draw.normal(size=12) if i % 3 == 0 or not rows else np.array(rows[draw.integers(len(rows))][1]) + draw.normal(size=12) * 0.25
        rows.append((1000 - i, [float(np.float32(x)) for x in base], 1 if i % 4 else int(i % 3)))
    rows += [(2000 + i, rows[7][1], 1) for i in range(40)]  # copies
    rows += [(3000, [x * 4 for x in rows[9][1]], rows[9][2]), (3001, rows[10][1], None), (3002, rows[10][1], 77), (3003, rows[8][1], rows[8][2])]
    rows += [(3003, rows[30][1], rows[30][2]), (None, rows[8][1], rows[8][2]), (None, [9.0] * 12, 55)]  # a repeated id, null ids
    rows += [(4000 + i, v, 1) for i, v in enumerate([None, [], [0.0] * 12, [None] + [1.0] * 11, [math.nan] * 12, [math.inf] + [1.0] * 11])]
    rows += [(5000 + i, [1.0, 0.1 * i, -0.0], 1) for i in range(9)] + [(6000, [1e-38] * 12, 1), (6001, [3e38] * 12, 1), (6002, [1.0] * 12, 1)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], VECTORS)
    found = gridjoin.link_vectors(df).select("vec_id", "n_links", "component_id")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_links(rows, 0.93)
    assert gridjoin.link_vectors(df.limit(0)).count() == 0
    none = gridjoin.link_vectors(df.filter("vec_id in (4000, 4002)")).select("vec_id", "n_links", "component_id")
    assert sorted(tuple(r) for r in none.collect()) == [(4000, 0, 4000), (4002, 0, 4002)]


def test_distant_stretches_are_skipped():
    """Dense heaps around a few centres: less than half of the pairs of stretches meet."""
    draw = np.random.default_rng(6)
    centres = gridjoin.units(draw.normal(size=(12, 32)) * np.repeat([6.0, 1.0], [4, 28]))
    vectors = np.repeat(centres, 200, axis=0) + draw.normal(size=(2400, 32)) * 0.02
    axes = np.linalg.eigh(np.cov(gridjoin.units(vectors).T))[1][:, ::-1][:, : gridjoin.AXES]
    width = math.sqrt(2 - 2 * 0.93)
    cells = np.floor(gridjoin.units(vectors) @ axes / width)
    vectors = vectors[np.lexsort(cells.T[::-1])]
    side = gridjoin.Side(vectors, axes)
    met = list(gridjoin.near_stretches(side, side, 2 - 2 * 0.93 + gridjoin.SLACK))
    stretches = len(side.low)
    assert len(met) < stretches * (stretches + 1) / 2 / 2
    counts, heads = gridjoin.compare(side, side, (np.ones(2400, np.int64),) * 2, 0.93)
    like = gridjoin.units(vectors) @ gridjoin.units(vectors).T >= 0.93
    assert np.array_equal(counts, like.sum(axis=1) - 1)
    assert all(len(set(heads[row].tolist())) == 1 for row in like) and np.array_equal(heads, heads[heads])
