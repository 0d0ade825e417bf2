import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from preptrail.functions import clean, code, pchip, progress, vectors


def test_company_names(values):
    names = {
        "Foo Labs, Inc.": "foo",
        "Acme Co., Ltd.": "acme co.,",
        "Software": "",
        "IBM Corporation": "ibm",
        "Visa": "visa",
        "Cisco": "cisco",
        "  Big   Blue\tGroup ": "big blue",
        "A Technologies Solutions Services LLC": "a technologies",
    }
    assert values(list(names), clean.normalize_company(F.col("c"))) == list(names.values())


def test_slug(values):
    urls = ["https://x.org/problems/two-sum/", "https://x.org/a//", "https://x.org/p?page=2&ref=x", "plain"]
    assert values(urls, clean.slug(F.col("c"))) == ["two-sum", "a", "p?page=2&ref=x", "plain"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>n &lt;= 10<sup>5</sup></p>", "n <= 10^5"),
        ("a<sub>i</sub> and <b>b</b>", "a_i\n and \nb"),
        ("x<sup> <i>n</i>+<b>1</b> </sup>y", "x^n+1\ny"),
        ("<SUP class='z'>2</SUP>", "^2"),
        ("<p title='a>b' id=c lang = \"d>\">t</p>", "t"),
        ('n<sup title="x>y">2</sup><br/>don\'t', "n^2\ndon't"),
        ('<a href="open>shut</a>', "shut"),
        ("2<sup>a<sup>b</sup></sup>", "2^ab"),
        ("2<sup>a<SUP title='>'>b</sup>c</sup>d<sup>e</sup></sup>f", "2^abc\nd^e\nf"),
        ("x<sub>i<sub>j</sub></sub><sup>2</sup>", "x_ij^2"),
        ("x<sup>a<sup>b", "x^ab"),
        ("<sup>" + "<b>y</b>" * 20000 + "<sup>z</sup></sup>", "^" + "y" * 20000 + "z"),
        ("<style>p{}</style><script>var t='</p>';</script>seen<!-- not <b> -->", "seen"),
        ("<p>a</p>\n\n\n\n<p>b</p>", "a\n\nb"),
        ("&nbsp;caf&eacute; &#8721; &amp;lt; &unknown;", "café ∑ &lt; &unknown;"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<![CDATA[raw]]>x", "raw\nx"),
        ("", ""),
        ("<p></p>" * 20000 + "deep", "deep"),
    ],
)
def test_html_to_text(values, html, text):
    assert values([html], clean.html_to_text(F.col("c"))) == [text]


def test_refetch(values):
    bodies = [None, "", "at most 10 5 items", "10\n9", "a\n^2", "a\n_i", "10^5 clean", "10 6"]
    assert values(bodies, clean.needs_refetch(F.col("c"))) == [True, True, True, True, True, True, False, False]


def test_texts(values):
    description = clean.description_or_title(F.col("c"), F.lit("Two Sum"), F.lit("EASY"))
    assert values([None, "", "body"], description) == ["Two Sum (EASY)", "Two Sum (EASY)", "body"]
    text = clean.search_text(F.col("c"), F.lit("t"), F.lit(None), F.lit("HARD"))
    assert values([None, "Acme"], text) == ["Unknown | t |  | HARD", "Acme | t |  | HARD"]
    assert values(["a\n\n\nb\nc"], clean.break_paragraphs(F.col("c"))) == ["a</br>b\nc"]
    assert values(["x" * 1500, None], F.length(clean.snippet(F.col("c")))) == [1000, 0]


def test_numeric_repair(values):
    assert values(["11-50", "10001+", "x", None], clean.size_rank(F.col("c"))) == [1.0, 7.0, 4.0, 4.0]
    counts = values(["100", "0", "-5", "many", None], clean.log_employees(F.col("c")))
    assert counts == pytest.approx([np.log1p(100)] + [np.log1p(1)] * 4)
    assert values(["1999", "0", "n/a", None], clean.founding_year(F.col("c"))) == [1999.0, 0.0, 2000.0, 2000.0]
    assert values(["1999", "0", None], clean.founding_year_cold_start(F.col("c"))) == [1999.0, 2000.0, 2000.0]


def test_links(values):
    assert values(["HTTP://A", "", None], clean.url_key(F.col("c"))) == ["http://a", None, None]
    assert values(["HTTP://A", "", None], clean.dedup_key(F.col("c"), F.col("i"))) == ["u:http://a", "i:1", "i:2"]


KNOTS = [0, 30, 90, 180, 360]


def _curve(spark, ys, days):
    df = spark.createDataFrame([(d,) for d in days], "day int").withColumn("y", F.array(*[F.lit(float(y)) for y in ys]))
    df = df.withColumn("d", pchip.slopes(F.col("y")))
    return [r[0] for r in df.orderBy("day").select(pchip.value(F.col("day"), F.col("y"), F.col("d"))).collect()]


@pytest.mark.parametrize("ys", [[0, 0.2, 0.5, 0.8, 1], [0, 0.5, 0.3, 0.3, 0.9], [0, 0, 0, 0, 0], [0, 1, 1, 1, 1]])
def test_pchip_passes_through_knots_and_stays_in_range(spark, ys):
    assert _curve(spark, ys, KNOTS) == pytest.approx(ys)
    values = _curve(spark, ys, list(range(0, 361)))
    for (a, b), (lo, hi) in zip(zip(KNOTS, KNOTS[1:]), zip(ys, ys[1:])):
        part = values[a : b + 1]
        steps = np.diff(part) * (1 if hi >= lo else -1)
        assert (steps >= -1e-12).all()
        assert min(part) >= min(lo, hi) - 1e-12 and max(part) <= max(lo, hi) + 1e-12


def test_pchip_slopes_by_hand(spark):
    ys = [0.0, 0.3, 0.6, 0.6, 1.0]
    df = spark.range(1).select(pchip.slopes(F.array(*[F.lit(y) for y in ys])).alias("d"))
    d = df.first()["d"]
    s = [0.01, 0.005, 0.0, 0.4 / 180]
    w1, w2 = 2 * 60 + 30, 60 + 2 * 30
    assert d[1] == pytest.approx((w1 + w2) / (w1 / s[0] + w2 / s[1]))
    assert d[2] == 0 and d[3] == 0
    assert d[0] == pytest.approx(((2 * 30 + 60) * s[0] - 30 * s[1]) / 90)
    end = ((2 * 180 + 90) * s[3] - 180 * s[2]) / 270
    assert d[4] == pytest.approx(end)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(
        vectors.dot(F.col("a"), F.col("b")), vectors.squared_distance(F.col("a"), F.col("b")), vectors.l2_normalize(F.col("a"))
    ).first()
    assert row[0] == 3.0 and row[1] == 20.0 and row[2] == pytest.approx([0.6, 0.8])
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<float>").select(vectors.l2_normalize(F.col("a"))).first()[0]
    assert zero == [0.0, 0.0]


def test_progress(spark):
    today = F.lit(datetime.date(2024, 1, 10))
    rows = [(0, 0, None, 5), (2, 2, datetime.date(2024, 1, 11), 9), (1, 2, datetime.date(2024, 1, 12), 9), (0, 3, None, 8)]
    df = spark.createDataFrame(rows, "done int, total int, date date, days int")
    finished = progress.is_finished(F.col("done"), F.col("total"))
    left = progress.days_remaining(F.col("date"), today, F.col("days"))
    out = df.select(
        progress.status(finished, left).alias("s"), left.alias("l"), progress.shown_total(F.col("total")).alias("t"),
        progress.percent(F.col("done"), F.col("total")).alias("p"),
    ).collect()
    assert [(r.s, r.l, r.t, r.p) for r in out] == [
        ("SOON", 5, 10, 0.0), ("FINISHED", 1, 2, 100.0), ("URGENT", 2, 2, 50.0), ("ON TRACK", 8, 3, 0.0)
    ]


@pytest.mark.parametrize(
    "answer, start, exact",
    [
        ("Here:\n```python\ndef two(a):\n    return a\n```", "def two(a):", "def two(a):\n    return a"),
        ("```\ndef hello():\n    pass\n```", "def hello():", None),
        ("def add(a, b):\n    return a + b", "def add", "def add(a, b):\n    return a + b"),
        ("```py\nclass Node:\n    pass\n```", "class Node:", "class Node:\n    pass"),
        ("", "", ""),
        ("```python\nopen = 1", "open = 1", "open = 1"),
        ("a ```py\nx```` b", "x", None),
    ],
)
def test_extract_code(values, answer, start, exact):
    (out,) = values([answer], code.extract_code(F.col("c")))
    assert out.startswith(start)
    assert exact is None or out == exact


def test_compile_reward(values):
    cases = {
        "def f(): return 1": (1, True, None),
        "def f(\n    return 1": (-1, False, "SyntaxError at line"),
        "class Foo:\n    pass": (1, True, None),
        "```python\ndef g(): return 2\n```": (1, True, None),
        "": (-1, False, "Empty code output."),
        "  \n": (-1, False, "Empty code output."),
        "``````": (-1, False, "Empty code."),
        "import os\nos.listdir('.')": (1, True, None),
        "def broken(:\n  pass": (-1, False, "SyntaxError at line 1"),
        "this is not code at all": (-1, False, "SyntaxError"),
        "(" * 5000 + ")" * 5000: (-1, False, ""),
        "x = 1\0": (-1, False, "SyntaxError"),
    }
    out = values(list(cases), code.compile_reward(F.col("c")))
    for got, (reward, compiled, error) in zip(out, cases.values()):
        assert (got["reward"], got["compiled"]) == (reward, compiled)
        assert got["error"] is None if error is None else got["error"].startswith(error)
