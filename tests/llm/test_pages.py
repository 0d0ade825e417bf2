"""Page extraction: what the site decides, and markup that is deep or broken."""

import time

import pytest

from preptrail.llm import extract

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_blocks_that_a_host_repeats_go_even_inside_an_article(spark):
    def page(i):
        own = f"<p>Own text {i} of this page.</p>" if i else ""
        return f"<body><article><h1>Title {i}</h1>{own}<p>Read our <b>weekly</b> letter.</p></article><div>Shop {i}</div></body>"

    rows = [(i, "http://a.org/x", page(i)) for i in range(1, 40)]
    rows += [(100 + i, f"http://b{i}.org/x", page(i)) for i in range(1, 30)]  # hosts of one page each
    rows += [(200 + i, "http://c.org/x", page(i) if i % 3 == 0 else f"<article><p>Other {i}</p></article>") for i in range(1, 40)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Title {i} Own text {i} of this page." for i in range(1, 40))
    assert all(got[100 + i].endswith("Read our weekly letter.") for i in range(1, 30))
    assert got[203].endswith("Read our weekly letter.")  # on a third of the host's pages only
    alone = [extract.main_text(u, h, set()) for i, u, h in rows if i < 100]
    assert all(text != got[i] for i, text in enumerate(alone, 1))  # without the tree the repeated block stays


def test_branches_that_a_host_repeats_go_where_no_main_text_is_marked(spark):
    page = "<body><div class=top><div>Same</div><div>words</div></div><div class=story><p>Story {0}</p><p>More {0}</p></div></body>"
    rows = [(i, "http://d.org", page.format(i)) for i in range(30)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Story {i} More {i}" for i in range(30)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<main><p>a</p><div class="social-science">b</div></main>', "a b"),
        ('<article><section class="alert-history">a</section><div class="notice-period">b</div></article>', "a b"),
        ('<article><p>a</p><div class="comment-list">b</div><div id="related-posts">c</div><div class="x ad">d</div></article>', "a"),
        ('<body class="has-header no-sidebar"><div class="page-header">a</div><p>b</p></body>', "b"),
        ('<article><p class="x>first</p><p>second <a href="y">link</a></p></article>', "first second link"),
        ("<article><p title='a > b'>x</p><p data-q=\"it's\">y</p><a href=/z/>z</a></article>", "x y z"),
        ("<p>a <!-- b", "a"),
        ("<p>a <b", "a"),
        ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
        ("<p>a<script>if (a<b) '</p>'</script>c<script>d", "ac"),
    ],
)
def test_markup(html, text):
    assert extract.main_text("http://a.org", html, set()) == text


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 5000 + "<article><p>text</p></article>",
        "".join(f"<div class=c{i}>" for i in range(5000)) + "<p>text",
        "<p>text</p>" + '<a "' * 250_000,
        "<p>text</p>" + '<p class="' * 100_000,
        "<p>text</p>" + "<a href='x" * 100_000,
        "<p>text" + "</div>" * 160_000,
        "<p>text" + "<center>" * 60_000 + "<h1></h1>" * 60_000,
    ],
)
def test_deep_and_broken_pages(spark, html):
    start = time.perf_counter()
    assert extract.main_text("http://a.org", html, set()) == "text"
    assert time.perf_counter() - start < 20  # a quadratic reading takes minutes
    if len(html) < 100_000:
        pages = spark.createDataFrame([(1, "http://a.org", html), (2, "http://a.org", None)], SCHEMA)
        assert [r.text for r in extract.extract(pages).orderBy("page_id").collect()] == ["text", ""]
