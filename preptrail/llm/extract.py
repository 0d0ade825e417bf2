"""Main text of web pages by site style trees: the pages of a host are merged, and branches whose
presentation and content hardly vary between them are removed."""

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.llm.columns import records
from preptrail.session import cut_lineage

THRESHOLD = 0.5
GAMMA = 0.9
#: An unseen branch counts as important on as many pages.
PRIOR_PAGES = 8

#: Element names of HTML and words that sites use in class and id.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
UNSEEN = set("head title script style noscript template iframe object svg canvas audio video math".split())
NOISE = set("nav header footer aside form button select option textarea input menu dialog fieldset".split())
MAIN = set("article main".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe signup share sharing social related recommended comment comments reply "
    "replies respond discussion disqus form search login skip".split()
)
#: Words that say where or what an element is, not what it is about: a name made of these and of noise words is noise.
PLACE_WORDS = set(
    "area bar block bottom box btn button buttons column container content custom fixed global icons inner item items left "
    "link links list main page panel post posts primary right secondary section site slot small sticky top widget wrap "
    "wrapper".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert dialog".split())
NEVER_BY_WORD = set("html body article main h1 h2 h3 h4 h5 h6".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
PLAIN = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption tr td th tbody thead tfoot".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Content that is no text ends with the element; other tags end at a ``>`` outside quoted values.
RAW = set("script style title textarea noscript iframe".split())
NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
AFTER_VALUE = set(" \t\n\r\f/>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(eq=False)
class Node:
    """A block element: its place in the tree, and the keys of its children and texts in order."""

    tag: str
    path: int
    prior: float | None  # 0: noise by name, 1: main text by name, None: the site decides
    parent: "Node | None" = None
    children: list[str] = field(default_factory=list)
    #: Element names of interest among its own and those around it, and whether a paragraph is still open.
    within: frozenset[str] = frozenset()
    in_paragraph: bool = False


#: Elements that a node knows to be around it, and those that keep a paragraph around them open.
AROUND = MAIN | UNSEEN
PARAGRAPH_STOPS = set("td th li div article section main blockquote".split())


def noisy(name: str) -> bool:
    """Whether a word of a class or id names noise: a noise word, alone or among words for places.

    ``comment-list`` and ``page-header`` do, ``social-science``, ``notice-period`` and ``no-sidebar`` do not.
    """
    parts = set(re.split(r"[^a-z]+", name)) - {""}
    return bool(parts & NOISE_WORDS) and parts <= NOISE_WORDS | PLACE_WORDS


def _prior(tag: str, names: set[str], roles: set[str], parent: Node) -> float | None:
    if tag in UNSEEN:
        return 0.0
    in_main = bool(parent.within & MAIN)
    if tag in NOISE and not (tag == "header" and in_main):
        return 0.0
    if tag not in NEVER_BY_WORD and not (tag == "header" and in_main) and (any(map(noisy, names)) or roles & NOISE_ROLES):
        return 0.0
    if tag == "article" and "article" in parent.within:
        return 0.0  # an article inside an article is a comment
    return 1.0 if tag in MAIN else None


def _inside(node: Node | None, tags: set[str]) -> bool:
    return node is not None and bool(node.within & tags)


def _tag_end(page: str, at: int) -> int:
    """Where the tag that is read up to ``at`` ends, after its ``>``; -1 if it never does.

    A quoted value ends at its quote if white space, a slash or the tag's end follows it; else the quote was
    never closed and counts as a character.
    """
    while found := VALUE_OR_END.search(page, at):
        at = found.end()
        if found[1] is None:
            return at
        closed = page.find(found[1], at)
        if closed >= 0 and page[closed + 1 : closed + 2] in AFTER_VALUE:
            at = closed + 1
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """``start, end, name, close, attributes`` of each stretch of a page that is no text; the name is None for
    comments, declarations and elements whose content is no text. Each character is passed a bounded
    number of times; markup that never ends reaches to the end of the page."""
    at, last = 0, page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        name = NAME.match(page, start)
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, None, False, ""
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            yield start, at, None, False, ""
        elif name:
            close, tag = page[start + 1] == "/", name[1].lower()
            end = _tag_end(page, name.end()) if name.end() <= last else -1
            at = len(page) if end < 0 else end
            if tag in RAW and not close and end >= 0:
                closing = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = closing.end() if closing else len(page)
                yield start, at, None, False, ""
            else:
                yield start, at, tag if end >= 0 else None, close, page[name.end() : at - 1]


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The blocks of text of a page in order, each with the element that holds it, and all elements."""
    root = Node("html", 0, None)
    nodes, blocks, stack, run = [root], [], [root], []
    open_ = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            stack[-1].children.append("#")
            blocks.append((stack[-1], text))

    def pop(ending: set[str], stop: set[str]) -> None:
        if not any(open_[tag] for tag in ending):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ending:
                flush()
                open_.subtract(node.tag for node in stack[depth:])
                del stack[depth:]
                return
            if stack[depth].tag in stop:
                return

    at = 0
    for start, end, tag, close, attributes in tags(page):
        run.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            continue
        if tag == "br" or tag in VOID:
            run.append("\n")
            continue
        if close:
            if tag not in ("html", "body"):
                pop({tag}, set())
            continue
        flush()
        if tag in ("html", "body", "head"):
            continue
        if tag in CLOSES_P and stack[-1].in_paragraph:
            pop({"p"}, PARAGRAPH_STOPS)
        if tag in SAME_KIND:
            pop(SAME_KIND[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        names, roles = set(), set()
        for name, one, two, three in ATTRIBUTE.findall(attributes):
            (roles if name.lower() == "role" else names).update((one or two or three).lower().split())
        parent = stack[-1]
        # Numbers in names tell elements of a kind apart, not kinds.
        kinds = sorted({re.sub(r"[^a-z]+", "-", n).strip("-") for n in names} - {""})
        key = f"{tag}.{'.'.join(kinds)}" if kinds else tag
        within = parent.within | {tag} if tag in AROUND else parent.within
        in_paragraph = tag == "p" or (parent.in_paragraph and tag not in PARAGRAPH_STOPS)
        node = Node(tag, _key(str(parent.path), key), _prior(tag, names, roles, parent), parent, [], within, in_paragraph)
        parent.children.append(key)
        nodes.append(node)
        if not attributes.rstrip().endswith("/") or tag in ("p", "div"):
            stack.append(node)
            open_[tag] += 1
    run.append(page[at:])
    flush()
    return blocks, nodes


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", url or "", re.I)
    return found[1].lower() if found else ""


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page adds to its host's tree: for each element its style (the children's keys), for each
    open element the distinct blocks of text up to ``REACH`` levels inside it, and each block by itself.
    Paragraphs of a main text are no branches, only their texts are nodes."""
    schema = pa.schema([("site", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())])
    for batch in batches:
        out: dict[str, list] = {name: [] for name in schema.names}
        for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks, nodes = parse(page or "")
            site = host(url)
            seen = {(site, _key(site), STYLE, 0)}
            branches = {id(n): _key(site, str(n.path)) for n in nodes if _is_branch(n)}
            for node in nodes:
                if id(node) in branches:
                    seen.add((site, branches[id(node)], STYLE, _key(*_squeezed(node.children))))
            for node, text in blocks:
                seen.add((site, _block_key(site, node, text), BLOCK, 0))
                feature, levels = _key(text), 0
                while node is not None and levels < REACH:
                    if id(node) in branches:
                        seen.add((site, branches[id(node)], CONTENT, feature))
                    node, levels = node.parent, levels + 1
            for row in seen:
                for name, value in zip(schema.names, row, strict=True):
                    out[name].append(value)
        yield records(out, schema)


def _block_key(site: str, node: Node, text: str) -> int:
    return _key(site, str(node.path), text)


def _is_branch(node: Node) -> bool:
    """Whether the site decides on an element: any, but for the paragraphs of a main text."""
    return node.parent is not None and not (node.tag in PLAIN and _inside(node, MAIN))


#: Kinds of features, and the levels below a branch whose texts are its content.
STYLE, CONTENT, BLOCK = 0, 1, 2
REACH = 32


def _squeezed(keys: list[str]) -> list[str]:
    return [k for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]


def site_trees(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts, a row per node: ``pages`` with it, entropies' parts of its styles and of the
    texts in it, and for a block of text the number of pages that have it at this place.

    A host's root has ``root_pages``, all its pages. Blocks on few pages are no part of any template and are
    left out before nodes are summed up.
    """
    features = pages.select("url", "html").mapInArrow(_features, "site string, node long, kind int, feature long")
    counted = features.groupBy("site", "node", "kind", "feature").agg(F.count("*").alias("n"))
    counted = counted.filter((F.col("kind") != BLOCK) | (2 * F.col("n") > PRIOR_PAGES))
    style, content = F.col("kind") == STYLE, F.col("kind") == CONTENT
    return counted.groupBy("site", "node").agg(
        F.max(F.when(style & (F.col("feature") == 0), F.col("n"))).alias("root_pages"),
        F.max(F.when(F.col("kind") == BLOCK, F.col("n"))).alias("block_pages"),
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("style_logs"),
        F.count(F.when(style, 1)).alias("styles"),
        F.count(F.when(content, 1)).alias("blocks"),
        F.coalesce(F.sum(F.when(content, F.log("n"))), F.lit(0.0)).alias("block_logs"),
    )


def importance() -> Column:
    """Of a branch of a host's merged tree, from the columns of ``site_trees``.

    Presentation: the entropy of the branch's styles over the pages that have it. Content: one less the
    mean entropy of its blocks of text over these pages. The more styles, the more presentation counts.
    """
    scale = F.log("pages")
    node = (scale - F.col("style_logs") / F.col("pages")) / scale
    own = F.when(F.col("blocks") > 0, 1 - F.col("block_logs") / F.col("blocks") / scale).otherwise(0.0)
    share = F.pow(F.lit(GAMMA), F.col("styles"))
    seen = F.when(F.col("pages") > 1, (1 - share) * node + share * own).otherwise(1.0)
    return (F.col("pages") * seen + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)


def low_nodes(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``site, node``: branches whose importance is below ``threshold``, and the blocks of text that a host
    repeats.

    These are the same words at the same place of the tree on more than half of the host's pages and
    ``PRIOR_PAGES`` others. Their entropy over the pages is near the largest there is, so they say next to
    nothing about a page, also inside a main text.
    """
    is_root, is_block = F.col("root_pages").isNotNull(), F.col("block_pages").isNotNull()
    trees = site_trees(pages).withColumn("importance", F.when(~is_root & ~is_block, importance()))
    few = trees.filter(is_root | is_block | (F.col("importance") < threshold))
    few = cut_lineage(few.select("site", "node", "root_pages", "block_pages"), "nodes")
    branches = few.filter(~is_root & ~is_block).select("site", "node")
    sites = few.filter(is_root).select("site", F.col("root_pages").alias("all"))
    blocks = few.filter(is_block).select("site", "node", "block_pages").join(sites, "site")
    return branches.union(blocks.filter(2 * F.col("block_pages") > F.col("all") + PRIOR_PAGES).select("site", "node"))


def main_text(url: str | None, page: str | None, low: set[int]) -> str:
    """Text of the page's blocks without noise and without the branches and blocks in ``low``.

    Elements that are noise by name go, but for the main texts in them, see ``_spared``; an article or
    main element, where the page has one, holds the text, and it is never a low branch. A block of text
    that is low goes wherever it is. Where all of a page is low, as on a host of copies, nothing low is
    removed. Where a main element holds no other text, the articles in it are main texts, too.
    """
    blocks, nodes = parse(page or "")
    site = host(url)
    mains = [n for n in nodes if n.prior == 1.0 and not _inside(n, UNSEEN)]
    has_main = bool(mains)
    outermost = _spared([n for n in mains if not _inside(n.parent, MAIN)])
    leading: set[int] = set()
    for node in (n for n in nodes if n.prior == 1.0):
        while node is not None and id(node) not in leading:
            leading.add(id(node))
            node = node.parent

    def kept(low: set[int], spared: set[int]) -> str:
        verdict: dict[int, tuple[bool, bool]] = {id(None): (True, not has_main)}  # keep, inside main
        for node in nodes:  # each after its parent
            keep, inside = verdict[id(node.parent)]
            if id(node) in spared:
                keep = True
            elif node.prior == 0.0:
                keep = False
            elif keep and low and node.prior is None and _is_branch(node) and _key(site, str(node.path)) in low:
                keep = id(node) in leading
            verdict[id(node)] = keep, inside or node.prior == 1.0
        return " ".join(t for node, t in blocks if all(verdict[id(node)]) and not (low and _block_key(site, node, t) in low))

    text = kept(low, outermost) or kept(set(), outermost)
    return text or kept(set(), _spared([n for n in mains if n.tag == "article" and _inside(n, {"main"})]))


def _spared(mains: list[Node]) -> set[int]:
    """The main texts that stay whatever the elements around them are called: a main element, and the
    articles with the fewest elements around them that are noise by name. An article with more of them
    is a comment or a teaser beside the text."""

    around: dict[int, int] = {id(None): 0}  # noise names around an element and its own

    def noise(node: Node | None) -> int:
        way = []
        while id(node) not in around:
            way.append(node)
            node = node.parent
        for inner in reversed(way):
            around[id(inner)] = around[id(inner.parent)] + (inner.prior == 0.0)
        return around[id(way[0] if way else node)]

    counts = {id(n): 0 if n.tag == "main" else noise(n.parent) for n in mains}
    least = min(counts.values(), default=0)
    return {i for i, n in counts.items() if n == least}


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page of ``page_id, url, html``.

    Blocks of text have character references decoded and white space turned into single spaces, and are
    joined by one space in page order. Branches of the host's merged tree below ``threshold`` and the blocks
    that it repeats on most pages go, see ``low_nodes`` and ``main_text``; menus, headers, footers, forms and
    the like also go by name, so that a page alone on its host is cleaned, too.

    A null or empty page has the empty text; a null url belongs to the nameless host. Repeated rows each
    count as a page, null ids are kept, an empty table gives no rows, other columns are ignored.

    Broken markup has a defined end, see ``tags``, and elements may be nested to any depth.

    Only the low nodes are gathered by host; a host's template has few. Its pages are never gathered.
    """
    named = pages.select("page_id", "url", "html")

    low = cut_lineage(low_nodes(named, threshold).groupBy("site").agg(F.collect_list("node").alias("low")), "low")
    site_of = F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    joined = named.withColumn("site", site_of).join(low, "site", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for batch in batches:
            ids, urls, htmls, lows = (c.to_pylist() for c in batch.columns)
            texts = [main_text(u, h, set(low or ())) for u, h, low in zip(urls, htmls, lows, strict=True)]
            yield records({"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
