"""Column functions that clean text, names, links and numbers."""

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preptrail import schemas as S

# --- Fixed values -----------------------------------------------------------
# One corporate suffix at the end of a company name, removed up to three times.
SUFFIX_PATTERN = (
    r"\s*\b(inc\.?|llc\.?|ltd\.?|corp\.?|corporation|company|co\.?"
    r"|group|plc|gmbh|s\.?a\.?|n\.?v\.?|technologies|technology|software"
    r"|systems|solutions|services|consulting|labs?|,)\s*$"
)
SUFFIX_PASSES = 3
# A body whose exponents were lost ("10 5") has to be fetched again.
LOST_EXPONENT_PATTERN = r"10\s+[459]"
# Stands for removed markup until runs of it become one line break.
TAG_MARK = "\u0001"
# ---------------------------------------------------------------------------


def strip_space(c: Column) -> Column:
    """Trim all whitespace, newlines and tabs included (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_space(c), F.lit(""))


def normalize_company(name: Column) -> Column:
    out = strip_space(F.lower(name))
    for _ in range(SUFFIX_PASSES):
        out = strip_space(F.regexp_replace(out, "(?iU)" + SUFFIX_PATTERN, ""))
    return F.regexp_replace(out, r"(?U)\s+", " ")


def slug(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def url_key(url: Column) -> Column:
    """Case-folded link; null when empty, so that empty links never equal each other."""
    return F.nullif(F.lower(F.coalesce(url, F.lit(""))), F.lit(""))


def dedup_key(url: Column, row_id: Column) -> Column:
    """Key under which the first row wins: the link, or the row itself without a link."""
    return F.coalesce(F.concat(F.lit("u:"), url_key(url)), F.concat(F.lit("i:"), row_id.cast("string")))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Rest of a tag after its name; a quoted attribute value may hold ``>``.
TAG_REST = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+>"""
ANY_TAG = "<[a-zA-Z/]" + TAG_REST


def _outermost(markup: Column, tag: str) -> Column:
    """Markup without the ``<tag>`` and ``</tag>`` that stand inside another such element."""
    own = rf"<{tag}\b{TAG_REST}|</{tag}\s*>"
    # Each piece is a tag (or nothing) and what follows it.
    pieces = F.split(markup, rf"(?i)(?={own})")
    opens = rf"(?i)^<{tag}\b"
    state = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        opening, closing = piece.rlike(opens), piece.rlike(rf"(?i)^</{tag}\s*>")
        depth = F.when(opening, state["depth"] + 1).when(closing, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        inner = (opening & (state["depth"] > 0)) | (closing & (state["depth"] > 1))
        text = F.when(inner, F.regexp_replace(piece, rf"(?i)^(?:{own})", "")).otherwise(piece)
        return F.struct(depth.alias("depth"), F.concat(state["out"], F.array(text)).alias("out"))

    return F.aggregate(pieces, state, step, lambda state: F.array_join(state["out"], ""))


def _mark_elements(markup: Column, tag: str, mark: str) -> Column:
    """Turn every ``<tag>text</tag>`` into a text node of its own that starts with ``mark``.

    An element inside another one of its kind is part of the outer one's text. Texts without such a tag, most of
    them, are only searched for its name.
    """
    # Two opening tags without a closing one between them; other texts need no fold.
    nested = rf"(?i)<{tag}\b{TAG_REST}(?:[^<]++|<(?!/?{tag}\b))*+<{tag}\b"
    closing = rf"(?i)</{tag}\s*>"

    def rewrite(piece: Column) -> Column:
        halves = F.split(piece, closing, 2)
        inner = strip_space(F.regexp_replace(halves[0], ANY_TAG, ""))
        rest = F.coalesce(F.get(halves, 1), F.lit(""))
        return F.concat(F.lit("<x>" + mark), inner, F.lit("<x>"), rest)

    def marked(pieces: Column) -> Column:
        rewritten = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), rewrite)
        return F.concat(pieces[0], F.array_join(rewritten, ""))

    def split(text: Column) -> Column:
        flat = F.when(text.rlike(nested), _outermost(text, tag)).otherwise(text)
        return bound(F.split(flat, rf"(?i)<{tag}\b" + TAG_REST), marked)

    return bound(markup, lambda text: F.when(F.contains(F.lower(text), F.lit(f"<{tag}")), split(text)).otherwise(text))


def html_to_text(markup: Column) -> Column:
    """Plain text of an HTML body: text nodes joined by newlines, ``<sup>``/``<sub>`` as ^ and _.

    Markup is removed with built-in expressions. The text is then sent to Python once, because entity names come
    from the standard library's table.
    """
    c = F.regexp_replace(markup, r"(?s)<!\[CDATA\[(.*?)\]\]>", "<x>$1<x>")
    unseen = r"(?is)<!--.*?-->|<(script|style|template|rt|rp)\b[^>]*>.*?</\1\s*>|<[!?][^>]*>"
    c = F.regexp_replace(c, unseen, "<x>")
    c = _mark_elements(c, "sup", "^")
    c = _mark_elements(c, "sub", "_")
    c = F.regexp_replace(F.regexp_replace(c, ANY_TAG, TAG_MARK), TAG_MARK + "+", "\n")
    c = _unescape(c)
    c = F.regexp_replace(c, r"\n+([\^_])", "$1")
    c = F.regexp_replace(c, r"([\^_])\n+", "$1")
    return strip_space(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def needs_refetch(body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return (
        (body == "")
        | body.rlike("(?U)" + LOST_EXPONENT_PATTERN)
        | F.contains(body, F.lit("\n^"))
        | F.contains(body, F.lit("\n_"))
    )


def topic_list(topics: Column) -> Column:
    return F.split(topics, ", ")


def search_text(company: Column, title: Column, topics: Column, difficulty: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.coalesce(company, F.lit("Unknown")),
        F.coalesce(title, F.lit("")),
        F.coalesce(topics, F.lit("")),
        F.coalesce(difficulty, F.lit("")),
    )


def snippet(text: Column) -> Column:
    return F.coalesce(F.substring(text, 1, S.SNIPPET_CHARS), F.lit(""))


def description_or_title(description: Column, title: Column, difficulty: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), F.format_string("%s (%s)", title, difficulty))


def break_paragraphs(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{2,}", "</br>")


def size_rank(size_range: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in S.SIZE_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, size_range), F.lit(S.UNKNOWN_SIZE_RANK)).cast("double")


PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column) -> Column:
    """Plain decimal number or null, never an error, whatever the text holds. Suffixes and hexadecimal
    forms are no numbers; neither is an infinity, which would spoil means."""
    text = c.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def log_employees(count: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(number(count), F.lit(1.0)), F.lit(1.0)))


def founding_year(year: Column) -> Column:
    return F.coalesce(number(year), F.lit(float(S.DEFAULT_FOUNDING_YEAR)))


def founding_year_cold_start(year: Column) -> Column:
    """At cold start a year of zero also counts as unknown; in training it stays zero."""
    return founding_year(F.nullif(number(year), F.lit(0.0)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
