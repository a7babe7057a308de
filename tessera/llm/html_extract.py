"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines, one per block element, in page order. A line weighs its text outside links, with character
references and white space resolved; in an <article> or <main> links weigh like other text. Weights of all lines are summed
over sliding windows: a window whose sum surges from nothing opens a stretch of text at its first line with weight, and one
whose sum dives to nothing closes it after the last such line. All lines between are kept, short ones and links too; those
outside all stretches, such as unmarked menus, go. A page may have many stretches, and no text is too short for one.

Markup only lowers weights. Lines that it marks as what an article is not (menus, footers, adverts, forms, reader comments,
...) weigh nothing and are never kept. Weaker hints (a class like legal or login) take the weight away outside <article> and
<main>, unless most of the page's text bears them, and the distribution decides: between lines of text such a line stays, at
the border of a stretch it goes.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

#: Lines of a window; so many weightless lines in a row are a dive.
WINDOW = 3

# HTML elements by their role (HTML Living Standard).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search fieldset".split())
DROPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist option".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark what an article is not, wherever they stand between hyphens.
SIGNS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|site-head(?:er)?|page-header|site-foot(?:er)?|page-footer|cookies?|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|signup|sign-up|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommended|read-more|pagination|pager|skip-link)(?:$|[\s_-])", re.I)
#: Words that an article's own parts bear, too; a class that starts like OWN (article-header) does not count.
HINTS = re.compile(r"(?:^|[_-])(?:header|footer|masthead|banner|login|widget|toolbar|copyright|legal|disclaimer|imprint)(?:$|[_-])", re.I)
OWN = re.compile(r"(?:article|entry|post|story|content|text|section|chapter|news|blog)[_-]", re.I)
#: An article is a reader comment or an advert only by a whole word of its class or id: themes put topics and settings there too (category-legal, comments-open).
ASIDES = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promos comment comments reply replies respond related recommended".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

# a quote opens a value only after "="; elsewhere, as in title=it's, it is a character
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[=\"'])*)>?|([^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
RAW_END = {t: re.compile(rf"</{t}\s*>?", re.I) for t in RAW}
SPACE = re.compile(r"[\s​﻿]+")


MARKED, HINTED = 2, 1


def _mark(tag: str, attrs: str, in_article: bool) -> int:
    """What an element says of its lines: MARKED as no part of an article, HINTED so, or 0."""
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return MARKED
    if not attrs or tag in ("html", "body", "main"):
        return 0
    found = [(name.lower(), a or b or c, hidden) for name, a, b, c, hidden in ATTR.findall(attrs)]
    if tag == "article":
        return MARKED if any(name in ("class", "id") and not ASIDES.isdisjoint(value.lower().split()) for name, value, _ in found) else 0
    out = 0
    for name, value, hidden in found:
        if hidden or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES or name in ("class", "id") and SIGNS.search(value) or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return MARKED
        if name in ("class", "id") and not in_article and any(HINTS.search(word) and not OWN.match(word) for word in value.split()):
            out = HINTED
    return out


def _resolved(text: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(text))).strip()


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, mark) of every block line with text."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, mark from here on, article from here on
    text: list[str] = []
    plain: list[str] = []  # the text, with a blank for what is in links
    links = 0  # open links
    bad, article = 0, False
    open_: Counter = Counter()  # of the stack, so that an end tag of nothing costs nothing

    def flush() -> None:
        nonlocal text, plain
        if text:
            joined = _resolved(text)
            if joined:
                out.append((joined, 0 if bad == MARKED else len(joined) if article or text == plain else len(_resolved(plain)), bad))
            text, plain = [], []

    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if m[4] is not None:
            text.append(m[4])
            plain.append(" " if links else m[4])
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in RAW_END:
                end = RAW_END[tag].search(page, pos)
                pos = end.end() if end else n
                continue
            if tag in DROPPED:
                depth = re.compile(rf"</{tag}\s*>", re.I).search(page, pos) if tag != "head" and tag != "option" else None
                if depth:
                    pos = depth.end()
                continue
            if tag == "br":
                text.append(" ")
                plain.append(" ")
                continue
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links += 1
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                open_["p"] -= 1
            stack.append((tag, bad, article))
            open_[tag] += 1
            if tag in ("article", "main") and bad != MARKED:
                article, bad = True, 0
            bad = max(bad, _mark(tag, m[3], article))
        else:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    _, bad, article = stack[k]
                    open_.subtract(t for t, _, _ in stack[k:])
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:  # a stray inline end tag closes no block
                    break
    flush()
    return out


def stretches(weight: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which lines stand in a stretch of text: from the first line with weight of a window whose sum surges from nothing to
    the last one before the sum dives to nothing again."""
    n = len(weight)
    sums = np.convolve(weight > 0, np.ones(width, int))  # sums[i]: lines i - width + 1 to i
    inside = np.r_[False, sums > 0, False]
    surge, dive = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    out = np.zeros(n, bool)
    for s, d in zip(surge, dive):  # the surging window ends with its first weight, the diving one begins after its last
        out[s : d - width + 1] = True
    return out


def main_text(page: str | None) -> str:
    """Null, empty and textless pages give an empty text."""
    got = lines(page or "")
    if not got:
        return ""
    weight, mark = np.array([w for _, w, _ in got]), np.array([m for _, _, m in got])
    hinted = mark == HINTED
    if weight[hinted].sum() <= weight[~hinted].sum():  # else the page is what it is hinted to be about
        weight[hinted] = 0
    inside = stretches(weight) & (mark != MARKED)
    return "\n".join(text for (text, _, _), here in zip(got, inside) if here)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) with text and n_chars instead of html; one row per page, other columns kept.

    Pages are read whole, however long, and one by one, whether their keys are null or repeat. Columns of pages named text or
    n_chars are replaced. Empty input: no rows.
    """
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(*others).withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).limit(0)
    kinds = ", ".join(f"`{c}` {k}" for c, k in schema.dtypes)

    def one(batch):
        texts = [main_text(h.as_py()) for h in batch.column(len(others))]
        return {c: batch.column(i) for i, c in enumerate(others)} | {"text": pa.array(texts, pa.string()), "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))}

    return arrow_map(pages.select(*others, "html"), one, kinds)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
