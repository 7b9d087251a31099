"""Main text of web pages by line-block distribution.

Markup is stripped to lines (blocks). A line weighs the length of its text, or nothing if it lies in an element that is
never part of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments); outside an
``article`` or ``main`` element link text weighs nothing. Weights are summed over sliding windows of lines: a stretch of
text begins where the sum surges from zero, or an article begins, and ends where it dives to zero, or the article ends.
The stretch with the largest window sum, which an article doubles, tells where the text is: if inside an article, all
stretches inside articles are kept, else those outside that reach a share of its sum.

Null, empty and textless pages give the empty string. The work is linear in the length of a page, whatever its markup.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Lines of a window; share of the strongest window sum that a stretch outside articles must reach.
WINDOW, LEAST_SHARE = 3, 0.05
RAW = "script|style|textarea|noscript|template|title|svg|iframe|object|math"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>", re.S | re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split())
BREAKS = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog footer form head header input menu nav select".split())
DROPPED_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent "
    "contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices popup "
    "promo promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split())
#: What follows such a word in the name of an element that holds nothing else ("share-buttons", "ad_slot").
HOLDERS = frozenset(
    "area bar block body box button buttons col column container content form group holder icons inner item items link links list main "
    "message overlay panel policy posts row section slot stories text thread top bottom left right unit widget wrap wrapper".split())
NEGATIONS = frozenset("no non without has with hide hides is".split())
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
#: Elements of running text: an id is an anchor there, and only the whole of a class name counts.
RUNNING = frozenset("p span li td th dt dd blockquote pre code em strong b i u a small".split())
NO_MARKS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())


def _names_dropped(mark: str, whole: bool) -> bool:
    """A class, id or role whose name says that the element is no part of the text.

    The name is one of DROPPED_WORDS, ends with one ("site-header", but not "no-sidebar"), or is one before words for holders.
    """
    words = [w for w in re.split(r"[^a-z0-9]+", mark) if w]
    if whole or len(words) < 2:
        return mark in DROPPED_WORDS
    if words[0] in NEGATIONS:
        return False
    return words[-1] in DROPPED_WORDS or words[0] in DROPPED_WORDS and all(w in HOLDERS or w in DROPPED_WORDS or w.isdigit() for w in words[1:])


def _dropped(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and inside)  # an article's own header holds its title
    if name in NO_MARKS or not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*+:\s*+none", value):
            return True
        if key in ("class", "role") or key == "id" and name not in RUNNING:
            if any(_names_dropped(mark, name in RUNNING) for mark in value.split()):
                return True
    return False


def _markup_end(page: str) -> int:
    """Tags end at the last ``>`` at the latest; what follows is text."""
    return page.rfind(">") + 1


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length of text outside links, inside an article) of every block; dropped ones are empty."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = inside = depth = 0
    skip = ""
    plain = 0

    def close() -> None:
        nonlocal parts, plain
        text = " ".join(html.unescape("".join(parts)).split())
        out.append((text, plain, inside > 0))
        parts, plain = [], 0

    at, limit, raw = 0, _markup_end(page), False
    for m in TOKEN.finditer(page, 0, limit):
        text = page[at : m.start()]
        at = m.end()
        if text and not skip:
            parts.append(text)
            if not linked:
                plain += len(text.strip())
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            raw = m.end() == limit and bool(m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0][-40:], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->"))
            continue
        end = bool(m[2] or m[5])
        if skip:
            # an unclosed element ends where the article or, for a paragraph, the next block begins
            if not end and (name in ("article", "main") or skip == "p" and name in BLOCKS):
                skip = ""
            elif end and name in ("article", "main", "body"):
                skip = ""
            elif name == skip:
                depth += -1 if end else 1
                if not depth:
                    skip = ""
                continue
            else:
                continue
        if name in BLOCKS:
            close()
        elif name in BREAKS:
            parts.append(" ")
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if end else 1))
        elif name == "a":
            linked = 0 if end else 1
        if not end and name not in VOID and _dropped(name, m[4] or m[7] or "", inside > 0):
            if name not in BLOCKS:
                parts.append(" ")
            skip, depth = name, 1
    if not skip and not raw:
        rest = page[at:]
        if "<!--" in page[limit:]:
            rest = page[at : page.index("<!--", limit)]  # a comment that never ends
        parts.append(rest)
        plain += len(rest.strip())
    close()
    return out


def stretches(rows: list[tuple[str, int, bool]]) -> list[tuple[int, int, int, bool]]:
    """(first line, line after the last, largest window sum, inside an article) of every stretch of text."""
    out, start, peak, side = [], None, 0, False
    weight = [len(t) if inside else plain for t, plain, inside in rows]
    window = 0
    for k, (_, _, inside) in enumerate(rows):
        if start is not None and inside != side:
            out.append((start, k, peak, side))  # the edge of an article is a dive and a surge
            start, window = None, 0
        first = max(0 if start is None else start, k - WINDOW + 1)
        window = sum(weight[first : k + 1]) if start is not None else weight[k]
        if window and start is None:
            start, peak, side = k, 0, inside  # surge
        elif not window and start is not None:
            out.append((start, k, peak, side))  # dive
            start = None
        peak = max(peak, window * 2 if inside else window)
    if start is not None:
        out.append((start, len(rows), peak, side))
    return out


def main_text(page: str) -> str:
    rows = lines(page)
    found = stretches(rows)
    if not found:
        return ""
    top = max(found, key=lambda s: s[2])
    kept = [s for s in found if s[3] == top[3] and (top[3] or s[2] >= LEAST_SHARE * top[2])]
    return "\n".join(rows[k][0] for a, b, _, inside in kept for k in range(a, b) if rows[k][0] and (inside or rows[k][1]))


@pandas_udf(StringType())
def extracted(pages: pd.Series) -> pd.Series:
    """Main text of each page, blocks joined by a line end; empty for null, empty or textless pages."""
    return pages.map(lambda p: main_text(p) if p else "")
