"""Main text of HTML pages by two passes of block rules."""



import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters and share of stop words from which a block is text, of its characters in links from which it is a menu,
#: and characters under which a block is too short to decide by itself.
LONG, STOPS_HIGH, STOPS_LOW, LINKS, SHORT = 140, 0.30, 0.12, 0.4, 70

# Common function words of the languages at hand, and names of parts of a page.
STOP_WORDS = frozenset(
    "the of and to in is it that for on as with was at by this are be from or an have not he she they we you his her which but had has were been their "
    "der die das und ist nicht ein eine zu den dem von mit für auf des im sich auch als an wie er sie es aus bei nach "
    "le la les de des un une et est que qui dans pour pas sur au avec ce il elle en du par plus "
    "el los las del que y en un una es se no por con para su al lo como más o".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("head script style noscript template svg math object iframe canvas audio video map datalist title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
APART_TAGS = frozenset("nav aside footer form menu dialog button select textarea label fieldset".split())
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer masthead topbar sidebar sidebars aside rail widget widgets related recommended share sharing social comment comments disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search pagination pager copyright legal skip toolbar".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _apart(tag: str, attrs: str, inside: bool) -> int:
    """2 for an element that is no part of the article by its tag or role, 1 by a word of its class or id only, else 0."""
    if tag in APART_TAGS or (tag == "header" and not inside):
        return 2
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in APART_ROLES or "display:none" in found.get("style", "").replace(" ", ""):
        return 2
    return int(bool(APART_NAMES.intersection(_NAME.findall(found.get("class", "") + " " + found.get("id", "")))))


def blocks(html: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters in links, set apart by its element as in _apart, heading, within an article) of each block, in page order.

    A main element, or the page's first article element, ends what the class words of a wrapper set apart.  A link ends at the
    next one and with the element that holds it; one that is never closed also ends at the next block.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    text: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # tag, hidden, apart, article, linked
    hidden = article = heading = linked = loose = seen = False
    apart = breaks = 0

    def flush() -> None:
        nonlocal breaks
        breaks = 0
        if text:
            whole = " ".join(unescape("".join(t for t, _ in text)).split())
            if whole:
                out.append((whole, sum(len(t.strip()) for t, in_link in text if in_link), apart, heading, article))
            text.clear()

    at, raw = 0, ""
    while at < len(html):
        if raw:
            m = re.compile(rf"</{raw}\b", re.I).search(html, at)
            end = m.start() if m else len(html)
            if not hidden:
                text.append((html[at:end], linked))
            at, raw = end, ""
            continue
        m = _TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at and not hidden:
            text.append((html[at:end], linked))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK_TAGS:
            flush()
            linked = linked and not loose
        elif tag == "br":
            breaks += 1
            text.append((" ", False))
        if closing:
            if tag == "a":
                linked = False
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                _, hidden, apart, article, linked = stack[k]
                del stack[k:]
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = False
            continue
        if tag in VOID_TAGS or m[0].endswith("/>") and tag not in BLOCK_TAGS:
            continue
        if tag == "p":  # a paragraph ends at the next one
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "div", "article", "section", "td", "body")), None)
            if k is not None and stack[k][0] == "p":
                _, hidden, apart, article, linked = stack[k]
                del stack[k:]
        if tag == "a":
            following = _LINK.search(html, at)
            linked, loose = True, not (following and following[1])
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS or tag in APART_TAGS:
            stack.append((tag, hidden, apart, article, linked))
            hidden = hidden or tag in HIDDEN_TAGS
            if tag == "body":
                hidden = False
            if apart == 1 and (tag == "main" or tag == "article" and not seen):
                apart = 0
            article = article or tag in ("article", "main")
            seen = seen or article
            apart = max(apart, _apart(tag, m[3], article))
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
        if tag in RAW_TAGS:
            raw = tag
    flush()
    return out


def main_blocks(html: str) -> list[str]:
    """Blocks of the article, by two passes.

    First pass: an element set apart, or a block mostly of links, is dropped; a long enough block with many stop words is text;
    a block in an article element needs few of them; other blocks are open.  Second pass: an open block takes the label of its
    nearest decided neighbours, of two different ones that of the nearer, at equal distance text; a heading follows
    the next decided block.  Without any decided block, open blocks of an article element are text.  A page that would be left
    without text is read again with what only class words set apart.
    """
    found = blocks(html)
    return _chosen(found) or _chosen([(text, links, int(apart == 2), *rest) for text, links, apart, *rest in found])


def _chosen(found: list[tuple[str, int, int, bool, bool]]) -> list[str]:
    label: list[int] = []  # 1 text, -1 not, 0 open
    for text, linked, apart, heading, article in found:
        words = _WORD.findall(text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if apart or linked > LINKS * len(text):
            label.append(-1)
        elif heading:
            label.append(0)
        elif article and (len(text) >= SHORT or stops >= STOPS_LOW):
            label.append(1)
        elif len(text) < SHORT:
            label.append(0)
        elif stops >= STOPS_HIGH or (len(text) >= LONG and stops >= STOPS_LOW):
            label.append(1)
        else:
            label.append(-1 if stops < STOPS_LOW / 2 and len(text) >= SHORT else 0)
    n = len(found)
    before, after = [(0, n + 1)] * n, [(0, n + 1)] * n  # label of the nearest decided block and its distance
    for span, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = (0, n + 1)
        for i in order:
            # blocks set apart tell nothing about an article element's own blocks
            span[i] = last
            if label[i] == 1 or label[i] == -1 and not found[i][2]:
                last = (label[i], 1)
            elif last[0]:
                last = (last[0], last[1] + 1)
    keep = []
    for i, (text, _, apart, heading, article) in enumerate(found):
        v = label[i]
        if not v:
            (b, db), (a, da) = before[i], after[i]
            if heading and a:
                v = a
            elif a and b and a != b:
                v = (a if da < db else b) if da != db else 1
            else:
                v = a or b or (1 if article else -1)
        if v == 1:
            keep.append(text)
    return keep


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, blocks joined by an empty line.

    Character references are decoded, white space inside a block becomes one space.  Null and empty pages give an
    empty text; broken markup is read to its end.  Null ids, repeated rows and null addresses pass as they are.
    Whole pages are read.  Other columns are neither read nor returned.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:  # noqa: ANN202
        for b in batches:
            yield b.map(lambda h: "\n\n".join(main_blocks(h)) if h else "")

    text = F.pandas_udf(run, "string")(F.coalesce(F.col(html_col), F.lit("")))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
