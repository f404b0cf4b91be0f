"""Main text of web pages by line-block distribution.

The markup is stripped into lines: a block element starts a new line, inline
elements do not.  Each line has a length, weighted by what the markup says
about it.  The text lengths are summed over sliding windows of ``window``
lines; a surge point is the first line whose window reaches ``surge``, the
dive point is where the window sum has fallen to nothing.  The text between a
surge and its dive is kept.

Lines inside boilerplate elements are left out: by element name, by the
attribute or class hidden, or by a whole role, class, id or aria-label token
that names a region ('sidebar', 'cookie-notice', 'main-nav'; not
'has-sidebar').  The words for reader comments and adverts may have any others
beside them ('reader-comments', 'advert-unit'), but for those of a state
('comments-open').  Names of headings and inline elements are not read.  A name on an ancestor, or a form around it, does not
take an article or main element away.

There are four regions: article and main elements; containers named like
content; articles inside a named boilerplate element; the rest.  Each is cut
by surge and dive points, and the region with the largest sum of kept
characters wins, those of articles counting four times and those of named
containers twice.  So a teaser card does not win over the text of the page,
nor a long footer over a short article.

Weights: in a marked region a line's characters are scaled by ``surge``, so
that a short paragraph is a surge, and the window slides over the region's
lines only: what makes a dive there is ``window`` or more lines in a row that
read like a menu, links for more than four fifths and of at most ``LABEL``
words each.  A list of sources has longer lines and stays.  In the rest a line
counts what its other characters exceed its linked ones by.  All lines between
a surge and its dive are kept, whatever their own weight.  Headings are text,
linked or not.  If no region has a surge, the marked lines are taken with their
links; on a page without marks the largest block sum is the surge, however
small, so a page of one short paragraph has its text.

Defined results: null or empty html, or a page without main text, gives the
empty text with 0 characters.  Broken markup is tolerated: unclosed elements
end with their parent or the page, a cut-off tag, comment or script ends the
page.  Texts are never cut.  Repeated rows are extracted each; other columns
are not read.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<\Z"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Most words of a line of links that reads like a menu.
LABEL = 3

# fixed values: element names of HTML and the usual names of page regions
_RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
                    "s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr li main nav ol p pre section table ul".split())
_BOILERPLATE = frozenset("nav footer aside form button menu dialog audio video input datalist optgroup option".split())
_BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion "
                       "sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
                       "commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay "
                       "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
                       "pagination pager copyright complementary contentinfo search form toolbar skip".split())
_HEAD_WORDS = frozenset("header head".split())
#: Words that name reader comments and adverts beside any other, but for words of a state.
_ALWAYS = frozenset("comment comments commentlist disqus discussion discussions advert adverts advertisement advertisements advertising".split())
_STATES = frozenset("has no not with without is are show hide open closed on off enabled disabled allowed count free less".split())
#: Words that a name of a region may have besides: 'site-footer', 'comment-list', 'ad-slot'.
_BESIDE = frozenset("site page main global primary secondary left right top bottom upper lower inner outer sticky post entry article list box "
                    "block container wrapper wrap area bar section region zone slot links items buttons posts form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN_WORDS = frozenset("article content main maincontent post entry story".split())


def _names(attrs: str) -> list[list[str]]:
    """The words of each class, id, role and itemprop token; an aria-label is one token."""
    out = []
    for m in _NAMES.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        out += [re.findall("[^-_:.\\s]+", t) for t in ([value] if m[1].lower() == "aria-label" else value.split())]
    return out


def _names_region(token: list[str], words: frozenset[str]) -> bool:
    return any(w in words for w in token) and all(w in words or w in _BESIDE or w.isdigit() for w in token)


def _hidden(attrs: str) -> bool:
    """Hidden by an attribute of its own, by its style, or by a class of that name."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    for m in _ATTRIBUTE.finditer(low):
        name, value = m[1], m[2] or m[3] or m[4] or ""
        if (name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "class" and "hidden" in value.split()
                or name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _names_strangers(token: list[str]) -> bool:
    """Reader comments or adverts, whatever stands beside the word."""
    return any(w in _ALWAYS for w in token) and not any(w in _STATES for w in token)


# what an element opens, and the region that holds in it
_HARD, _FORM, _SOFT, _REST, _ARTICLE, _CONTAINER, _IN_SOFT, _IN_CONTAINER = -3, -2, -1, 0, 1, 2, 3, 4


def _kind(tag: str, attrs: str, in_main: bool) -> int:
    """Boilerplate by element (_HARD), form (_FORM) or name (_SOFT), _ARTICLE, _CONTAINER, or _REST for neither."""
    if attrs and _hidden(attrs):
        return _HARD
    if tag in ("html", "body"):
        return _REST
    if tag in _BOILERPLATE:
        return _FORM if tag == "form" else _HARD
    names = _names(attrs) if attrs and tag not in _INLINE and tag not in _HEADINGS else []
    if tag == "main":
        return _ARTICLE
    if any(_names_region(t, _BAD_WORDS) or _names_strangers(t) for t in names):
        return _SOFT
    if not in_main and (tag == "header" or any(_names_region(t, _HEAD_WORDS) for t in names)):
        return _SOFT
    if tag == "article":
        return _ARTICLE
    return _CONTAINER if tag in ("div", "section", "td") and any(w in _MAIN_WORDS for t in names for w in t) else _REST


def _inside(region: int, kind: int) -> int:
    """The region in an element of this kind that lies in ``region``."""
    if kind == _REST or region == _HARD:
        return region
    if region == _SOFT:
        return {_HARD: _HARD, _ARTICLE: _IN_SOFT}.get(kind, _SOFT)
    if kind < 0 or region in (_REST, _FORM):
        return kind
    return _IN_CONTAINER if region == _CONTAINER and kind == _ARTICLE else region


def html_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, region, link characters) of each line; regions below 0 are boilerplate."""
    lines: list[tuple[str, int, int]] = []
    buf: list[str] = []
    linked = 0
    stack: list[tuple[str, int]] = []      # open elements with the region that held before
    places: dict[str, list[int]] = {}      # where the open elements of a name are in the stack
    region = 0

    def flush() -> None:
        nonlocal linked
        lines.append((" ".join(html_lib.unescape("".join(buf)).split()), region, linked))
        buf.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal region
        while len(stack) > k:
            name, region = stack.pop()
            places[name].pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            buf.append(page[at:])
            break
        if m.start() > at:
            piece = page[at:m.start()]
            buf.append(piece)
            if any(t == "a" for t, _ in stack[-3:]) and not any(t in _HEADINGS for t, _ in stack[-4:]):
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:                                               # closing tag
            if tag in _VOID:
                if tag == "br":
                    flush()
                continue
            if tag not in _INLINE:
                flush()
                if places.get(tag):
                    close(places[tag][-1])
            elif places.get(tag):                              # an inline element ends inside its block only
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != tag and stack[k][0] in _INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] == tag:
                    if stack[k][1] != region:
                        flush()
                    close(k)
            continue
        if tag in _RAW or tag == "head":
            if not m[4]:
                stop = re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, at)
                at = stop.end() if stop else end
            if tag != "svg" and tag != "math":
                flush()
            continue
        if tag in _VOID:
            if tag not in _INLINE:
                flush()
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
            if tag in _ENDS_P:                                 # an open p ends where a block starts, an open li at the next
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag == "li":
                        close(i)
                        break
                    if stack[i][0] not in _INLINE:
                        break
        if m[4]:
            continue
        new = _inside(region, _kind(tag, m[3], region > 0))
        if inline and new != region:
            flush()
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, region))
        region = new
    flush()
    return lines


def _between(lines: list[tuple[str, int, int]], weight: list[int], window: int, surge: int, whole: bool) -> list[tuple[str, int, int]]:
    """The lines from each surge point to its dive point; in a ``whole`` region the last windows end with it."""
    last = max(0, len(lines) - window) if whole else len(lines)
    block = [sum(weight[min(i, last):min(i, last) + window]) for i in range(len(weight))]
    kept, inside = [], False
    for i, line in enumerate(lines):
        if not inside and block[i] >= surge and (weight[i] or whole and i == 0):
            inside = True                                      # surge
        if inside and not block[i]:
            inside = False                                     # dive
        if inside:
            kept.append(line)
    return kept


def _is_label(text: str, linked: int) -> bool:
    """Reads like an entry of a menu."""
    return 5 * linked > 4 * len(text) and len(text.split()) <= LABEL


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The lines between surge and dive points of the region with the largest block sums, joined by one space."""
    lines = [x for x in html_lines(page or "") if x[0] and x[1] >= 0]
    best, most = [], 0
    marked = [((_ARTICLE, _IN_CONTAINER), 4, ()), ((_CONTAINER,), 2, (_IN_CONTAINER,)), ((_IN_SOFT,), 1, ())]
    for regions, times, also in marked:
        mine = [x for x in lines if x[1] in regions or x[1] in also]
        kept = _between(mine, [0 if _is_label(t, n) else surge * len(t) for t, _, n in mine], window, surge, True)
        size = times * sum(max(0, len(t) - n) for t, r, n in kept if r in regions)
        if size > most:
            best, most = kept, size
    weight = [max(0, len(t) - 2 * n) for t, _, n in lines]
    if not any(x[1] > 0 for x in lines):                       # nothing is marked: the largest block sum is a surge at any size
        surge = min(surge, max([sum(weight[i:i + window]) for i in range(len(weight))], default=0) or surge)
    kept = _between(lines, weight, window, surge, False)
    if sum(max(0, len(t) - n) for t, r, n in kept if r == _REST) > most:
        best = kept
    if not best:                                               # nothing but links: the marked lines with them
        best = next((x for regions, _, also in marked if (x := [y for y in lines if y[1] in regions or y[1] in also])), [])
    return " ".join(t for t, _, _ in best)


def extract_main_text(pages: DataFrame, window: int = 3, surge: int = 80) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); one pass, no shuffle."""

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, window, surge) for x in page], dtype=object)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return (rows.select("page_id", "url", text("html").alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
