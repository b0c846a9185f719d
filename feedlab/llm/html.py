"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element is one line. A line weighs as much text as the part of the page around it
has, less what stands in links; menus, headers, footers, sidebars, notices, adverts, forms and comments weigh nothing.
The distribution of the weights over sliding windows of lines surges where the text begins and dives where it ends; the
threshold between is a share of the page's own highest value. Lines between a surge and the dive after it are the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from itertools import takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
#: Unquoted parts of a tag end at the next "<", so a page of tags that never close is read in linear time.
_REST = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b{_REST}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_REST})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[!?][^<>]*+>""", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted recommended related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget".split())
_COMMENT_WORDS = frozenset("comment comments reply replies ad advert promo related".split())
#: Words that may as well belong to an article's subject; they count only where the rest of the name says nothing else.
_AMBIGUOUS = frozenset("banner header notice notices promo recommended related reply search share skip social subscribe widget".split())
_PLAIN = frozenset("area bar block bottom box btn button buttons container content form icon icons inner item items left link links list main page panel post posts primary right row secondary section site stories top wrap wrapper".split())
#: What follows one of these in a class or id says what the layout around has, not what the element is.
_LAYOUT_WORDS = frozenset("has with no without".split())
_WHOLE = frozenset("html body".split())
#: Blocks that are lines of what is around them, not parts of the page.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption address hr table tbody thead tfoot tr td th caption html body center details summary hgroup".split())


def _is_boiler(tag: str, attrs: str) -> bool:
    if tag in _BOILER_TAGS:
        return True
    if tag in _WHOLE or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "role":
            if _BOILER_ROLES.intersection(names):
                return True
            continue
        listed = _COMMENT_WORDS if tag in ("article", "main") else _BOILER_WORDS
        for name in names:
            words = {w for w in takewhile(lambda w: w not in _LAYOUT_WORDS, re.split(r"[_\-]+", name)) if w}
            sure = (words & listed) - _AMBIGUOUS
            if sure or words & listed and words <= _BOILER_WORDS | _PLAIN:
                return True
    return False


@dataclass(frozen=True)
class Line:
    """A block of a page: its text, the part of the page that it stands in, and what speaks against it."""

    text: str
    part: int  # number of the innermost article or main element, else of the block around the line
    main: bool  # in an article or main element
    boiler: bool
    linked: int  # characters inside links


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in order, without markup."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]  # tag, boilerplate, in article, part
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            _, boiler, main, part = stack[-1]
            out.append(Line(text, part, main, boiler, linked))
        parts.clear()
        linked = 0

    def pop_to(tag: str, stop: frozenset | None) -> None:
        if not open_[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                open_.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stop is not None and stack[k][0] not in stop:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:  # comment, script and the like
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag not in _INLINE
        if block:
            flush()
        if m[2] or m[5]:
            if tag == "a":
                links = max(0, links - 1)
            pop_to(tag, None)
            continue
        if tag in _VOID:
            continue
        if block and tag != "li":
            pop_to("p", _INLINE)
        if tag == "li":
            pop_to("li", _INLINE | {"p"})
        _, boiler, inside, part = stack[-1]
        hit = _is_boiler(tag, m[4] or m[7] or "")
        if tag == "a":
            links += 1
        if hit and not block and parts:  # an inline advert ends the line before it
            flush()
        main = tag in ("article", "main")
        if not inside and (main or block and tag not in _LINES):  # what is in an article or main element is one part
            n += 1
            part = n
        stack.append((tag, boiler or hit, inside or main, part))
        open_[tag] += 1
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def weights(lines: list[Line]) -> list[float]:
    """Weight of each line: the characters of its part of the page, less those in links; 0 for boilerplate.

    The lines of a part stand or fall together, so that a short line weighs as much as the part that it belongs to. An
    article or main element is one part, whatever blocks are in it, and counts twice.
    """
    own = [0 if x.boiler else len(x.text) - min(x.linked, len(x.text)) * (not x.main) for x in lines]
    size: Counter[int] = Counter()
    for x, w in zip(lines, own, strict=True):
        size[x.part] += w * (1 + x.main)
    return [float(size[x.part]) if not x.boiler else 0.0 for x in lines]


def between(weight: list[float], window: int, share: float) -> list[bool]:
    """Whether each line lies between a surge and the dive after it.

    The distribution is the mean of the weights among ``window`` lines that weigh something, centred; lines that weigh
    nothing stand in no window. It surges where it rises above ``share`` of its highest value and dives where it falls to
    that again. A short line beside a heavy one is in the window of that and so belongs to the text.
    """
    heavy = [i for i, w in enumerate(weight) if w]
    half, sums = window // 2, []
    for j in range(len(heavy)):
        near = heavy[max(0, j - half) : j + half + 1]
        sums.append(sum(weight[i] for i in near) / len(near))
    least, out = share * max(sums, default=0.0), [False] * len(weight)
    for i, s in zip(heavy, sums, strict=True):
        out[i] = s > least
    return out


def main_text(html: str | None, window: int = 3, share: float = 0.25) -> str:
    """The lines from each surge to its dive that weigh something, joined by one newline; empty for null or blank pages.

    A page of nothing but links keeps all that is no boilerplate.
    """
    lines = lines_of(html or "")
    weight = weights(lines)
    if not any(weight):
        weight, share = [0.0 if x.boiler else float(len(x.text)) for x in lines], 0.0
    return "\n".join(x.text for x, w, ok in zip(lines, weight, between(weight, window, share), strict=True) if ok and w)


@F.pandas_udf(StringType())
def _main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract(pages: DataFrame, html: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each row, from the whole html; one row in, one row out.

    Null and empty pages give an empty text, repeated rows equal texts, an empty table no rows; a column of ``pages``
    named ``text_col`` is replaced. Nothing between a surge and its dive is dropped but boilerplate, however short; outside
    of them go lines more than half a window away from any line of a part that has ``share`` of the heaviest part's text (a
    share just at the threshold is outside).
    """
    return pages.withColumn(text_col, _main_text(F.col(html)))
