"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines, one per block element, and each weighs as much as
its text.  Marks of an article or main part, if they hold a fair share of the
page, make their lines heavier and all others light, whatever those are; else
lines that are mostly links weigh nothing.  Menus, headers, footers, sidebars,
notices, adverts, forms and reader comments that elements, roles or class names
mark go with the markup where lightness cannot tell them: inside such a marked
part, and on pages without one.  Weights are summed over sliding windows of lines.  Where the
sums rise above a low level a stretch begins, and where they dive below it, it
ends; a stretch whose sums surge is main text, and so is a low one between two
such.  What stands between surge and dive is kept.

Defined cases: a null or empty page has no text; broken, unclosed and crossed
markup is read as it comes, in time that is linear in the page; pages are read
whole; repeated rows are read one by one; other columns stay, but for one that
has the name of the result, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; the sum from which a window surges (or the page's highest, if that is less); the sum below which it
#: has dived, on a page whose marks count (on others, 1); what a marked line weighs beside its text; the most that another
#: line of such a page weighs; the share of a page's text that marks must hold to count.
WINDOW = 3
SURGE, DIVE = 86, 20
MARKED, BESIDE = 30, 6
FAIR = 0.25

# Elements of HTML by their part in a page.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe".split())
_FALLBACK = set("object svg canvas audio video select".split())
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
_OUTSIDE = set("nav menu aside footer form button dialog fieldset search label input datalist".split())
_NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer masthead topbar"
    " comment comments commentlist discussion disqus respond reply replies"
    " cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations toolbar widget widgets".split()
)
_COMMENTS = set("comment comments commentlist discussion disqus respond reply replies".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CONTENT = set("main content article post entry story body text".split())

_PIECE = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _outside(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is not main text: 'comment', 'other', or '' if it may be."""
    if tag in _OUTSIDE or tag in _FALLBACK or tag == "header" and not in_main:
        return "other"
    if tag in ("html", "body", "main") or "=" not in attributes and "hidden" not in attributes:
        return ""
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "other"
        if name == "role" and value.strip().lower() in _ROLES:
            return "other"
        if name in ("class", "id"):
            found = {w.lower() for w in _WORDS.findall(value)}
            if found & _COMMENTS:
                return "comment"
            if found & _NAMED and not found & _CONTENT or "header" in found and not in_main and not found & _CONTENT:
                return "other"
    return ""


#: What a new item, cell or row ends by itself, and the elements that it does not look beyond.
_ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


Line = tuple[str, int, bool, bool]


class _Page:
    """Reads a page into lines (text, characters in links, whether in an article or main part, whether in a menu, advert and the like).

    Open elements are a stack, and for each tag the places of its elements in
    it; so nothing is searched for, whatever is left open or closed twice.
    """

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        # open elements: (tag, why it is outside, whether it is in an article or main part)
        self.open: list[tuple[str, str, bool]] = [("", "", False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.mains: list[int] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            _, outside, marked = self.open[-1]
            if text:
                self.lines.append((text, self.linked, marked, bool(outside)))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.places.get("a"):
            self.linked += len(text)

    def _last(self, *tags: str) -> int:
        """Where the innermost of these is open, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        block = tag in _BLOCK
        if block:
            self.flush()
            self._imply(tag)
        if tag in _VOID:
            return
        _, outside, marked = self.open[-1]
        why = _outside(tag, attributes, marked)
        main = tag in ("article", "main")
        if main:
            if outside == "other" and why != "comment":
                outside = ""  # an unclosed menu or advert does not reach into the article
            marked = marked or not why and not outside
        if not block and why:
            self.flush()
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if block:
            self.blocks.append(at)
        if main:
            self.mains.append(at)
        self.open.append((tag, outside or why, marked))

    def _imply(self, tag: str) -> None:
        """Ends what a new block ends by itself: an open paragraph, and an item, cell or row of the same list or table."""
        if tag in _ENDED:
            stop = self._last(*_STOPS[tag])
            ended = self._last(*_ENDED[tag])
            if ended > stop:
                self._close(ended)
                return
            inside = [p for p in self.places.get("p", ())[-1:] if p > stop]
        else:
            inside = self.blocks[-1:] if self.blocks and self.open[self.blocks[-1]][0] == "p" else []
        if inside:
            self._close(inside[0])
            self._imply(tag)

    def _close(self, i: int) -> None:
        for at in range(len(self.open) - 1, i - 1, -1):
            self.places[self.open[at][0]].pop()
        del self.open[i:]
        for kind in (self.blocks, self.mains):
            while kind and kind[-1] >= i:
                kind.pop()

    def end(self, tag: str) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
        at = self._last(tag)
        # an inline end tag does not reach over blocks, nor a small block's over an article's ends
        if not at or not block and self.blocks and self.blocks[-1] > at or tag not in ("main", "body", "html") and self.mains and self.mains[-1] > at:
            return
        if not block and self.open[at][1] and not self.open[at - 1][1]:
            self.flush()
        self._close(at)


def lines_of(page: str) -> list[Line]:
    """The text of every block, and where it stands."""
    out, at = _Page(), 0
    same = len(page.lower()) == len(page)  # some letters change their length
    lowered = page.lower() if same else "".join(c.lower() if c.isascii() else c for c in page)
    last: dict[str, int] = {}
    while True:
        low = page.find("<", at)
        if low < 0:
            break
        m = _PIECE.match(page, low) or _LOOSE.match(page, low)
        if not m:
            out.text(page[at : low + 1])
            at = low + 1
            continue
        if low > at:
            out.text(page[at:low])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag or tag == "head":  # only a head's title, scripts and styles have text
            continue
        if m[1]:
            out.end(tag)
        elif tag in _RAW and not m[3].endswith("/"):
            close = lowered.find(f"</{tag}", at)
            stop = page.find(">", close) if close >= 0 else -1
            at = stop + 1 if stop >= 0 else len(page)
        elif tag in _FALLBACK:
            # what is never closed has no content; that is looked up once
            if tag not in last:
                last[tag] = lowered.rfind(f"</{tag}")
            if last[tag] >= at and not m[3].endswith("/"):
                out.start(tag, m[3])
        else:
            out.start(tag, m[3])
    out.text(page[at:])
    out.flush()
    return out.lines


def weighed(lines: list[Line]) -> tuple[list[str], list[int], bool]:
    """The texts that windows go over, what each weighs, and whether marks of articles and main parts count."""
    own = [(text, linked, marked) for text, linked, marked, outside in lines if not outside]
    inside = sum(len(text) for text, _, marked in own if marked)
    if inside and inside >= FAIR * sum(len(text) for text, *_ in own):
        found = [(text, len(text) + MARKED if marked else min(BESIDE, max(0, len(text) - 2 * linked))) for text, linked, marked, outside in lines if not (marked and outside)]
        return [t for t, _ in found], [w for _, w in found], True
    return [t for t, *_ in own], [0 if 2 * linked > len(text) else len(text) for text, linked, _ in own], False


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge and its dive.

    A line is low if the window that begins with it or the one that ends with
    it sums to less than dive.  A run of lines that are not low surges if a
    window that begins in it reaches surge, or the highest sum of all runs.  A run that
    does not is kept between two that do.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    runs, first = [], None
    for i in range(len(weights) + 1):
        high = i < len(weights) and sums[i] >= dive and sum(weights[max(0, i - window + 1) : i + 1]) >= dive
        if high and first is None:
            first = i
        elif not high and first is not None:
            runs.append((first, i))
            first = None
    highest = [max(sums[a:b]) for a, b in runs]
    surging = [k for k, h in enumerate(highest) if h >= min(surge, max(highest))]
    return runs[surging[0] : surging[-1] + 1] if surging else []


def main_text(page: str, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    texts, weights, marked = weighed(lines_of(page))
    return "\n".join(text for a, b in stretches(weights, window, surge, dive if marked else 1) for text in texts[a:b])


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of a column of pages, or puts it in the place of a column of that name."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([main_text(p or "") for p in column], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "string")(F.coalesce(F.col(html), F.lit(""))))
