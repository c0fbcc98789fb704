"""Main text of web pages (operator 2): parser events, text-to-tag ratio a line, Gaussian smoothing, clustering."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kestrel.llm.common import with_columns_in_arrow

#: Elements that start a block of their own, and those whose content is never article text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form menu dialog button select option textarea "
    "iframe object svg canvas".split()
)
ARTICLES = frozenset(("article", "main"))
#: Words in class, id or role that mark what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disclaimer footer header menu menubar modal nav navbar navigation newsletter notice notices "
    "popup promo promoted related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = frozenset("comment comments respond".split())
OUTSIDE = (False, (), 0)
#: Share of a page's text from which a declared article counts, factor of the ratio outside such an article, and share of the threshold
#: that a line's own ratio must have.
DECLARED, BESIDE, OWN = 1 / 3, 0.01, 1 / 8
CLOSED_BY = {  # an open element that a start tag ends
    "li": {"li"},
    "p": {"p"},
    "dd": {"dd", "dt"},
    "dt": {"dd", "dt"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "option": {"option"},
}


class Lines(HTMLParser):
    """Streams a page into lines: [text pieces, tags, shut out, numbers of the hinted elements around it, number of its article or 0]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, *OUTSIDE]]
        self.open: list[tuple] = []  # element, shut out, hinted elements, article
        self.articles = 0
        self.hinted: list[bool] = []  # of each hinted element: whether it is about reader comments
        self.holds_article: set[int] = set()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers of the source aren't used."""
        return j

    def _line(self) -> None:
        around = self.open[-1][1:] if self.open else OUTSIDE
        if self.lines[-1][0] or self.lines[-1][1]:
            self.lines.append([[], 0, *around])
        else:
            self.lines[-1][2:] = around

    def _hints(self, attrs) -> set[str]:
        found: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                found |= HINTS & set(re.split(r"[^a-z0-9]+", value.lower()))
        return found

    def _pop(self, k: int) -> None:
        before = self.open[k - 1][1:] if k else OUTSIDE
        changed = any(one[0] in BLOCKS or one[1:] != before for one in self.open[k:])
        del self.open[k:]
        if changed:
            self._line()

    def handle_starttag(self, tag, attrs) -> None:
        ends = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCKS else ())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                self._pop(k)
                break
            if self.open[k][0] in BLOCKS:
                break
        if tag == "br":
            self.lines[-1][0].append(" ")
        if tag not in VOID:
            before = shut, hints, article = self.open[-1][1:] if self.open else OUTSIDE
            hidden = any(name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" for name, value in attrs)
            shut = shut or tag in NEVER or hidden
            if tag in ARTICLES and not shut:
                self.holds_article.update(hints)
                if not article:
                    self.articles += 1
                    article = self.articles
            elif tag not in ("html", "body") and attrs and (found := self._hints(attrs)):
                hints = (*hints, len(self.hinted))
                self.hinted.append(not COMMENTS.isdisjoint(found))
            self.open.append((tag, shut, hints, article))
            if tag in BLOCKS or (shut, hints, article) != before:
                self._line()
        elif tag in BLOCKS:
            self._line()
        self.lines[-1][1] += 1

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        self.lines[-1][1] += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                break
            if tag == "p" and self.open[k][0] in ("article", "main", "div", "section", "td"):
                break

    def handle_data(self, data) -> None:
        self.lines[-1][0].append(data)


@lru_cache
def kernel(radius: int, sigma: float) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return weights / weights.sum()


def smooth(values: list[float], radius: int, sigma: float) -> np.ndarray:
    """Gaussian mean of each value and its neighbours; beyond an end the end's value counts."""
    padded = [values[0]] * radius + values + [values[-1]] * radius
    return np.convolve(padded, kernel(radius, sigma), "valid")


def threshold_between(values: np.ndarray) -> float:
    """The value half-way between the means of the two clusters it parts; 0 counts as one more value."""
    values = np.append(values, 0.0)
    now = float(values.mean())
    for _ in range(100):
        high = values >= now
        after = float(values[high].mean() + (values[~high].mean() if not high.all() else 0.0)) / 2
        if abs(after - now) <= 1e-12:
            break
        now = after
    return now


def main_text(html: str | None, radius: int = 2, sigma: float = 1.0) -> tuple[str, np.ndarray, float]:
    """(text, smoothed ratio a line, threshold)."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(" ".join("".join(pieces).split()), *rest) for pieces, *rest in parser.lines]
    total, beneath = 0, [0] * len(parser.hinted)
    for t, _, shut, hints, _ in lines:
        if not shut:
            total += len(t)
            for h in hints:
                beneath[h] += len(t)
    # What a name hints at is not the page's main part: an element around an article, or around most of a page without one, stays.
    stays = {h for h, n in enumerate(beneath) if h in parser.holds_article or (2 * n > total and not parser.articles and not parser.hinted[h])}
    out = [shut or not stays.issuperset(hints) for _, _, shut, hints, _ in lines]
    ratio = [0.0 if o else math.log1p(len(t) / (tags or 1)) for (t, tags, *_), o in zip(lines, out)]
    own = sum(len(t) for (t, *_, article), o in zip(lines, out) if article and not o)
    if own and own >= DECLARED * sum(len(t) for (t, *_), o in zip(lines, out) if not o):
        most = max(ratio)
        ratio = [most if article else BESIDE * r for (*_, article), r in zip(lines, ratio)]
    smoothed = smooth(ratio, radius, sigma)
    threshold = threshold_between(smoothed)
    keep = (smoothed >= threshold) & (np.array(ratio) >= OWN * threshold) & (smoothed > 0)
    return "\n".join(t for (t, *_), o, k in zip(lines, out, keep) if k and t and not o), smoothed, threshold


def extract(pages: DataFrame, html: str = "html", radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Append text and n_chars (code points of text) to ``pages`` in place of the html column; no shuffle.

    Each page is streamed through the standard parser once into lines (one a block element) with the logarithm of their text-to-tag
    ratio; ratios are smoothed with a Gaussian, and a threshold half-way between the means of the two clusters it parts tells
    content lines, of which those without a ratio of their own go. What else is known of a page changes ratios before that: parts that
    elements declare as navigation, header, footer, sidebar or form have ratio 0, and so have parts whose class, id and role
    names hint at adverts, notices or comments, unless they are around an article or most of the page; if a declared article has a
    third of the text, its lines have the page's highest ratio, so that a short paragraph in it isn't lost, and lines beside it a
    hundredth of theirs. White space in a block is one space, blocks are joined by one line feed. Null, empty and text-less pages give
    an empty text; rows repeat as they come; columns named text or n_chars are replaced.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def start():
        def step(pages_):
            texts = [main_text(p, radius, sigma)[0] for p in pages_]
            return [texts, [len(t) for t in texts]]

        return step

    return with_columns_in_arrow(pages, [html], fields, start)
