"""The main text of web pages by text-to-tag ratios over a stream of parser events.

1. The standard library's parser turns a page into events; text between two block tags is
   one line. A line knows its text, its tags, how much of it is link text, the nearest
   ``article`` or ``main`` around it, and whether an element that is never article text
   holds it: menus, page headers, footers, asides, forms, hidden elements, scripts, and
   elements whose class, id or role names an advert, a notice, a sidebar or comments.
2. The ratio of a line is its characters for each of its tags. Ratios are smoothed along
   the page by a Gaussian kernel, so a short paragraph between long ones stays high.
3. The logarithms of the smoothed ratios fall into two clusters at the threshold of least
   variance within them; the upper one is content. Ratios that differ little are one cluster.
4. If one article (or main) holds most of the content's characters, the region is that
   element: all its lines but lists of links. Elsewhere the region is the content lines
   with what lies between them, and a heading right before the first one; lists of links go.

Defined results: a missing or empty page gives the empty text; a page whose text lies all in
left-out elements does too; an element without an end lasts to the end of its parent or the
page, an unknown end is passed over, a comment without an end loses its opening only, and a
tag that the page breaks off is no text; a document type or declaration is none either; equal rows
give equal results; an empty table gives an empty one; other columns are not looked at. White
space is what ``str.split`` splits at. Work and memory are linear in the page, but for sorting
its lines' ratios.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements and the words that mark elements as no article text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup "
    "option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
NESTING = frozenset(
    "address article aside audio blockquote body button canvas center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup iframe li main math menu nav noscript object ol p pre script search "
    "section select span style summary svg table tbody td template textarea th title tr ul video".split())
NEVER = frozenset(
    "aside audio button canvas dialog footer form head header iframe menu nav noscript object script search select style "
    "svg template textarea title video".split())
#: What an article may lie in after all, if the page is written so or an end is missing.
AROUND = frozenset("form header nav".split())
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs captcha comment commentlist "
    "comments consent cookie cookiebar cookies copyright disqus dropdown footer gdpr hidden login masthead menu modal nav "
    "navbar navigation newsletter notice notification notices overlay pager pagination paginator popup promo promoted "
    "promotion recommendations recommended related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription teaser toc toolbar widget widgets".split())
#: Outside of an article.
HEADERS = MARKS | {"header"}
#: Words beside a mark that say what a wrapper has or lacks, not what it is.
ABOUT = frozenset("has have no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

SIGMA = 1.0
RADIUS = 3
SAME = 1.0
MOST = 0.5
LINKS = 0.5
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    article: int
    heading: bool


def is_marked(attributes: dict[str, str | None], marks: frozenset[str] = MARKS) -> bool:
    """Whether class, id, role or style say that an element is no article text or not shown."""
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").strip().lower() == "true":
        return True
    if ROLES.intersection((attributes.get("role") or "").lower().split()):
        return True
    if "display:none" in "".join((attributes.get("style") or "").lower().split()):
        return True
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        parts = [x.lower() for x in WORDS.findall(name)]
        if marks.intersection(parts) and not ABOUT.intersection(parts):
            return True
    return False


class Lines(HTMLParser):
    """The lines of a page outside of left-out elements; ``lines`` after ``close``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.link = self.heading = False
        self.stack: list[tuple[str, str, int, bool]] = []  # name, and what held before it
        self.open: Counter[str] = Counter()
        self.why, self.article, self.articles = "", 0, 0
        self.ended, self.last, self.endless = False, -1, False  # the page is whole, its last bracket, no comment ends

    def _settled(self, parse, i: int, opening: int) -> int:
        """Where markup at ``i`` ends; at the page's end an unfinished one goes up to its first bracket, else its opening.

        Whether there is a bracket ahead is known beforehand, so unfinished markup is not scanned again and again.
        """
        if self.ended and i > self.last:
            return i + opening
        end = parse(i)
        return self.rawdata.find(">", i) + 1 if end < 0 and self.ended else end

    def parse_starttag(self, i: int) -> int:
        return self._settled(super().parse_starttag, i, len(self.rawdata) - i)

    def parse_endtag(self, i: int) -> int:
        return self._settled(super().parse_endtag, i, len(self.rawdata) - i)

    def parse_pi(self, i: int) -> int:
        return self._settled(super().parse_pi, i, 2)

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections are comments outside of XML, whatever they hold."""
        if self.rawdata.startswith("<!--", i):
            return super().parse_html_declaration(i)
        parse = self.parse_bogus_comment if self.rawdata.startswith("<![", i) else super().parse_html_declaration
        return self._settled(parse, i, 2)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without an end loses its opening only; <!--> and <!---> are whole."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = -1 if self.endless else super().parse_comment(i, report)
        if end < 0 and self.ended:
            self.endless = True
            return i + 4
        return end

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.article, self.heading))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += not self.why
        if tag == "a":
            self.link = True
        if tag in HEADINGS:
            self.heading = True
        if tag in NESTING:
            self._nest(tag, dict(attrs))

    def _nest(self, tag: str, attributes: dict[str, str | None]) -> None:
        if self.stack and self.stack[-1][0] == ("li" if tag == "li" else "p" if tag in BLOCKS else ""):
            self._leave(self.stack[-1][0])  # its end may be left out
        why, article = self.why, self.article
        whole = tag in ("article", "main")
        if whole and why in AROUND:
            why = ""
        if not why:
            if tag in NEVER and not (tag == "header" and article):
                why = tag
            elif tag not in ("html", "body", "main") and is_marked(attributes, MARKS if article else HEADERS):
                why = "mark"
            elif whole:
                self.articles += 1
                article = self.articles
        self.stack.append((tag, self.why, self.article, self.link))
        self.open[tag] += 1
        self.why, self.article = why, article

    def _leave(self, tag: str) -> None:
        while self.stack:
            name, why, article, link = self.stack.pop()
            self.open[name] -= 1
            self.why, self.article, self.link = why, article, link
            if name == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.why
        if tag in BLOCKS:
            self._end_line()
        if tag == "a":
            self.link = False
        if tag in HEADINGS:
            self.heading = False
        if self.open[tag]:
            self._leave(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A slash ends foreign elements only; elsewhere it means nothing."""
        self.handle_starttag(tag, attrs)
        if self.open["svg"] or self.open["math"]:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.why:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)

    def close(self) -> None:
        self.ended, self.last = True, self.rawdata.rfind(">")
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian means along the lines; at the page's edges the kernel is cut and scaled."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[radius:radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray, same: float = SAME) -> float:
    """The start of the upper of two clusters with the least variance inside; all, if they are close."""
    x = np.sort(values)
    if not len(x) or x[-1] - x[0] < same:
        return -np.inf
    n = np.arange(1, len(x))
    low = np.cumsum(x)[:-1]
    between = low * low / n + (x.sum() - low) ** 2 / (len(x) - n)
    between[np.diff(x) <= 0] = -np.inf
    return float(x[1 + int(np.argmax(between))])


def regions(lines: list[Line]) -> list[str]:
    """The texts of the content regions' lines, in page order."""
    if not lines:
        return []
    chars = np.array([len(x.text) for x in lines], dtype=float)
    ratios = chars / np.maximum(1, [x.tags for x in lines])
    level = np.log1p(smoothed(ratios))
    content = level >= threshold(level)
    lists = np.array([x.linked for x in lines]) > LINKS * chars
    content &= ~lists
    if not content.any():
        content = ~lists if not lists.all() else np.zeros(len(lines), bool)
    article = np.array([x.article for x in lines])
    held = np.bincount(article[content], chars[content]) if content.any() else np.zeros(1)
    best = int(np.argmax(held))
    if best and held[best] > MOST * held.sum():
        keep = (article == best) & (content | ~lists)
    else:
        at = np.flatnonzero(content)
        keep = np.zeros(len(lines), bool)
        if len(at):
            first = at[0]
            while first and lines[first - 1].heading and not lists[first - 1]:
                first -= 1
            keep[first:at[-1] + 1] = True
            keep &= ~lists
    return [x.text for x, k in zip(lines, keep, strict=True) if k]


def main_text(page: str | None) -> str:
    parser = Lines()
    parser.feed(page or "")
    parser.close()
    return " ".join(regions(parser.lines))


def extracted(pages: DataFrame, id_column: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed(
        {"id": id_column, "url": url})
