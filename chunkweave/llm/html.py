"""Main text of web pages by text-to-tag ratios (after Weninger, Hsu and Han, 2010).

Parser events are taken as they come and cut into lines at block elements. A line's ratio is its characters over its
tags. The logarithms of the ratios, smoothed by a Gaussian, fall into two clusters about a threshold. A line's score is that smoothed
ratio and evidence: article and main speak for it, menus, forms, footers and names like "sidebar" against it, as do signs of
readers' comments. A region (the lines of one article, section, div or other container, not those of containers in it) is content
if most of its text scores above the threshold; one inside such a region that nothing speaks against need only be above the mean of
the lower cluster. Tags and names decide nothing by themselves: much text in a box named "legal" can outweigh its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkweave.llm.frames import REST, with_rest

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("head script style noscript template title canvas iframe audio video select option datalist textarea button".split())
#: Evidence, on the scale of logarithms of ratios.
FOR_MAIN, FOR_NAME, AGAINST = 2.5, 0.5, -6.0
#: Elements and roles that speak against the article.
ASIDE = frozenset("nav header footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of id and class names that speak against it.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "sidebar aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs toc pager pagination header masthead footer copyright legal "
    "comment comments commentlist reply replies respond response responses feedback discussion reviews disqus share sharing social related recommended teaser toolbar hidden".split()
)
#: Parts of them that speak for it.
GOOD_NAMES = frozenset("article content entry story post text body".split())
#: A line that heads a block of readers' comments.
COMMENT_HEAD = re.compile(r"(\d+ )?((readers?'?s?|all|user) )?(comments?|responses?|replies|reply|discussion|feedback|kommentare?|commentaires?|comentarios?|leave a (comment|reply))( \(?\d+\)?)?:?", re.I)
#: What a reader's comment has beside its text.
COMMENT_SIGN = re.compile(r"\b(repl(y|ies)|says|said|wrote|ago|antworten|schrieb|répondre|responder)\b", re.I)
BYLINE = 60
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of these ends an open one of the same set.
ENDS_LIKE = [frozenset(["p"]), frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["td", "th"]), frozenset(["tr"])]
#: Containers, whose own lines are judged together; lists, tables and quotes belong to the container around them.
REGIONS = frozenset("article main section div".split())
#: An open element is not ended from inside one of these.
BARRIERS = REGIONS | frozenset("body td table ul ol dl blockquote".split())
MAIN = frozenset(["article", "main"])
SIGMA = 1.0


class Region:
    """A container: what is around it, what speaks for or against it, and its kind and first line, which may show a comment."""

    __slots__ = ("around", "kind", "own", "evidence", "first", "headed", "signed", "inner")

    def __init__(self, around: int, kind: tuple, own: float, evidence: float):
        self.around, self.kind, self.own, self.evidence = around, kind, own, evidence
        self.first: str | None = None
        self.headed = self.signed = False
        self.inner: list[int] = []


class Lines(HTMLParser):
    """Turns events into lines: text, tags, region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = [("body", False, 0, False)]  # tag, silent, region, in an article
        self.regions = [Region(-1, ("body", ""), 0.0, 0.0)]
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.stack[-1][2]
            self.lines.append((text, max(self.tags, 1), at))
            self.tags = 0
            region = self.regions[at]
            if region.first is None:
                region.first, region.headed = text, any(t in HEADINGS for t, *_ in self.stack[-3:])
            region.signed = region.signed or len(text) <= BYLINE and COMMENT_SIGN.search(text) is not None
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        for like in ENDS_LIKE:
            if tag in like:
                self._close(like, BARRIERS - like)
        if tag not in INLINE and tag not in ("p", "html", "body"):
            self._close(ENDS_LIKE[0], BARRIERS)
        _, silent, at, main = self.stack[-1]
        own = _evidence(tag, attrs, main)
        if own or tag in REGIONS:
            kind = (tag, next((v for n, v in attrs if n == "class"), None) or "")
            self.regions.append(Region(at, kind, own, self.regions[at].evidence + own))
            self.regions[at].inner.append(len(self.regions) - 1)
            at = len(self.regions) - 1
        self.stack.append((tag, silent or tag in SILENT, at, main or tag in MAIN))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if tag != "body":
            self._close(frozenset([tag]), frozenset())

    def _close(self, tags: frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the innermost open element of these, and what is open in it, if no barrier is in between."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                if any(x[0] not in INLINE for x in self.stack[k:]):
                    self._end_line()
                del self.stack[k:]
                return
            if self.stack[k][0] in barrier:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def _evidence(tag: str, attrs: list[tuple[str, str | None]], main: bool) -> float:
    """What an element says for or against its text being the article's. main: there is an article or main around it."""
    said = 0.0
    if tag in MAIN and not main:
        said += FOR_MAIN
    if tag in ASIDE and not (tag == "header" and main):
        said += AGAINST
    if tag in ("html", "body", "main") or tag == "article" and not main:
        return said
    for name, value in attrs:
        if name in ("class", "id") and value:
            parts = set(re.split(r"[^a-z]+", value.lower()))
            if not NAMES.isdisjoint(parts):
                return said + AGAINST
            if not GOOD_NAMES.isdisjoint(parts):
                said += FOR_NAME
        elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return said + AGAINST
    return said


def _comments(regions: list[Region]) -> None:
    """Evidence against blocks of readers' comments, which names need not show: their head line, or several alike, each with a byline and a sign of a comment."""
    for region in regions[1:]:
        if region.first is not None and region.kind[0] not in MAIN and COMMENT_HEAD.fullmatch(region.first):
            _add(regions, region, AGAINST)
    for region in regions:
        kinds: dict[tuple, list[Region]] = {}
        for i in region.inner:
            kinds.setdefault(regions[i].kind, []).append(regions[i])
        for alike in kinds.values():
            if len(alike) > 1 and all(_signed(regions, r) for r in alike):
                for r in alike:
                    _add(regions, r, AGAINST)


def _signed(regions: list[Region], region: Region) -> bool:
    return region.first is not None and not region.headed and len(region.first) <= BYLINE and (region.signed or any(_signed(regions, regions[i]) for i in region.inner))


def _add(regions: list[Region], region: Region, evidence: float) -> None:
    region.own += evidence
    todo = [region]
    while todo:
        r = todo.pop()
        r.evidence += evidence
        todo += [regions[i] for i in r.inner]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]


def threshold(ratios: np.ndarray) -> tuple[float, float]:
    """Midway between the means of the two clusters that it makes, by two-means in one dimension; and the mean of the lower one."""
    at = float(ratios.mean())
    for _ in range(50):
        low, high = ratios[ratios < at], ratios[ratios >= at]
        if not len(low) or not len(high):
            return at, at
        new = float(low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at, float(low.mean())


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines, regions = parser.lines, parser.regions
    if not lines:
        return ""
    _comments(regions)
    region = np.array([r for *_, r in lines])
    ratios = smoothed(np.log([len(t) / n for t, n, _ in lines]))
    scores = ratios + np.array([r.evidence for r in regions])[region]
    length = np.array([len(t) for t, *_ in lines], float)
    at, low = threshold(ratios)

    def most(least: float) -> np.ndarray:
        """Whether most of a region's text is in lines of this score or more."""
        every, above = (np.bincount(region, length * x, len(regions)) for x in (np.ones(len(lines)), scores >= least))
        return (2 * above >= every) & (every > 0)

    passed, nearly = most(at), most(low)
    for i, r in enumerate(regions[1:], 1):  # a container comes before those in it
        passed[i] |= passed[r.around] and nearly[i] and r.own >= 0
    for r in [r for i, r in enumerate(regions) if passed[i]]:  # the own lines of an article around it, as its heading
        while r.around >= 0:
            around, r = r.around, regions[r.around]
            passed[around] |= r.kind[0] in MAIN and r.evidence > 0
    return " ".join(t for t, _, r in lines if passed[r])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "html"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*[n for n in batch.schema.names if n != "html"], "__text"])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with text, the main text, in place of a column of that name; html is dropped.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space. A null or
    empty html gives an empty text, as does a page without content. Pages are taken one by one, whatever ids they have.
    """
    packed = with_rest(pages, html).select(F.col(f"`{html}`").alias("html"), REST)
    out = packed.mapInArrow(_texts, T.StructType([packed.schema[REST], T.StructField("__text", T.StringType())]))
    return out.select(*[F.col(f"{REST}.`{c}`").alias(c) for c in pages.columns if c not in (html, "text")], F.col("__text").alias("text"))
