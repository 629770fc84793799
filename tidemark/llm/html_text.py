"""Main text of web pages: streamed parser events, text-to-tag ratios and region choice.

The standard library's parser streams events; block elements make the lines of a page.
Each line's ratio of characters to tags is smoothed with a Gaussian over its neighbours,
and two-means clustering of the logarithms gives the threshold above which a line is dense;
``DENSE`` characters a tag are dense on any page. Lines in elements that hold no article
text by their kind (menus, forms, footers ...), role or naming have ratio 0, and so have
those outside the article and main elements of a page on which these are dense; a form that
holds an article, a main element or nearly all text of its page is no such element.

The content regions are the elements that win most: an element counts the distances of its
lines' levels from the threshold, dense ones up and sparse ones down, less a fixed price
for being a region of its own; paragraphs, lists and tables are parts of one. So a region holds the short paragraphs between its dense
ones, and link lists beside it stay out; a page without a region that wins is one region.
Of a region's lines those of ratio 0 are left out, as they are below the threshold.

Time is linear in a page's size: an element knows what the elements around it mean for it.

Defined results: null and empty pages have an empty text; markup that never closes is read
to its end, and a head ends where content begins; a page with text outside any element is
one region; pages that repeat an id are rows of their own; an empty table gives an empty
table; other columns are carried along and one named like an added one is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_arrow, table

SIGMA = 1.0
#: Characters a tag, smoothed, that are dense on any page.
DENSE = 25
#: Share of a page's text that a form must hold to stay.
SHARE = 0.9

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td template "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, and elements that hold no article text.
_UNSEEN = frozenset("applet audio canvas datalist embed head iframe input object option script select style svg template textarea title video".split())
_BESIDE = frozenset("aside button dialog footer menu nav noscript".split())
#: What may stand in a head; any other element or text ends it.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class, id or role that mark an element as boilerplate.
_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
_EXEMPT = frozenset(("html", "body", "main"))
#: What an opening tag closes if it is open: (openers, closed).
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCES = frozenset(("article", "table", "ul", "ol", "dl", "section", "main", "body", "td", "th", "div"))
_WALLS = _FENCES - {"td", "th", "div"}
#: What is never a region of its own: parts of a text.
_PARTS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption hr br".split())
_ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th", "option"))


class _Element:
    """An open or closed element, with what its ancestors mean for it."""

    __slots__ = ("tag", "parent", "block", "unseen", "beside", "silent", "paragraph", "items", "content", "own", "chars", "frame")

    def __init__(self, tag: str, parent: _Element | None, unseen: bool = False, beside: bool = False):
        self.tag, self.parent = tag, parent
        self.unseen = unseen or (parent is not None and parent.unseen)
        self.beside = beside or (parent is not None and parent.beside)
        #: within an element without text of the page that stands inside a line: its text is no line of its own
        self.silent = parent is not None and (parent.silent or (tag not in _BLOCKS and (self.unseen or self.beside) and not (parent.unseen or parent.beside)))
        self.block = self if tag in _BLOCKS or parent is None else parent.block
        #: whether a paragraph is open within the nearest fence, and which items within the nearest wall
        self.paragraph = tag == "p" or (tag not in _FENCES and parent is not None and parent.paragraph)
        held = parent.items if parent is not None and tag not in _WALLS else frozenset()
        self.items = held | {tag} if tag in _ITEMS else held
        self.content = tag in ("article", "main") or (parent is not None and parent.content)
        self.own: list[int] = []
        self.chars = 0
        self.frame = tag in ("article", "main")


class Lines(HTMLParser):
    """Collects ``(text, tags, element, dropped)`` of the block lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("#page", None)
        self.elements = [self.at]
        #: (text, tags, whether it has ratio 0), in page order; elements know the numbers of their own
        self.lines: list[tuple[str, int, bool]] = []
        self._open = [Counter()]
        self._head: _Element | None = None
        self._text: list[str] = []
        self._tags = 0

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text and not self.at.unseen:
                self.at.block.own.append(len(self.lines))
                self.lines.append((text, self._tags, self.at.beside))
            self._text = []
        self._tags = 0

    def _push(self, element: _Element) -> None:
        self.at = element
        self.elements.append(element)
        self._open[-1][element.tag] += 1
        if element.tag in ("article", "body"):
            self._open.append(Counter())
        if element.tag == "head":
            self._head = element

    def _close(self, element: _Element) -> None:
        while True:
            gone, self.at = self.at, self.at.parent
            if gone.tag in ("article", "body"):
                self._open.pop()
            self._open[-1][gone.tag] -= 1
            if gone is self._head:
                self._head = None
            if gone is element:
                return

    def _up(self) -> Iterator[_Element]:
        at: _Element | None = self.at
        while at is not None:
            yield at
            at = at.parent

    def _end_head(self) -> None:
        for e in self._up() if self._head is not None else ():
            if e.tag == "head":
                self._flush()
                self._close(e)
                return
            if e.tag in ("body", "template"):
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _HEAD:
            self._end_head()
        self._tags += 1
        if tag in _BLOCKS:
            self._flush()
            self._tags = 1
            if self.at.paragraph:  # a block ends an open paragraph
                self._close(next(e for e in self._up() if e.tag == "p"))
            closes = _IMPLIED.get(tag, ())
            while not self.at.items.isdisjoint(closes):
                found = next(e for e in self._up() if e.tag in closes)
                self._close(found)
                if tag != "tr" or found.tag == "tr":
                    break
        if tag == "br":
            self._text.append("\n")
        if tag in _VOID:
            return
        unseen = tag in _UNSEEN or any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "style" and v and "display:none" in v.replace(" ", "").lower() for n, v in attrs)
        self._push(_Element(tag, self.at, unseen and tag not in _EXEMPT, self._boilerplate(tag, attrs)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use"):
            self.handle_endtag(tag)

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _BESIDE or tag == "header" and not self.at.content:
            return True
        if tag in _EXEMPT:
            return False
        for name, value in attrs:
            if not value:
                continue
            if name in ("class", "id", "role") and not _NAMES.isdisjoint(re.split(r"[^a-z]+", value.lower())):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        there = self._open[-1][tag] > 0 or tag in ("article", "body") and len(self._open) > 1 and self._open[-2][tag] > 0 or tag == "html" and self._open[0][tag] > 0
        if tag in _BLOCKS:
            self._flush()
        if there:
            self._close(next(e for e in self._up() if e.tag == tag))

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._end_head()
        if not self.at.silent:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()
        self._drop_forms()

    def _drop_forms(self) -> None:
        """Lines of forms have ratio 0, but for forms that are the page's frame."""
        if not any(e.tag == "form" for e in self.elements):
            return
        for e in reversed(self.elements):  # children come after their parents
            e.chars += sum(len(self.lines[i][0]) for i in e.own if not self.lines[i][2])
            if e.parent is not None:
                e.parent.chars += e.chars
                e.parent.frame = e.parent.frame or e.frame
        whole = SHARE * self.elements[0].chars
        forms = [e for e in self.elements if e.tag == "form"]
        framed = any(e.frame or e.content or e.chars >= whole for e in forms)
        inside: set[_Element] = set()
        for e in self.elements:
            if e.parent in inside or e.tag == "form" and not (e.frame or e.content or e.chars >= whole):
                inside.add(e)
        held = [i for e in inside for i in e.own]
        if not framed and sum(len(self.lines[i][0]) for i in held if not self.lines[i][2]) >= whole:
            return
        for i in held:
            self.lines[i] = (*self.lines[i][:2], True)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights beyond the ends are left out."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The middle between the two centres that best part the values."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            return low
        parted = sum(below) / len(below), sum(above) / len(above)
        if parted == (low, high):
            break
        low, high = parted
    return (low + high) / 2


def regions(elements: list[_Element], scores: list[float], price: float) -> list[bool]:
    """Which lines stand in a content region: the elements of the greatest sum of scores less the price of each."""
    take, best, chosen = {}, {}, set()
    apart: dict[_Element, list[_Element]] = {}
    for e in elements[1:]:
        apart.setdefault(e.parent, []).append(e)
    for e in reversed(elements):
        inner = apart.get(e, ())
        take[e] = sum(scores[i] for i in e.own) + sum(take[c] for c in inner)
        best[e] = sum(best[c] for c in inner)
        if e.tag not in _PARTS and take[e] - price > 0 and take[e] - price >= best[e]:
            best[e] = take[e] - price
            chosen.add(e)
    within = [False] * len(scores)
    inside: set[_Element] = set()
    for e in elements:
        if e in chosen or e.parent in inside:
            inside.add(e)
        for i in e.own:
            within[i] = e in inside
    return within if any(within) else [True] * len(scores)


def densities(lines: list[tuple[str, int, bool]]) -> tuple[list[float], float]:
    """Logarithms of the lines' smoothed ratios, and the threshold between sparse and dense ones."""
    smooth = smoothed([0.0 if beside else len(text) / max(1, tags) for text, tags, beside in lines])
    levels = [0.0 if beside else math.log1p(r) for r, (_, _, beside) in zip(smooth, lines, strict=True)]
    return levels, min(threshold(levels), math.log1p(DENSE))


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text, in page order."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if all(beside for _, _, beside in lines):
        return []
    levels, cut = densities(lines)
    # a page whose articles are dense says itself what stands outside them
    content = {i for e in parser.elements if e.content for i in e.own}
    if any(levels[i] >= cut and not lines[i][2] for i in content):
        lines = [(text, tags, beside or i not in content) for i, (text, tags, beside) in enumerate(lines)]
        levels, cut = densities(lines)
    # a line of ratio 0 says nothing about the element around it
    scores = [0.0 if beside else level - cut for level, (_, _, beside) in zip(levels, lines, strict=True)]
    within = regions(parser.elements, scores, cut / 2)
    return [text for (text, _, beside), level, held in zip(lines, levels, within, strict=True) if held and not (beside and level < cut)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its markup, with ``text`` and ``n_chars``."""
    added = {"text": "string", "n_chars": "bigint"}
    kept = [c for c in df.columns if c != html and c not in added]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(html).to_pylist()]
        columns = {c: batch.column(c) for c in kept}
        return pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in added.items())])
    return map_arrow(df, run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
