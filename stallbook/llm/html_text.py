"""Main text of web pages.

The standard library's streaming parser turns a page into lines, one for each block
of text, with the characters and tags it has and the element around it.  Lines of
elements that are boilerplate by their kind, role or name go.  Text per tag, without the
text of links and smoothed by a Gaussian over neighbouring lines, is split by a threshold
into content and the rest.  The region is where the content lies: the ``article`` or
``main`` elements if they hold most of it, else the smallest box around all of it.  Inside
the region a stretch of links goes if smoothing leaves it below the threshold, and so does
a box of nothing but links that reaches as far as the Gaussian; a link between paragraphs
is lifted above by them.  Everything else of the region stays.

Elements are numbered as they open, so sums over what they hold run from the last to the
first and flags from the first to the last: a page takes time in proportion to its length,
however deeply it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallbook.llm.common import ship_package, table

#: Lines that the Gaussian looks to either side, and its width.
RADIUS, SIGMA = 3, 1.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements that end tags of others don't reach through, and that regions are made of.
BOXES = frozenset("article aside body blockquote div fieldset footer form header html main nav section table td th".split())
DROPPED = frozenset(
    "aside button canvas datalist dialog footer head iframe menu nav noscript object script select "
    "style svg template textarea title".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
#: Words of class names and ids that mark boilerplate.
SUSPECT = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright dialog disclaimer disqus feedback footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Last words of names that say nothing about what an element holds.
PLAIN_ENDS = frozenset("area bar block box button buttons container inner left link links list right section wrap wrapper".split())
#: First words of names that tell what a page has or lacks around it.
ABOUT_OTHERS = frozenset("has hide is no not show with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element with this part of the page's text is no boilerplate, whatever its name,
#: and ``article`` or ``main`` elements are the region if they hold this part of the content.
MOST, REGION_PART = 2 / 3, 1 / 2
#: Blocks of running text: their names tell of what they say, not of what they are for.
TEXT_BLOCKS = frozenset("p pre h1 h2 h3 h4 h5 h6 dd dt hgroup".split())
READER_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset("ul ol dl table menu".split())
_PARAGRAPH, _PARAGRAPH_ENDS = frozenset(["p"]), BOXES | _LISTS
_NAME_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_of(value: str) -> set[str]:
    """The last telling word of each name in a class or id."""
    out = set()
    for name in value.split():
        words = _NAME_WORDS.findall(_CAMEL.sub(" ", name).lower())
        if not words or words[0] in ABOUT_OTHERS:
            continue
        while len(words) > 1 and words[-1] in PLAIN_ENDS:
            words.pop()
        out.add(words[-1])
    return out


class Element:
    """An open or closed element, its number and its parent's."""

    __slots__ = ("tag", "number", "parent", "dropped", "suspect", "comments", "holds_main", "region", "link", "heads")

    def __init__(self, tag: str, number: int, parent: Element | None, dropped: bool = False, suspect: bool = False):
        self.tag, self.number, self.parent, self.dropped, self.suspect = tag, number, parent, dropped, suspect
        self.holds_main = self.link = self.comments = self.heads = False
        self.region: str | None = None


class Line:
    __slots__ = ("text", "tags", "linked", "element")

    def __init__(self, text: str, tags: int, linked: int, element: Element):
        self.text, self.tags, self.linked, self.element = text, tags, linked, element


class Lines(HTMLParser):
    """Collects the lines of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.at = Element("html", 0, None)
        self.elements = [self.at]
        #: Open elements by tag, since the nearest open box and in all.
        self.inside: list[Counter] = [Counter()]
        self.open: Counter = Counter()
        self.depth_dropped = 0
        self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            # a link that is still open may be none that ends
            self.lines.append(Line(text, self.tags, 0 if self.links else self.linked, self.at))
            self.tags = 0
        self.parts = []
        self.linked = 0

    def push(self, tag: str, dropped: bool, suspect: bool) -> None:
        self.at = Element(tag, len(self.elements), self.at, dropped, suspect)
        self.elements.append(self.at)
        self.depth_dropped += dropped
        self.open[tag] += 1
        self.inside[-1][tag] += 1
        if tag in BOXES:
            self.inside.append(Counter())

    def pop_to(self, element: Element) -> None:
        """Closes ``element`` and what is open inside it."""
        while True:
            top, self.at = self.at, self.at.parent
            self.depth_dropped -= top.dropped
            self.links -= top.link
            self.open[top.tag] -= 1
            if top.tag in BOXES:
                self.inside.pop()
            self.inside[-1][top.tag] -= 1
            if top is element:
                return

    def open_within(self, tags: set[str] | frozenset[str], stops: frozenset[str]) -> Element | None:
        """The outermost open element with one of these tags inside the nearest stop."""
        # cells of tables are boxes themselves, counted where they were opened
        inside = self.inside[-1]
        if not any(self.open[t] if t in BOXES else inside[t] for t in tags):
            return None
        found, e = None, self.at
        while e.parent:
            if e.tag in tags:
                found = e
            elif e.tag in stops:
                break
            e = e.parent
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCKS:
            self.end_line()
            if tag in _CLOSED_BY and (old := self.open_within(_CLOSED_BY[tag], _LISTS)):
                self.pop_to(old)
            elif (old := self.open_within(_PARAGRAPH, _PARAGRAPH_ENDS)) is not None:
                self.pop_to(old)
        if tag in VOID or tag in ("html", "body"):
            return
        dropped, suspect, comments, main = tag in DROPPED, tag in ("form", "header"), False, tag in ("main", "article")
        for name, value in attrs:
            if (name == "class" or name == "id") and value and tag not in TEXT_BLOCKS:
                words = names_of(value)
                suspect = suspect or not SUSPECT.isdisjoint(words)
                comments = comments or not READER_COMMENTS.isdisjoint(words)
            elif name == "role" and value:
                dropped = dropped or value.lower() in DROPPED_ROLES
                suspect = suspect or value.lower() == "form"
                main = main or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                dropped = True
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                dropped = True
        self.push(tag, dropped, suspect)
        self.at.comments = comments
        # with neither target nor name it stands in a link's place
        if tag == "a" and ("href" in (names := {name for name, _ in attrs}) or names.isdisjoint(("id", "name"))):
            self.at.link = True
            self.links += 1
        if main and not (suspect or dropped):
            self.at.region = tag if tag in ("main", "article") else "main"
            e = self.at.parent
            while e and not e.holds_main:
                e.holds_main = True
                e = e.parent
        if tag in HEADINGS:
            e = self.at.parent
            while e and e.tag != "header" and e.tag not in BOXES:
                e = e.parent
            if e and e.tag == "header":
                e.heads = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        boxes = tag in BOXES or tag in _LISTS
        if not (self.open[tag] if boxes else self.inside[-1][tag]):
            return
        e = self.at
        while e.parent and (boxes or e.tag not in BOXES):
            if e.tag == tag:
                self.pop_to(e)
                return
            e = e.parent

    def handle_data(self, data: str) -> None:
        if not self.depth_dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data) - data.count(" ")


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean over neighbours; at the ends over those there are."""
    reach = np.arange(-radius, radius + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def densities(lines: list[Line]) -> np.ndarray:
    """Smoothed text beside links per tag, less the threshold: the standard deviation or,
    if that is higher than it may be for any line to pass, half the mean."""
    plain = [len(x.text) - x.linked for x in lines]
    ratios = smoothed(np.array([n / max(1, x.tags) for n, x in zip(plain, lines)], dtype=float))
    return ratios - min(ratios.std(), ratios.mean() / 2)


def is_link(line: Line) -> bool:
    return line.linked >= len(line.text) - line.text.count(" ")


def held(elements: list[Element], amounts: np.ndarray) -> np.ndarray:
    """Sums of the elements' own amounts over all they hold."""
    out = amounts.astype(float).tolist()
    for e in reversed(elements):
        if e.parent:
            out[e.parent.number] += out[e.number]
    return np.array(out)


def own_amounts(elements: list[Element], lines: list[Line], amounts: np.ndarray) -> np.ndarray:
    return np.bincount([x.element.number for x in lines], amounts, len(elements))


def below(elements: list[Element], marked: np.ndarray) -> np.ndarray:
    """Which elements are marked or lie in one that is."""
    out = marked.tolist()
    for e in elements:
        if e.parent and out[e.parent.number]:
            out[e.number] = True
    return np.array(out, dtype=bool)


def without_suspects(elements: list[Element], lines: list[Line]) -> list[Line]:
    """The lines outside suspect elements.  Known only now, an element is none if it holds
    an ``article`` or ``main``, for readers' comments all of the page, or, on pages
    without these, most of the text; nor is the header of an article that has its heading."""
    texts = np.array([len(x.text) for x in lines], dtype=float)
    mass = held(elements, own_amounts(elements, lines, texts))
    main = np.array([e.region is not None and mass[e.number] > 0 for e in elements])
    in_main, mains = below(elements, main), held(elements, main)
    regions, most = main.sum(), MOST * texts.sum()

    def goes(e: Element) -> bool:
        if not e.suspect or not mass[e.number]:
            return False
        if e.tag == "header" and e.heads and in_main[e.number]:
            return False
        if not regions:
            return e.tag == "header" or mass[e.number] < most
        return not (e.holds_main and (not e.comments or mains[e.number] == regions))

    out = below(elements, np.array([goes(e) for e in elements], dtype=bool))
    return [x for x in lines if not out[x.element.number]]


def in_region(elements: list[Element], lines: list[Line]) -> list[Line]:
    """The lines of the region that holds the content, without stretches of links."""
    density = densities(lines)
    good = density > 0
    if not good.any():
        good = np.ones(len(lines), dtype=bool)
    weight = np.where(good, [len(x.text) - x.linked for x in lines], 0)
    for kind in ("article", "main"):
        inside = below(elements, np.array([e.region == kind for e in elements], dtype=bool))
        mine = np.array([inside[x.element.number] for x in lines], dtype=bool)
        if mine.any() and weight[mine].sum() >= REGION_PART * weight.sum():
            return [x for x, own in zip(lines, mine) if own]
    count, total = held(elements, own_amounts(elements, lines, good)), good.sum()
    # of the boxes around all content lines, which lie one in the other, the last to open
    box = max((e for e in elements if (e.tag in BOXES or not e.parent) and count[e.number] == total), key=lambda e: e.number)
    inside = below(elements, np.arange(len(elements)) == box.number)
    # the outermost box inside the region that a line lies in
    branch = np.arange(len(elements))
    for e in elements:
        if e.parent and e.number != box.number and inside[e.number]:
            above = branch[e.parent.number]
            branch[e.number] = above if e.parent.number != box.number and above != box.number else e.number if e.tag in BOXES else box.number
    marked = [(x, d, branch[x.element.number]) for x, d in zip(lines, density) if inside[x.element.number]]
    sizes = Counter(b for _, _, b in marked)
    others = {b for x, _, b in marked if not is_link(x)} | {box.number}
    return without_menus([(x, d) for x, d, b in marked if b in others or sizes[b] < RADIUS])


def without_menus(marked: list[tuple[Line, float]]) -> list[Line]:
    """The lines but stretches of links that smoothing, on the whole, has not lifted to the content."""
    out, i = [], 0
    while i < len(marked):
        j = i
        while j < len(marked) and is_link(marked[j][0]):
            j += 1
        if sum(d for _, d in marked[i:j]) <= 0:
            i = j
        if i == j:
            if j < len(marked):
                out.append(marked[j][0])
            i = j + 1
        else:
            out += [x for x, _ in marked[i:j]]
            i = j
    return out


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = without_suspects(parser.elements, parser.lines) if parser.lines else []
    return "\n\n".join(x.text for x in in_region(parser.elements, lines)) if lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row of ``pages`` (``html`` too).

    Null, empty or textless html gives an empty text of 0 characters.  White space in
    a block becomes one space, ``br`` included; blocks are joined by an empty line.
    Unclosed and crossed elements are closed as a browser would.  Repeated rows are
    extracted each, null ids and urls stay, further columns are ignored, an empty
    table gives an empty table.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    )
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, folder, "pages"))
