"""Main text of web pages from streaming parser events and text-to-tag ratios.

The page is fed to the standard library's event parser. Block-level tags cut
its text into lines; every line has a length of text and a number of tags.
Text inside boilerplate elements (by tag, role, or a name as class or id)
counts as none; an element closed off by its name alone stays if it holds
nearly all of the page's text. The ratios of text to tags are smoothed with a Gaussian over
neighbouring lines, and lines above a threshold are selected. The content
region is the outermost article or main element (or several) if it holds
nearly all of the selected text, else the whole page without the lines of
links outside the container that does; all its lines outside boilerplate are
returned, the short ones too.

Defined results: null or empty html gives the empty text; a page without any
text outside boilerplate gives the empty text; unclosed and stray tags are
tolerated; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import small_batches, texts_of

# Element names of HTML.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body div main section td".split())
BOILERPLATE = frozenset("""applet aside button canvas datalist dialog embed fieldset footer form head iframe input label
math menu nav noframes noscript object option script select style svg template textarea title video audio""".split())
SECTIONS = frozenset("aside dialog footer header menu nav".split())   # an article inside belongs to them
REPEATED = frozenset("dd dt li option p td th tr".split())   # closed by the next one of their kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
toolbar""".split())
# Words of a class or id that name boilerplate.
NAMES = re.compile(
    r"^(ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|consent|cookies?|copyright|disqus|footer|"
    r"gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|outbrain|pagination|popup|promo|related|"
    r"replies|respond|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|taboola|toolbar|widget)$")
# Words that may stand beside one of them; with any other word (related-work, share-prices) a name says something else.
BESIDE = frozenset("""actions area article articles author bar bars blog block blocks body bottom box button buttons column
container content cookie cookies desktop email entry fixed float floating form global google group holder icon icons
inner item items left link links list main mobile module panel page pane policy popular post posts primary privacy
reader readers region right row secondary section site sticky stories sub tertiary thread tool tools top unit user users
view wrap wrapper zone""".split())
# Words that make a class the state of a layout (has-sidebar, comments-open).
STATE_FIRST = frozenset("has have no not with without is are show hide hidden".split())
STATE_LAST = frozenset("open opened closed close active inactive enabled disabled on off visible collapsed expanded".split())
REPLIES = frozenset("comment comments disqus replies respond".split())   # never main text, however long
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

CHUNK = 1 << 16            # characters fed to the parser at a time
SIGMA = 1.0                # of the Gaussian, in lines
REGION_SHARE = 0.9         # of the selected text that the content region must hold


class _Lines(HTMLParser):
    """Collects lines: their text, number of tags, and the container they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # (tag, container, boilerplate, named) of open structural elements
        # Elements that may be closed off, also with the articles inside, and such articles; "" is the page.
        self.around: list[int] = [-1]                    # element -> the element around it
        self.why: list[str] = [""]                       # element -> its name, "section" for a tag or role, or "article"
        self.ended: list[bool] = [False]                 # element -> whether its end tag came
        self.named: list[int] = []                       # line -> the element it stands in
        self.parents: list[int] = [-1]                   # container -> the container around it
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.place: list[int] = []
        self.kinds: list[str] = [""]                     # container -> its tag
        self.links: list[int] = []                       # line -> characters inside links
        self.heading: list[bool] = []                    # line -> whether it is a heading's
        self._link, self._linked, self._heading = False, 0, False
        self._text: list[str] = []
        self._tags = 0

    def _element(self, why: str, around: int) -> int:
        self.around.append(around)
        self.why.append(why)
        self.ended.append(False)
        return len(self.around) - 1

    def _cut(self) -> None:
        """End the line; its text counts for nothing inside boilerplate."""
        text = " ".join("".join(self._text).split())
        if text or self._tags:
            container, junk, named = self.open[-1][1:] if self.open else (0, False, 0)
            self.texts.append("" if junk else text)
            self.tags.append(self._tags)
            self.place.append(container)
            self.named.append(named)
            self.links.append(self._linked)
            self.heading.append(self._heading)
        self._text, self._tags, self._linked, self._heading = [], 0, 0, False

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][2]):
            self._text.append(data)
            if self._link:
                self._linked += len(" ".join(data.split()))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        last = self.open[-1][0] if self.open else ""
        if (last in REPEATED and tag == last) or (last == "p" and tag in BLOCKS and tag != "br"):
            self._cut()
            self.open.pop()  # its end tag was left out
        container, junk, named = self.open[-1][1:] if self.open else (0, False, 0)
        in_article = any(t == "article" for t, *_ in self.open)
        nested = in_article or any(t == "main" for t, *_ in self.open)
        if tag in ("main", "body"):
            junk, named = False, 0  # whatever boilerplate was left unclosed before
        elif tag == "article" and (junk or named):
            junk, named = False, self._element("article", named)  # the same, unless its end tag still comes
        own_junk = _is_boilerplate(tag, attrs, in_article, nested)
        name = "" if own_junk else _name(tag, attrs, in_article, nested)
        if tag in BLOCKS or own_junk or name:
            self._cut()
        self._tags += 1
        self._heading |= tag in HEADINGS
        self._link = tag == "a" or (self._link and tag not in BLOCKS)
        if tag in VOID:
            return
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
        if name:
            named = self._element(name, named)
        elif own_junk and (tag in SECTIONS or tag not in BOILERPLATE):
            named = self._element("section", named)
        if tag in CONTAINERS or tag in BOILERPLATE or own_junk or name or tag == "header":
            self.open.append((tag, container, junk or own_junk, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._cut()
        self._tags += 1

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if tag in BLOCKS or depth is not None:
            self._cut()
        self._tags += 1
        self._link = self._link and tag != "a" and tag not in BLOCKS
        if depth is not None:
            if named := self.open[depth][3]:
                self.ended[named] |= not depth or self.open[depth - 1][3] != named
            del self.open[depth:]

    def close(self) -> None:
        super().close()
        self._cut()


def _is_boilerplate(tag: str, attrs: list, in_article: bool, nested: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main") or (tag == "article" and not nested) or not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def _name(tag: str, attrs: list, in_article: bool, nested: bool) -> str:
    """The word of a class or id that names the element boilerplate, or nothing."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return ""
    found = ""
    for attr, value in attrs:
        for token in value.split() if attr in ("class", "id") and value else ():
            words = [w.lower() for w in WORD.findall(token) if len(w) > 1]
            if not words or words[0] in STATE_FIRST or (len(words) > 1 and words[-1] in STATE_LAST):
                continue
            # An article's own header holds its title.
            names = [w for w in words if NAMES.match(w) and not (in_article and w == "header")]
            if names and all(w in BESIDE or NAMES.match(w) for w in words):
                found = next((w for w in names if w in REPLIES), found or names[0])
    return found if tag != "article" or nested or found in REPLIES else ""


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines (zeros beyond both ends)."""
    reach = max(1, int(np.ceil(2 * sigma)))
    x = np.arange(-reach, reach + 1)
    kernel = np.exp(-x * x / (2 * sigma * sigma))
    return np.convolve(ratios, kernel / kernel.sum(), "full")[reach:len(ratios) + reach]


def extract(html: str | None) -> str:
    """The main text of one whole page, its blocks joined by newlines."""
    if not html:
        return ""
    parser = _Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at:at + CHUNK])
    parser.close()
    texts = _without_named(parser)
    sizes = np.array([len(t) for t in texts], np.float64)
    if not sizes.any():
        return ""
    ratio = smooth(sizes / np.maximum(1, parser.tags))
    # One standard deviation, but never so high that no line is selected.
    selected = ratio >= min(ratio.std(), ratio.max() / 2)
    mass = np.zeros(len(parser.parents))
    np.add.at(mass, parser.place, np.where(selected, sizes, 0))
    for c in range(len(mass) - 1, 0, -1):  # a container also holds what its inner containers hold
        mass[parser.parents[c]] += mass[c]
    inside = _region(parser, sizes, mass)
    return "\n".join(t for t, own in zip(texts, inside, strict=True) if t and own)


def _without_named(parser: _Lines) -> list[str]:
    """The lines' texts, empty inside elements that are closed off by their names, and in articles inside
    closed-off sections whose end tag was not left out."""
    around, why, n = parser.around, parser.why, len(parser.around)
    section = [False] * n
    for e in range(1, n):
        section[e] = section[around[e]] or (why[e] == "section" and parser.ended[e])
    mass = np.zeros(n)
    np.add.at(mass, parser.named, [0 if section[e] else len(t) for t, e in zip(parser.texts, parser.named, strict=True)])
    for e in range(n - 1, 0, -1):
        mass[around[e]] += mass[e]
    closed, firm = section[:], section[:]
    for e in range(1, n):
        own = why[e] in REPLIES or (why[e] not in ("section", "article") and mass[e] < REGION_SHARE * mass[0])
        firm[e] = firm[e] or firm[around[e]] or (own and parser.ended[e])
        closed[e] = firm[e] if why[e] == "article" else closed[e] or closed[around[e]] or own
    return ["" if closed[e] else t for t, e in zip(parser.texts, parser.named, strict=True)]


def _region(parser: _Lines, sizes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Which lines belong to the content region; ``mass`` is the selected text of each container.

    These are the outermost articles and main elements with more than links, if they hold nearly all of the
    selected text. Otherwise nothing is left out but lines of links outside the innermost container that does.
    """
    place, links = np.array(parser.place), np.array(parser.links, np.float64)
    parents, total = parser.parents, mass[0]
    home = np.full(len(parents), -1)  # the outermost article or main around a container
    for c in range(1, len(parents)):
        home[c] = home[parents[c]] if home[parents[c]] >= 0 else c if parser.kinds[c] in ("article", "main") else -1
    text, linked = np.zeros(len(parents)), np.zeros(len(parents))
    at = home[place]
    np.add.at(text, at[at >= 0], sizes[at >= 0])
    np.add.at(linked, at[at >= 0], np.minimum(links, sizes)[at >= 0])
    content = (text > 0) & (2 * linked <= text)
    if mass[content].sum() >= REGION_SHARE * total:
        return (at >= 0) & content[at]
    region = 0
    while True:
        inner = [c for c in range(region + 1, len(mass)) if parents[c] == region and mass[c] >= REGION_SHARE * total]
        if not inner:
            break
        region = inner[0]
    inside = np.zeros(len(mass), bool)
    inside[region] = True
    for c in range(region + 1, len(mass)):
        inside[c] = inside[parents[c]]
    return inside[place] | (2 * links <= sizes) | np.array(parser.heading)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [extract(h) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
