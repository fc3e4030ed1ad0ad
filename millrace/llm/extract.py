"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mapped

# Elements that end the block before them and the one within them.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main"
    " menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr"
    " ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose text a reader never sees as part of the page.
SILENT_TAGS = frozenset(
    "audio button canvas datalist head iframe math noembed noframes noscript object script"
    " select style svg template textarea title video".split()
)
# Elements, roles and words in a class or id that mark what isn't the article.
ASIDE_TAGS = frozenset("aside dialog footer form header menu nav".split())
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation"
    " search toolbar".split()
)
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb"
    " breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header"
    " login masthead menu menus modal nav navbar navigation newsletter notice notices pager"
    " pagination popup promo promoted promotion recommended related replies respond search"
    " share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription"
    " teaser toolbar topbar widget widgets".split()
)
# Of these words, those that name what readers wrote.
READER_WORDS = frozenset("comment comments disqus replies respond".split())
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content entry main post story text".split())
# A start tag closes what stands open of these, up to the nearest of the others.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr", "table thead tbody tfoot"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"),
    "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"),
    "tfoot": ("thead tbody tfoot", "table"),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# Elements that a paragraph can't leave open behind them.
_HOLDS_P = frozenset("article aside blockquote body button div td th table li section".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# A path is content if its ratio reaches this share of the mean over the page's text.
MIN_SHARE = 0.25
# Share of links from which a path in a marked article isn't content.
MAX_LINKS = 0.5
# Share of a path's smoothed ratio that comes from its container.
SMOOTHING = 0.5


@dataclass
class Block:
    path: int
    element: int
    text: str
    links: int  # characters within links


@dataclass
class _Open:
    tag: str
    path: int
    element: int
    silent: bool
    article: bool
    heading: bool = False


@dataclass
class _Element:
    """What counts of an element once the page is read to its end."""

    parent: int
    tag: str
    # Marked by its tag, role or style; by words of its name; by such words alone.
    aside: bool
    named: frozenset[str]
    pure: bool
    # A title within the header of an article.
    title: bool


class Paths:
    """Paths of block elements, each a number with its parent's: none is kept twice."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.parent = [0]
        self.name = [""]
        self.article = [False]

    def below(self, path: int, name: str) -> int:
        key = (path, name)
        if key not in self.numbers:
            self.numbers[key] = len(self.parent)
            self.parent.append(path)
            self.name.append(name)
            self.article.append(False)
        return self.numbers[key]


class _Blocks(HTMLParser):
    """Cuts a page into blocks of text, each with its path of block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", 0, 0, False, False)]
        self.elements = [_Element(0, "", False, frozenset(), False, False)]
        self.paths = Paths()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = 0
        self.in_link = 0
        self.standing: dict[str, int] = defaultdict(int)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.open[-1]
                self.blocks.append(Block(top.path, top.element, text, self.links))
                if top.article:
                    self.paths.article[top.path] = True
        self.parts = []
        self.links = 0

    def pop_to(self, depth: int) -> None:
        for closed in self.open[depth:]:
            self.in_link -= closed.tag == "a"
            self.standing[closed.tag] -= 1
        del self.open[depth:]

    def close_implied(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == "p":
                    self.pop_to(depth)
                    break
                if self.open[depth].tag in _HOLDS_P:
                    break
        if tag in _CLOSES:
            closed, ends = _CLOSES[tag]
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in closed:
                    self.pop_to(depth)
                    break
                if self.open[depth].tag in ends:
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        self.close_implied(tag)
        above = self.open[-1]
        values = {k: v or "" for k, v in attrs} if attrs else {}
        named_as = values.get("class", "") + " " + values.get("id", "")
        words = {w.lower() for w in _NAME_PARTS.findall(named_as)} if attrs else set()
        article = above.article or tag in ARTICLE_TAGS or bool(words & ARTICLE_WORDS)
        page = tag in ("html", "body")
        aside = not page and (
            tag in ASIDE_TAGS
            or values.get("role", "").lower() in ASIDE_ROLES
            or "hidden" in values
            or values.get("aria-hidden") == "true"
            or "display:none" in values.get("style", "").replace(" ", "").lower()
        )
        # The title in the header of an article is part of it.
        heading = above.heading or (tag == "header" and above.article)
        title = tag in HEADINGS and above.heading and not (words & ASIDE_WORDS)
        path = above.path
        if tag in BLOCK_TAGS:
            first = (values.get("class") or values.get("id") or "").split()[:1]
            path = self.paths.below(path, f"{tag}.{first[0]}" if first else tag)
        element = above.element
        named = frozenset() if page or not words & ASIDE_WORDS else frozenset(words)
        if aside or named or title or tag in BLOCK_TAGS:
            pure = any(
                parts and parts <= ASIDE_WORDS
                for parts in ({w.lower() for w in _NAME_PARTS.findall(n)} for n in named_as.split())
            ) if named else False
            self.elements.append(_Element(element, tag, aside, named, pure, title))
            element = len(self.elements) - 1
        self.in_link += tag == "a"
        self.standing[tag] += 1
        self.open.append(
            _Open(tag, path, element, above.silent or tag in SILENT_TAGS, article, heading)
        )

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash at the end of a tag has no meaning in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.standing[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self.open[-1].silent:
            self.parts.append(data)
            if self.in_link:
                self.links += len(data.strip())


def blocks_of(html: str | None) -> tuple[list[Block], Paths]:
    """The blocks of a page that may be its article, and the paths they stand at."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    gone = _asides(parser.elements, parser.blocks)
    return [b for b in parser.blocks if not gone[b.element]], parser.paths


def _asides(elements: list[_Element], blocks: list[Block]) -> list[bool]:
    """Whether each element, or one around it, isn't the article.

    A tag, role or style that says so counts.  A name counts as long as nothing speaks
    against it: it doesn't on what is or holds ``main`` or the longest ``article``, nor,
    on a page without these, on what holds most of the text outside links, unless the
    name is made of such words alone or speaks of readers.
    """
    free = [0] * len(elements)
    for block in blocks:
        free[block.element] += max(0, len(block.text) - block.links)
    readers = [False] * len(elements)
    for i, e in enumerate(elements):
        if i:
            readers[i] = readers[e.parent] or bool(e.named & READER_WORDS and e.tag not in ARTICLE_TAGS)
    for i in range(len(elements) - 1, 0, -1):
        if not elements[i].aside:
            free[elements[i].parent] += free[i]
    protected = {i for i, e in enumerate(elements) if e.tag == "main"}
    articles = [i for i, e in enumerate(elements) if e.tag == "article" and not readers[i]]
    if articles:
        protected.add(max(articles, key=lambda i: (free[i], -i)))
    marked = bool(protected)
    for i in list(protected):
        while i and (i := elements[i].parent) not in protected:
            protected.add(i)
    gone = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        spared = i in protected or (
            not marked
            and 2 * free[i] > free[0]
            and not e.pure
            and bool(e.named & ARTICLE_WORDS or not e.named & READER_WORDS)
        )
        gone[i] = (gone[e.parent] or e.aside or bool(e.named and not spared)) and not (
            e.title and not gone[_header_around(elements, i)]
        )
    return gone


def _header_around(elements: list[_Element], at: int) -> int:
    """What stands around the nearest header of an element."""
    while at and elements[at].tag != "header":
        at = elements[at].parent
    return elements[at].parent


def _ratio(chars: int, nodes: int, marks: int, links: int) -> float:
    """Text per node, weighed by punctuation per node and by the share outside links."""
    free = max(0.0, 1 - links / chars) if chars else 0.0
    return chars / nodes * (1 + math.log1p(marks / nodes)) * free * free if nodes else 0.0


def content_paths(blocks: list[Block], paths: Paths) -> set[int]:
    """The paths whose ratio marks them as content.

    Text length, punctuation and link text are summed over all blocks of a path, so a
    short paragraph counts like its neighbours of the same path.  A path's ratio is
    smoothed by that of its container over all paths in it; a heading has the best
    ratio of the paths beside it.  The threshold is a share of the mean over the
    page's text.  Where the page marks its article, paths within it only have to be
    more text than links, and the rest of the page has to reach the mean itself.
    """
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    around: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for block in blocks:
        marks = len(_PUNCTUATION.findall(block.text))
        for total in (sums[block.path], around[paths.parent[block.path]]):
            for k, v in enumerate((len(block.text), 1, marks, block.links)):
                total[k] += v
    article = {p for p in sums if paths.article[p]}
    fused: dict[int, float] = {}
    best: dict[int, float] = defaultdict(float)
    for path, own in sums.items():
        beside = paths.parent[path]
        fused[path] = (1 - SMOOTHING) * _ratio(*own) + SMOOTHING * _ratio(*around[beside])
        best[beside] = max(best[beside], fused[path])
    for path in fused:
        if paths.name[path].partition(".")[0] in HEADINGS:
            fused[path] = best[paths.parent[path]]
    chars = sum(own[0] for own in sums.values())
    mean = sum(fused[p] * own[0] for p, own in sums.items()) / max(1, chars)
    least = mean if article else MIN_SHARE * mean
    found = {p for p, ratio in fused.items() if ratio > 0 and ratio >= least}
    clear = {p for p in article if sums[p][3] <= MAX_LINKS * sums[p][0]}
    return (found - article) | clear


def main_text(html: str | None) -> str:
    """The article's blocks, one per line.

    White space within a block, a line break included, becomes one space.
    """
    blocks, paths = blocks_of(html)
    content = content_paths(blocks, paths)
    return "\n".join(b.text for b in blocks if b.path in content)


def with_main_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Extract the main text of every page.

    Result, one row per row of ``df``: page_id, url, text (empty if there is none),
    n_chars.  Null and empty pages have no text; null ids and addresses stay; repeated
    rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    picked = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return mapped(picked, run, "page_id long, url string, text string, n_chars long")
