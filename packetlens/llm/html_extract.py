"""Main text of web pages: removal of site templates, then structural rules.

Elements are hashed with all they contain, menus and footers as well as text. Spark counts, per host, on how many pages each
subtree occurs; subtrees that recur on ``TEMPLATE_PAGES`` pages or more, and on ``TEMPLATE_SHARE`` of the host's pages, are the
site's template and are deleted with their text. Pages with the same main text count once, so a page that was copied is no
template. On pages without ``article`` or ``main``, text blocks (paragraphs, list items, cells, headings) must be on
``TEXT_SHARE`` of them. Text blocks, headings and the like inside an ``article`` or ``main`` element are never taken for a
template: there only containers (``div``, ``ul``, ``table``, ...) are candidates. What varies from page to page is left to rules:
menus, headers (an article's own too), footers, sidebars, notices, adverts, forms, scripts and reader comments are known by element,
role or class name (the lists below) and go as well. An ``article`` or ``main`` in a form or in an element with such a name stays.

Only small rows (host, subtree hash, page) are shuffled for the counts; they combine before the shuffle, so one
host may have most pages. A second pass over the pages gets each page's template subtrees by a join.

Defined results: null or empty html gives an empty text; a null or odd url is the host ``""``. A page without
``article`` or ``main`` is taken as a whole, less what the rules name. Unclosed, misnested and cut markup is read leniently,
pages of any length and depth. Rows that repeat a page id, or have none, are extracted one by one. An empty table
gives an empty table.
"""

from __future__ import annotations

import html as entities
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import slices, stored, table

TEMPLATE_PAGES = 10
#: Of a host's distinct pages: for containers, and for text blocks outside the main text.
TEMPLATE_SHARE = 0.05
TEXT_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends open elements of these kinds, up to the given limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Start tags that leave an open head open; any other, or text, ends it.
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
DROPPED = frozenset(
    "head title script style noscript template nav menu header footer aside form search iframe object canvas svg math "
    "button select textarea dialog".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A class or id goes if it is one of these names, or a compound of them and of ``QUALIFIERS`` only.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer comment comments discussion notice cookie cookies consent popup modal newsletter subscribe signup "
    "social share sharing related".split()
)
#: Words beside a dropped name that leave it what it is: ``site-header``, ``ad-slot``; not ``no-sidebar``, ``share-price``.
QUALIFIERS = frozenset(
    "site page global main primary secondary top bottom left right upper lower sticky fixed mobile desktop js wp widget block box bar "
    "slot unit list area links link buttons button icons form policy toggle posts articles post container inner 1 2 3".split()
)
#: Articles in these are not the page's own; in elements dropped by another name they stay.
FOREIGN_NAMES = frozenset("comment comments discussion related".split())
MAIN = frozenset({"article", "main"})
#: Inside the main text only these can be template.
CONTAINERS = frozenset("div section ul ol dl table figure details fieldset center".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[\"'>]")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


NOT_P, NO_TAGS = BLOCK - {"p"}, frozenset()
#: Open elements that are looked at one by one; of more, the places per tag are compared.
NEAR = 32
PLACED = BLOCK - MAIN - {"html", "body", "head"}
#: Elements that hold a piece of an article's text.
TEXTUAL = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr blockquote pre address figcaption summary legend option".split())


class _Element:
    __slots__ = ("tag", "dropped", "named", "main", "content", "first")
    #: ``dropped``: by a rule, here or above.

    def __init__(self, tag: str, dropped: bool, named: bool, main: bool, first: int):
        #: ``named``: dropped by a name only, and an article or main within is not.
        self.tag, self.dropped, self.named, self.main, self.first = tag, dropped, named, main, first
        self.content: list[str] = []


class Page:
    """The text blocks of a page, and the subtrees that may be template with the blocks they hold.

    ``blocks``: texts in order, and whether each is in the main element or falls to a rule; ``subtrees``: (hash, first block,
    block after the last, is a text block). Elements are closed by a stack, without recursion, and each part of the source is read
    a bounded number of times; each hash covers tags, class names and text of the whole subtree.
    """

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.in_main: list[bool] = []
        self.ruled: list[bool] = []
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self.stack = [_Element("", False, False, False, 0)]
        self.text: list[str] = []
        self.gone: list[str] = []
        self.open: dict[str, list[int]] = {}
        self.endless: set[int] = set()
        self.has_main = False
        self._read(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def _read(self, source: str) -> None:
        at, n, last = 0, len(source), source.rfind(">")
        while at < n:
            start = source.find("<", at)
            if start < 0 or start > last and not source.startswith(("<!", "<?"), start):
                # No tag can end any more.
                self._data(source[at:])
                break
            if source.startswith("<!--", start):
                found, size = source.find("-->", start + 4), 3
            elif source.startswith(("<!", "<?"), start):
                found, size = source.find(">", start), 1
            else:
                tag = _TAG.match(source, start + 1)
                if not tag:
                    self._data(source[at : start + 1])
                    at = start + 1
                    continue
                if start > at:
                    self._data(source[at:start])
                end = self._tag_end(source, tag.end())
                at = self._tag(source, tag[1], tag[2].lower(), source[tag.end() : end], end + 1)
                continue
            if start > at:
                self._data(source[at:start])
            at = found + size if found >= 0 else n

    def _tag_end(self, source: str, at: int) -> int:
        """Where the tag's ``>`` is, outside quotes if there is one. A quote is followed at most once over the whole page."""
        chain, here = [], at
        while found := _SPECIAL.search(source, here):
            if found[0] == ">":
                return found.start()
            if found.start() in self.endless:
                break
            chain.append(found.start())
            here = source.find(found[0], found.end()) + 1
            if not here:
                break
        # From these quotes on no tag ends outside quotes.
        self.endless.update(chain)
        return source.find(">", at)

    def _tag(self, source: str, end: str, tag: str, rest: str, at: int) -> int:
        """Opens or closes an element; the place to read on, which is behind the raw text of a script and the like."""
        if end:
            self._end(tag)
            return at
        self._start(tag, rest)
        if tag in RAW and not rest.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            return close.start() if close else len(source)
        return at

    def _data(self, text: str) -> None:
        if self.stack[-1].tag == "head" and text.strip():
            self._end_open(("head",), NO_TAGS)
        top = self.stack[-1]
        if "&" in text:
            text = entities.unescape(text)
        (self.gone if top.dropped else self.text).append(text)
        top.content.append(text)

    def _flush(self) -> None:
        """The texts read since the last block, what falls to rules apart from what doesn't."""
        for pieces, ruled in ((self.gone, True), (self.text, False)):
            if pieces and (joined := " ".join("".join(pieces).split())):
                self.blocks.append(joined)
                self.in_main.append(self.stack[-1].main and not ruled)
                self.ruled.append(ruled)
        self.text, self.gone = [], []

    def _start(self, tag: str, rest: str) -> None:
        if tag not in HEAD_TAGS and self.open.get("head"):
            self._end_open(("head",), NO_TAGS)
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                (self.gone if self.stack[-1].dropped else self.text).append(" ")
            return
        if tag in BLOCK:
            self._end_open(("p",), NOT_P)
            if tag in ENDS:
                self._end_open(*ENDS[tag])
            self._flush()
        top = self.stack[-1]
        names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(rest)} if "=" in rest else {}
        role = names.get("role", "").lower()
        is_main = tag == "main" or role == "main"
        opened = top.named and (is_main or tag == "article")
        dropped = (top.dropped and not opened) or tag in DROPPED or role in DROPPED_ROLES
        by_rule = tag in DROPPED and tag != "form" or role in DROPPED_ROLES
        named = dropped and not by_rule and (top.named or (tag == "form" and not top.dropped and not top.main))
        if not dropped and not is_main and (found := self._names(tag, names)):
            dropped, named = True, not top.main and FOREIGN_NAMES.isdisjoint(found)
        elif named and not FOREIGN_NAMES.isdisjoint(self._names(tag, names)):
            named = False
        # An article in an element with a dropped name may be a teaser: it stays, but other text of the page does too.
        main = not dropped and (top.main or is_main or (tag in MAIN and not opened))
        self.has_main |= main
        element = _Element(tag, dropped, named, main, len(self.blocks))
        element.content.append(f"<{tag} {names.get('class', '')}>")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(element)

    @staticmethod
    def _names(tag: str, names: dict[str, str]) -> set[str]:
        """The dropped names among the classes and the id. Of an article only names count that make it another's."""
        if not names or tag in ("main", "html", "body"):
            return set()
        found: set[str] = set()
        for token in f"{names.get('class', '')} {names.get('id', '')}".lower().split():
            parts = set(re.split(r"[_-]+", token)) - {""}
            known = parts & DROPPED_NAMES
            if known and parts - known <= QUALIFIERS:
                found |= known
        return found & FOREIGN_NAMES if tag == "article" else found

    def _end_open(self, tags, limits) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``limits`` is open within."""
        held = [self.open[t][-1] for t in tags if self.open.get(t)]
        if not held:
            return
        at, size = max(held), len(self.stack)
        if size - at <= NEAR:
            if any(self.stack[i].tag in limits for i in range(at + 1, size)):
                return
        elif at < max((self.open[t][-1] for t in limits if self.open.get(t)), default=0):
            return
        while len(self.stack) > at:
            self._close()

    def _end(self, tag: str) -> None:
        limits = NOT_P if tag == "p" else NO_TAGS if tag in BLOCK else BLOCK
        self._end_open((tag,), limits)

    def _close(self) -> None:
        element = self.stack[-1]
        if element.tag in BLOCK:
            self._flush()
        self.stack.pop()
        self.open[element.tag].pop()
        digest = xxhash.xxh64_intdigest("\0".join(element.content).encode("utf-8", "surrogatepass"))
        self.stack[-1].content.append(f"{digest:x}")
        inside = element.main and element.tag not in MAIN
        candidate = element.tag in CONTAINERS if inside else element.tag in PLACED and not element.main
        if candidate and len(self.blocks) > element.first:
            self.subtrees.append((digest - (1 << 63), element.first, len(self.blocks), element.tag in TEXTUAL))

    def wanted(self) -> list[bool]:
        """Of each block, whether the rules keep it."""
        return [main if self.has_main else not ruled for main, ruled in zip(self.in_main, self.ruled)]

    def body(self) -> int:
        """A hash of the main text."""
        text = "\n".join(b for b, w in zip(self.blocks, self.wanted()) if w)
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)

    def candidates(self) -> set[tuple[int, bool]]:
        """The subtrees that hold text, and whether they are text blocks."""
        return {(h, textual) for h, _, _, textual in self.subtrees}

    def template_blocks(self, template) -> list[bool]:
        """Of each block, whether it lies in a template subtree."""
        inside = [0] * (len(self.blocks) + 1)
        for h, a, b, _ in self.subtrees if template else ():
            if h in template:
                inside[a] += 1
                inside[b] -= 1
        return [depth > 0 for depth in itertools.accumulate(inside[:-1])]

    def main_text(self, template=()) -> str:
        """What is neither template nor falls to a rule."""
        kept = zip(self.blocks, self.wanted(), self.template_blocks(template))
        return "\n".join(text for text, wanted, gone in kept if wanted and not gone)


def host_of(url: str | None) -> str:
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip().lower())
    return found[1] if found else ""


SUBTREE = "page_id long, host string, body long, subtree long, textual boolean"


def _subtrees(batches):
    """A row per page with a null subtree, and a row for each of its candidates."""
    for part in slices(batches):
        rows = []
        for page, url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
            read = Page(source.as_py() or "")
            body, host = read.body(), host_of(url)
            rows.append((page, host, body, None, None))
            rows += [(page, host, body, *c) for c in read.candidates()]
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(map(list, zip(*rows)), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "body", "subtree", "textual"])


def template_subtrees(pages: DataFrame, min_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """(page_id, template): the hashes of the template subtrees on each page that has any."""
    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_subtrees, SUBTREE)
    found = stored(found, "subtrees")
    distinct = found.select("host", "subtree", "textual", "body").distinct()
    counts = distinct.groupBy("host", "subtree", "textual").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    counts = stored(counts, "subtree-counts")
    # The null subtree counts the host's pages.
    sizes = counts.filter("subtree is null").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("textual"), TEXT_SHARE).otherwise(TEMPLATE_SHARE)
    template = counts.filter("subtree is not null").join(sizes, "host").filter(F.col("n") >= share * F.col("pages"))
    template = stored(template.select("host", "subtree"), "site-templates")
    on = found.join(template, ["host", "subtree"]).groupBy("page_id")
    return stored(on.agg(F.collect_set("subtree").alias("template")), "templates")


TEXT = "page_id long, url string, text string, n_chars long"


def _texts(batches):
    for part in slices(batches):
        ids, urls, sources, templates = (part.column(i) for i in range(4))
        texts = [
            Page(source.as_py() or "").main_text(frozenset(template or ()))
            for source, template in zip(sources, templates.to_pylist())
        ]
        arrays = [ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """The main text of every page (page_id, url, html), see TEXT."""
    template = template_subtrees(pages, min_pages).withColumnRenamed("page_id", "_he_page")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.join(template, F.col("page_id").eqNullSafe(F.col("_he_page")), "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_texts, TEXT)


def op7(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
