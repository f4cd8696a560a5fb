"""Main-text extraction from web pages by flat text blocks and a small decision tree.

A page is cut into flat text blocks at block-level tags. Each block is described by its
own and its neighbours' word counts and link densities, and by what its nearest
sectioning element and its class names say; neighbours are the nearest blocks that don't
frame the page, those of a list or table of text the ones around it. A decision tree, trained on the labelled table below, keeps or drops it.
Kept blocks are joined in page order by one line feed.

Class names frame a block only as whole names, or as compounds of framing words with
words for a box or a place ("cookie-banner", "comments-area", but not "comments-open",
"has-sidebar" or "article-header"); names of an article's or a main element's own tag
don't count. Inside these, headers stay.

Null and empty pages give an empty text. Pages of any length are read whole; a page
without closing tags is read to its end; tags that may be left out (``</head>``, ``</p>``,
``</li>``) are. Repeated rows give equal results; extra columns are ignored; an empty table
gives an empty result. There are no ties: each block is judged alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcurve.llm import common

CHUNK_BYTES = 4 << 20

# Fixed values of HTML: elements that break a block, that hold no text of the page, that have no end tag, whose
# content is no markup, that a head may hold, and that end an open one when they start.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template iframe svg head title select textarea button object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
HEAD = frozenset("base link meta noscript script style template title".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
LISTS = frozenset("ul ol menu dir dl table".split())
#: Sectioning elements that hold a page's main text, and those that frame it.
BODY = frozenset("article main".split())
FRAME = frozenset("nav footer aside form menu dialog header".split())
#: Words in class, id and role that speak for framing, those that go with them in a compound, and those for main text.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pagination pager popup promo replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
BOX_WORDS = frozenset("area bar block bottom box container content contentinfo global group inline inner item items left links list main outer overlay page panel primary reader readers right row section secondary site slot sticky thread top unit user users wrap wrapper".split())
BODY_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Framing words that a header or a caption inside an article may carry.
OUTSIDE = frozenset("header masthead banner".split())

_OPENED = re.compile(r"<(?:/?[A-Za-z]|[!?])")
_TAG, _NAME_END, _VALUE_OR_END, _EQUALS = re.compile(r"</?(?=[A-Za-z])"), re.compile(r"[\s/>]"), re.compile(r"[>=]"), re.compile(r"=\s*")
# a whole tag in the usual writing, which no ``<`` can lie in: it reads no further than the next one
_PLAIN_TAG = re.compile(r"<(/?[A-Za-z][^\s/><]*)([^<>=]*(?:=\s*\"[^\"<]*\"[^<>=]*)*)>")
_NAMES = re.compile(r"(?:^|[\s/\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


class Tokens:
    """The tags, comments and declarations of a page, by a cursor that reads no stretch again.

    What a search found ahead, or that it found nothing, holds for every place before it; a tag
    without an end is remembered by the places of its attributes' values, where others would join it.
    """

    def __init__(self, page: str):
        self.page, self.ahead, self.endless = page, {}, set()

    def _next(self, what: str | re.Pattern, at: int) -> int:
        """The first place of ``what`` from ``at`` on, the page's length if there is none."""
        start, found = self.ahead.get(what, (0, -1))
        if not start <= at <= found:
            if isinstance(what, str):
                found = self.page.find(what, at)
            else:
                m = what.search(self.page, at)
                found = m.start() if m else -1
            found = len(self.page) if found < 0 else found
            self.ahead[what] = (at, found)
        return found

    def _close(self, at: int) -> int:
        """The place of the ``>`` that ends the attributes from ``at`` on, outside of quoted values; -1 if there is none."""
        passed: list[int] = []
        while True:
            at = self._next(_VALUE_OR_END, at)
            if at < len(self.page) and self.page[at] == ">":
                return at
            if at == len(self.page) or at in self.endless:
                self.endless.update(passed)
                return -1
            passed.append(at)
            value = _EQUALS.match(self.page, at).end()
            at += 1
            if value < len(self.page) and self.page[value] in "\"'" and (end := self._next(self.page[value], value + 1)) < len(self.page):
                at = end + 1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The next token: where it starts and ends, its name with a slash before that of an end tag, its attributes, and CDATA's text."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if m := _PLAIN_TAG.match(page, at):
                return at, m.end(), m[1], m[2], ""
            if page.startswith("<!--", at):
                end = self._next("-->", at + 4)
                return at, min(end + 3, len(page)), "", "", ""
            if page.startswith("<![CDATA[", at):
                end = self._next("]]>", at + 9)
                return at, min(end + 3, len(page)), "", "", page[at + 9 : end]
            if page.startswith(("<!", "<?"), at):
                if (end := self._next(">", at + 2)) < len(page):
                    return at, end + 1, "", "", ""
            elif m := _TAG.match(page, at):
                named = self._next(_NAME_END, m.end())
                if named < len(page) and (end := self._close(named)) >= 0:
                    return at, end + 1, page[at + 1 : named], page[named:end], ""
            at += 1
        return None


@dataclass(slots=True)
class Block:
    text: str
    words: int
    density: float  # share of the words that stand in links
    place: int  # nearest sectioning element: 0 none, 1 main text, 2 framing
    hint: int  # nearest telling class name: 0 none, 1 main text, 2 framing
    heading: int
    listed: int = 0  # the list or table that it stands in, 0 for none


def _hint(attributes: str, inside: bool) -> int:
    """What class, id and role say, inside an article or outside; framing names win."""
    found = 0
    for m in _NAMES.finditer(attributes):
        for name in html.unescape(m[1] or m[2] or m[3] or "").split():
            words = _WORDS.findall(_CAMEL.sub("-", name).lower())
            framing = [w for w in words if w in FRAME_WORDS and not (inside and w in OUTSIDE)]
            if framing and all(w in FRAME_WORDS or w in BOX_WORDS or w.isdigit() for w in words):
                return 2
            if len(words) == 1 and words[0] in BODY_WORDS or words and len(words) == 2 and all(w in BODY_WORDS for w in words):
                found = 1
    return found


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int, int]] = []  # name, place, hint, silent, link depth, list
    open_: Counter[str] = Counter()
    place = hint = silent = link = listed = lists = 0
    heading, at = 0, 0
    text: list[str] = []
    linked: list[str] = []
    tokens = Tokens(page)

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n_linked = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(1.0, n_linked / len(words)), place, hint, heading, listed))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if piece and silent and open_["head"] and silent == 1 and not piece.isspace():
            end("head")  # text begins the body
        if piece and not silent:
            text.append(piece)
            if link:
                linked.append(piece)

    def cut(i: int) -> None:
        """End the open elements from the i-th on."""
        nonlocal place, hint, silent, link, listed
        _, place, hint, silent, link, listed = stack[i]
        for name, *_ in stack[i:]:
            open_[name] -= 1
        del stack[i:]

    def end(name: str) -> None:
        if open_[name]:
            cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))

    def implied(name: str) -> None:
        """End what the start of this element ends: an open paragraph, an item before it."""
        if open_["p"]:
            i = len(stack) - 1
            while stack[i][0] != "p" and stack[i][0] not in BLOCK:
                i -= 1
            if stack[i][0] == "p":
                cut(i)
        ends = ENDS.get(name, "").split()
        if any(open_[x] for x in ends):
            first = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in LISTS:
                    break
                if stack[i][0] in ends:
                    first = i
            if first is not None:
                cut(first)

    while True:
        found = tokens.after(at)
        if not found:
            rest = page[at:]
            opened = _OPENED.search(rest)  # a tag that never ends says nothing
            say(rest[: opened.start()] if opened else rest)
            break
        start, stop, name, attributes, data = found
        say(page[at:start])
        at = stop
        if not name:
            if data:
                say(html.escape(data))
            continue
        ends, name = name.startswith("/"), name.removeprefix("/").lower()
        if open_["head"] and not ends and name not in HEAD and name != "head":
            end("head")  # its end tag may be left out
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            flush()
            heading = int(not ends and len(name) == 2 and name[0] == "h" and name[1] in "123456")
        if ends:
            end(name)
            continue
        if name in BLOCK:
            implied(name)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        if name in RAW:
            closing = _END[name].search(page, at)
            shut = page.find(">", closing.end()) if closing else -1
            at = shut + 1 if shut >= 0 else len(page)
            continue
        stack.append((name, place, hint, silent, link, listed))
        open_[name] += 1
        if name in LISTS and not listed:
            listed = lists = lists + 1
        if name in BODY:
            place, hint = 1, 0
        else:
            if name in FRAME:
                place = place if name == "header" and place == 1 else 2
            if name not in ("html", "body") and (told := _hint(attributes, place == 1)):
                hint = told
        silent += name in SILENT
        link = 1 if name == "a" else link
    flush()
    return out


def features(found: Sequence[Block]) -> list[tuple[float, ...]]:
    """place, hint, heading, words and link density of a block, then those two of the nearest blocks before and after that don't frame.

    A list or table whose words are mostly no links is a unit: the neighbours of each of its blocks stand outside of it.
    """
    words, linked = Counter(), Counter()
    for b in found:
        words[b.listed] += b.words
        linked[b.listed] += b.words * b.density
    unit = [b.listed if b.listed and 2 * linked[b.listed] < words[b.listed] else 0 for b in found]

    def sides(order: Sequence[int]) -> list[Block]:
        out, near, outer, inside = [], none, none, 0
        for i in order:
            if unit[i] != inside:
                inside, outer = unit[i], near
            out.append(outer if inside else near)
            near = near if 2 in (found[i].place, found[i].hint) else found[i]
        return out

    none = Block("", 0, 0.0, 0, 0, 0)
    before, after = sides(range(len(found))), sides(range(len(found) - 1, -1, -1))[::-1]
    return [(b.place, b.hint, b.heading, b.words, b.density, a.words, a.density, c.words, c.density) for a, b, c in zip(before, found, after, strict=True)]


# Labelled blocks whose neighbours don't decide: place, hint, heading, words, link density, 1 for main text.
SETTLED = (
    # menus, headers, footers, sidebars, forms
    (2, 0, 0, 1, 1.0, 0), (2, 0, 0, 14, 0.0, 0), (2, 0, 1, 4, 0.0, 0), (2, 1, 0, 60, 0.0, 0), (2, 2, 0, 9, 0.3, 0),
    # adverts, notices, reader comments named by their classes, inside the article and outside
    (0, 2, 0, 7, 0.0, 0), (0, 2, 0, 90, 0.0, 0), (0, 2, 1, 2, 0.0, 0), (0, 2, 0, 3, 1.0, 0), (1, 2, 0, 6, 0.0, 0), (1, 2, 0, 120, 0.0, 0), (1, 2, 1, 3, 0.0, 0),
    # article and main, headings, short blocks and links included
    (1, 0, 1, 2, 0.0, 1), (1, 0, 1, 9, 1.0, 1), (1, 0, 0, 1, 0.0, 1), (1, 0, 0, 4, 0.0, 1), (1, 0, 0, 12, 0.8, 1), (1, 0, 0, 25, 0.1, 1), (1, 0, 0, 120, 0.0, 1), (1, 0, 0, 2, 1.0, 1), (1, 0, 0, 6, 0.3, 1),
    (1, 1, 0, 1, 0.0, 1), (1, 1, 0, 5, 0.9, 1), (1, 1, 0, 12, 0.0, 1), (1, 1, 0, 70, 0.0, 1), (1, 1, 1, 5, 0.4, 1), (1, 1, 1, 2, 1.0, 1),
    # no sectioning element, but a telling class
    (0, 1, 1, 2, 0.0, 1), (0, 1, 1, 7, 0.0, 1), (0, 1, 0, 1, 0.0, 1), (0, 1, 0, 4, 0.0, 1), (0, 1, 0, 6, 0.3, 1), (0, 1, 0, 12, 0.0, 1), (0, 1, 0, 50, 0.0, 1), (0, 1, 0, 25, 0.2, 1),
    # neither, but long prose
    (0, 0, 0, 90, 0.0, 1), (0, 0, 0, 30, 0.0, 1), (0, 0, 0, 35, 0.3, 1),
)
#: Words and link density of the block before and the block after: nothing, a link, prose, a short line, in all their pairs.
KINDS = ((0, 0.0), (1, 1.0), (6, 1.0), (14, 0.0), (80, 0.1), (4, 0.0))
# Blocks that the neighbours decide, by the kinds of the block before and the one after; all others are dropped:
# heading, words, link density, and for which neighbours it is main text.
_PROSE, _TEXT = (3, 4), (0, 3, 4, 5)
OPEN = (
    (0, 12, 0.0, "not between links"), (0, 15, 0.2, "not between links"), (0, 9, 0.0, "not between links"),
    (0, 2, 0.0, "prose beside it or alone"), (0, 6, 0.0, "prose beside it or alone"), (0, 4, 0.3, "prose beside it or alone"),
    (1, 2, 0.0, "prose after it or alone"), (1, 7, 0.0, "prose after it or alone"), (1, 14, 0.0, "prose after it or alone"), (1, 5, 1.0, "prose after it"),
    (0, 1, 1.0, "prose on both sides"), (0, 4, 1.0, "prose on both sides"), (0, 12, 0.8, "prose on both sides"),
)
WHERE: dict[str, Callable[[int, int], bool]] = {
    "not between links": lambda a, c: a in _TEXT or c in _TEXT,
    "prose beside it or alone": lambda a, c: a in _PROSE or c in _PROSE or a == c == 0,
    "prose after it or alone": lambda a, c: c in _PROSE or a == c == 0,
    "prose after it": lambda a, c: c in _PROSE,
    "prose on both sides": lambda a, c: a in _PROSE and c in _PROSE,
}
PAIRS = [(a, c) for a in range(len(KINDS)) for c in range(len(KINDS))]
LABELLED = tuple((*case[:5], *KINDS[a], *KINDS[c], case[5]) for case in SETTLED for a, c in PAIRS) + tuple(
    (0, hint, *case[:3], *KINDS[a], *KINDS[c], int(WHERE[case[3]](a, c))) for case in OPEN for hint in ((0, 1) if case[2] > 0.5 else (0,)) for a, c in PAIRS
)


def train(rows: Sequence[tuple[float, ...]] = LABELLED, depth: int = 14) -> tuple:
    """A binary decision tree by Gini impurity: (feature, threshold, at most, above) or a label."""
    labels = [int(r[-1]) for r in rows]
    ones = sum(labels)
    if not depth or ones in (0, len(rows)):
        return (int(2 * ones >= len(rows)),)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            cut = (lo + hi) / 2
            left = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
            n, k = len(left), sum(left)
            impurity = 2 * (k * (n - k) / n + (ones - k) * (len(rows) - n - ones + k) / (len(rows) - n))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, f, cut = best
    return (f, cut, train([r for r in rows if r[f] <= cut], depth - 1), train([r for r in rows if r[f] > cut], depth - 1))


def keep(tree: tuple, x: Sequence[float]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if keep(tree, x))


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url and the main text of every page."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "html", CHUNK_BYTES):
                text = [main_text(h, tree) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(text, pa.string())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(common.tidy(run), "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_html_extract": query}
ORACLES: dict[str, str] = {}
