"""Main text of web pages by composite text density.

A page is read into a tree as a browser would read sloppy markup: missing end tags are implied,
scripts and styles are skipped whole, a page that breaks off ends there. Parts that are never
the article (menus, forms, adverts, ..., known by tag, role, class or id) are cut off. Then

* the density of a node is its characters per tag, times a logarithm that falls with the share
  of link characters and link tags in it, to a base that rises with the page's own share;
* the density sum of a node adds up the densities of its children (text of its own counts as
  one), which is greatest for the node whose children are the paragraphs;
* the least density on the way from that node to the body is the threshold. On that way, what
  stands beside the path belongs to the article if it reaches the threshold and is a paragraph,
  heading, list, quotation, table or the like with little link text, or is a container with a
  good part of the greatest density sum.

A block of hardly anything but links is left out. Where a page names its articles, the greatest sum is looked for inside them, and the one article
that holds it is taken as a whole. The rule reads one page at a time; pages are dealt to tasks by
Spark, and no page needs another.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import batches, small_batches

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
HEAD = frozenset("title meta link style script base noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
# A paragraph ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li tbody tfoot thead tr".split())
# What begins another of its kind ends the open one, unless one of the second set lies between.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
} | {part: (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])) for part in ("tbody", "thead", "tfoot")}
CELLS = frozenset(["td", "th", "caption", "table"])
# Parts of a page that are not its article.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend map menu nav "
    "noembed noframes noscript object optgroup option script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADERS = frozenset("header masthead topbar".split())
HINTS = COMMENTS | HEADERS | frozenset(
    "ad adbox ads adsense adslot adunit advert advertisement advertising adverts aside banner breadcrumb breadcrumbs "
    "consent cookie cookies copyright footer gdpr login menu menus modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted promotion related recommended share sharing sidebar sidebars signup social "
    "sponsor sponsored subscribe widget widgets".split())
# In a class such as "has-sidebar" the hint is about something else than the element.
ABOUT = frozenset("has no with without is not".split())
PARAGRAPHS = frozenset("address blockquote center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table ul".split())
# A container beside the path needs this part of the greatest density sum.
GOOD_PART = 0.25
# From this part of link characters on, a block of two or more links is a menu.
MENU_PART = 0.75

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """The tree of one page: parallel lists over its nodes, parents before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.items, self.hints = ["#"], [-1], [[]], [frozenset()]
        self.stack = [0]
        # How many of each tag are open: what is not open is not looked for.
        self.open: Counter[str] = Counter()
        at = 0
        while (found := TOKEN.search(source, at)) is not None:
            self._text(source[at : found.start()])
            at = found.end()
            if found["end"]:
                self._close(found["end"].lower())
            elif found["start"]:
                tag = found["start"].lower()
                self._open(tag, found["rest"])
                if tag in RAW:
                    end = RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
                    self._pop_from(len(self.stack) - 1)
        self._text(source[at:])

    def _text(self, text: str) -> None:
        if text:
            if self.tag[self.stack[-1]] == "head" and text.strip():
                self._pop_from(len(self.stack) - 1)
            self.items[self.stack[-1]].append(html.unescape(text))

    def _pop_from(self, k: int) -> None:
        self.open.subtract(self.tag[i] for i in self.stack[k:])
        del self.stack[k:]

    def _pop_to(self, names, barrier) -> None:
        """Close the innermost open one of ``names``, unless a barrier is met before."""
        if not any(self.open[name] for name in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in names:
                return self._pop_from(k)
            if tag in barrier:
                return None

    def _open(self, tag: str, rest: str) -> None:
        if self.tag[self.stack[-1]] == "head" and tag not in HEAD:
            self._pop_from(len(self.stack) - 1)
        if tag == "body":
            self._pop_to(("head",), ())
        if tag in ENDS_P:
            self._pop_to(("p",), CELLS)
        if tag in SIBLINGS:
            self._pop_to(*SIBLINGS[tag])
        hints = set()
        for kind, *values in ATTRIBUTE.findall(rest):
            for name in "".join(values).split():
                parts = {part.lower() for part in NAME_PARTS.findall(name)}
                if kind.lower() == "role":
                    hints |= {"role"} if name.lower() in ROLES else {"main"} if name.lower() == "main" else set()
                elif not parts & ABOUT:
                    hints |= parts & HINTS
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.items[self.stack[-1]].append(node)
        self.items.append([])
        self.hints.append(frozenset(hints))
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def _close(self, tag: str) -> None:
        if tag in BLOCKS or tag in CELLS:
            self._pop_to((tag,), () if tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot", "body", "html") else CELLS)
        else:
            # The end of bold type and the like does not end the block that holds it.
            self._pop_to((tag,), BLOCKS | CELLS)

    def above(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.parent[node]


def _cut(page: Page) -> list[bool]:
    """For each node, whether it is part of what is never the article."""
    n = len(page.tag)
    named, titles = [0] * n, [0] * n
    inside, cut = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        own = page.tag[i] in ("article", "main") and not page.hints[i] & COMMENTS or "main" in page.hints[i]
        named[page.parent[i]] += named[i] + own
        titles[page.parent[i]] += titles[i] + (page.tag[i] == "h1")
        named[i] += own
    for i in range(1, n):
        up, tag, hints = page.parent[i], page.tag[i], page.hints[i] - {"main"}
        inside[i] = inside[up] or tag in ("article", "main") or "main" in page.hints[i]
        hinted = bool(hints) and tag not in ("html", "body", "main")
        if tag == "article":
            hinted = bool(hints & COMMENTS)
        if tag == "header" or hinted and hints <= HEADERS:
            # The header of an article, or the only place of the page's title, stays.
            gone = not inside[up] and not named[i] and (not titles[i] or titles[i] < titles[0])
        elif hinted and not hints & COMMENTS:
            gone = not named[i] and not titles[i]
        else:
            gone = hinted and not named[i]
        cut[i] = cut[up] or gone or tag in DROPPED and not (tag in ("form", "fieldset") and named[i])
    return cut


def _squeezed(text: str) -> int:
    return len(" ".join(text.split()))


def _density(chars: float, tags: int, link_chars: float, links: int, page_share: float) -> float:
    """Characters per tag, adjusted for links; a count of none stands as one."""
    if not chars:
        return 0.0
    tags, linked, links = max(tags, 1), max(link_chars, 1), max(links, 1)
    base = log(chars / max(chars - link_chars, 1) * linked + page_share * chars + e)
    return chars / tags * log(chars * tags / (linked * links)) / log(base)


def _chosen(page: Page, cut: list[bool]) -> tuple[int, set[int]]:
    """The node whose text is the article, and the nodes below it that are left out."""
    n = len(page.tag)
    chars, tags, link_chars, links, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if cut[i]:
            continue
        own[i] = sum(_squeezed(x) for x in page.items[i] if isinstance(x, str))
        chars[i] += own[i]
        if page.tag[i] == "a":
            link_chars[i] = chars[i]
        if i:
            up = page.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            links[up] += links[i] + (page.tag[i] == "a")
    share = link_chars[0] / max(chars[0], 1)
    density = [0.0 if cut[i] else _density(chars[i], tags[i], link_chars[i], links[i], share) for i in range(n)]
    total = [_density(own[i], 1, 0, 0, share) for i in range(n)]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += density[i]

    blocks = [i for i in range(n) if not cut[i] and chars[i] and (not i or page.tag[i] in BLOCKS or page.tag[i] in CELLS)]
    if not blocks:
        return 0, set()
    articles = {i for i in blocks if page.tag[i] == "article"}
    mains = {i for i in blocks if page.tag[i] == "main" or "main" in page.hints[i]}
    held = [False] * n
    for i in range(n):
        held[i] = i in (articles or mains) or i > 0 and held[page.parent[i]]
    best = max((i for i in blocks if held[i] or not (articles or mains)), key=lambda i: (total[i], -i))
    if articles:
        return next(i for i in page.above(best) if i in articles), set()
    # From the best node up, for as long as something beside the path belongs to it.
    path = list(page.above(best))
    top = next((k for k, i in enumerate(path) if i in mains or page.tag[i] == "body"), len(path) - 1)
    threshold = min(density[i] for i in path[: top + 1])

    def belongs(i: int) -> bool:
        if cut[i] or not chars[i] or 2 * link_chars[i] > chars[i]:
            return False
        if page.tag[i] not in BLOCKS or page.tag[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return True
        return density[i] >= threshold and (page.tag[i] in PARAGRAPHS or total[i] >= GOOD_PART * total[best])

    # A block of hardly anything but links is a menu, wherever it stands.
    root, left_out = best, {i for i in blocks if links[i] > 1 and link_chars[i] >= MENU_PART * chars[i] and i not in path}
    for k in range(1, top + 1):
        beside = [x for x in page.items[path[k]] if isinstance(x, int) and x != path[k - 1]]
        joins = [i for i in beside if belongs(i)]
        if joins:
            root = path[k]
        left_out.update(i for i in beside if i not in joins)
    return root, left_out


def main_text(source: str | None) -> str:
    """The article of one page: its blocks in page order, a line for each.

    White space inside a block, a line break and the gap between cells of a row are one space.
    A null, empty or blank page, and one without any text outside menus and the like, gives an
    empty text.
    """
    page = Page(source or "")
    cut = _cut(page)
    root, left_out = _chosen(page, cut)
    lines: list[list[str]] = [[]]
    # Node and the next of its items; deep nesting costs list entries, not calls.
    stack = [(root, 0)]
    while stack:
        node, k = stack.pop()
        if k == len(page.items[node]):
            if page.tag[node] in BLOCKS:
                lines.append([])
            continue
        stack.append((node, k + 1))
        item = page.items[node][k]
        if isinstance(item, str):
            lines[-1].append(item)
        elif not cut[item] and item not in left_out:
            if page.tag[item] in BLOCKS:
                lines.append([])
            elif page.tag[item] in ("br", "td", "th"):
                lines[-1].append(" ")
            stack.append((item, 0))
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in lines)))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) for every row of ``pages``.

    A row is a row: repeated pages and null ids are given as they come, see :func:`main_text`
    for null and empty pages.
    """
    small_batches(pages.sparkSession)

    def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 500):
            texts = [main_text(source) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
