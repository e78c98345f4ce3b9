"""Main text of web pages by wrapper induction.

For each host a few reference pages are chosen. Every page of the host is aligned with
them by simple tree matching. Where matched nodes have the same text the node is constant, else
it is a slot that varies. Summed over all pages of the host by the node's path (tags
and class names from the root) this is the host's wrapper: paths that stay constant are
template, those that vary are slots. Pages whose content is mostly that of the reference
are copies of it, and tell nothing about the template. A text on a template path is dropped only if
it was itself found constant. The content of a page is what stands in its slots, leaving out those that are menus, adverts and the like by their element, name or
share of link text; if the page marks its article, content is looked for there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import portions, ready, stored, texts_of
from coldwatch.llm.dom import BLOCK, Matcher, Node, read

REFERENCES = 2  # pages per host that all its pages are aligned with
CONSTANT_SHARE = 0.9  # of aligned nodes of a path, from which on it is template
LEAST_ALIGNED = 10
COPIED_MAIN = 0.5  # of the text of a page's marked article that its reference has, too: a copy
COPIED_PAGE = 0.8  # the same, of all text that may be content, where no article is marked
LINK_SHARE = 0.5  # of a slot's text, from which on it is a menu
SHAPES_KEPT = 100_000

# Elements and words in class, id or role that mark what is no main text.
ASIDE = frozenset(
    "head script style noscript template nav footer aside form button select option label legend"
    " textarea iframe svg dialog menu title".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies"
    " consent notice notices newsletter subscribe subscription signup comment comments reply"
    " replies respond disqus share sharing social related recommended popup modal overlay login"
    " search searchform widget toolbar pagination pager masthead topbar alert contentinfo"
    " complementary hidden skip".split()
)
HEADER_WORDS = frozenset({"header"})
# Longer than the article on many a page, so their share of a page's text protects nothing.
THREAD_WORDS = frozenset("comment comments reply replies respond disqus".split())
# Before a name these say that an element goes without or beside what is named.
BESIDE = frozenset("with without no not non has have had is show hide enable disable use".split())
MOST_TEXT = 0.5  # of a page's unlinked text, beyond which a name does not make an element aside
MAIN = frozenset({"article", "main"})


def _named(node: Node, words: frozenset[str]) -> bool:
    """Is the element, by one of its names, one of these things: by the first or the last word."""
    for name in node.names:
        parts = [w for w in name.replace("_", "-").split("-") if w and not w.isdigit()]
        if parts and parts[0] not in BESIDE and (parts[0] in words or parts[-1] in words):
            return True
    return False


def is_aside(node: Node, in_main: bool, protected: bool = False) -> bool:
    """Is this element, by its kind or name, no part of a page's main text.

    ``protected`` elements are not judged by name, and forms may be protected.
    """
    if node.tag == "form" and protected:
        return False
    if node.tag in ASIDE or (node.tag == "header" and not in_main):
        return True
    if protected or node.tag in ("", "html", "body") or not node.names:
        return False
    return _named(node, ASIDE_WORDS) or (not in_main and _named(node, HEADER_WORDS))


def protected(root: Node) -> set[int]:
    """Ids of elements that hold the marked article, or most of the page's unlinked text.

    Some pages stand in a form as a whole. Such a form is protected if it holds the marked article
    or, as paragraphs and headings, most of the page's unlinked text.
    The marked article is the longest. One in an element with an aside's name, like a teaser
    among related pages, is not if more text stands outside of such elements.
    """
    sizes: dict[int, int] = {}
    prose: dict[int, int] = {}  # of the sizes, what stands in paragraphs and headings
    parents: dict[int, Node] = {}
    within: set[int] = set()  # elements in others with an aside's name
    outside = 0
    order, rest = [], [root]
    while rest:
        node = rest.pop()
        if node.tag == "a" or (node.tag in ASIDE and node.tag != "form"):
            continue
        order.append(node)
        named = id(node) in within or node.tag == "form" or (
            node.names and node.tag not in ("html", "body") and _named(node, ASIDE_WORDS)
        )
        for child in node.nodes:
            parents[id(child)] = node
            if named:
                within.add(id(child))
        sizes[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        prose[id(node)] = 0
        outside += 0 if named else sizes[id(node)]
        rest.extend(node.nodes)
    for node in reversed(order):  # children first
        sizes[id(node)] += sum(sizes.get(id(c), 0) for c in node.nodes)
        prose[id(node)] = (
            sizes[id(node)] if node.tag in PROSE else sum(prose.get(id(c), 0) for c in node.nodes)
        )
    least = MOST_TEXT * sizes.get(id(root), 0)
    found = {
        id(n) for n in order
        if (n.names or n.tag == "form") and not _named(n, THREAD_WORDS)
        and (prose if n.tag == "form" else sizes)[id(n)] > least
    }
    marked = [n for n in order if n.tag in MAIN and sizes[id(n)]]
    marked = [n for n in marked if id(n) not in within or sizes[id(n)] >= outside]
    node = max(marked, key=lambda n: sizes[id(n)], default=None)
    while node is not None:
        found.add(id(node))
        node = parents.get(id(node))
    return found


class Slot:
    """A block of a page: its path, its own text, how much of it is in links."""

    __slots__ = ("path", "parts", "linked", "node", "aside", "main")

    def __init__(self, path: str, node: Node, aside: bool, main: bool):
        self.path, self.node, self.aside, self.main = path, node, aside, main
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def slots(root: Node) -> list[Slot]:
    """The blocks of a page in page order; inner blocks part the text around them."""
    found: list[Slot] = []
    current: Slot | None = None
    kept = protected(root)
    # (node or text, path, in a link, aside, in main, block element around); None ends a block.
    # Paths are digests, as short for deep elements as for others.
    paths: dict[tuple[str, str], str] = {}
    rest: list[tuple | None] = [(root, "", False, False, False, root)]
    while rest:
        top = rest.pop()
        if top is None:
            current = None
            continue
        item, path, link, aside, main, around = top
        if isinstance(item, str):
            if current is None:
                if item.isspace():
                    continue
                current = Slot(path, around, aside, main)
                found.append(current)
            current.parts.append(item)
            if link:
                current.linked += len(item)
            continue
        if item.tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        aside = aside or is_aside(item, main, id(item) in kept)
        main = main or (item.tag in MAIN and not aside)
        link = link or item.tag == "a"
        block = item.tag in BLOCK or item.tag == ""
        if block:
            if item.tag:
                step = (path, item.label)
                path = paths.get(step) or paths.setdefault(step, f"{_digest('/'.join(step)):x}")
            around = item
            current = None
            rest.append(None)
        rest.extend((c, path, link, aside, main, around) for c in reversed(item.children))
    return found


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)


class _Page:
    """A page's tree, the text of its block elements, and the texts that may be its content."""

    def __init__(self, page: str):
        self.root = read(page)
        self.slots = slots(self.root)
        self.texts: dict[int, str] = {}
        for slot in self.slots:
            before = self.texts.get(id(slot.node))
            self.texts[id(slot.node)] = slot.text() if before is None else f"{before}\n{slot.text()}"
        open_slots = [
            s for s in self.slots if not s.aside and s.linked <= LINK_SHARE * sum(map(len, s.parts))
        ]
        inside = [s for s in open_slots if s.main]
        self.least = COPIED_MAIN if inside else COPIED_PAGE
        self.content = [s.text() for s in inside or open_slots]
        self.held = set(self.content)
        _matcher.number(self.root)

    def copies(self, other: _Page) -> bool:
        """Is its content mostly that of the other page, whatever else varies around it."""
        whole = sum(map(len, self.content))
        return sum(len(t) for t in self.content if t in other.held) >= self.least * whole


_matcher = Matcher()
_references: dict[str, _Page] = {}


def _reference(page: str) -> _Page:
    if page not in _references:
        if len(_references) >= 256:
            _references.clear()
        _references[page] = _Page(page)
    return _references[page]


def observed(page: str, references: list[str]) -> dict[str, tuple[list[int], set[str]]]:
    """Per path of a page: aligned nodes, constant ones, characters, those in links; constant texts."""
    if len(_matcher.shapes) > SHAPES_KEPT:
        _matcher.clear()
        _references.clear()
    mine = _Page(page)
    found: dict[str, tuple[list[int], set[str]]] = {}
    by_node: dict[int, list[Slot]] = {}
    for slot in mine.slots:
        counts, _ = found.setdefault(slot.path, ([0, 0, 0, 0], set()))
        counts[2] += sum(map(len, slot.parts))
        counts[3] += slot.linked
        by_node.setdefault(id(slot.node), []).append(slot)
    for reference in references:
        if reference == page:
            continue
        other = _reference(reference)
        if mine.copies(other):
            continue  # a copy tells nothing
        for node, match in _matcher.pairs(mine.root, other.root):
            own = by_node.get(id(node))
            if own is None:
                continue
            same = mine.texts[id(node)] == other.texts.get(id(match))
            counts, constant = found[own[0].path]
            counts[0] += 1
            counts[1] += same
            if same:
                constant.update(s.text() for s in own)
    return found


def _observations(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "path", "aligned", "constant", "chars", "linked", "text"]
    for batch in source:
        totals: dict[tuple[str, str], list[int]] = {}
        texts: set[tuple[str, str, int]] = set()
        hosts, references = batch.column("host").to_pylist(), batch.column("references")
        for i, (host, page) in enumerate(zip(hosts, texts_of(batch, "html"))):
            for path, (counts, constant) in observed(page, references[i].as_py() or []).items():
                total = totals.setdefault((host, path), [0, 0, 0, 0])
                for k in range(4):
                    total[k] += counts[k]
                texts.update((host, path, _digest(t)) for t in constant)
        rows = [(*key, *counts, None) for key, counts in totals.items()]
        rows += [(host, path, 0, 0, 0, 0, text) for host, path, text in texts]
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def references(pages: DataFrame, count: int = REFERENCES) -> DataFrame:
    """(host, references): for each host the pages of ``count`` least hashes of ids."""
    ids = pages.groupBy("host").agg(
        F.array_distinct(
            F.array(
                *[F.min_by("page_id", F.xxhash64(F.lit(seed), "page_id")) for seed in range(count)]
            )
        ).alias("ids")
    )
    chosen = stored(ids.select("host", F.explode("ids").alias("page_id")), "reference-ids")
    texts = pages.join(chosen, ["host", "page_id"]).groupBy("host", "page_id").agg(
        F.min("html").alias("html")
    )
    # At most ``count`` pages per host.
    return texts.groupBy("host").agg(F.array_sort(F.collect_list("html")).alias("references"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, content, texts): the roles of the paths of each host's pages.

    ``texts`` are digests of the texts found constant, of paths that are template; other paths
    have none.
    """
    ready(pages.sparkSession)
    known = stored(references(pages), "references")
    seen = pages.join(known, "host", "left").select("host", "html", "references")
    sums = seen.mapInArrow(
        _observations,
        "host string, path string, aligned long, constant long, chars long, linked long, text long",
    )
    total = sums.groupBy("host", "path").agg(
        *[F.sum(c).alias(c) for c in ("aligned", "constant", "chars", "linked")],
        F.collect_set("text").alias("texts"),  # no more than the reference pages have
    )
    template = (F.col("aligned") >= LEAST_ALIGNED) & (
        F.col("constant") >= CONSTANT_SHARE * F.col("aligned")
    )
    menu = F.col("linked") > LINK_SHARE * F.col("chars")
    texts = F.when(template & ~menu, F.col("texts"))
    return total.select("host", "path", (~template & ~menu).alias("content"), texts.alias("texts"))


def main_text(page: str, dropped: dict[str, set[int] | None]) -> str:
    """The content of a page; ``dropped`` are the paths and texts that its host's wrapper drops.

    A path with None is dropped with all its texts.
    """
    kept = []
    for slot in slots(read(page)):
        if slot.aside:
            continue
        text = slot.text()
        if slot.path in dropped:
            texts = dropped[slot.path]
            if texts is None or _digest(text) in texts:
                continue
        kept.append((slot, text))
    inside = [text for slot, text in kept if slot.main]
    beside = sum(len(t) - s.linked for s, t in kept if s.node.tag in PROSE and not s.main)
    # A marked article beside which there is more prose is a teaser.
    whole = not inside or beside > sum(map(len, inside))
    return "\n".join(t for s, t in kept if t and (whole or s.main))


def _extracted(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(source):
        dropped = batch.column("dropped")
        texts = [
            main_text(page, {d["path"]: d["texts"] and set(d["texts"]) for d in dropped[i].as_py() or []})
            for i, page in enumerate(texts_of(batch, "html"))
        ]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A block is an element like a paragraph, heading, list item or cell. Character
    references are decoded, white space in a block becomes one space, and blocks are joined in
    page order by a line feed. Null and empty pages have an empty text. Pages without a
    readable host share one wrapper; a host with a single page has none to compare with, so
    only elements and names decide. Repeated rows are each extracted. Other columns are
    ignored. An empty table gives no rows.
    """
    ready(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        host_of(F.col("url")).alias("host"),
    )
    roles = wrappers(rows)
    dropped = stored(
        roles.where("not content").groupBy("host").agg(F.collect_list(F.struct("path", "texts")).alias("dropped")),
        "wrappers",
    )
    return rows.join(dropped, "host", "left").select("page_id", "url", "html", "dropped").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long"
    )
