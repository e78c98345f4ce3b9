"""A small tree of an HTML page, and the alignment of two trees by simple tree matching.

Reading is forgiving: end tags may be missing or stray, and the usual elements close
each other. Text of elements that are no text (script, style) is skipped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator, Sequence
from typing import TypeVar

import numpy as np

T = TypeVar("T")

# A tag is matched as a whole if neither < nor > stands in its quotes, as is usual.
OPENING = re.compile(
    r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*+)(?:((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>)?)"
)
DECLARATION = re.compile("<[!?]")
ATTRIBUTE = re.compile("[>\"']")
CELLS = 1_000_000  # of an alignment of children that are held at once
GAINS = 2_000_000  # scores of children with columns of an alignment that are kept
WIDE = 64  # columns of an alignment from which on its rows are arrays
NAMED = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template iframe svg math object textarea title".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody"
    " tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form"
    " fieldset address hr details summary menu dialog center".split()
)
# A start tag ends an open element of these kinds, up to the bounds named.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_BOUNDS = frozenset("html body main article section div td th li dd blockquote button".split())


class Node:
    """An element: its label, and its children as nodes and texts in page order."""

    __slots__ = ("tag", "names", "label", "children", "shape", "nodes")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names = tag, names
        # Digits tell elements of one kind apart ("post-17"), so alignment does without them.
        self.label = tag + "".join("." + DIGITS.sub("", n) for n in names)
        self.children: list[Node | str] = []
        self.nodes: list[Node] = []
        self.shape = -1


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return ()
    found = []
    for m in NAMED.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden":
            found.append("hidden")
        else:
            found += value.lower().split()
    return tuple(found)


class Markup:
    """The tags of a page, each found from where the one before it ended.

    A tag ends at the first ``>`` outside of quotes, or, if a quote is never closed, at the first
    one at all. What has no end is text. Reading is linear in the page: ``hopeless`` are
    quotes from which no end was found, and are not tried again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.hopeless: set[int] = set()

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; there is one."""
        start, seen = at, []
        while m := ATTRIBUTE.search(self.page, at):
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            if m.start() in self.hopeless or m.start() == self.last[m[0]]:
                break
            at = self.page.find(m[0], m.end()) + 1
        self.hopeless.update(seen)
        return self.page.find(">", start)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes); comments and declarations have no name."""
        page = self.page
        m = OPENING.search(page, at)
        if m is None:
            return None
        if m[5] is not None:
            return m.start(), m.end(), m[3], m[4], m[5]
        if m[1] or m[2]:
            mark = "-->" if m[1] else ">"
            end = page.find(mark, m.end())
            return m.start(), len(page) if end < 0 else end + len(mark), "", "", ""
        if m.end() > self.last[">"]:
            # No tag ends from here on; a comment still may begin.
            begins = DECLARATION.search(page, m.start() + 1)
            return (begins.start(), len(page), "", "", "") if begins else None
        end = self._end(m.end())
        return m.start(), end + 1, m[3], m[4], page[m.end() : end]


def read(page: str) -> Node:
    """The tree of a page, under a root without a name."""
    root = Node("")
    stack = [root]
    opened: Counter[str] = Counter()  # elements on the stack, so that none is sought in vain
    done = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            stack[-1].children.append(html.unescape(piece))
        elif piece:
            stack[-1].children.append(" ")

    def close(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    markup = Markup(page)
    while found := markup.after(done):
        start, end, ends, name, attributes = found
        text(page[done:start])
        done = end
        if not name:
            continue
        tag = name.lower()
        if ends:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in ("html", "body", "head") and opened[tag]:
            continue
        kinds, bounds = CLOSES.get(tag, (None, None))
        if kinds is None and tag in BLOCK:
            kinds, bounds = {"p"}, P_BOUNDS
        if kinds and any(opened[k] for k in kinds):
            last = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in kinds:
                    last = depth
                    if "p" in kinds:
                        break
                elif stack[depth].tag in bounds:
                    break
            if last:
                close(last)
        node = Node(tag, _names(attributes))
        stack[-1].children.append(node)
        stack[-1].nodes.append(node)
        if tag in NO_TEXT:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, done)
            done = closing.end() if closing else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    text(page[done:])
    return root


class Columns:
    """The children that those of another node are aligned with, and what a match with each gains."""

    def __init__(self, nodes: list[Node]):
        places: dict[int, int] = {}
        codes = [places.setdefault(n.shape, len(places)) for n in nodes]
        first: dict[int, Node] = {}
        for n in nodes:
            first.setdefault(n.shape, n)
        self.distinct = list(first.values())
        self.wide = len(codes) >= WIDE
        self.codes = np.array(codes) if self.wide else codes
        self.top = np.zeros(len(codes) + 1, np.int64) if self.wide else [0] * (len(codes) + 1)
        self.kept = {}  # gains by the shape of the other node, in the order of ``distinct``

    def below(self, row, gains):
        """The next row of an alignment: the best matchings with one node more.

        ``row`` may end early; a short one is a list, a long one an array, their numbers the same.
        """
        if not self.wide:
            best, found = 0, [0]
            for before, above, code in zip(row, row[1:], self.codes):
                both = before + gains[code]
                if both > best:
                    best = both
                if above > best:
                    best = above
                found.append(best)
            return found
        found = np.zeros_like(row)
        both = gains.take(self.codes[: len(row) - 1])
        both += row[:-1]
        np.maximum(both, row[1:], out=both)
        np.maximum.accumulate(both, out=found[1:])
        return found


class Matcher:
    """Simple tree matching; trees of one shape are numbered alike and matched once.

    Alignments of children are exact at any length. They take time as the product of both lengths
    (where both lists begin with the same shapes, as the sum), memory as their sum.
    """

    KEPT = 200_000

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []  # nodes of a tree, by shape
        self.scores: dict[tuple[int, int], int] = {}  # may be cleared at any time

    def clear(self) -> None:
        """Forgets all shapes; trees have to be numbered again."""
        self.shapes.clear()
        self.sizes.clear()
        self.scores.clear()

    def number(self, root: Node) -> None:
        """Gives every node of a tree the number of its shape, children first."""
        order, rest = [], [root]
        while rest:
            node = rest.pop()
            order.append(node)
            rest.extend(node.nodes)
        for node in reversed(order):
            key = (node.label, *[n.shape for n in node.nodes])
            node.shape = self.shapes.setdefault(key, len(self.shapes))
            if node.shape == len(self.sizes):
                self.sizes.append(1 + sum(self.sizes[n.shape] for n in node.nodes))

    def _gains(self, x: Node, columns: Columns) -> Generator[tuple[Node, Node], int, Sequence[int]]:
        """The scores of a node and each distinct column; asks for those it cannot tell."""
        gains = columns.kept.get(x.shape)
        if gains is not None:
            return gains
        gains = []
        for y in columns.distinct:
            if x.label != y.label:
                gain = 0
            elif x.shape == y.shape:
                gain = self.sizes[x.shape]
            elif not x.nodes or not y.nodes:
                gain = 1
            else:
                gain = self.scores.get((x.shape, y.shape))
                if gain is None:
                    gain = yield x, y
            gains.append(gain)
        if columns.wide:
            gains = np.array(gains)
        if (len(columns.kept) + 1) * len(gains) > GAINS:
            columns.kept.clear()
        columns.kept[x.shape] = gains
        return gains

    def _scoring(self, a: Node, b: Node) -> Generator[tuple[Node, Node], int, int]:
        """The score of two nodes of one label; asks for scores of their children."""
        xs, ys = a.nodes, b.nodes
        begin, end = _alike(xs, ys), 0
        while end < min(len(xs), len(ys)) - begin and xs[-1 - end].shape == ys[-1 - end].shape:
            end += 1
        # Children of one shape at the begin and the end are matched in some largest matching.
        found = 1 + sum(self.sizes[x.shape] for x in (*xs[:begin], *xs[len(xs) - end :]))
        xs, ys = xs[begin : len(xs) - end], ys[begin : len(ys) - end]
        if xs and ys:
            columns = Columns(ys)
            row = columns.top
            for x in xs:
                row = columns.below(row, (yield from self._gains(x, columns)))
            found += int(row[-1])
        if len(self.scores) >= self.KEPT:
            self.scores.clear()
        self.scores[a.shape, b.shape] = found
        return found

    def _done(self, work: Generator[tuple[Node, Node], int, T]) -> T:
        """The result of ``work``. Trees may be of any depth: what waits for scores stands on a stack."""
        waiting, score = [work], None
        while True:
            try:
                asked = waiting[-1].send(score)
            except StopIteration as done:
                waiting.pop()
                if not waiting:
                    return done.value
                score = done.value
            else:
                waiting.append(self._scoring(*asked))
                score = None

    def score(self, a: Node, b: Node) -> int:
        """Size of the largest matching of two trees that keeps order and parents."""
        return self._done(self._gains(a, Columns([b])))[0]

    def _matched(self, xs: list[Node], ys: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The matched ones of two lists of children, last first.

        The table is traced back from its end. It is made in pieces of ``CELLS`` cells, from rows
        kept half way, half of the rest and so on, so a long one is never held as a whole.
        """
        columns = Columns(ys)
        kept = [(0, columns.top)]
        i, j = len(xs), len(ys)
        while i and j:
            at, row = kept[-1]
            if at == i:
                kept.pop()
                continue
            table = [row[: j + 1]]
            while i - at > 1 and (i - at) * j > CELLS:
                middle = (at + i) // 2
                for x in xs[at:middle]:
                    table = [columns.below(table[0], self._done(self._gains(x, columns)))]
                at = middle
                kept.append((at, table[0]))
            for x in xs[at:i]:
                table.append(columns.below(table[-1], self._done(self._gains(x, columns))))
            while i > at and j:
                if table[i - at][j] == table[i - at - 1][j]:
                    i -= 1
                elif table[i - at][j] == table[i - at][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield xs[i], ys[j]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The matched nodes of two numbered trees."""
        matched, rest = [], [(a, b)] if a.label == b.label else []
        while rest:
            x, y = rest.pop()
            matched.append((x, y))
            begin = _alike(x.nodes, y.nodes)  # the table would match these, too
            rest.extend(zip(x.nodes[:begin], y.nodes[:begin]))
            if begin < min(len(x.nodes), len(y.nodes)):
                rest.extend(self._matched(x.nodes[begin:], y.nodes[begin:]))
        return matched


def _alike(xs: list[Node], ys: list[Node]) -> int:
    """How many nodes two lists begin with that have the same shapes."""
    return next((i for i, (x, y) in enumerate(zip(xs, ys)) if x.shape != y.shape), min(len(xs), len(ys)))
