"""Page extraction: planted pages, the tree reader, and tree matching against brute force."""

from __future__ import annotations

import random
import time
from functools import cache

import pytest

from coldwatch.llm import pages
from coldwatch.llm.dom import Matcher, Node, read

SCHEMA = "text string, page_id long, url string, html string, host string"


def extracted(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame([("t", *r, "h") for r in rows], SCHEMA)
    return {r.page_id: r for r in pages.extract(df).collect()}


def page(n: int, paragraphs: list[str]) -> str:
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t='</p>';</script>"
        f"</head><body class='with-sidebar'><header><h2>Site</h2></header><nav><ul><li><a href=x>M{n}</a></ul></nav>"
        f"<div class='ad'>Buy {n}</div><article><h1>Head &amp; {n}</h1>{body}"
        f"<p class=stamp>Printed on recycled paper</p><div class='comments'><p>Nice {n}</p></div>"
        f"<form><input><button>Send</button></form></article>"
        f"<aside>Other {n}</aside><div id=cookie-notice>OK?</div><footer>&copy; {n}</footer>"
    )


def test_content_of_a_host(spark):
    rows = [
        (n, "https://a.example.com/x", page(n, [f"First {n} &lt;b&gt;<br> line", f"more\n  <b>text</b>&nbsp;{n}"]))
        for n in range(30)
    ]
    got = extracted(spark, rows)
    for n in range(30):
        assert got[n].text == f"Head & {n}\nFirst {n} <b> line\nmore text {n}"
        assert got[n].n_chars == len(got[n].text)


def test_template_without_marked_article(spark):
    rows = [
        (n, "http://b.example.org", f"<body><div>Same words everywhere</div><div>Story {n}<p>Body {n * n}")
        for n in range(20)
    ]
    got = extracted(spark, rows)
    # Both divs have one path, which varies in half of the pages' nodes, so it is kept.
    assert all(f"Story {n}\nBody {n * n}" in got[n].text for n in range(20))
    rows = [(n, u, h.replace("<div>Same", "<div class=top>Same")) for n, u, h in rows]
    assert extracted(spark, rows)[7].text == "Story 7\nBody 49"


def test_near_copies_are_no_template(spark):
    def story(k: str, advert: str) -> str:
        body = "".join(f"<p>Paragraph {i} of the story of {k}</p>" for i in range(10))
        return f"<body><div>Offer {advert}</div><article><h1>On {k}</h1>{body}<p class=stamp>All rights kept</p></article>"

    lines = lambda k: [f"Paragraph {i} of the story of {k}" for i in range(10)]
    rows = [(n, "http://two.example/", story("bees", f"no {n}")) for n in range(2)]
    rows += [(100 + n, "http://hot.example/", story("ants", f"no {n}")) for n in range(45)]
    rows += [(200 + n, "http://hot.example/", story(f"owl {n}", f"no {n + 50}")) for n in range(5)]
    # Without a marked article, and with text inside of other elements.
    rows += [
        (300 + n, "http://plain.example/", "<div class=x>" + "".join(f"<p>{t}</p>" for t in lines("bees")) + f"</div>Day {n}")
        for n in range(2)
    ]
    rows += [
        (400 + n, "http://spans.example/", f"<article><p><span>Word {n}</span></p><p class=stamp><b>Kept</b></p>")
        for n in range(20)
    ]
    got = {k: r.text.split("\n") for k, r in extracted(spark, rows).items()}
    assert all(got[n][:11] == ["On bees", *lines("bees")] for n in range(2))
    assert all(got[100 + n][:11] == ["On ants", *lines("ants")] for n in range(45))
    assert all(got[200 + n][:11] == [f"On owl {n}", *lines(f"owl {n}")] for n in range(5))
    assert all(got[300 + n][:10] == lines("bees") for n in range(2))
    assert all(got[400 + n] == [f"Word {n}"] for n in range(20))


def test_only_constant_texts_of_a_template_path_are_dropped(spark):
    fixed = "".join(f"<p>Line {i}</p>" for i in range(12))
    own = lambda n: f"A paragraph that only page {n} has, longer than all of the lines around it: {n * n}." * 3
    rows = [(n, "http://k.example/", f"<article><h1>T{n}</h1>{fixed}<p>{own(n)}</p></article>") for n in range(20)]
    got = extracted(spark, rows)
    assert all(got[n].text.split("\n") == [f"T{n}", own(n)] for n in range(20))


def test_names_that_only_mention_an_aside(spark):
    story = "<h1>Head</h1><p>First paragraph of the story.</p><p>Second paragraph of it.</p>"
    wanted = "Head\nFirst paragraph of the story.\nSecond paragraph of it."
    around = [
        "<div class='content with-sidebar'>{}</div>", "<div id=page class=no-sidebar>{}</div>",
        "<article class='post has-comments'>{}</article>", "<main class=layout-nav-left>{}</main>",
        "<div class=sidebar-right><article>{}</article></div>", "<div class='banner'>{}</div>",
        "<article class='post-share'>{}</article>", "<div class=with-ads><p class=no-ads></p>{}</div>",
    ]
    aside = [
        "<div class=ad>Buy this</div>", "<div id=cookie-notice>OK?</div>", "<div class=left-sidebar>More</div>",
        "<div class=ad-slot-1>Buy</div>", "<section class=comments><p>Nice</p></section>", "<div class=site-header>Site</div>",
        "<div class=related><article><p>Teaser</p></article></div>",
        "<div id=comments>" + "<p>A comment that has more words than the story itself has.</p>" * 5 + "</div>",
    ]
    pages_of = [(a.format(story), x) for a in around for x in aside]
    rows = [(n, f"http://n{n}.example/", f"<body>{x}{a}{x}</body>") for n, (a, x) in enumerate(pages_of)]
    got = extracted(spark, rows)
    for n, (a, x) in enumerate(pages_of):
        # A banner is one only while it does not hold most of the page.
        if "'banner'" not in a or ("Teaser" not in x and "more words" not in x):
            assert got[n].text == wanted, (a, x)
    # Parts of the article that are none of it still go.
    inside = story.replace("<p>Second", "<div class=share>Tell a friend</div><p>Second")
    rows = [(n, f"http://i{n}.example/", a.format(inside)) for n, a in enumerate(around)]
    got = extracted(spark, rows)
    assert all(got[n].text == wanted for n in range(len(around)))


def test_edge_cases(spark):
    rows = [
        (0, None, None), (1, "", ""), (2, "not a url", "plain text"), (3, "http://c/", "<p>one"),
        (4, "http://d/", "<p>same</p>"), (4, "http://d/", "<p>same</p>"), (None, "http://e/", "<p>x</p>"),
        (5, "http://f/", "<div>" * 3000 + "deep"), (6, "http://g/", "<p>a < b & c &amp; d <i title=\"x>y\">z</i>"),
        (7, "http://h/", "<script>no"), (8, "http://i/", "<!-- open"), (9, "http://j/", "<ul>" + "<li>i" * 2000),
        (10, "http://k/", "w " * 200_000),
    ]
    df = spark.createDataFrame([("t", *r, "h") for r in rows], SCHEMA)
    found = pages.extract(df).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    assert text[0] == text[1] == text[7] == text[8] == ""
    assert (text[2], text[3], text[4], text[None], text[5]) == ("plain text", "one", "same", "x", "deep")
    assert text[6] == "a < b & c & d z"
    assert text[9] == "\n".join(["i"] * 2000) and len(text[10]) == 399_999
    assert pages.extract(df.limit(0)).collect() == []


def tree(rng: random.Random, depth: int) -> Node:
    node = Node(rng.choice("ab"))
    for _ in range(rng.randint(0, 3) if depth else 0):
        node.nodes.append(tree(rng, depth - 1))
    node.children = list(node.nodes)
    return node


def test_tree_matching_against_plain_recursion():
    rng = random.Random(8)
    matcher = Matcher()

    @cache
    def forests(x: tuple, y: tuple) -> int:
        if not x or not y:
            return 0
        return max(
            forests(x[1:], y), forests(x, y[1:]), trees(x[0], y[0]) + forests(x[1:], y[1:])
        )

    def trees(a: Node, b: Node) -> int:
        return 1 + forests(tuple(a.nodes), tuple(b.nodes)) if a.label == b.label else 0

    for _ in range(200):
        a, b = tree(rng, 3), tree(rng, 3)
        matcher.number(a)
        matcher.number(b)
        pairs = matcher.pairs(a, b)
        assert matcher.score(a, b) == trees(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})


@pytest.mark.parametrize("count", [50, 250, 400, 3000])
def test_lists_of_any_length_are_aligned(count):
    rows = [f"<p>a {n}</p><h3>b {n}</h3>" for n in range(count)]
    matcher = Matcher()
    a, b = read("<div>" + "".join(rows)), read("<div><ul></ul>" + "".join(rows[:9] + ["<hr>"] + rows[9:]))
    matcher.number(a), matcher.number(b)
    pairs = matcher.pairs(a, b)
    assert matcher.score(a, b) == len(pairs) == 2 + 2 * count
    children = [(x.children, y.children) for x, y in pairs if x.tag in ("p", "h3")]
    assert len(children) == 2 * count and all(x == y for x, y in children)


@pytest.mark.parametrize("cells, wide", [(1, 64), (20, 1), (300, 4)])
def test_tables_in_pieces_match_the_same_nodes(monkeypatch, cells, wide):
    def matched(a: Node, b: Node) -> set:
        matcher = Matcher()
        matcher.number(a), matcher.number(b)
        found = matcher.pairs(a, b)
        assert len(found) == matcher.score(a, b)
        return {(id(x), id(y)) for x, y in found}

    rng = random.Random(9)
    couples = []
    for _ in range(60):
        a, b = Node("r"), Node("r")
        for root in (a, b):
            root.nodes = [tree(rng, 2) for _ in range(rng.randint(1, 40))]
        couples.append((a, b, matched(a, b)))
    monkeypatch.setattr("coldwatch.llm.dom.CELLS", cells)
    monkeypatch.setattr("coldwatch.llm.dom.WIDE", wide, raising=False)
    assert all(matched(a, b) == found for a, b, found in couples)


def test_reader_closes_what_is_open():
    root = read("<ul><li>a<li>b</ul><p>c<b>d<p>e</div><table><tr><td>f<td>g<tr><td>h</table><br/>i")
    labels = [n.label for n in root.nodes]
    assert labels == ["ul", "p", "p", "table", "br"]
    assert [len(n.nodes) for n in root.nodes] == [2, 1, 0, 2, 0]


@pytest.mark.parametrize("text", [
    "<a " * 350_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">", "<a \"'>" * 150_000, "</x>" * 200_000,
    "<a <!--" * 100_000, "<span><h1>" * 50_000, "<p><b>" * 80_000, "<div>" * 100_000 + "deep",
])
def test_broken_and_deep_pages_are_read_in_linear_time(text):
    begun = time.process_time()
    pages.main_text(text, {})
    assert time.process_time() - begun < 20


def test_depth_changes_nothing():
    body = "<nav>Menu item</nav><article><p>Body text</p></article><div class='comments'><p>reader says</p></div>"
    for depth in (0, 150, 199, 250, 5000):
        assert pages.main_text("<div>" * depth + body + "</div>" * depth, {}) == "Body text"
    matcher = Matcher()
    a, b = read("<div>" * 5000 + "<p>x"), read("<div>" * 4000 + "<p>y")
    matcher.number(a), matcher.number(b)
    assert matcher.score(a, b) == 4001 == len(matcher.pairs(a, b))
    assert len(read("<div id=post-12></div>").nodes) == 1
    assert read("<div id=post-12></div>").nodes[0].label == read("<div id=post-7></div>").nodes[0].label


def test_forms():
    whole = "<form id='aspnetForm'><nav>Menu</nav>{}<footer>Foot</footer><input><button>Go</button></form>"
    assert pages.main_text(whole.format("<article><p>Body</p></article>"), {}) == "Body"
    prose = "<div><h1>Title</h1><p>A text of some words.</p><p>And another.</p></div>"
    assert pages.main_text(whole.format(prose), {}) == "Title\nA text of some words.\nAnd another."
    asked = "<form><label>Your name</label><div>Send us what you think of this page today</div><p>Terms.</p></form>"
    assert pages.main_text(f"<p>Short.</p>{asked}", {}) == "Short."
    assert pages.main_text(f"<article><p>Body</p>{asked}</article>", {}) == "Body"


def test_a_teaser_is_no_article():
    teaser = "<article><h2>Also read</h2></article>"
    body = "<div><p>The text of the page, which is much longer.</p><p>It goes on.</p></div>"
    assert "It goes on." in pages.main_text(body + teaser, {})
    rest = "<div>A line beside it</div>"
    assert pages.main_text(f"<article><p>Short text.</p></article>{rest}", {}) == "Short text."
