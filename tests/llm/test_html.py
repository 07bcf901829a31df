import itertools
import math

import pytest

from transitlab.llm.html_content import Layouts, Model, extract, kind, labels, layout_model, parse
from transitlab.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return layout_model()


def slow_marginals(model: Model, nodes):
    """Content marginals by adding up all assignments."""
    own = [model.own(n, nodes[0].size) for n in nodes]
    totals, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        log = model.root[states[0]]
        for i, (node, s) in enumerate(zip(nodes, states)):
            log += own[i][s]
            if i:
                log += model.edge.get(kind(nodes[node.parent].tag), model.edge["*"])[states[node.parent]][s]
        weight = math.exp(log)
        totals += weight
        for i, s in enumerate(states):
            content[i] += weight * s
    return [c / totals for c in content]


@pytest.mark.parametrize(
    "page",
    [
        "",
        "text",
        "<p>One.<p>Two words<div class=ad>Buy this",
        "<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>Some words.</article><footer>x</footer>",
        "<div><ul><li>a<li><a href=1>b c d</a></ul></div><main>Long enough text to be one.</main>",
    ],
)
def test_marginals_are_exact(model, page):
    nodes = parse(page)
    assert model.marginals(nodes) == pytest.approx(slow_marginals(model, nodes), abs=1e-9)


def test_held_out_layouts(model):
    layouts, wrong, runs, whole = Layouts(12345), 0, 0, 0
    for _ in range(300):
        nodes = parse(layouts.page())
        bad = [n for n, s, p in zip(nodes, labels(nodes), model.marginals(nodes)) if n.tag == "#text" and s != (p > 0.5)]
        wrong, runs, whole = wrong + len(bad), runs + sum(n.tag == "#text" for n in nodes), whole + (not bad)
    assert wrong < 0.025 * runs and whole > 0.75 * 300


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept them all.</p></div>
<article><h1>A title &amp; more</h1><p>First&nbsp;line<br>and the second.<p>An <b>unclosed <i>paragraph
 over lines</p><div class="ad">Buy now!</div><ul><li>An item.<li>Another one</ul>All rights reserved.
<section id="comments"><h3>Comments</h3><p>I liked this text a lot, thank you for it.</p></section></article>
<aside><h3>Related</h3><p><a href="/b">Other text</a></p></aside>
<form><label>Mail</label><input name=q></form><!-- <p>gone</p> --><footer>&copy; 2020 Site. Legal notice.</footer>"""


def test_a_page(model):
    assert model.main_text(PAGE).split("\n") == [
        "A title & more", "First line and the second.", "An unclosed paragraph over lines", "An item.", "Another one",
        "All rights reserved.",
    ]


LONG = "Some sentence of the article with quite a lot of words in it, so that it is prose."
SHORT = "It goes on."


@pytest.mark.parametrize(
    "page, want",
    [
        (  # columns whose names say nothing
            f"<div class='wrapper'><div class='hdr'><a href=x>Home</a> <a href=y>News</a></div><div class='col-8'><h1>The title</h1><p>{LONG}</p>"
            f"<p>{LONG}</p></div><div class='col-4'><h3>Related</h3><ul><li><a href=1>one other text</a></li><li><a href=2>two</a></li></ul></div></div>",
            ["The title", LONG, LONG],
        ),
        (  # comments under a name of their own
            f"<div class='main'><h1>Title one</h1><p>{LONG}</p><p>{LONG}</p><div class='feedback-thread'><h3>Comments</h3><p>I liked it.</p>"
            "<p>Me too, a lot of it.</p></div></div>",
            ["Title one", LONG, LONG],
        ),
        (  # straight under the body
            f"<body><h1>Title here</h1><p>{LONG}</p><p>{LONG}</p><ul><li><a href=1>Home</a></li><li><a href=2>Up</a></li></ul></body>",
            ["Title here", LONG, LONG],
        ),
        (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a></td><td><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></td></tr></table>", ["Title", LONG, LONG]),
        (f"<article><h1>T</h1><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><noscript><p>{LONG}</p></noscript></article>", ["T", f"{LONG} x=1", LONG]),
        (f"<p>{LONG}</p>", [LONG]),
        (f"<div class='ad'><p>{LONG}</p></div>", None),  # whatever it is, a page with sentences has an article
    ],
)
def test_pages_written_by_hand(model, page, want):
    """What a reader would call the article; nothing here comes from the parser."""
    found = model.main_text(page).split("\n")
    assert found == want if want else found != [""]


def test_end_tags_without_an_element_cost_nothing():
    import time

    def seconds(n):
        start = time.perf_counter()
        parse("<div>" * n + "</section>" * n)
        return time.perf_counter() - start

    assert seconds(40_000) < 30 * max(seconds(4_000), 0.01)


@pytest.mark.parametrize(
    "page, runs",
    [
        ("a < b &lt; c", ["a < b < c"]),
        ("<p title='a > b'>x</p>", ["x"]),
        ('<p title="open>x</p>', ["x"]),
        ("<SCRIPT>no<p>no</SCRIPT >yes", ["yes"]),
        ("<script>never closed <p>no", []),
        ("<textarea><p>no</textarea><P>yes", ["yes"]),
        ("<head><title>no</title><p>yes", ["yes"]),
        ("</div></p>x</nothing><p/>y", ["x", "y"]),
        ("<td>a<td>b<tr><td>c", ["a", "b", "c"]),
        ("<!-- open <p>no", []),
        ("<![CDATA[ x ]]><?php x ?>t", ["t"]),
        ("<p>a" * 3000, ["a"] * 3000),
        ("<div>" * 5000 + "deep", ["deep"]),
        ("<svg><title>no</title><text>no</text></svg>yes", ["yes"]),
    ],
)
def test_parser_takes_anything(model, page, runs):
    nodes = parse(page)
    assert [n.text for n in nodes if n.tag == "#text"] == runs
    assert all(n.parent < i for i, n in enumerate(nodes))
    model.marginals(nodes)


def test_query_finds_the_articles(spark, small):
    """The articles of the table are marked as such, so that what the model finds can be held against them."""
    rows = {r.page_id: r for r in QUERIES["op9_tree_marginals"](spark, small).collect()}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        nodes = parse(page.html)
        inside = [False] * len(nodes)
        for i, node in enumerate(nodes):
            inside[i] = node.tag == "article" or i > 0 and inside[node.parent]
        want = "\n".join(n.text for n, a in zip(nodes, inside) if a and n.tag == "#text")
        assert rows[page.page_id].text == want and rows[page.page_id].n_chars == len(want)


def test_edges(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, None, None), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (4, "u", "<p>" + "word " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(pages, model).collect()
    assert len(found) == len(rows)
    assert [r.text for r in found if r.page_id in (1, 2, None)] == ["", "", ""]
    assert {r.n_chars for r in found if r.page_id == 4} == {200_000 * 5 - 1}
    assert extract(pages.limit(0), model).count() == 0
