"""Main text of web pages by a graphical model over the tree of each page.

Every block element and text run is a variable: content (or leading to content) or
not. Parent-child potentials, by the parent's kind, tie neighbours together; node
potentials hold what the node shows of itself: its element, the words in its class,
id and role, and what is in it: how much of the page's text, how much of it linked,
sentences, a main heading, where it stands, and what its first heading says. For
text: its length, the share in links, its punctuation and place. Names may be
missing or mean nothing, as in part of the labelled pages. The graph is a tree, so sum-product messages, first upward from the leaves and then
downward from the root, give exact marginals. Text runs whose marginal for content
is over one half are the page's main text. All potentials are smoothed counts over
labelled pages: layouts written by rule, with the label of each part in them.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .html_tree import Node, SAYS, parse, said

CONTENT = "content"

#: Parents whose children differ in how far they follow them; all others are one kind.
PARENTS = frozenset("#root body div section article main p h1 h2 h3 ul ol li table tr td aside nav header footer form".split())

#: The runs of one part are much alike, so each one's own evidence counts as this share of an independent one.
TEXT_WEIGHT = 0.4

#: What an element holds is told by several features that go together, so each counts as this share.
SHAPE_WEIGHT = 0.5

#: Elements that hold one block; what is in them is told by their text.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 figcaption pre button label caption".split())

#: Parts of lists and tables: many of them say no more than what they are part of.
ITEMS = frozenset("li tr td th dt dd tbody thead tfoot".split())


def step(value: float, *bounds: float) -> int:
    """How many of the rising bounds the value reaches."""
    return sum(value >= b for b in bounds)


def features(node: Node, page: int) -> list[str]:
    """What a node shows of itself, in a page of so many characters of text."""
    place = step(node.start, 0.02, 0.1, 0.5, 0.9, 0.98)
    if node.tag != "#text":
        own = [] if node.tag in ITEMS else [f"<{node.tag}>"]
        own += [f".{cue}" for cue in sorted(node.cues)]
        if node.headed:
            own.append(f".headed {node.headed}")
        if node.tag in ITEMS or node.tag in BLOCKS:
            return own
        linked = step(node.links / max(1, node.size), 0.01, 0.3, 0.7)
        shape = f"~size {step(node.size / max(1, page), 0.02, 0.1, 0.3, 0.6)}", f"~linked {linked} prose {min(3, node.prose)}"
        return [*own, *shape, f"~title {node.title}", f"~at {place}"]
    words = node.text.count(" ") + 1
    share = node.linked / len(node.text)
    found = [
        f"{node.within} words {min(5, words.bit_length())}",
        f"{node.within} linked {0 if share == 0 else 1 if share < 0.5 else 2}",
        f"{node.within} sentence {node.text[-1] in '.!?…:;\"”»)'}",
        f"{node.within} at {place}",
    ]
    says = said(node.text)
    return [*found, f"says {says}"] if says else found


def kind(tag: str) -> str:
    return tag if tag in PARENTS else "*"


@dataclass(frozen=True)
class Model:
    """Log-potentials: of a feature, and of a child's state given its parent's kind and state; states are 0 and 1."""

    node: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]

    def own(self, node: Node, page: int) -> tuple[float, float]:
        """Features that no labelled page has say nothing."""
        found = [(self.node[f], SHAPE_WEIGHT if f[0] == "~" else 1.0) for f in features(node, page) if f in self.node]
        weight = TEXT_WEIGHT if node.tag == "#text" else 1.0
        return weight * sum(x[0] * w for x, w in found), weight * sum(x[1] * w for x, w in found)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """For each node, the probability of content, by sum-product messages in logarithms."""
        up = [self.own(node, nodes[0].size) for node in nodes]
        up[0] = (up[0][0] + self.root[0], up[0][1] + self.root[1])
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            parent = nodes[i].parent
            edge = self.edge.get(kind(nodes[parent].tag), self.edge["*"])
            belief = up[i]
            sent[i] = tuple(_add(row[0] + belief[0], row[1] + belief[1]) for row in edge)
            up[parent] = (up[parent][0] + sent[i][0], up[parent][1] + sent[i][1])
        whole = list(up)
        for i in range(1, len(nodes)):
            parent = nodes[i].parent
            edge = self.edge.get(kind(nodes[parent].tag), self.edge["*"])
            rest = (whole[parent][0] - sent[i][0], whole[parent][1] - sent[i][1])
            down = tuple(_add(edge[0][s] + rest[0], edge[1][s] + rest[1]) for s in (0, 1))
            whole[i] = (up[i][0] + down[0], up[i][1] + down[1])
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in whole]

    def main_text(self, source: str | None) -> str:
        """The text runs that are content, in page order, one to a line.

        A page with sentences has an article: if no run reaches one half, those that reach half of the best one's
        chance are it."""
        nodes = parse(source)
        chances = self.marginals(nodes)
        runs = [(n, p) for n, p in zip(nodes, chances) if n.tag == "#text"]
        least = 0.5
        if nodes[0].prose and not any(p > least for _, p in runs):
            least = 0.5 * max(p for n, p in runs if n.prose)
        return "\n".join(n.text for n, p in runs if p > least)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def labels(nodes: list[Node]) -> list[int]:
    """1 for text under the label ``content`` and for elements that hold such text, else 0."""
    given = [node.label for node in nodes]
    for i in range(1, len(nodes)):
        given[i] = given[i] or given[nodes[i].parent]
    state = [int(label == CONTENT and node.tag == "#text") for node, label in zip(nodes, given)]
    for i in range(len(nodes) - 1, 0, -1):
        state[nodes[i].parent] |= state[i]
    return state


def train(pages: Iterable[str], smooth: float = 0.5) -> Model:
    """Counts over pages whose elements bear ``data-label`` (content or another word; children inherit it)."""
    seen: list[Counter] = [Counter(), Counter()]
    totals = {True: [0, 0], False: [0, 0]}
    pairs: Counter = Counter()
    roots = [0, 0]
    for page in pages:
        nodes = parse(page)
        state = labels(nodes)
        roots[state[0]] += 1
        for i, node in enumerate(nodes):
            seen[state[i]].update(features(node, nodes[0].size))
            totals[node.tag == "#text"][state[i]] += 1
            if i:
                for name in {kind(nodes[node.parent].tag), "*"}:
                    pairs[name, state[node.parent], state[i]] += 1

    def log_share(part: float, whole: float) -> float:
        return math.log((part + smooth) / (whole + 2 * smooth))

    node = {
        f: tuple(log_share(seen[s][f], totals[not f.startswith(("<", ".", "~"))][s]) for s in (0, 1))
        for f in {*seen[0], *seen[1]}
    }
    edge = {
        name: tuple(
            tuple(log_share(pairs[name, p, c], pairs[name, p, 0] + pairs[name, p, 1]) for c in (0, 1)) for p in (0, 1)
        )
        for name in {key[0] for key in pairs}
    }
    return Model(node, edge, tuple(log_share(r, sum(roots)) for r in roots))


class Layouts:
    """Labelled pages by rule. The words are of no matter; what varies is what pages are made of."""

    ARTICLES = (
        "<article>", "<article>", "<main>", "<main><article>", "<div class='content'>", "<div id='main-content'>",
        "<div class='post-body'>", "<section class='entry-content'>", "<div class='article'>", "<div id='main'><div class='text'>",
        "<div class='story'>", "<div role='main'>", "<div class='page'><section>", "<div>", "", "", "",
    )
    MENUS = ("<nav><ul>", "<ul class='menu'>", "<div class='navigation'><ul>", "<div id='nav'><ul>", "<ul class='breadcrumb'>", "<div class='pagination pager'><ul>", "<div role='navigation'><ul>", "<div class='toolbar tabs'><ul>")
    ADS = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion", "adsense")
    NOTICES = ("cookie", "cookie notice", "consent", "gdpr", "alert", "popup modal", "overlay", "notice", "newsletter", "subscribe", "paywall", "disclaimer", "dialog", "notification", "cookies privacy")
    SIDES = ("sidebar", "side widget", "related", "recommended more", "social share", "sharing", "tags", "trending popular", "teaser", "aside", "links", "author bio")
    COMMENTS = ("comments", "comment list", "responses replies", "discussion disqus", "reader comments", "respond reply")
    HEADS = ("<header>", "<div class='header'>", "<div id='masthead'>", "<header class='top'>", "<div id='topbar' class='logo'>")
    FEET = ("<footer>", "<div class='footer'>", "<div id='bottom' class='copyright'>", "<footer class='legal'>", "<div role='contentinfo'>")

    #: Names that say nothing. Pages of some makers have no others.
    PLAIN = ("wrapper", "wrap", "col-8", "col-4", "row", "box", "inner", "outer", "hdr", "ftr", "c1", "x9f", "left", "right", "block-3", "container", "css-1q2w", "grid")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = False  # whether the page at hand has names that say nothing
        self.pool = ["".join(self.r.choices("aeinorst", k=self.r.randint(2, 9))) for _ in range(500)]

    def words(self, low: int, high: int, end: str = ".") -> str:
        return " ".join(self.r.choices(self.pool, k=self.r.randint(low, high))).capitalize() + end

    def prose(self) -> str:
        return self.words(*self.r.choice(((1, 3), (3, 15), (10, 40), (30, 120), (80, 200))), self.r.choice((".", ".", ".", "!", "?", "")))

    def link(self, text: str) -> str:
        return f"<a href='/{text[:5]}'>{text}</a>"

    def heading(self, *tags: str, says: str = "") -> str:
        tag = self.r.choice(tags)
        text = self.words(1, 8, "")
        if says and self.r.random() < 0.6:
            text = f"{self.r.choice(('', '3 '))}{self.r.choice(SAYS[says].split()).capitalize()}{self.r.choice(('', ' ' + self.words(1, 2, '')))}"
        return f"<{tag}>{text}</{tag}>"

    def named(self, name: str) -> str:
        """The name, or on a plain page mostly one that says nothing."""
        return self.r.choice(self.PLAIN) if self.plain and self.r.random() < 0.8 else name

    def block(self) -> str:
        """A part of an article."""
        shape = self.r.randrange(16)
        if shape < 7:
            inside = self.prose()
            return f"<p>{inside} {self.link(self.words(1, 3, ''))} {self.prose()}</p>" if self.r.random() < 0.2 else f"<p>{inside}" + self.r.choice(("</p>", "</p>", ""))
        if shape == 7:
            return self.heading("h2", "h2", "h3", "h3", "h4")
        if shape in (8, 14, 15):
            return "<ul>" + "".join(f"<li>{self.prose()}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>"
        if shape == 9:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if shape == 10:
            return f"<figure><img src='x'><figcaption>{self.words(3, 12)}</figcaption></figure>"
        if shape == 11:
            return f"<pre>{self.prose()}</pre>"
        if shape == 12:
            cells = "".join(f"<td>{self.words(1, 4, '')}</td>" for _ in range(3))
            return f"<table><tr>{cells}</tr></table>"
        return f"<div>{self.prose()}</div>" if self.r.random() < 0.5 else f"<ol><li>{self.prose()}<li>{self.prose()}</ol>"

    def closed(self, opening: str, inside: str) -> str:
        """The opening tags, the first marked as no content, the inside and the closing tags."""
        first, _, rest = opening.partition(">")
        tags = [part.split()[0].strip(">") for part in opening.split("<")[1:]]
        return f"{first} data-label='other'>{rest}{inside}" + "".join(f"</{t}>" for t in reversed(tags))

    def items(self, linked: float) -> str:
        texts = [self.words(1, 6, "") for _ in range(self.r.randint(2, 8))]
        return "".join(f"<li>{self.link(t) if self.r.random() < linked else t}</li>" for t in texts)

    def other(self, names: tuple[str, ...], tags: tuple[str, ...] = ("div", "section"), says: str = "") -> str:
        """An element of another kind, with prose, links or a list in it."""
        inside = self.r.choice(
            (
                self.prose(),
                f"<p>{self.prose()}</p>",
                f"{self.heading('h2', 'h3', 'h3', 'h4', 'p', says=says)}<p>{self.prose()}</p><p>{self.link(self.words(1, 5, ''))}</p>",
                f"<ul>{self.items(0.9)}</ul>",
                f"<p>{self.prose()}</p><button>{self.words(1, 2, '')}</button>",
            )
        )
        where = self.r.choice(("class", "class", "id"))
        return self.closed(f"<{self.r.choice(tags)} {where}='{self.named(self.r.choice(names))}'>", inside)

    def form(self) -> str:
        fields = "".join(f"<p><label>{self.words(1, 3, '')}</label><input></p>" for _ in range(self.r.randint(1, 4)))
        return self.closed("<form>", f"<p>{self.prose()}</p>{fields}<button>{self.words(1, 2, '')}</button>")

    def comments(self) -> str:
        texts = "".join(f"<{t}>{self.prose()}</{t}>" for t in (self.r.choice(("li", "div", "p")) for _ in range(self.r.randint(1, 5))))
        return self.closed(f"<{self.r.choice(('div', 'section', 'ol', 'aside'))} {self.r.choice(('id', 'class'))}='{self.named(self.r.choice(self.COMMENTS))}'>", f"{self.heading('h2', 'h3', 'h4', says='comments')}{texts}")

    def menu(self) -> str:
        return self.closed(self.opened(self.r.choice(self.MENUS)), self.items(0.97))

    def around(self) -> str:
        """One thing that is no article, as it may stand beside or inside one."""
        return self.r.choice(
            (
                lambda: self.other(self.ADS, says="ad"),
                lambda: self.other(self.NOTICES, says="notice"),
                lambda: self.other(self.SIDES, ("div", "div", "aside", "section"), self.r.choice(("related", "share"))),
                lambda: self.closed("<aside>", f"{self.heading('h2', 'h3', 'h4', says='related')}<p>{self.prose()}</p>"),
                self.form,
                self.comments,
                self.menu,
            )
        )()

    def opened(self, opening: str) -> str:
        """Opening tags; on a plain page those of division have names that say nothing."""
        if not self.plain or "<div" not in opening and "<ul" not in opening:
            return opening
        return re.sub(r"='[^']*'", lambda _: f"='{self.r.choice(self.PLAIN)}'", opening)

    def page(self) -> str:
        self.plain = False
        parts = [self.block() for _ in range(self.r.randint(1, 14))]
        if self.r.random() < 0.3:
            parts.insert(self.r.randrange(len(parts) + 1), self.around())
        self.plain = self.r.random() < 0.4
        title = f"<h1>{self.words(1, 9, self.r.choice(('', '.')))}</h1>" if self.r.random() < 0.9 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        opening = self.opened(self.r.choice(self.ARTICLES))
        table = self.plain and self.r.random() < 0.2
        if table:
            opening = "<td>"
        tags = [part.split()[0].strip(">") for part in opening.split("<")[1:]]
        if opening:
            first, _, rest = opening.partition(">")
            article = f"{first} data-label='content'>{rest}{title}{''.join(parts)}" + "".join(f"</{t}>" for t in reversed(tags))
        else:  # straight under the body
            article = "".join(x if "data-label" in x else x.replace(">", " data-label='content'>", 1) for x in [title, *parts] if x)
        before = [self.menu() if self.r.random() < 0.6 else self.around() for _ in range(self.r.randint(0, 3))]
        after = [self.around() for _ in range(self.r.randint(0, 3))]
        if table:
            cells = [f"<td data-label='other'>{x}</td>" for x in (self.menu(), self.around())]
            article = f"<table><tr>{cells[0]}{article}{cells[1] if self.r.random() < 0.5 else ''}</tr></table>"
        if self.r.random() < 0.6:
            before.insert(0, self.closed(self.opened(self.r.choice(self.HEADS)), f"{self.heading('h1', 'p', 'p', 'div')}{self.menu()}"))
        if self.r.random() < 0.8:
            after.append(self.closed(self.opened(self.r.choice(self.FEET)), f"{self.r.choice(('&copy; ', ''))}{self.prose()}"))
        body = f"{''.join(before)}{article}{''.join(after)}"
        for _ in range(self.r.randint(1, 3) if self.r.random() < 0.35 else 0):
            body = f"<div class='{self.r.choice(self.PLAIN)}'>{body}</div>"
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


@lru_cache(maxsize=4)
def layout_model(pages: int = 2000, seed: int = 1) -> Model:
    """The model trained on ``pages`` labelled pages by rule: the bound on the labelled sample."""
    layouts = Layouts(seed)
    return train(layouts.page() for _ in range(pages))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each page: its main text, blocks joined by line breaks.

    A null or empty html gives an empty text. Any mark-up is read, however broken.
    Repeated rows and null ids are answered each; a run whose chances are equal is
    no content; an empty table gives no rows. Other columns are not read.
    """
    model = model or layout_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [model.main_text(source) for source in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return map_slices(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"),
        run,
        "page_id long, url string, text string, n_chars long",
        text="html",
    )
