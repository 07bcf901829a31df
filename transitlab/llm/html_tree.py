"""A page's block elements and text runs as a tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that run inside a line; they aren't nodes.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr object output "
    "picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mover munder mstyle semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style template iframe svg canvas audio video head title textarea select".split())
RAW = frozenset("script style textarea title iframe template".split())

#: An opening element of the key ends open elements of the value, up to a container.
CLOSES = {
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "tbody": {"thead", "tbody", "tr", "td", "th", "p"},
    "option": {"option"},
}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav body form".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element (``tag``) or a run of text (tag ``#text``). Indices in the tree rise in page order."""

    tag: str
    parent: int
    cues: frozenset[str] = frozenset()
    label: str | None = None
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)
    size: int = 0
    links: int = 0
    prose: int = 0
    start: float = 0.0
    headed: str = ""
    title: bool = False
    within: str = ""


#: Words of a short run that say what a part is, by language; what isn't here says nothing.
SAYS = {
    "comments": "comment comments reply replies responses discussion kommentar kommentare antworten commentaire commentaires réponses comentario comentarios respuestas",
    "related": "related recommended trending popular more also read ähnliche beliebt empfohlen weitere similaires populaires recommandés relacionados populares",
    "share": "share follow tweet teilen folgen partager suivre compartir seguir",
    "notice": "cookie cookies consent privacy accept subscribe newsletter abonnieren datenschutz abonner acepto suscribirse",
    "ad": "advertisement sponsored anzeige werbung publicité publicidad",
    "legal": "copyright reserved imprint impressum legal",
}
SAID = {word: what for what, words in SAYS.items() for word in words.split()}


def said(text: str) -> str:
    """What a run of at most six words says of its part: the kind of the first word that has one, else nothing."""
    words = text.lower().split()
    return next((SAID[w] for w in (w.strip(".,:!?()") for w in words) if w in SAID), "") if len(words) <= 6 else ""


def measure(nodes: list[Node]) -> list[Node]:
    """Adds up the text of each element: characters, linked ones, sentences of ten words or more, what stands before,
    what its first heading says, whether a main heading is in it, and whether a text is (``within``) a heading."""
    before = 0
    for node in nodes:
        node.start = before
        if node.tag == "#text":
            node.size, node.links = len(node.text), node.linked
            above = nodes[node.parent].tag
            node.within = above if above == "h1" else "h" if above in HEADINGS else ""
            node.prose = int(node.text.count(" ") >= 9 and node.linked * 2 < node.size)
            before += node.size
    for i in range(len(nodes) - 1, 0, -1):
        node, parent = nodes[i], nodes[nodes[i].parent]
        parent.size, parent.links, parent.prose = parent.size + node.size, parent.links + node.links, parent.prose + node.prose
        if node.tag in HEADINGS and node.children and nodes[node.children[0]].tag == "#text":
            parent.headed = said(nodes[node.children[0]].text)  # the first heading is met last
        parent.title |= node.title or node.tag == "h1"
    for node in nodes:
        node.start /= max(1, before)
    return nodes


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def cues_of(found: dict[str, str]) -> frozenset[str]:
    """The words in an element's class, id and role."""
    names = " ".join(found.get(name, "") for name in ("class", "id", "role"))
    return frozenset(m.lower() for m in TOKEN.findall(names))


def parse(source: str | None) -> list[Node]:
    """The tree of a page; node 0 is its root. Anything is accepted: unclosed, crossed and unknown elements, bare text."""
    source = source or ""
    nodes = [Node("#root", -1)]
    stack = [0]
    run: list[str] = []
    links = linked = 0
    skip: list[str] = []
    open_at: dict[str, list[int]] = {}  # places of open elements in the stack, by name: an end tag without one costs nothing

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            nodes.append(Node("#text", stack[-1], text=text, linked=min(linked, len(text))))
            nodes[stack[-1]].children.append(len(nodes) - 1)
        linked = 0

    def write(text: str) -> None:
        nonlocal linked
        if text and not skip:
            run.append(text)
            if links:
                linked += len(" ".join(text.split()))

    def pop() -> None:
        open_at[nodes[stack.pop()].tag].pop()

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            pop()

    at, n = 0, len(source)
    while at < n:
        opening = source.find("<", at)
        if opening < 0:
            write(source[at:])
            break
        write(source[at:opening])
        if source.startswith("<!--", opening):
            end = source.find("-->", opening + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), opening):
            end = source.find(">", opening)
            at = n if end < 0 else end + 1
            continue
        name = NAME.match(source, opening)
        if not name:
            write("<")
            at = opening + 1
            continue
        at = name.end()
        while (part := QUOTED.search(source, at)) and part[0] != ">":
            at = part.end()
        inside, at = source[name.end() : part.start() if part else n], part.end() if part else n
        tag, ends = name[2].lower(), bool(name[1])
        if tag in SKIPPED:
            if ends:
                if tag in skip:
                    del skip[skip.index(tag) :]
                continue
            if tag in RAW:  # its content isn't markup
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else n
            if not inside.rstrip().endswith("/") and not (tag in RAW and at == n):
                skip.append(tag)
            continue
        if skip == ["head"] and tag not in VOID and not ends:  # a head left open ends with the first element of a body
            skip.clear()
        if skip:
            continue
        if tag in INLINE:
            if tag == "br":
                write(" ")
            elif tag == "a":
                links = max(0, links - 1) if ends else links + 1
            continue
        if ends:
            if open_at.get(tag):
                close(open_at[tag][-1])
                links = 0
            continue
        flush()
        if tag == "html" or tag == "body" and open_at.get("body"):
            continue
        if tag in VOID:
            continue
        links = 0
        if tag in CLOSES:
            while len(stack) > 1 and nodes[stack[-1]].tag not in HOLDERS and nodes[stack[-1]].tag != tag:
                if nodes[stack[-1]].tag not in CLOSES[tag]:
                    break
                pop()
            if nodes[stack[-1]].tag in CLOSES[tag]:
                pop()
        elif nodes[stack[-1]].tag == "p" or nodes[stack[-1]].tag in HEADINGS and tag in HEADINGS:
            pop()
        found = attributes(inside) if "=" in inside else {}
        nodes.append(Node(tag, stack[-1], cues_of(found), found.get("data-label")))
        nodes[stack[-1]].children.append(len(nodes) - 1)
        if not inside.rstrip().endswith("/") or found:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return measure(nodes)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
