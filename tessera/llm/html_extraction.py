"""Main text of web pages by a tree-structured graphical model over the DOM.

A tolerant scanner builds the tree of block elements; inline markup belongs to
its block, and each run of text between block boundaries is a leaf. Every node
is content or not. Its unary potential is a logistic model of its tag, class
words, length, link share and marks; parent and child share a potential by the
kind of the child. Both are estimated from labelled pages. Sum-product messages
go up from the leaves and down from the root, and a leaf whose marginal says
content is a block of the text.

The labelled pages come from ``labelled_pages``: layouts of many kinds, each
with its content marked, filled with invented words by a fixed rule. A share of
them, ``NAMELESS``, has no telling tags or names; such pages have weights and
potentials of their own. Marks are only read from training pages.

Defined results: a null or empty page, or one without content, gives the empty
text; character references are decoded, white space inside a block (line breaks
too) is one space, blocks are trimmed and joined in page order by a line feed.
Never text are comments, raw-text elements (``RAW``; one without an end takes the
rest of the page, as in a browser) and what a template that is closed holds. Controls and
media without an end tag end at the next block, an svg too.
Repeated rows each get their row; rows are independent, so there is no shuffle.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import freeing, modest_batches, read_table

#: Element kinds of HTML.
MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics annotation annotation-xml"
INLINE = set(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "iframe")
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table tbody td tfoot th thead tr ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",), "button": ("button",)}
SCOPES = set("ul ol menu dl table body article section div main aside nav header footer form blockquote".split())
#: Words in class, id and role that tell what an element is for.
CUES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip sitemap",
    "foot": "footer foot colophon copyright legal imprint bottom",
    "head": "header masthead topbar branding logo hero tagline",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending more teaser teasers",
    "ad": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner affiliate dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall privacy message toast",
    "comment": "comment comments commentlist respond reply replies disqus discussion thread",
    "share": "share sharing social follow tags tag meta byline author date",
    "form": "form search login signup register contact input poll survey",
    "content": "article content post entry main body story text prose page markdown copy",
}
CUE = {w: k for k, ws in CUES.items() for w in ws.split()}

#: Attributes whose quotes close, before white space or the tag's end if there is a tag between; where one doesn't, the tag ends at the next ``>``.
_ATTRS = r"(?:[^>\"']|\"(?:[^\"<]*\"|[^\"]*\"(?=[\s/>]))|'(?:[^'<]*'|[^']*'(?=[\s/>])))*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|\Z))|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<with>" + _ATTRS + r"(?=>)|[^>]*)>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>" + _ATTRS + r"(?=>)|(?=[\s/>\"'])[^>]*)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for tag in RAW}
#: Elements that pages leave open by mistake.
_ENCLOSING = re.compile(r"<(/?)(template|object|canvas|audio|video|select|button)(?=[\s/>])[^>]*>", re.IGNORECASE)
#: A tag or comment that the page ends in.
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_UNQUOTED = re.compile(r"=\s*[^\s\"']+\Z")
_CUE_ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_LABEL = re.compile(r"\bdata-main=\"([01])\"")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LEAF = "#text"
#: Share of the labelled pages whose elements have no telling tags or names.
NAMELESS = 0.25
#: Elements whose name tells what they are for.
TELLING = set("article aside dialog footer form header main menu nav search".split())


@dataclass
class Tree:
    """Nodes in page order (parents before children): tag, parent, class words, and a leaf's text and link characters."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    cues: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    label: list[int | None] = field(default_factory=lambda: [None])

    def add(self, tag: str, parent: int, cues: tuple[str, ...] = (), text: str = "", linked: int = 0, label: int | None = None) -> int:
        for values, v in ((self.tag, tag), (self.parent, parent), (self.cues, cues), (self.text, text), (self.linked, linked), (self.label, label)):
            values.append(v)
        return len(self.tag) - 1


def _closed(html: str) -> dict[int, int]:
    """Where each element of ``_ENCLOSING`` that has an end tag starts, and where it ends."""
    out, open_at = {}, {}
    for m in _ENCLOSING.finditer(html):
        at = open_at.setdefault(m[2].lower(), [])
        if not m[1]:
            at.append(m.start())
        elif at:
            out[at.pop()] = m.end()
    return out


def _self_closed(attrs: str | None) -> bool:
    """Whether a tag of foreign content ends with a slash that isn't part of an unquoted value."""
    return bool(attrs) and attrs[-1] == "/" and not _UNQUOTED.search(attrs)


def parse(html: str, marked: bool = False) -> Tree:
    """The tree of a page; ``marked``: of a training page, whose elements may say ``data-main``.

    Linear in the page: open elements are counted by name, so the stack is only
    searched for what is on it, and what is found leaves it.
    """
    t, stack, pieces, linked, in_link = Tree(), [0], [], 0, 0
    stop = html.rfind(">") + 1  # no tag ends after it
    closed, loose = _closed(html[:stop]), set()
    opened: Counter[str] = Counter()
    foreign: list[int] = []  # depths of the open svg and foreignobject elements

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                t.add(LEAF, stack[-1], text=text, linked=min(linked, len(text)), label=t.label[stack[-1]])
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(text)

    def close(k: int) -> None:
        """The element at depth ``k`` and all in it end."""
        for node in stack[k:]:
            opened[t.tag[node]] -= 1
            loose.discard(node)
        del stack[k:]
        while foreign and foreign[-1] >= k:
            foreign.pop()

    def drawing() -> int:
        """The depth of the svg that tags are now read in, 0 if none."""
        return foreign[-1] if foreign and t.tag[stack[foreign[-1]]] == "svg" else 0

    at = 0
    while m := _TOKEN.search(html, at, stop):
        put(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                raw = m["raw"].lower()
                if not (_self_closed(m["with"]) and drawing()):
                    at = _RAW_END[raw].search(html, at).end() if at < stop else len(html)
                if raw in ("textarea", "iframe"):
                    flush()
            elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            continue
        if tag == "template" and m.start() in closed:
            at = closed[m.start()]
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if m["end"]:
            flush()
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if t.tag[stack[k]] == tag))
                in_link = 0
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and (k := drawing() or (loose and next((k for k, node in enumerate(stack) if node in loose), 0))):
            close(k)  # one without an end goes as far as the next block
        if tag in CLOSES_P or tag in CLOSES_SAME:
            ends = CLOSES_SAME.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                open_tag = t.tag[stack[k]]
                if open_tag in ends:
                    close(k)
                    break
                if open_tag in SCOPES:
                    break
        attrs, cues, label = m["attrs"], (), t.label[stack[-1]]
        if attrs:
            words = [w for g in _CUE_ATTRS.findall(attrs) for x in g if x for w in _WORDS.findall(_CAMEL.sub(" ", x).lower())]
            cues = tuple(sorted({CUE[w] for w in words if w in CUE}))
            if marked and (mark := _LABEL.search(attrs)):
                label = int(mark[1])
        node = t.add(tag, stack[-1], cues, label=label)
        if not (_self_closed(attrs) and (tag == "svg" or drawing())):
            stack.append(node)
            opened[tag] += 1
            if tag in ("svg", "foreignobject"):
                foreign.append(len(stack) - 1)
            if m.start() not in closed and _ENCLOSING.match(m[0]):
                loose.add(node)
    put(_UNENDED.split(html[at:], maxsplit=1)[0])
    flush()
    return t


def _kind(tag: str) -> str:
    return "h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag


def nameless(t: Tree) -> bool:
    """Nothing on the page tells what it is for: it has features and potentials of its own, how much text an element has and how much of that is links."""
    return not any(t.cues) and not any(x in TELLING for x in t.tag)


def _pair_kind(t: Tree, i: int, plain: bool) -> str:
    return f"{_kind(t.tag[i])}~" if plain else _kind(t.tag[i])


def _linkage(linked: int, n: int) -> int:
    return 0 if not linked else 1 if 2 * linked < n else 2


def node_features(t: Tree) -> list[list[str]]:
    # Characters, linked characters and leaves of what is below each node.
    size, linked_, leaves = [len(x) for x in t.text], t.linked[:], [int(x == LEAF) for x in t.tag]
    for i in range(len(t.tag) - 1, 0, -1):
        p = t.parent[i]
        size[p] += size[i]
        linked_[p] += linked_[i]
        leaves[p] += leaves[i]
    plain = nameless(t)
    out = []
    for i, (tag, parent, cues, text, linked) in enumerate(zip(t.tag, t.parent, t.cues, t.text, t.linked, strict=True)):
        f = [f"t:{_kind(tag)}", *(f"c:{c}" for c in cues)]
        if plain and tag != LEAF:
            f.append(f"sub:{_linkage(linked_[i], size[i])}:{min(int(math.log2(size[i] + 1)) // 2, 5)}:{min(int(math.log2(leaves[i] + 1)), 3)}")
        if tag == LEAF:
            n = len(text)
            f += [f"in:{_kind(t.tag[parent])}", f"len:{min(int(math.log2(n + 1)), 9)}", f"link:{_linkage(linked, n)}"]
            if text[-1] in ".!?:;…。！？\"”":
                f.append("stop")
            if "©" in text or "(c)" in text[:40].lower():
                f.append("copyright")
        out.append([f"{x}~" for x in f] if plain else f)
    return out


@dataclass
class Model:
    """Unary weights by feature, and log potentials (parent's label, child's label) by the child's kind."""

    weights: dict[str, float]
    pair: dict[str, tuple[float, float, float, float]]
    default: tuple[float, float, float, float]
    #: How much a leaf's own potential counts: leaves of one block repeat each other's evidence.
    leaf: float = 1.0
    #: The same on pages without telling names.
    plain_leaf: float = 1.0

    def marginals(self, t: Tree) -> list[float]:
        """Log-odds of content of each node by sum-product over the tree."""
        n, weights, pair = len(t.tag), self.weights, self.pair
        unary = [sum(weights.get(x, 0.0) for x in f) for f in node_features(t)]
        plain = nameless(t)
        leaf = self.plain_leaf if plain else self.leaf
        unary = [leaf * u if tag == LEAF else u for u, tag in zip(unary, t.tag, strict=True)]
        pot = [pair.get(_pair_kind(t, i, plain), self.default) for i in range(n)]
        # A message is the log-odds that it says; belief: unary and messages of the children.
        up, belief = [0.0] * n, unary[:]
        for i in range(n - 1, 0, -1):
            up[i] = _pass(belief[i], pot[i])
            belief[t.parent[i]] += up[i]
        out = belief[:]
        for i in range(1, n):
            p = t.parent[i]
            a, b, c, d = pot[i]
            out[i] = belief[i] + _pass(out[p] - up[i], (a, c, b, d))
        return out


def _pass(odds: float, pot: tuple[float, float, float, float]) -> float:
    """Log-odds at the one end from those at the other; pot: (here 0, there 0), (0, 1), (1, 0), (1, 1)."""
    a, b, c, d = pot
    return _plus(c, d + odds) - _plus(a, b + odds)


def _plus(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y - x > -40 else x


def fit(pages: list[str], ridge: float = 0.5, rounds: int = 250) -> Model:
    """A model from pages whose elements say ``data-main="1"`` or ``"0"`` (inherited by what is inside)."""
    seen: dict[tuple[str, ...], list[int]] = {}
    pairs = []
    for html in pages:
        t = parse(html, marked=True)
        for f, y in zip(node_features(t), t.label, strict=True):
            if y is not None:
                seen.setdefault(tuple(f), [0, 0])[y] += 1
        plain = nameless(t)
        # What holds both content and other things has no label: it isn't content itself, but its children may be (without names, they tell by themselves).
        pairs += [(_pair_kind(t, i, plain), t.label[t.parent[i]] or 0, t.label[i]) for i in range(1, len(t.tag)) if t.label[i] is not None and not (plain and t.label[t.parent[i]] is None)]
    names = sorted({x for f in seen for x in f})
    index = {x: i for i, x in enumerate(names)}
    x, count = np.zeros((len(seen), len(names))), np.array(list(seen.values()), float)
    for i, f in enumerate(seen):
        x[i, [index[v] for v in f]] = 1
    n, y = count.sum(axis=1), count[:, 1]
    w = v = np.zeros(len(names))
    step = 1.0 / (np.linalg.eigvalsh((x * n[:, None]).T @ x)[-1] / 4 + ridge)
    for k in range(rounds):
        g = x.T @ (n / (1 + np.exp(-x @ v)) - y) + ridge * v
        new = v - step * g
        v, w = new + k / (k + 3) * (new - w), new
    rate = y.sum() / n.sum()

    def potential(some: list[tuple[int, int]]) -> tuple[float, float, float, float]:
        """log P(parent, child) / (P(parent) P(child)), with one count of each combination at the average rate."""
        c = np.outer([1 - rate, rate], [1 - rate, rate]) * 4
        for a, b in some:
            c[a, b] += 1
        c /= c.sum()
        p = np.log(c / np.outer(c.sum(1), c.sum(0)))
        return p[0, 0], p[0, 1], p[1, 0], p[1, 1]

    kinds: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in pairs:
        kinds.setdefault(kind, []).append((a, b))
    model = Model(dict(zip(names, w.tolist(), strict=True)), {k: potential(v) for k, v in kinds.items()}, potential([(a, b) for _, a, b in pairs]))
    # The share of the leaves' evidence under which most of the labelled leaves come out right, the larger of equals.
    trees = [parse(html, marked=True) for html in pages[::2]]

    def wrong(name: str, leaf: float) -> int:
        setattr(model, name, leaf)
        own = [t for t in trees if nameless(t) == (name == "plain_leaf")]
        return sum((m > 0) != bool(y) for t in own for tag, y, m in zip(t.tag, t.label, model.marginals(t), strict=True) if tag == LEAF and y is not None)

    for name in ("leaf", "plain_leaf"):
        setattr(model, name, min((0.05, 0.1, 0.2, 0.35, 0.6, 1.0), key=lambda x: (wrong(name, x), -x)))  # noqa: B023
    return model


def blocks(html: str | None, model: Model) -> list[str]:
    """The content blocks of a page, in page order."""
    if not html:
        return []
    t = parse(html)
    return [text for tag, text, m in zip(t.tag, t.text, model.marginals(t), strict=True) if tag == LEAF and m > 0]


def labelled_pages(n: int = 600, seed: int = 20) -> list[str]:
    """Pages of many layouts with their content marked by ``data-main``."""
    r = random.Random(seed)
    syllables = "an be co da el fi go ha in jo ka le mi no or pa qui re sa te un vo wa xe yo zu ä é ñ ß ção ли на то".split()
    word = lambda: "".join(r.choices(syllables, k=r.choice((1, 2, 2, 3, 3, 4))))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize()

    ends = "....!?"

    def sentences(lo: int, hi: int) -> str:
        if r.random() < 0.06:  # one word over and over
            return " ".join([word()] * r.randint(5, 200))
        return " ".join(phrase(2, 18) + r.choice(ends) for _ in range(r.randint(lo, hi)))

    def inline(s: str) -> str:
        k = r.random()
        a, _, b = s.partition(" ")
        return f"<a href='#'>{a}</a> {b}" if k < 0.12 else f"<b>{a}</b> {b}" if k < 0.25 else f"{a} <em>{b}</em>" if k < 0.3 else s

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(k))

    nameless = False  # of the page that is being written

    def unnamed(inner: str, label: int) -> str:
        """An element that nothing tells what it is for."""
        tag = r.choice(("div", "div", "section", "td"))
        return f"<{tag}{r.choice(('', f' class={word()}', f' id={word()}{r.randint(1, 99)}', ' style=margin:0'))} data-main=\"{label}\">{inner}</{tag}>"

    def named(kind: str, tags: tuple[str, ...], inner: str, bare: float = 0.4) -> str:
        """A block that isn't content: by its tag, or a div with a telling name."""
        if nameless:
            return unnamed(inner, 0)
        if tags and r.random() < bare:
            return f'<{tags[0]} data-main="0">{inner}</{tags[0]}>'
        tag = r.choice(("div", "div", "section", *tags))
        name = r.choice(CUES[kind].split()) if kind in CUES else kind
        attr = r.choice((f'class="{name}"', f'id="{name}"', f'class="{word()} {name}-box"', f'class="{name}s" role="{name}"'))
        return f'<{tag} {attr} data-main="0">{inner}</{tag}>'

    def prose(lo: int = 1, hi: int = 6) -> str:
        out = []
        for _ in range(r.randint(lo, hi)):
            k = r.random()
            if k < (0.7 if nameless else 0.6):  # without names, links are what tells a menu
                out.append(f"<p>{inline(sentences(1, 6))}" + "</p>" * (r.random() < 0.85))
            elif k < 0.67:  # a paragraph that is a link
                out.append(f"<p><a href='#'>{r.choice((phrase(1, 6), sentences(1, 3)))}</a></p>")
            elif k < 0.7:  # sources
                out.append(f"<ul>{links(r.randint(1, 5))}</ul>")
            elif k < 0.78:
                h = phrase(2, 8)
                out.append(f"<h2>{h if nameless or r.random() < 0.75 else f'<a href=#>{h}</a>'}</h2><p>{sentences(1, 5)}</p>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{r.choice((phrase(2, 8), sentences(1, 2)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote><p>{sentences(1, 3)}</p></blockquote>")
            elif k < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{phrase(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif k < 0.975:
                out.append(f"<pre>{phrase(3, 12)}</pre>")
            else:  # verse, lists of names
                out.append("".join(f"<p>{phrase(1, 4)}{r.choice(ends)}</p>" for _ in range(r.randint(8, 80))))
        return "".join(out)

    def extras() -> list[str]:
        every = [
            lambda: named("ad", ("aside",) if r.random() < 0.3 else (), r.choice((sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f"<a href='#'>{phrase(2, 6)}</a>"))),
            lambda: named("side", ("aside",), f"<h3>{phrase(1, 3)}</h3><ul>{links(r.randint(2, 6))}</ul>" + f"<p>{sentences(1, 2)}</p>" * r.randint(0, 2)),
            lambda: named("notice", (), r.choice((f"<p>{sentences(1, 3)}</p>", sentences(1, 2)))),
            lambda: named("share", (), r.choice((f"<ul>{links(3)}</ul>", phrase(1, 4)))),
            lambda: named("form", ("form",), f"<p>{phrase(2, 8)}</p><div>{phrase(1, 3)}</div>", 0.7),
        ]
        return [f() for f in r.sample(every, r.randint(1, 4))]

    def embedded() -> str:
        """Controls, drawings and what stands in for media aren't content; noscript and object are what they are in."""
        k = r.random()
        if k < 0.3:
            return f'<button data-main="0">{phrase(1, 4)}</button>'
        if k < 0.45:
            return '<select data-main="0">' + "".join(f"<option>{phrase(1, 3)}" + "</option>" * (r.random() < 0.7) for _ in range(r.randint(2, 6))) + "</select>"
        if k < 0.6:
            tag = r.choice(("video", "audio", "canvas"))
            return f'<{tag} data-main="0">{r.choice((sentences(1, 1), f"<p>{sentences(1, 1)}</p>"))}</{tag}>'
        if k < 0.7:
            return f'<svg data-main="0"><path d="M0 0"/><text>{phrase(1, 3)}</text></svg>'
        tag = r.choice(("noscript", "object"))
        return f"<{tag}>{r.choice((sentences(1, 4), f'<p>{sentences(1, 4)}</p>'))}</{tag}>"

    def comments() -> str:
        one = lambda: f'<{(t := r.choice(("li", "div", "article")))} class="comment"><p>{phrase(1, 2)}</p><p>{sentences(1, 3)}</p></{t}>'
        return named("comment", (), f"<h3>{phrase(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 4))))

    out = []
    for _ in range(n):
        nameless = r.random() < NAMELESS
        ends = ("....!?", "....!?", "....!?", ("", "", " *", "%", ","))[r.randrange(4)]  # some pages are written without full stops
        title = f"<h1>{phrase(1, 9)}{r.choice(('', '.', '?'))}</h1>"
        if r.random() < 0.3 and not nameless:  # a header of the article's own
            title = f"<header>{title}{r.choice(('', f'<p>{phrase(1, 5)}</p>', f'<p>{sentences(1, 2)}</p>'))}</header>"
        body = title * (r.random() < 0.9) + prose(1, 8)
        inside = "".join(r.sample([*extras(), ""], 1)) if r.random() < 0.35 and not nameless else ""
        if inside:
            body += inside + prose(1, 3) * (r.random() < 0.6)
        if r.random() < 0.3:
            body += embedded() + prose(1, 3) * (r.random() < 0.8)
        k = r.random()
        if nameless:
            wrapped = re.sub("<(/?)(?:p|blockquote)>", r"<\1div>", body) if r.random() < 0.5 else body
            main = unnamed(wrapped, 1)
        elif k < 0.35:
            main = f'<article data-main="1">{body}</article>'
        elif k < 0.6:
            main = f'<main data-main="1">{body}</main>'
        else:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(CUES["content"].split())}" data-main="1">{body}</div>'
        before = [named("nav", ("nav",), f"<ul>{links(r.randint(3, 9))}</ul>", 0.7)]
        if r.random() < 0.6:
            before.insert(0, named("head", ("header",), r.choice((f"<p>{phrase(1, 6)}</p>", f"<h2>{phrase(1, 3)}</h2>", phrase(1, 5))), 0.6))
        after = [named("foot", ("footer",), r.choice((f"&copy; {phrase(1, 4)}. {sentences(1, 2)}", f"<p>{sentences(1, 2)}</p>", f"<ul>{links(4)}</ul><p>&copy; {phrase(2, 5)}</p>")), 0.7)]
        if r.random() < 0.4 and not nameless:
            after.insert(0, comments())
        # Without names, an advert or a notice of a few sentences can't be told from an article.
        more = [unnamed(f"<ul>{links(r.randint(3, 6))}</ul>", 0)] * (r.random() < 0.5) if nameless else extras()
        split = r.randint(0, len(more))
        page = "".join([*before, *more[:split], main, *more[split:], *after])
        if r.random() < 0.3:
            page = f'<div class="{r.choice(("wrapper", "container", "site", "page"))}">{page}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title></head><body>{page}</body></html>")
    return out


def extracted(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of html; columns of these names are replaced."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string, n_chars long"])

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = ["\n".join(blocks(h.as_py(), model)) for h in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    return modest_batches(pages).select(html, *[f.name for f in kept]).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE_SQL: dict[str, str] = {}
