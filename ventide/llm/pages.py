"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements. Each node is content or not: its tag, names and text give
its own evidence, and each parent-child edge has potentials for the four combinations, which depend
on the child. Sum-product messages, upward and then downward, give every node's exact marginal;
text whose block is more likely content than not is kept.

The weights are trained by the exact likelihood gradient on labelled pages. The label source is the
table itself: a bounded sample of its pages that mark their article is taken apart, and pages are
put together from these blocks in many layouts (`compose`), whose labels are known because the
layout is. Every page is then extracted with the trained model; landmarks are evidence, not rules.

Defined cases: a null or empty page has an empty text; markup that is never closed ends with its
parent or with the page, and the head with the first thing that cannot be in it; <svg/> and its like
hold nothing, and so does <script/> if no </script> follows; scripts, styles, the head and comments are no text; rows are independent,
so repeated rows and keys stay; an empty table gives an empty result; clashing columns are replaced.
With no page to learn from, the layouts are filled with a few words of their own.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A

SAMPLE = 200  # pages whose blocks the labelled pages are made of
COMPOSED = 800  # labelled pages
HASHED = 2048
STEPS, RATE, DECAY = 300, 0.1, 3e-5

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas audio video".split())
RAW = frozenset("script style title textarea noscript iframe".split())
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# What a start tag ends if it is open below the given limits.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
        "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARK = re.compile(r'data-y="([01])"')
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Families of names; a name belongs to a family if it begins like one of its stems.
FAMILIES = {
    "menu": "nav menu breadcrumb crumb tab toolbar skip pagination pager",
    "top": "header masthead topbar logo brand",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar side aside widget rail related recommend more trending popular",
    "notice": "cookie consent notice alert gdpr privacy popup modal dialog overlay banner message warning",
    "advert": "ad ads advert adv sponsor promo adsense dfp commercial outbrain taboola",
    "form": "form search login signup newsletter subscri register field contact",
    "talk": "comment reply replies disqus discussion respond feedback",
    "share": "share social follow like tweet facebook",
    "text": "article post content main body entry story text page hentry document",
}
_EXACT = {"ad", "ads", "adv", "side", "foot", "tab", "more", "like", "text", "page", "main", "body", "post", "form"}
_STEMS = [(stem, family) for family, stems in FAMILIES.items() for stem in stems.split()]
FLAGS = ("bias", "named", "link_none", "link_some", "link_half", "link_most", "empty", "words_1", "words_5", "words_15",
         "words_40", "words_more", "stop_end", "many_stops", "copyright", "shallow", "deep", "first", "last",
         "leaf", "children", "all_links", *(f"family_{f}" for f in FAMILIES))
FLAG = {name: i for i, name in enumerate(FLAGS)}
EDGE_KINDS = 5  # bias, child named like text, child named like something else, child is a text tag, landmark tag
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption tr tbody".split())
LANDMARKS = frozenset("article main nav aside header footer form section".split())


@dataclasses.dataclass
class Node:
    parent: int
    tag: str
    names: tuple[str, ...]
    depth: int
    label: int | None
    pieces: list[str] = dataclasses.field(default_factory=list)
    linked: int = 0
    children: int = 0


def parse(html: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, and the text pieces with their blocks in page order.

    Only the trainer's own pages are `labelled`: there the mark of `compose` tells what a block is, and
    a block without one is what its parent is. In any other page that attribute means nothing.
    """
    nodes = [Node(-1, "#page", (), 0, None)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with the block they write to
    text: list[tuple[int, str]] = []
    at, hidden, links = 0, 0, 0

    def close(index: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[index:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[index:]

    def write(raw: str) -> None:
        if stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if hidden or not raw:
            return
        block = stack[-1][1]
        decoded = unescape(raw) if "&" in raw else raw
        text.append((block, decoded))
        if links:
            nodes[block].linked += len(decoded.strip())

    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            break
        write(html[at:found.start()])
        at = found.end()
        end, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "body", "html", "div"):
                    break
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "br":
            write("\n")
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        ends, limits = ENDS.get(tag, ((), ()))
        if ends:
            lowest = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in limits:
                    break
                if stack[i][0] in ends:
                    lowest = i
            if lowest is not None:
                close(lowest)
        block = stack[-1][1]
        if labelled and tag == "body" and (own := MARK.search(rest)):
            nodes[0].label = int(own.group(1))
        stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at) if tag in RAW else None
        opened = not rest.endswith("/") or tag in INLINE or stop is not None
        hidden += opened and tag in HIDDEN
        links += tag == "a"
        if tag not in INLINE and tag not in HIDDEN and not hidden and tag not in ("html", "body"):
            names = []
            for _, *values in _ATTRIBUTE.findall(rest):
                names += [n.lower() for n in _NAMES.findall(next((v for v in values if v), ""))]
            nodes[block].children += 1
            own = MARK.search(rest) if labelled else None
            label = int(own.group(1)) if own else nodes[block].label
            nodes.append(Node(block, tag, tuple(dict.fromkeys(names)), nodes[block].depth + 1, label))
            block = len(nodes) - 1
        if opened:
            stack.append((tag, block))
        if tag in RAW and opened:
            if tag == "textarea":
                write(html[at:stop.start() if stop else len(html)])
            at = stop.start() if stop else len(html)
    write(html[at:])
    for block, piece in text:
        nodes[block].pieces.append(piece)
    return nodes, text


def families(names: tuple[str, ...]) -> set[str]:
    return {family for name in names for stem, family in _STEMS
            if name == stem or (stem not in _EXACT and name.startswith(stem))}


def _hash(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return len(FLAGS) + (h ^ (h >> 15)) % HASHED


def features(nodes: list[Node]) -> tuple[list[list[int]], list[list[int]]]:
    """Per node its feature numbers, and the kinds of the edge to its parent."""
    whole = [" ".join("".join(n.pieces).split()) for n in nodes]
    length, linked = [len(t) for t in whole], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        length[nodes[i].parent] += length[i]
        linked[nodes[i].parent] += linked[i]
    out, kinds = [], []
    for i, (n, text) in enumerate(zip(nodes, whole)):
        f = [FLAG["bias"], _hash("tag " + n.tag)]
        known = families(n.names)
        if n.names:
            f.append(FLAG["named"])
        f += [FLAG[f"family_{k}"] for k in known]
        f += [_hash("name " + name) for name in n.names]
        share = linked[i] / length[i] if length[i] else 0
        f.append(FLAG["link_none" if not share else "link_some" if share < 0.2 else "link_half" if share < 0.6 else "link_most"])
        words = text.count(" ") + 1 if text else 0
        f.append(FLAG["empty" if not words else "words_1" if words < 4 else "words_5" if words < 10 else "words_15"
                      if words < 25 else "words_40" if words < 60 else "words_more"])
        if text[-1:] in tuple(".!?…。"):
            f.append(FLAG["stop_end"])
        if text.count(". ") > 1:
            f.append(FLAG["many_stops"])
        if "©" in text or "(c)" in text:
            f.append(FLAG["copyright"])
        f.append(FLAG["shallow" if n.depth < 3 else "deep"])
        if i <= 1:
            f.append(FLAG["first"])
        if i == len(nodes) - 1:
            f.append(FLAG["last"])
        f.append(FLAG["children" if n.children else "leaf"])
        if share > 0.9:
            f.append(FLAG["all_links"])
        out.append(list(dict.fromkeys(f)))
        edge = [0]
        if "text" in known:
            edge.append(1)
        if known - {"text"}:
            edge.append(2)
        if n.tag in TEXT_TAGS:
            edge.append(3)
        if n.tag in LANDMARKS:
            edge.append(4)
        kinds.append(edge)
    return out, kinds


class Forest:
    """Many trees as arrays, level by level."""

    def __init__(self, trees: list[list[Node]]):
        parent, depth, f, k, labels = [], [], [], [], []
        for nodes in trees:
            base = len(parent)
            parent += [n.parent + base if n.parent >= 0 else -1 for n in nodes]
            depth += [n.depth for n in nodes]
            a, b = features(nodes)
            f += a
            k += b
            labels += [n.label or 0 for n in nodes]
        self.parent, self.labels = np.array(parent, np.int64), np.array(labels, np.int64)
        depth = np.array(depth, np.int64)
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1)]
        self.owner = np.repeat(np.arange(len(f)), [len(x) for x in f])
        self.feature = np.array([y for x in f for y in x], np.int64)
        self.edge_owner = np.repeat(np.arange(len(k)), [len(x) for x in k])
        self.kind = np.array([y for x in k for y in x], np.int64)
        self.child = self.parent >= 0

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of the nodes and of (parent, child) of each edge, by sum-product."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.owner, unary[self.feature], n)
        pair = np.zeros((n, 4))
        for c in range(4):
            pair[:, c] = np.bincount(self.edge_owner, edges[self.kind, c], n)
        pair = pair.reshape(n, 2, 2)
        up, belief = np.zeros((n, 2)), own.copy()
        for level in reversed(self.levels):  # children tell their parents
            up[level] = np.logaddexp.reduce(pair[level] + belief[level][:, None, :], axis=2)
            np.add.at(belief, self.parent[level], up[level])
        joint = np.zeros((n, 2, 2))
        for level in self.levels:  # parents tell their children what they know without them
            rest = belief[self.parent[level]] - up[level]
            joint[level] = rest[:, :, None] + pair[level] + belief[level][:, None, :]
            belief[level] += np.logaddexp.reduce(rest[:, :, None] + pair[level], axis=1)
        belief -= np.logaddexp.reduce(belief, axis=1, keepdims=True)
        flat = joint.reshape(n, 4)
        return belief, (flat - np.logaddexp.reduce(flat, axis=1, keepdims=True)).reshape(n, 2, 2)


@dataclasses.dataclass
class Model:
    unary: np.ndarray
    edges: np.ndarray


def fit(trees: list[list[Node]]) -> Model:
    """Maximum likelihood with a small penalty, by adaptive gradient steps over all trees."""
    forest = Forest(trees)
    size = len(FLAGS) + HASHED
    weights = np.zeros(size + EDGE_KINDS * 4)
    child = np.flatnonzero(forest.child)
    seen = np.zeros_like(weights)
    seen[:size] = np.bincount(forest.feature, forest.labels[forest.owner], size)
    truth = forest.labels[forest.parent] * 2 + forest.labels
    on_edge = forest.child[forest.edge_owner]
    seen[size:] = np.bincount(forest.kind[on_edge] * 4 + truth[forest.edge_owner[on_edge]], minlength=EDGE_KINDS * 4)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        node, edge = forest.marginals(weights[:size], weights[size:].reshape(EDGE_KINDS, 4))
        p = np.exp(node[:, 1])
        expected = np.zeros_like(weights)
        expected[:size] = np.bincount(forest.feature, p[forest.owner], size)
        q = np.exp(edge).reshape(-1, 4)
        for c in range(4):
            expected[size + c::4] = np.bincount(forest.kind[on_edge], q[forest.edge_owner[on_edge], c], EDGE_KINDS)
        slope = (expected - seen) / len(child) + DECAY * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:size], weights[size:].reshape(EDGE_KINDS, 4))


def extract(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [parse(html or "") for html in pages]
    forest = Forest([nodes for nodes, _ in parsed])
    content = forest.marginals(model.unary, model.edges)[0][:, 1] > np.log(0.5)
    out, base = [], 0
    for nodes, text in parsed:
        blocks: list[str] = []
        last = -1
        for block, piece in text:
            if content[base + block]:
                if block == last:
                    blocks[-1] += piece
                else:
                    blocks.append(piece)
            last = block if piece.strip() or block == last else -1
        out.append(" ".join(" ".join(blocks).split()))
        base += len(nodes)
    return out


# --- labelled pages -------------------------------------------------------------------------------

_FILLER = ["Words of a sentence that says little.", "Another one follows it here.", "And a last one."]
# Layout pieces: tag and names; kinds of block that are no content.
CONTENT_BOXES = ["article", "main", 'div class="post-content"', 'div id="content"', 'div class="entry-content"',
                 'div class="article-body"', 'div role="main"', 'section class="story"', 'div id="main"',
                 'div class="text"', 'div itemprop="articleBody"', 'div class="body"', "section", "div", 'td class="content"']
WRAPPERS = ["", 'div id="page"', 'div class="container"', 'div class="wrapper"', "div", 'div id="root"', "main"]
BOXES = {
    "menu": ["nav", 'div class="menu"', 'ul class="nav"', 'div class="breadcrumbs"', 'div id="navigation"', 'div class="navbar"'],
    "top": ["header", 'div id="header"', 'div class="masthead"', 'div class="site-header"', 'div class="top"'],
    "foot": ["footer", 'div id="footer"', 'div class="copyright"', 'div class="site-footer"', "footer"],
    "side": ["aside", 'div class="sidebar"', 'div class="widget"', 'div class="related"', 'div id="side"', 'section class="recommended"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div role="alert"', 'div class="banner"', 'div id="consent"',
               'div class="alert"', 'div class="modal"', 'div class="cookie"', "dialog"],
    "advert": ['div class="ad"', 'div class="advert"', 'ins class="adsbygoogle"', 'div class="sponsored"', 'div class="promo"',
               'div class="ads"', 'aside class="ad"', 'div id="advertisement"'],
    "form": ["form", 'div class="newsletter"', 'form class="search"', 'div class="login"', 'form id="subscribe"'],
    "talk": ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment"', 'div class="replies"',
             'section id="discussion"', 'ul class="comments"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="tags"'],
}


def _wrap(box: str, inner: str, label: int | None = None) -> str:
    if not box:
        return inner
    mark = "" if label is None else f' data-y="{label}"'
    return f"<{box}{mark}>{inner}</{box.split()[0]}>"


def compose(rng: np.random.Generator, paragraphs: list[str], others: list[str]) -> str:
    """One labelled page: these paragraphs as its article, others in whatever surrounds it."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda p: rng.random() < p

    def short(text: str) -> str:
        words = text.split()
        return " ".join(words[:int(rng.integers(1, 9))])

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{escape(short(pick(others)).split(" ")[0])}</a></{tag}>'
                       for _ in range(int(rng.integers(2, 9))))

    def noise(kind: str) -> str:
        box, text = pick(BOXES[kind]), pick(others)
        if kind in ("menu", "share"):
            inner = links() if box.startswith("ul") else pick([f"<ul>{links()}</ul>", links("span"), links("div")])
        elif kind == "top":
            inner = pick([f"<div>{escape(short(text))}</div>", f"<h1>{escape(short(text))}</h1>", f"<p>{escape(short(text))}</p>"])
            inner += f"<nav><ul>{links()}</ul></nav>" if some(0.4) else ""
        elif kind == "foot":
            inner = pick([f"&copy; {escape(text)}", f"<p>&copy; {escape(short(text))}</p><ul>{links()}</ul>",
                          f"<p>{escape(text)}</p>", f"<div>{links('span')}</div>"])
        elif kind == "form":
            inner = f"<label>{escape(short(text))}</label><input><button>{escape(short(text))}</button>"
            inner = f"<p>{escape(text)}</p>" + inner if some(0.4) else inner
        elif kind == "talk":
            item = "li" if box[0] in "ou" else "div"
            inner = "".join(
                f'<{item} class="{pick(["comment", "reply", "c", ""])}">' + pick(["<b>{}</b>", "<span>{}</span>", ""]).format(
                    escape(short(pick(others)))) + f"<p>{escape(pick(others))}</p></{item}>" for _ in range(int(rng.integers(1, 5))))
            inner = (f"<h3>{escape(short(text))}</h3>" if some(0.5) and item == "div" else "") + inner
        else:
            inner = pick([escape(text), f"<p>{escape(text)}</p>", f"<h3>{escape(short(text))}</h3><p>{escape(text)}</p>",
                          f"<p>{escape(short(text))}</p>", f"<ul>{links()}</ul>" if kind == "side" else escape(text)])
            inner += pick(["<button>OK</button>", '<a href="/x">more</a>', "", ""]) if kind == "notice" else ""
        return _wrap(box, inner, 0)

    def inside(text: str) -> str:
        words = escape(text).split(" ")
        if some(0.3) and len(words) > 3:
            i = int(rng.integers(len(words) - 1))
            words[i] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/y">{}</a>', "<span>{}</span>"]).format(words[i])
        return " ".join(words)

    parts = []
    for i, text in enumerate(paragraphs):
        if i == 0 and some(0.8):
            title = f"<h1>{escape(text)}</h1>"
            parts.append(_wrap("header", title) if some(0.15) else title)
        elif some(0.08):
            parts.append(pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format(
                "".join(f"<li>{inside(t)}</li>" for t in re.split(r"(?<=\.) ", text))))
        elif some(0.08):
            parts.append(f"<table><tr><td>{inside(text)}</td><td>{escape(short(text))}</td></tr></table>")
        else:
            tag = pick(["p"] * 14 + ["h2", "h3", "blockquote", "pre", "div", "figcaption"])
            body = short(text) if tag in ("h2", "h3") else text
            parts.append(f"<p><b>{inside(body)}<br>" if some(0.06) else f"<{tag}>{inside(body)}</{tag}>")
        if some(0.12):
            parts.append(noise(pick(["advert", "share", "notice", "form", "side", "advert"])))
    if some(0.15):
        parts.append(noise("talk"))
    box = pick(CONTENT_BOXES[:2] * 6 + CONTENT_BOXES)
    if some(0.1):  # no box at all: what is not marked is content
        body = [*parts, *(noise(k) for k in ("foot", "menu", "advert", "talk") if some(0.3))]
        if some(0.3):
            body = [escape(t) + "<br>" for t in paragraphs]
        return f'<html><body data-y="1">{"".join(body)}</body></html>'
    article = _wrap(box, "".join(parts), 1)
    if box.startswith("td"):
        article = f"<table><tr>{article}</tr></table>"
    before = [noise(k) for k in ("notice", "top", "menu", "advert", "side", "form") if some(0.4)]
    after = [noise(k) for k in ("share", "side", "advert", "talk", "form", "notice") if some(0.35)]
    rng.shuffle(before)
    rng.shuffle(after)
    foot = noise("foot") if some(0.85) else ""
    middle = _wrap(pick(["", "", "div", 'div class="row"', "main", 'div class="columns"']), "".join(before[-2:]) + article + "".join(after))
    return (f"<html><head><title>{escape(short(paragraphs[0]))}</title><script>var a='<p>';</script></head><body>"
            + _wrap(pick(WRAPPERS), "".join(before[:-2]) + middle + foot) + "</body></html>")


def train(pages: DataFrame, *, html: str = "html", sample: int = SAMPLE, composed: int = COMPOSED) -> Model:
    """Fit the model on labelled pages made of the blocks of about `sample` pages."""
    known = pages.where(F.col(html).isNotNull()).select(F.col(html).alias("html"))
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit("pages"), "html"), F.lit(1 << 30)) / float(1 << 30)
    taken = sorted(r[0] for r in known.where(draw < share).distinct().collect())  # about `sample` pages
    articles, rest = [], list(_FILLER)
    for page in taken:
        nodes, _ = parse(page)
        inside = [n.tag == "article" for n in nodes]
        for i in range(1, len(nodes)):
            inside[i] |= inside[nodes[i].parent]
        texts = [" ".join("".join(n.pieces).split()) for n in nodes]
        if mine := [t for t, own in zip(texts, inside) if own and t]:
            articles.append(mine)
            rest += mine[-2:]
        rest += [t for t, own in zip(texts, inside) if t and not own]
    articles = articles or [_FILLER]
    rng = np.random.default_rng(97)
    made = [parse(compose(rng, articles[int(rng.integers(len(articles)))], rest), labelled=True)[0] for _ in range(composed)]
    return fit(made)


def main_text(pages: DataFrame, model: Model, *, html: str = "html", drop: tuple[str, ...] = ()) -> DataFrame:
    """The pages (without the columns in `drop`) with their main text as `text`."""
    gone = {"text", *(d.lower() for d in drop)}
    keep = [c for c in pages.columns if c.lower() not in gone]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in A.portions(batches, html):
            found = extract(model, part.column(part.schema.get_field_index(html)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(found, pa.string())],
                names=schema.names)

    return pages.mapInArrow(run, schema)
