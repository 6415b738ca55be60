"""Main-text extraction by minimum cut.

A page is cut into blocks: runs of text between block-level boundaries.  A
logistic classifier gives each block a cost of being content and a cost of
being boilerplate; these are the capacities of its edges to the two terminals.
Neighbours in reading order, and blocks under the same parent, are tied by
edges whose capacity falls with their distance in the tree.  The minimum cut
separates content from boilerplate at the least total cost, so a short
paragraph follows its surroundings while a strongly marked block does not.

The classifier looks at what a block is made of (words, links, sentences), at
HTML's own elements, and at where the block stands: the page's body of prose is
the element that holds most of it, and a block's region is the part of the page
that branches off on the way to that element.  Names in class and id attributes
are one hint among these, as authors name things as they like.  It is trained
here, on pages that a seeded generator writes with known labels, with well-known
names, invented ones or none (`trained_weights`); nothing is fitted to the data
that it judges.

Parsing takes time in proportion to the page, whatever the markup: open elements
are found by name, and a quote that is never closed is met once.

Defined results: a null or empty page, or one without content, gives "".
Broken markup is read as far as it goes: unknown close tags are ignored, open
elements end with the page, an unclosed comment or script hides the rest.
Scripts, styles, templates, drawings, frames, media, and the choices and text
fields of forms have no text of the page's own and are left out; everything else
is for the cut to decide.  Repeated rows are extracted each; extra columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTED = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
CLASS_OR_ID = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

# fixed values: HTML's element classes
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "template", "svg", "select", "canvas", "audio", "video", "xmp"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
LISTS = {"dl", "ol", "table", "ul"}
BOILERPLATE_TAGS = {"nav", "aside", "footer", "form", "menu", "button", "dialog", "fieldset", "label", "head"}
CONTENT_TAGS = {"article", "main"}
# fixed values: which open elements a new one ends, and which keep it from looking further up
ENDS = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CELL_STOPS = ("table", "div", "article", "section", "main", "body")
# fixed values: words that often name a region in class, id and role attributes
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "author", "banner", "bio", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "complementary", "contentinfo", "cookie", "cookies", "copyright", "discussion",
    "disqus", "footer", "form", "gdpr", "header", "links", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "privacy",
    "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar",
    "trending", "widget",
}
BOILERPLATE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "menu", "navig", "newsletter", "promo", "sidebar", "sponsor", "subscri")
CONTENT_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
SENTENCE_ENDS = frozenset(".!?…:;\"”»。！？।؟۔")
FEATURES = (
    "bias", "tag_bad", "tag_good", "name_bad", "name_good", "in_main", "link_share", "region_links", "log_words", "sentence", "heading", "first_heading", "list_item", "few_words", "copyright",
    "region_prose", "region_apart", "region_late", "body_text", "paragraph", "cell",
)
#: What an element passes on to those inside it.
LINK, TAG_BAD, TAG_GOOD, NAME_BAD, NAME_GOOD, LIST = 1, 2, 4, 8, 16, 32
#: Levels of the tree that are walked to tell how far apart two neighbours are; beyond it they count as far.
REACH = 6


class Block(NamedTuple):
    text: str
    node: int  # the innermost block-level element
    links: float  # share of characters inside links
    state: int


@dataclass(frozen=True)
class Page:
    """Blocks in reading order and the tree of block-level elements, parents before children."""

    blocks: list[Block]
    parent: list[int]
    name: list[str]


@dataclass(frozen=True)
class CutParameters:
    order_tie: float = 0.8
    parent_tie: float = 0.4
    ceiling: float = 6.0


def _state(name: str, attrs: str, above: int) -> int:
    """What an element and all above it say about the text inside; the innermost mark holds, but a region
    inside boilerplate is content only if it is a main part."""
    state = above
    if name in BOILERPLATE_TAGS or (name == "header" and not above & TAG_GOOD):
        state = (state | TAG_BAD) & ~(TAG_GOOD | NAME_GOOD)
    elif name in CONTENT_TAGS and (name == "main" or not above & (TAG_BAD | NAME_BAD)):
        state = (state | TAG_GOOD) & ~(TAG_BAD | NAME_BAD)
    if name == "li":
        state |= LIST
    elif name in ("article", "section", "table"):
        state &= ~LIST
    if not attrs or "=" not in attrs or name in ("body", "html"):
        return state
    named = set()
    for m in CLASS_OR_ID.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        named.update(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    if not named:
        return state
    good = named & CONTENT_WORDS
    bad = {w for w in named if w in BOILERPLATE_WORDS or w.startswith(BOILERPLATE_STARTS)}
    if bad == {"header"} and (good or above & (TAG_GOOD | NAME_GOOD)):
        return state  # the head of an article, not of the page
    if bad == {"sidebar"} and named & {"with", "has", "no"}:
        bad = set()  # says what stands beside it
    if bad:
        return (state | NAME_BAD) & ~(NAME_GOOD | TAG_GOOD)
    if good and not state & (TAG_BAD | NAME_BAD):
        return state | NAME_GOOD
    return state


def parse_page(page: str) -> Page:
    """Blocks and their tree, in one pass."""
    blocks: list[Block] = []
    parent, names = [-1], ["#"]
    # open elements: name, state, and the tree's node that was innermost outside it
    stack: list[tuple[str, int, int]] = [("#", 0, 0)]
    places: dict[str, list[int]] = {}  # of each name's open elements in the stack
    open_blocks: list[int] = [0]  # places of open block-level elements
    pieces: list[str] = []
    linked = at = node = 0
    end, last_close, tag = len(page), page.rfind(">"), QUOTED

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = SPACE.sub(" ", html_lib.unescape(raw) if "&" in raw else raw).strip()
            if text:
                blocks.append(Block(text, node, min(1.0, linked / len(text)), stack[open_blocks[-1]][1]))
            pieces.clear()
        linked = 0

    def close_to(place: int) -> None:
        """Ends the element at a place of the stack and all inside it."""
        nonlocal node
        while len(stack) > place:
            name, _, outer = stack.pop()
            places[name].pop()
            if open_blocks[-1] == len(stack):
                open_blocks.pop()
                node = outer

    def innermost(wanted: tuple[str, ...]) -> int:
        return max([places[n][-1] for n in wanted if places.get(n)], default=0)

    while at < end:
        start = page.find("<", at) if at <= last_close else -1
        if start < 0 or start > last_close:
            start = end
        if start > at:
            pieces.append(page[at:start])
            if stack[-1][1] & LINK:
                linked += start - at
            if start == end:
                break
        m = tag.match(page, start)
        if m is None and tag is QUOTED and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
            tag = PLAIN  # a quote is never closed: from here on quotes mean nothing
            m = tag.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                if page.startswith(("<!-->", "<!--->"), start):
                    at = page.index(">", start) + 1
                else:
                    close = page.find("-->", start + 4)
                    at = end if close < 0 else close + 3
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.index(">", start) + 1
            else:
                pieces.append("<")
                at = start + 1
            continue
        at, name, attrs = m.end(), m[2].lower(), m[3]
        block = name in BLOCK
        if block:
            flush()
        if m[1]:
            # an inline element is not closed from inside another block
            if places.get(name) and (block or places[name][-1] > open_blocks[-1]):
                close_to(places[name][-1])
            continue
        if name in RAW_TEXT:
            if attrs.endswith("/") and name == "svg":
                continue
            close = RAW_END[name].search(page, at)
            stop = end if close is None else close.start()
            if name == "xmp":
                flush()
                pieces.append(page[at:stop].replace("&", "&amp;"))
                flush()
            after = page.find(">", stop) if close is not None else -1
            at = end if after < 0 else after + 1
            continue
        if block:
            # an open paragraph ends where another block begins, a list item at the next one
            ends = ENDS.get(name, ("p",))
            if name in ("tr", "td", "th"):
                place = innermost(ends)
                if place > innermost(CELL_STOPS):
                    close_to(place)
            elif stack[open_blocks[-1]][0] in ends:
                close_to(open_blocks[-1])
        elif name == "br":
            pieces.append(" ")
        if name in VOID or attrs.endswith("/") and not block:
            continue
        above = stack[-1][1]
        outer = node
        if block:
            open_blocks.append(len(stack))
            parent.append(node)
            names.append(name)
            node = len(parent) - 1
            state = _state(name, attrs, above)
        else:
            state = above | LINK if name == "a" else above
        places.setdefault(name, []).append(len(stack))
        stack.append((name, state, outer))
    flush()
    return Page(blocks, parent, names)


def _words(text: str) -> float:
    """Words, or for scripts without spaces half the characters."""
    spaced = text.count(" ") + 1
    return len(text) / 2 if len(text) > 12 * spaced and ord(text[len(text) // 2]) >= 0x2E80 else float(spaced)


def main_part(page: Page, mass: list[float]) -> int:
    """The element that holds the page's body of prose: a main part or the one large article where there is one,
    else the innermost container with most of the mass."""
    for kind in ("main", "article"):
        marked = [i for i, n in enumerate(page.name) if n == kind and mass[i] > 0]
        if marked:
            best = max(marked, key=lambda i: (mass[i], -i))
            if kind == "main" or mass[best] >= 0.5 * sum(mass[i] for i in marked):
                return best
    children: dict[int, list[int]] = {}
    for i in range(1, len(page.parent)):
        if page.name[i] in CONTAINERS:
            children.setdefault(page.parent[i], []).append(i)
    at = 0
    while inside := children.get(at):
        best = max(inside, key=lambda i: (mass[i], -i))
        if mass[best] < 0.6 * mass[at] or not mass[best]:
            break
        at = best
    return at


def features(page: Page) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(page.parent)
    mass, letters, links, held = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    words, prose, headed = [], [], [False] * n
    for b in page.blocks:
        w = _words(b.text)
        own = w * (1 - b.links) * (1.0 if b.text[-1] in SENTENCE_ENDS else 0.3)
        own *= 0.0 if b.state & TAG_BAD else 0.3 if b.state & NAME_BAD else 1.0
        words.append(w)
        prose.append(own)
        mass[b.node] += own
        letters[b.node] += len(b.text)
        links[b.node] += b.links * len(b.text)
        held[b.node] += 1
        headed[b.node] = headed[b.node] or page.name[b.node] in HEADINGS
    for i in range(n - 1, 0, -1):
        above = page.parent[i]
        mass[above] += mass[i]
        letters[above] += letters[i]
        links[above] += links[i]
        held[above] += held[i]
        headed[above] = headed[above] or headed[i]
    main = main_part(page, mass)
    spine, at = set(), main
    while at >= 0:
        spine.add(at)
        at = page.parent[at]
    region, inside = [-1] * n, [False] * n
    for i in range(n):
        above = page.parent[i]
        if i not in spine:
            region[i] = i if above in spine else region[above]
        inside[i] = i == main or (above >= 0 and inside[above])
    return _rows(page, np.array(words), np.array(prose), [np.array(x) for x in (mass, letters, links, held, headed, region, inside)], max(mass[main], 0.0))


def _rows(page: Page, words: np.ndarray, prose: np.ndarray, of_nodes: list[np.ndarray], total: float) -> np.ndarray:
    mass, letters, links, held, headed, region, inside = of_nodes
    kinds = {name: np.array([n in of for n in page.name]) for name, of in (("heading", HEADINGS), ("title", ("h1", "h2")), ("list", LISTS), ("box", ("div", "section")), ("part", ("div", "section", "article", "ul", "ol")), ("p", ("p", "pre", "blockquote", "dd")), ("cell", ("td", "th", "caption", "figcaption", "dt")))}
    node = np.array([b.node for b in page.blocks])
    state = np.array([b.state for b in page.blocks])
    share = np.array([b.links for b in page.blocks])
    ended = np.array([b.text[-1] in SENTENCE_ENDS for b in page.blocks])
    r, within, heading = region[node], inside[node], kinds["heading"][node]
    there, at = r >= 0, np.maximum(r, 0)
    has = lambda flag: (state & flag) > 0
    apart = there & (held[at] > 1) & ~kinds["list"][at] & ~headed[at]
    before = np.cumsum(np.where(within, prose, 0.0)) - np.where(within, prose, 0.0)
    first = np.zeros(len(node), bool)
    first[np.flatnonzero(heading)[:1]] = True
    clean, around = within & ~has(TAG_BAD | NAME_BAD), np.where(there, links[at] / np.maximum(1.0, letters[at]), share)
    columns = (
        np.ones(len(node)), has(TAG_BAD), has(TAG_GOOD), has(NAME_BAD), has(NAME_GOOD), within, share, around, np.log1p(words), ended,
        heading, first & kinds["title"][node], has(LIST), words < 4, np.array(["©" in b.text for b in page.blocks]), np.where(there & ~within, mass[at] / (total + 1.0), 0.0),
        (apart & within) | (there & kinds["box"][at] & ~heading & ~within), there & within & (before >= 0.8 * total) & ~heading & kinds["part"][at], clean & (around < 0.4), clean & kinds["p"][node], clean & kinds["cell"][node],
    )
    return np.stack([c.astype(float) for c in columns], 1)


def smoothness_edges(page: Page, p: CutParameters) -> list[tuple[int, int, float]]:
    parent = page.parent
    depth = [0] * len(parent)
    for i in range(1, len(depth)):
        depth[i] = depth[parent[i]] + 1
    ties = [p.order_tie / (1 + 0.5 * steps) for steps in range(2 * REACH + 1)]
    edges, last_under, before = [], {}, -1
    for i, block in enumerate(page.blocks):
        a, b, steps = before, block.node, 0
        if i:
            # edges of the tree between the two, as far as they are counted
            while a != b and steps < 2 * REACH:
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
                steps += 1
            edges.append((i - 1, i, ties[steps]))
        before = block.node
        above = max(parent[before], 0)
        if (j := last_under.get(above)) is not None and j != i - 1:
            edges.append((j, i, p.parent_tie))
        last_under[above] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side.

    gain > 0 is a node's capacity from the source less that to the sink (the
    smaller of the two flows straight through and cuts alike either way); edges
    have one capacity both ways.  Shortest augmenting paths in level graphs,
    searched with an explicit stack.
    """
    n = len(gain)
    supply = [max(g, 0.0) for g in gain]
    demand = [max(-g, 0.0) for g in gain]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        near[a].append(len(to)); to.append(b); room.append(c)  # noqa: E702
        near[b].append(len(to)); to.append(a); room.append(c)  # noqa: E702
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if supply[i] > tiny]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            if demand[i] > tiny:
                reached = True
            for e in near[i]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        following = [0] * n
        for start in [i for i in range(n) if level[i] == 0]:
            path: list[int] = []
            node = start
            while supply[start] > tiny:
                if demand[node] > tiny:
                    flow = min([supply[start], demand[node], *[room[e] for e in path]])
                    supply[start] -= flow
                    demand[node] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, node = [], start
                    continue
                while following[node] < len(near[node]):
                    e = near[node][following[node]]
                    if room[e] > tiny and level[to[e]] == level[node] + 1:
                        break
                    following[node] += 1
                if following[node] < len(near[node]):
                    path.append(near[node][following[node]])
                    node = to[path[-1]]
                elif path:
                    e = path.pop()
                    node = to[e ^ 1]
                    following[node] += 1
                else:
                    break


def label_blocks(page: Page, weights: np.ndarray, p: CutParameters = CutParameters()) -> list[bool]:
    """True for content.  A terminal capacity is the log cost of the other label, up to a ceiling."""
    if not page.blocks:
        return []
    scores = features(page) @ weights
    content_cost = np.minimum(np.logaddexp(0, -scores), p.ceiling)
    boilerplate_cost = np.minimum(np.logaddexp(0, scores), p.ceiling)
    return minimum_cut((boilerplate_cost - content_cost).tolist(), smoothness_edges(page, p))


def extract_text(text: str | None, weights: np.ndarray | None = None, p: CutParameters = CutParameters()) -> str:
    if not text:
        return ""
    page = parse_page(text)
    keep = label_blocks(page, trained_weights() if weights is None else weights, p)
    return "\n".join(b.text for b, k in zip(page.blocks, keep, strict=True) if k)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method for logistic regression with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        mean = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (mean * (1 - mean))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, x.T @ (mean - y) + ridge * w)
    return w


SCRIPTS = ("aeiounrstldkm", "aeiouäöüßnrstchg", "аеионтрсвклмд", "αειονσρτκλμπ")


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and the labels of its blocks, in order.

    Its regions carry HTML's own elements, well-known names, invented names, or no mark at all.
    """
    out: list[str] = ["<!DOCTYPE html><html><head><title>t</title></head><body>"]
    labels: list[bool] = []
    letters = rng.choice(SCRIPTS)
    naming = rng.choice(("known", "known", "invented", "none"))

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi).capitalize() + rng.choice(["." if rng.random() < 0.9 else "", "!", "?", "."])

    def put(markup: str, content: bool) -> None:
        out.append(markup)
        labels.append(content)

    def opened(tag: str, *known: str) -> tuple[str, str]:
        """An element of the given kind, or a plain one with a name, as the page's author has it."""
        if naming == "known" and rng.random() < 0.5 and tag != "div":
            return f"<{tag}>", f"</{tag}>"
        name = rng.choice(known) if naming == "known" else "x" + "".join(rng.choice("bdfgklmnprtvz") for _ in range(rng.randint(3, 8)))
        kind = rng.choice(("div", "div", "section"))
        return (f"<{kind}>" if naming == "none" else f'<{kind} {rng.choice(("class", "id"))}="{name}">'), f"</{kind}>"

    def links(n: int) -> None:
        listed = rng.random() < 0.7
        out.append("<ul>" if listed else "<p>")
        if listed:
            for _ in range(n):
                put(f'<li><a href="/x">{words(1, 4)}</a></li>', False)
        else:
            put(" ".join(f'<a href="/x">{words(1, 3)}</a>' for _ in range(n)), False)
        out.append("</ul>" if listed else "</p>")

    def region(tag: str, known: tuple[str, ...], what: str) -> None:
        first, last = opened(tag, *known)
        out.append(first)
        if what == "links":
            links(rng.randint(2, 9))
        elif what == "notice":
            for _ in range(rng.randint(1, 2)):
                put(f"<p>{sentence(2, 14)}</p>" if rng.random() < 0.6 else f"<div>{sentence(2, 14)}</div>", False)
        elif what == "bare":
            put(sentence(2, 12), False)
        elif what == "form":
            put(f'<p>{words(1, 6)}</p><input name="q">', False)
        elif what == "teasers":
            if rng.random() < 0.5:
                put(f"<h3>{words(1, 3)}</h3>", False)
            for _ in range(rng.randint(1, 5)):
                put(f'<p><a href="/z">{words(3, 9)}</a></p>', False)
        elif what == "comments":
            if rng.random() < 0.4:
                put(f"<h3>{words(1, 2)}</h3>", False)
            for _ in range(rng.randint(1, 6)):
                out.append("<div>")
                if rng.random() < 0.7:
                    put(f"<p>{words(1, 3)}</p>", False)
                put(f"<p>{sentence(3, 30)}</p>", False)
                out.append("</div>")
        out.append(last)

    def boilerplate() -> None:
        region(*rng.choice((
            ("nav", ("menu", "navbar", "breadcrumbs"), "links"), ("div", ("menu", "links", "toolbar"), "links"), ("header", ("header", "masthead"), "notice"), ("div", ("ad", "advert", "promo"), "bare"), ("div", ("ad", "sponsored"), "notice"),
            ("div", ("cookie-notice", "consent", "alert"), "notice"), ("aside", ("sidebar", "widget"), "links"), ("aside", ("sidebar", "related"), "teasers"), ("form", ("search", "login", "newsletter"), "form"),
        )))

    for _ in range(rng.randint(1, 4)):
        boilerplate()
    marked = naming == "known" and rng.random() < 0.8
    if marked:
        opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><article>', "</article></div>")])
    else:
        opening, closing = rng.choice([opened("div", "page", "column"), ("<div><div>", "</div></div>"), ("<div>", "</div>")])
    semantic = "article" in opening or "main" in opening
    brief = semantic and rng.random() < 0.4
    above = not semantic and rng.random() < 0.3
    if above:
        put(f"<h1>{words(3, 12)}</h1>", True)
    out.append(opening)
    if not above:
        put(f"<h1>{words(1 if brief else 3, 12)}</h1>", True)
    if rng.random() < 0.15:
        put(f"<p><b>{words(3, 12)}.<br></p>", True)
    # paragraphs as such or as plain elements, on their own or in sections
    paragraph = rng.choice(("p", "p", "p", "div"))
    grouped = not brief and rng.random() < 0.35
    opened_section = ""
    for _ in range(rng.randint(0, 2) if brief else rng.randint(4, 14)):
        if grouped and rng.random() < 0.35:
            out.append(opened_section and f"</{opened_section}>")
            opened_section = rng.choice(("section", "div"))
            out.append(f"<{opened_section}>")
            if rng.random() < 0.7:
                put(f"<h2>{words(1, 6)}</h2>", True)
        kind = rng.random()
        if kind < 0.68:
            put(f"<{paragraph}>{' '.join(sentence(1, 25) for _ in range(rng.randint(1, 6)))}</{paragraph}>", True)
        elif kind < 0.75:
            put(f"<h2>{words(1, 6)}</h2>", True)
        elif kind < 0.82:
            out.append("<ul>")
            for _ in range(rng.randint(2, 4)):
                put(f"<li>{sentence(2, 12)}</li>", True)
            out.append("</ul>")
        elif kind < 0.85:
            if not opened_section:
                boilerplate()
        elif kind < 0.87:
            put(f"<{paragraph}>{words(1, 4)}</{paragraph}>", True)
        elif kind < 0.885:
            put(f"<blockquote>{sentence(6, 30)}</blockquote>", True)
        elif kind < 0.91:
            out.append("<table>")
            for _ in range(rng.randint(2, 4)):
                out.append("<tr>")
                for _ in range(2):
                    put(f"<td>{words(1, 3) if rng.random() < 0.6 else rng.randint(1, 9999)}</td>", True)
                out.append("</tr>")
            out.append("</table>")
        elif kind < 0.94:
            put(f'<{paragraph}>{words(1, 2)} <a href="/y">{words(1, 3)}</a>.</{paragraph}>', True)
        else:
            put(f'<{paragraph}>{sentence(4, 9)} <a href="/y">{words(1, 3)}</a> {sentence(4, 9)}</{paragraph}>', True)
    out.append(opened_section and f"</{opened_section}>")
    if rng.random() < 0.3 and naming == "known":
        region("section", ("comments", "replies", "discussion"), "comments")
    out.append(closing)
    if rng.random() < 0.5:
        region("section", ("comments", "replies", "discussion"), "comments")
    if rng.random() < 0.4:
        boilerplate()
    first, last = opened("footer", "footer", "copyright")
    out.append(first)
    put(f"<p>{rng.choice(('&copy; ', '&copy; 2024 ', ''))}{sentence(1, 15)}</p>" if rng.random() < 0.5 else f"&copy; {sentence(1, 15)}", False)
    if rng.random() < 0.4:
        links(rng.randint(2, 4))
    out.append(last + "</body></html>")
    return "".join(out), labels


@cache
def trained_weights(pages: int = 600, seed: int = 5) -> np.ndarray:
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        text, truth = generated_page(rng)
        page = parse_page(text)
        if len(page.blocks) == len(truth):
            rows.append(features(page))
            labels += truth
    return fit_logistic(np.concatenate(rows), np.array(labels, float))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parameters: CutParameters = CutParameters()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.  No shuffle: each task extracts its own pages."""
    weights = trained_weights()
    id_type = pages.select(id_col).schema[0].dataType.simpleString()
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: extract_text(page, weights, parameters) if isinstance(page, str) else "").astype(object)

    done = chosen.select(F.col("page_id").cast(id_type).alias("page_id"), "url", extract("html").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
