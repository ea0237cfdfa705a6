"""Main text of web pages by a minimum cut.

A page becomes blocks of text in page order, each with the elements around it. A block's features
give a linear score for content; the costs of calling it content or boilerplate, ``log(1 + exp(-score))``
and ``log(1 + exp(score))``, are the capacities of its edges to the terminals. Blocks that follow each
other, or that follow each other within the same parent, are joined by smoothness edges whose
capacity falls with their distance in the tree. The minimum cut between the terminals labels all
blocks at once; max-flow (Dinic's) finds it.

Text of scripts, styles, forms, the head and comments is never a block; fallback text (noscript, object), formulas and labels outside forms
are text like any other. Character references are decoded,
white space within a block becomes one space, blocks are joined by an empty line. Null html is empty;
broken markup is read as far as browsers would (open elements are closed by their parents; a tag that
never ends drops the rest). Each page is handled on its own, whatever its length: each open element knows the nearest block, container and
list around it and each name its open elements, so that reading is linear in length, however deep the nesting and however many
end tags have no start; the way between two blocks in the tree is as long as the tags between them. The graph has at most two smoothness edges for each block.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style template textarea title".split())
#: What may stand in a head; anything else, text too, ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SKIPPED = frozenset("button datalist form head input option select svg textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
CONTAINERS = frozenset("article aside blockquote body details div fieldset figure footer form header html main nav section table td th".split())
LISTINGS = frozenset("ul ol dl table select".split())
SELF_CLOSING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id and role that mark furniture or the article.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|sidebar|aside|widget\w*|related|recommend\w*|"
    r"share|sharing|social|nav\w*|menu\w*|breadcrumbs?|pag(?:er|ination)|footer|masthead|toolbar|comments?|commentlist|respond|repl(?:y|ies)|disqus|skip|copyright)(?=$|[\s_-]|\d)",
    re.I,
)
#: Words that mark furniture outside an article but may well name a part of one.
FURNITURE_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:banner|notice|alert|side|foot|header|legal|tags?|search)(?=$|[\s_-]|\d)", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post(?:body|content|text)?|entry|content|story|main|body|text|prose|blog)(?=$|[\s_-]|\d)", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_XMP_END = re.compile(r"</xmp(?=[\s/>])", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D\xa0]+")


@dataclass(frozen=True)
class Weights:
    """Of the linear score and the smoothness edges."""

    bias: float = -0.6
    in_article: float = 4.0
    article_class: float = 1.5
    furniture_element: float = 9.0
    furniture_class: float = 8.0
    doubtful_class: float = 3.0
    length: float = 0.8
    sentence: float = 0.7
    link_share: float = 3.5
    heading: float = 0.5
    list_item: float = 0.4
    smooth: float = 0.8
    sibling: float = 0.5


@dataclass
class _Open:
    name: str
    inside: int  # depth of article or main around
    good: int
    bad_element: int
    bad_class: int
    doubtful: int
    # Places in the stack of the nearest elements of a kind, this one included.
    block: int
    container: int
    listing: int
    wall: int
    node: tuple  # the container around as (parent's node, depth)
    holder: int


@dataclass
class Block:
    text: str
    linked: int
    name: str
    inside: int
    good: int
    bad_element: int
    bad_class: int
    doubtful: int
    parent: int
    node: tuple


_ROOT = (None, 0)


class _Page:
    """Reads a page into blocks."""

    def __init__(self, html: str) -> None:
        self.html, self.blocks, self.parts, self.linked, self.links = html, [], [], 0, 0
        self.stack = [_Open("", 0, 0, 0, 0, 0, 0, 0, 0, 0, _ROOT, 0)]
        self.places: dict[str, list[int]] = {}
        self.skip = 0
        self.ids = 0
        self.read()

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", _html.unescape("".join(self.parts))).strip(" ")
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, min(self.linked, len(text)), self.stack[top.block].name, top.inside, top.good, top.bad_element, top.bad_class, top.doubtful, top.holder, top.node))
        self.parts, self.linked = [], 0

    def end_head(self) -> None:
        while self.stack[-1].name == "head":
            self.pop_to(len(self.stack) - 1)

    def text(self, piece: str) -> None:
        if self.stack[-1].name == "head" and _html.unescape(piece).strip(" \t\n\f\r"):
            self.end_head()
        if not self.skip:
            self.parts.append(piece)
            if self.links:
                self.linked += len(piece)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            x = self.stack.pop()
            self.places[x.name].pop()
            self.skip -= x.name in SKIPPED
            self.links -= x.name == "a"

    def last(self, *names: str) -> int:
        """The place in the stack of the innermost open element of these names; 0 if none is open."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def opened(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
            if name in CLOSES_P and self.stack[at := self.stack[-1].block].name == "p":
                self.pop_to(at)
            if name in SELF_CLOSING and (at := self.last(*SELF_CLOSING[name])) > self.stack[-1].listing:
                self.pop_to(at)
        elif name == "br":
            self.text(" ")
        if name in VOID:
            return
        top = self.stack[-1]
        marks, hidden = [], False
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                if m[1].lower() == "hidden":
                    hidden = True
                else:
                    marks.append(m[2] or m[3] or m[4] or "")
        marks = " ".join(marks)
        main = name in ("article", "main") or "main" in marks.split()
        # The header of an article holds its title; that of a page doesn't.
        furniture = name in ("nav", "footer", "aside", "menu", "dialog", "search") or name == "header" and not top.inside or hidden
        marked = bool(marks) and not main and name not in ("html", "body")
        bad = marked and bool(FURNITURE.search(marks))
        doubtful = marked and not bad and bool(FURNITURE_OUTSIDE.search(marks))
        if doubtful and not top.inside:
            bad, doubtful = True, False
        self.ids += 1
        at, holds = len(self.stack), name in CONTAINERS
        self.stack.append(
            _Open(
                name, top.inside + main, top.good + bool(marks and not bad and ARTICLE.search(marks)), top.bad_element + furniture, top.bad_class + bad, top.doubtful + doubtful,
                at if name in BLOCK else top.block, at if holds else top.container, at if name in LISTINGS or holds and name not in ("td", "th") else top.listing,
                at if name in ("article", "main", "td", "th", "body") else top.wall, (top.node, top.node[1] + 1) if holds else top.node, self.ids if holds or name in ("ul", "ol", "dl") else top.holder,
            )
        )
        self.places.setdefault(name, []).append(at)
        self.skip += name in SKIPPED
        self.links += name == "a"

    def closed(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        elif name == "br":
            self.text(" ")
        at, top = self.last(name), self.stack[-1]
        # An end tag without a start in reach changes nothing.
        if at and (name in BLOCK or at > top.container) and (name in CONTAINERS or at > top.wall):
            self.pop_to(at)

    def read(self) -> None:
        h, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = h.find("<", at)
            if lt < 0:
                self.text(h[at:])
                break
            if lt > at:
                self.text(h[at:lt])
            c = h[lt + 1 : lt + 2]
            if c == "!" and h.startswith("<!--", lt):
                end = h.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif c in ("!", "?"):
                end = h.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                m = _NAME.match(h, lt + 1 + (c == "/"))
                if not m:
                    self.text("<")
                    at = lt + 1
                    continue
                rest = _REST.match(h, m.end())
                if rest is None:  # never ends, or holds an odd quote
                    end = h.find(">", m.end())
                    if end < 0:
                        break
                    attributes, at = h[m.end() : end], end + 1
                else:
                    attributes, at = h[m.end() : rest.end() - 1], rest.end()
                name = m[0].lower()
                if c != "/" and name not in HEAD:
                    self.end_head()
                if c == "/":
                    self.closed(name)
                elif name == "xmp":
                    end = m.start() if (m := _XMP_END.search(h, at)) else -1
                    self.opened("pre", attributes)
                    self.text(_html.escape(h[at : end if end >= 0 else n], quote=False))
                    self.closed("pre")
                    at = n if end < 0 or (close := h.find(">", end)) < 0 else close + 1
                elif name in RAW or name == "noscript" and self.stack[-1].name == "head":
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(h, at)
                    close = h.find(">", end.end()) if end else -1
                    at = n if close < 0 else close + 1
                else:
                    self.opened(name, attributes)
        self.flush()


def blocks(html: str | None) -> list[Block]:
    return _Page(html or "").blocks


def score(b: Block, w: Weights = Weights()) -> float:
    """Positive for content."""
    n = len(b.text)
    s = w.bias + w.length * math.log1p(n / 40) - w.link_share * b.linked / n
    s += w.sentence * min(3, len(re.findall(r"[.!?…。](?:\s|$)", b.text)))
    s += w.in_article * bool(b.inside) + w.article_class * min(2, b.good)
    s -= w.furniture_element * b.bad_element + w.furniture_class * b.bad_class + w.doubtful_class * bool(b.doubtful)
    return s + w.heading * (b.name in ("h1", "h2", "h3", "h4", "h5", "h6")) - w.list_item * (b.name == "li")


def _between(a: tuple, b: tuple) -> int:
    """Containers to leave and enter on the way from one container to another."""
    n = 0
    while a is not b:
        n += 1
        if a[1] >= b[1]:
            a = a[0]
        else:
            b = b[0]
    return n


def _edges(bs: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(bs):
        if i:
            out.append((i - 1, i, w.smooth / (1 + _between(bs[i - 1].node, b.node))))
        if (j := last.get(b.parent, i)) < i - 1:
            out.append((j, i, w.sibling))
        last[b.parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays with the source. ``source``, ``sink``: capacities to the terminals; ``edges``: in both directions.

    What a node can send straight through is sent first, which leaves each node an excess or a deficit;
    blocking flows (Dinic's) then go from nodes with excess to nodes with deficit.
    """
    n = len(source)
    rest = [round((a - b) * 1e6) for a, b in zip(source, sink)]
    if not any(x < 0 for x in rest):
        return [True] * n
    if not any(x > 0 for x in rest):
        return [False] * n
    to, cap, out = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        cap += [round(c * 1e6)] * 2
    while True:
        level = [0 if x > 0 else -1 for x in rest]
        queue, reached = deque(i for i in range(n) if rest[i] > 0), False
        while queue:
            i = queue.popleft()
            reached |= rest[i] < 0
            for e in out[i]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while rest[s] > 0 and level[s] == 0:
                path, i = [], s
                while rest[i] >= 0:
                    while turn[i] < len(out[i]) and not (cap[out[i][turn[i]]] and level[to[out[i][turn[i]]]] == level[i] + 1):
                        turn[i] += 1
                    if turn[i] < len(out[i]):
                        path.append(out[i][turn[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        turn[i] += 1
                    else:
                        break
                if not path:
                    break
                push = min([rest[s], -rest[i], *(cap[e] for e in path)])
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                rest[s] -= push
                rest[i] += push


def main_text(html: str | None, w: Weights = Weights()) -> str:
    bs = blocks(html)
    scores = [score(b, w) for b in bs]
    soft = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    content = minimum_cut([soft(s) for s in scores], [soft(-s) for s in scores], _edges(bs, w)) if bs else []
    return "\n\n".join(b.text for b, keep in zip(bs, content) if keep)


def _extract(batches: Iterator[pa.RecordBatch], w: Weights) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x, w) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, weights: Weights = Weights()) -> DataFrame:
    """Columns row (of ``keep``, else of all columns but the html), text, n_chars; a row per page. No shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep or [c for c in pages.columns if c != html]])
    packed = pages.select(row.alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    schema = packed.drop("html").schema.add("text", "string").add("n_chars", "long")
    return packed.mapInArrow(lambda batches: _extract(batches, weights), schema)
