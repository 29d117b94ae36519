"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. Each block gets a score: log-odds of being article text, summed from
the elements around it, its links and its wording. A positive score is the capacity of its arc from the
source, a negative one that of its arc to the sink. Neighbouring blocks and successive blocks of one
parent are tied by edges that weaken with their distance in the tree. The minimum cut is the labelling
of least total cost; blocks on the source's side are the article.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.llm.common import ship

# ---- fixed values: elements by what they are in HTML -------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK_TAGS - frozenset("html body option optgroup td th tr tbody thead tfoot caption".split())
SILENT = frozenset("head script style noscript template iframe svg canvas audio video noembed noframes textarea "
                   "title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# elements that end an open one of the same kind when they begin
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
# ---- fixed values: evidence, in log-odds ----------------------------------------------------------
FOR_TAGS = {"article": 3.0, "main": 3.0}
AGAINST_TAGS = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -5.0, "menu": -7.0, "dialog": -7.0, "header": -6.0,
                "select": -7.0, "button": -7.0, "label": -4.0, "fieldset": -5.0, "search": -7.0}
FOR_NAMES = frozenset("article articlebody body content entry hentry main maincontent post prose story text".split())
AGAINST_NAMES = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs captcha comment commentlist comments "
    "consent cookie cookies disclaimer disqus discussion feedback footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notification overlay pagination paywall popup promo promotion reactions recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar "
    "widget".split())
NAME_FOR, NAME_AGAINST, HIDDEN = 1.5, -7.0, -9.0
PRIOR, LINKS, LONG, SENTENCE, SHORT, RIGHTS = -0.5, -4.0, 1.8, 0.6, -0.3, -2.5
NEXT_EDGE, PARENT_EDGE = 2.0, 1.0
RIGHTS_TEXT = re.compile("©|\\(c\\) ?[12][0-9]{3}|all rights reserved|copyright", re.I)
STATES = frozenset("has have with without no not is".split())  # has-sidebar says what a page has, not what this is
SLUGS = frozenset("a about an and for from in of on or the to vs".split())  # comment-on-policy is a title
_PARTS = re.compile(r"[a-z]+")
# a number of so many digits is no character; the standard reader would try to make a number of it
_ZEROS, _HUGE = re.compile(r"&#0{2,}"), re.compile(r"&#0?[1-9][0-9]{7,}")


def names_of(value: str) -> tuple[set[str], set[str]]:
    """Names that speak for an article and against one, from the tokens of class, id, role and itemprop.

    A token with both kinds, such as footer-content, speaks against; states and titles say nothing.
    """
    good, bad = set(), set()
    for token in value.lower().split():
        parts = _PARTS.findall(token)
        if not parts or parts[0] in STATES or SLUGS.intersection(parts):
            continue
        against = AGAINST_NAMES.intersection(parts)
        if against:
            bad |= against
        else:
            good |= FOR_NAMES.intersection(parts)
    return good, bad


class _Node:
    __slots__ = ("tag", "parent", "depth", "evidence", "in_article")

    def __init__(self, tag: str, parent: _Node | None, evidence: float, in_article: bool):
        self.tag, self.parent, self.evidence, self.in_article = tag, parent, evidence, in_article
        self.depth = parent.depth + 1 if parent else 0


class Block:
    """Text of one block with what the labelling looks at."""

    __slots__ = ("text", "node", "heading", "linked")

    def __init__(self, text: str, node: _Node, heading: bool, linked: int):
        self.text, self.node, self.heading, self.linked = text, node, heading, linked


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.node = _Node("", None, 0.0, False)
        self.silent = 0
        self.parts: list[str] = []
        self.links = 0
        self.linked = 0
        self.heading = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.node, self.heading > 0, self.linked))
        self.parts, self.linked = [], 0

    def _evidence(self, tag: str, attrs: dict[str, str | None], inside: bool) -> float:
        score = FOR_TAGS.get(tag, 0.0)
        if not (tag == "header" and inside):
            score += AGAINST_TAGS.get(tag, 0.0)
        if tag in ("html", "body"):
            return score
        named = " ".join(filter(None, (attrs.get(k) for k in ("class", "id", "role", "itemprop"))))
        if named:
            good, bad = names_of(named)
            if good:
                score += NAME_FOR
            elif bad and tag not in FOR_TAGS and not (inside and bad == {"header"}):
                score += NAME_AGAINST
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            score += HIDDEN
        return score

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS or tag == "body":
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", {"article", "section", "div", "td", "th", "li", "blockquote", "body"})
        if tag in SIBLINGS:
            self._close_any(SIBLINGS[tag], {"ul", "ol", "dl", "menu", "table", "select"})
        inside = self.node.in_article or tag in FOR_TAGS
        self.node = _Node(tag, self.node, self.node.evidence + self._evidence(tag, dict(attrs), self.node.in_article), inside)
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.heading += tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "a", "iframe", "svg"):
            self.handle_endtag(tag)

    def _leave(self, until: _Node) -> None:
        while self.node is not until:
            self.silent -= self.node.tag in SILENT
            self.links -= self.node.tag == "a"
            self.heading -= self.node.tag in HEADINGS
            self.node = self.node.parent

    def _close_any(self, tags: set[str], stop: set[str]) -> None:
        node = self.node
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self._leave(node.parent)
                return
            node = node.parent

    def _close(self, tag: str, stop: set[str]) -> None:
        self._close_any({tag}, stop)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        node = self.node
        while node.parent is not None:
            if node.tag == tag:
                self._leave(node.parent)
                return
            node = node.parent

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration of an unknown kind is a comment up to its ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[Block]:
        self.close()
        self._flush()
        return self.blocks


def blocks_of(html: str) -> list[Block]:
    reader = _Reader()
    if "&#" in html:
        html = _HUGE.sub("&#1114112", _ZEROS.sub("&#0", html))
    reader.feed(html)
    return reader.finish()


def score(block: Block) -> float:
    """Log-odds that the block belongs to the article."""
    n = len(block.text)
    value = PRIOR + max(-12.0, min(6.0, block.node.evidence))
    value += LINKS * min(1.0, block.linked / n)
    value += LONG if n >= 80 else 0.0
    value += SENTENCE if block.text[-1] in ".!?…:;\"”»" else 0.0
    if n < 25 and not block.heading:
        value += SHORT
    if n < 400 and RIGHTS_TEXT.search(block.text) and not block.node.in_article:
        value += RIGHTS
    return value


def _distance(a: _Node, b: _Node, most: int = 12) -> int:
    """Steps between two elements in the tree, ``most`` where it is further."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Ties between neighbours, and between successive blocks of one parent; weak where their elements speak
    for different sides."""
    edges, last = [], {}

    def tie(a: int, b: int, weight: float) -> None:
        edges.append((a, b, weight / (1 + abs(blocks[a].node.evidence - blocks[b].node.evidence))))

    for i, block in enumerate(blocks):
        if i:
            tie(i - 1, i, NEXT_EDGE / (1 + _distance(blocks[i - 1].node, block.node)))
        parent = id(block.node.parent or block.node)
        if parent in last and last[parent] < i - 1:
            tie(last[parent], i, PARENT_EDGE)
        last[parent] = i
    return edges


def source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes the minimum cut leaves with the source, by maximum flow along shortest open paths.

    Nodes whose choice is free go to the sink.
    """
    n = len(scores)
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, w in edges:
        to[a].append(len(head))
        head.append(b)
        room.append(w)
        to[b].append(len(head))
        head.append(a)
        room.append(w)
    excess, need = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            reached = reached or need[u] > tiny
            for e in to[u]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if not reached:
            return [v >= 0 for v in level]
        at = [0] * n
        for start in range(n):
            path = []
            u = start
            while excess[start] > tiny:
                if need[u] > tiny:
                    flow = min([excess[start], need[u], *(room[e] for e in path)])
                    excess[start] -= flow
                    need[u] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, u = [], start
                    continue
                while at[u] < len(to[u]):
                    e = to[u][at[u]]
                    if room[e] > tiny and level[head[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(to[u]):
                    path.append(to[u][at[u]])
                    u = head[path[-1]]
                elif path:  # a dead end: step back and past this edge
                    e = path.pop()
                    u = head[e ^ 1]
                    at[u] += 1
                else:
                    break


def main_text(html: str | None) -> str:
    """Article text of one page; empty for a null, empty or text-free page."""
    if not html:
        return ""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    keep = source_side([score(b) for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null, empty and text-free pages have the empty text; no page, however malformed, stops the job. Each row
    is read alone and whole: repeated rows give repeated results, an empty table gives none, other columns are
    ignored, whatever their names.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
