"""Main text of a page by a minimum cut between content and boilerplate."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import map_slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
#: Never text of a page.
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video head title select textarea option datalist".split())
#: Boilerplate by tag.
FRAME = frozenset("nav footer aside header form menu dialog button fieldset".split())
ARTICLE = frozenset("article main".split())
#: Words of class, id and role that mark boilerplate, and those that mark content.
BAD = frozenset(
    "ad ads adv advert adverts advertisement adsense advertising sponsor sponsored promo promotion promoted banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "disclaimer popup modal overlay newsletter subscribe subscription signup login signin register share sharing social comment comments "
    "commentlist reply replies respond disqus discussion related recommended recommendations teaser widget search pagination pager skip "
    "copyright legal hidden complementary contentinfo search form tags paywall".split()
)
GOOD = frozenset("article content post entry story body text main maintext articlebody".split())
#: Of an article's own names only these mark boilerplate: each reader comment may be an article.
COMMENT = frozenset("comment comments commentlist reply replies".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
#: Tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre search section table ul".split()
)
#: Lists and tables keep their open rows when an inner one starts.
SCOPES = frozenset("ul ol dl table body html div section article main td th".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("bad", "good", "holds", "parent", "tag", "unseen")

    def __init__(self, tag: str, attrs: list, parent: Element | None):
        self.tag, self.parent, self.holds = tag, parent, False
        named = dict(attrs)
        names = [name for key in ("class", "id", "role") for name in (named.get(key) or "").split()] if tag not in ("html", "body") else []
        words: set[str] = set()
        for name in names:
            own = {t.lower() for t in TOKEN.findall(name)}
            words |= own - {"header"} if own & GOOD else own  # a post-header has the title
        style = SPACE.sub("", named.get("style") or "").lower()
        self.unseen = tag in UNSEEN or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style
        self.good = tag in ARTICLE or bool(words & GOOD)
        self.bad = tag in FRAME or bool(words & (COMMENT if tag in ARTICLE else BAD))


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


class Blocks(HTMLParser):
    """Cuts a page into blocks of text, each with the element it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks = [Element("#page", [], None)], []
        self.parts, self.linked, self.links, self.unseen, self.heads = [], 0, 0, 0, 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            element = self.stack[-1]
            while element.tag in INLINE:
                element = element.parent
            self.blocks.append(Block(text, self.linked, element))
        self.parts, self.linked = [], 0

    def pop(self, at: int) -> None:
        for element in self.stack[at:]:
            self.links -= element.tag == "a"
            self.heads -= element.tag == "head"
            self.unseen -= element.unseen
        del self.stack[at:]

    def end_head(self) -> None:
        """The open head ends, with what is open in it."""
        if not self.heads:
            return
        at = next(k for k, element in enumerate(self.stack) if element.tag == "head")
        if all(element.tag not in ("title", "script", "style", "template", "noscript") for element in self.stack[at:]):
            self.pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag not in HEAD and tag != "head":
            self.end_head()
        if tag in VOID:
            return
        closes = CLOSES.get(tag) or (frozenset(["p"]) if tag in ENDS_P else None)
        if closes:
            for at in range(len(self.stack) - 1, 0, -1):
                own = self.stack[at].tag
                if own in closes:
                    self.pop(at)
                    break
                if own in SCOPES:
                    break
        element = Element(tag, attrs, self.stack[-1])
        if tag in ARTICLE and not element.bad:
            for outer in self.stack:
                outer.holds = True
        self.links += tag == "a"
        self.heads += tag == "head"
        self.unseen += element.unseen
        self.stack.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self.pop(at)
                break

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self.end_head()
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def cut_blocks(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def framed(block: Block) -> bool:
    """Does the block stand in an element whose tag or name marks boilerplate? One that holds the article doesn't count."""
    element, lead = block.element, block.element.tag == "h1"
    while element is not None:
        if element.bad and not element.holds and not (lead and element.tag == "header"):
            return True
        element = element.parent
    return False


def evidence(block: Block, frame: bool) -> float:
    """The classifier: log-odds that a block is content, from its words, its links and where it stands."""
    words = len(block.text.split())
    score = 1.2 * math.log1p(words) - 2.0 - 4.0 * min(1.0, block.linked / len(block.text))
    score += 0.5 * (block.text[-1] in ".!?…\"'”»") - 3.0 * (words < 30 and ("©" in block.text or "all rights reserved" in block.text.lower()))
    score += {"p": 0.5, "h1": 2.0, "h2": 1.0, "h3": 1.0, "blockquote": 0.5, "pre": 0.5, "li": -0.5, "td": -0.3}.get(block.element.tag, 0.0)
    if frame:
        return score - 12.0
    element = block.element
    while element is not None and not element.good:
        element = element.parent
    return score + 3.0 * (element is not None)


def edges(blocks: list[Block], frames: list[bool]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours on the page, and the last block in the same element, parent and grandparent.

    Nearness in the document's tree ends where an element marked as boilerplate begins.
    """
    out, seen = [], {}
    for k, (block, frame) in enumerate(zip(blocks, frames)):
        if k:
            out.append((k - 1, k, 0.3))
        element = block.element
        for distance, weight in enumerate((3.0, 3.0, 0.75)):
            before = seen.get((distance, id(element), frame))
            if before is not None:
                out.append((before, k, weight))
            seen[distance, id(element), frame] = k
            element = element.parent
            if element is None:
                break
    return out


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node: is it on the source's side of a minimum cut?

    Positive scores are capacities from the source, negative ones to the sink,
    links hold both ways. Flow is pushed along shortest paths, level by level,
    until none is left; what the source still reaches is its side.
    """
    n = len(scores)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, score in enumerate(scores):
        if score > 0:
            link(source, k, score, 0.0)
        elif score < 0:
            link(k, sink, -score, 0.0)
    for a, b, weight in links:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(out[at]):
                path.append(out[at][turn[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    """The blocks on the content side of the cut, in page order, one to a line; empty if there is none."""
    blocks = cut_blocks(html or "")
    frames = [framed(b) for b in blocks]
    scores = [evidence(b, f) for b, f in zip(blocks, frames)]
    if not any(s > 0 for s in scores):
        return ""
    keep = minimum_cut(scores, edges(blocks, frames)) if any(s < 0 for s in scores) else [True] * len(blocks)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    A null or empty html has an empty text. n_chars counts code points. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def work(part: pa.RecordBatch) -> Iterable:
        return [part.column("page_id"), part.column("url"), [main_text(h) for h in part.column("html").to_pylist()]]

    small = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = map_slices(small, work, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
