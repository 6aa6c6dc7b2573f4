"""HTML extraction by minimum-cut labelling of a page's text blocks.

A page is cut into blocks of text at block-level tags.  A fixed linear classifier scores each block from the telling
elements around it (by tag, role, class and id: the nearest counts, but reader comments, asides, hidden parts and the
like make boilerplate of all within), its words, its share of link text and its punctuation.  The
logistic costs of calling it boilerplate or content are its terminal capacities.  Neighbouring blocks and consecutive
blocks of one parent are joined by edges whose capacity falls with their distance in the tree, and a maximum flow
gives the cut: the blocks on the source's side are the content, joined in page order.

Defined cases: an empty table gives an empty result; null or empty html, or a page without content, gives empty text;
unclosed and stray tags are mended as browsers do for paragraphs and lists; character references are decoded; white
space in a block (a line break too) becomes one space; nothing is cut off, however long; only the columns named are read.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template svg math iframe object canvas audio video select button textarea option datalist".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "option"}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
AGAINST_TAG = set("nav footer aside form menu dialog".split())
FOR_TAG = {"article", "main"}
AGAINST_ROLE = set("navigation banner contentinfo complementary dialog alert alertdialog search form menu menubar toolbar".split())
FOR_ROLE = {"main", "article"}
AGAINST = set("""ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notices notification alert popup modal overlay sidebar side aside widget widgets menu menus nav navbar navigation topnav breadcrumb breadcrumbs
toolbar footer foot header masthead topbar share sharing social related recommended recommendations newsletter subscribe subscription
signup login comment comments commentlist disqus respond reply replies discussion search searchform form pagination pager legal copyright
disclaimer skip hidden paywall teaser trending""".split())
REMARKS = set("comment comments commentlist disqus respond reply replies".split())
STATE = set("has no with without open closed".split())  # a class of such a word tells what a page has, not what its element is
WRAP = set("wrap wrapper wrapping layout container page site outer inner grid row columns".split())
FOR = set("article content main post entry story articlebody maincontent".split())
NEAR = 0.8


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    score: float


def words_of(value: str) -> set[str]:
    return set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def hint(tag: str, attrs: dict[str, str | None]) -> tuple[float, int] | None:
    """What an element tells of its text, positive (content) or negative (boilerplate), and how firmly (1 to 3)."""
    if tag in ("html", "body"):
        return None
    style = (attrs.get("style") or "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return -12.0, 3
    role = (attrs.get("role") or "").lower()
    each = [words_of(x) for x in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()]
    names = set().union(*each)
    bad, good = set().union(*(x for x in each if not x & STATE)) & AGAINST, names & FOR
    if bad == {"header"} and (good or tag != "div"):
        bad = set()
    if role in AGAINST_ROLE - {"form"} or tag in AGAINST_TAG - {"form"} or bad & REMARKS:
        return -8.0, 3
    if bad:
        return -8.0, 1 if names & WRAP or bad == {"form"} else 2
    if role in FOR_ROLE or tag in FOR_TAG or attrs.get("itemprop") == "articleBody":
        return 4.0, 3
    if good:
        return 4.0, 2
    return (-8.0, 1) if "form" in (tag, role) else None


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, tuple[float, int] | None]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.serial, self.links, self.unseen = 0, 0, 0, 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, tuple(s[1] for s in self.stack if s[0] not in INLINE), self.rate(text)))
        self.parts, self.linked = [], 0

    def rate(self, text: str) -> float:
        told, heading, shield = None, False, 1
        tags = [s[0] for s in self.stack]
        for tag, _, said in reversed(self.stack):
            heading = heading or tag in ("h1", "h2", "h3", "h4")
            if said is None or (told or 0) < 0:
                continue
            if said[0] > 0:
                told, shield = told or said[0], max(shield, said[1])
            elif said[1] >= shield:  # an outer element overrules an inner one that is no firmer
                told = said[0]
        if "header" in tags and "article" not in tags and "main" not in tags:
            told = -8.0
        n = len(text.split())
        s = (told or 0.0) + min(n, 40) / 10 - 1.0 - 6.0 * min(1.0, self.linked / max(1, len(text)))
        s += 0.7 * (text[-1] in ".!?:;\"'”»") + 0.7 * heading
        if "©" in text[:40] or "all rights reserved" in text.lower():
            s -= 4.0
        return s

    def close_to(self, k: int) -> None:
        for tag, _, _ in self.stack[k:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            scope = SCOPE.get(tag, set())
            for k in range(len(self.stack) - 1, -1, -1):
                t = self.stack[k][0]
                if t == "p" or (t in PARAGRAPH and t == tag) or (tag in ("dt", "dd") and t in ("dt", "dd")) or (tag in ("td", "th") and t in ("td", "th")) or (t == "head" and tag == "body"):
                    self.close_to(k)
                    break
                if t in scope or (t not in INLINE and t not in PARAGRAPH and t not in UNSEEN):
                    break
        if tag in VOID:
            return
        if tag == "a" and self.links:  # links don't nest
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "a":
                    del self.stack[k]
                    self.links -= 1
                    break
        self.serial += 1
        self.stack.append((tag, self.serial, hint(tag, dict(attrs))))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in INLINE:  # an inline end closes no block
                    if any(s[0] not in INLINE for s in self.stack[k + 1:]):
                        return
                self.close_to(k)
                return

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(re.sub(r"\s+", " ", data))


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return len(a) + len(b) - 2 * k


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out, seen = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        if b.path[:-1] in seen:
            near.add(seen[b.path[:-1]])
        out += [(j, i, NEAR / (1 + distance(blocks[j].path, b.path) / 2)) for j in near]
        seen[b.path[:-1]] = i
    return out


def minimum_cut(gain: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side.  gain > 0: capacity from the source, < 0: to the sink."""
    n = len(gain)
    s, t = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)
    for i, g in enumerate(gain):
        arc(s, i, max(g, 0.0), 0.0)
        arc(i, t, max(-g, 0.0), 0.0)
    for a, b, c in pairs:
        arc(a, b, c, c)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if t not in level:
            return [i in level for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:  # blocking flow, depth first
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, u = [], s
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > 1e-9 and level.get(to[e], -1) == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def extract(html: str | None) -> str:
    """The main text of a page."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    blocks = reader.blocks
    gain = [softplus(b.score) - softplus(-b.score) for b in blocks]  # cost of dropping less cost of keeping
    keep = minimum_cut(gain, edges(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
