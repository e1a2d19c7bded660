"""Main text of web pages by minimum-cut labelling of their blocks.

A page falls into blocks: runs of text between block-level tags. A classifier prices the two labels of each block, content
or boilerplate, and the prices become capacities of its edges to the two terminals. Blocks that follow each other, and blocks under
one parent, are joined by smoothness edges, stronger the nearer they are in the tree. The minimum cut is the cheapest
labelling; a maximum flow finds it.

The classifier adds what the enclosing elements are called (tags, class, id, role) and a naive Bayes over the block's shape. Its
counts come from all blocks whose elements are called either way, in all pages, added to the prior counts below.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.llm.batches import small_batches

NAMED, SHAPE = 8.0, 3.0  # price of a name, and the most that a shape can add or take
NEAR, SIBLING = 4.0, 1.0  # smoothness of neighbours, divided by their distance in the tree; and of blocks under one parent
UNIT = 1000  # prices are whole numbers of 1 / UNIT

# Element and attribute names of HTML pages.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("button canvas datalist label map object option select svg template audio video math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu noscript".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner bottom breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies copyright disqus footer form gdpr header legal links login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promotion recommended register related replies reply respond search share sharing "
    "sidebar side signin signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CONTENT = frozenset("article articlebody content entry main post story".split())
LAYOUT = frozenset("has layout no page with without wrap wrapper".split())
CLOSERS = {"li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"])}
SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "li": ("li",)}
PHRASES = ("©", "all rights reserved", "advertisement", "cookie", "copyright", "log in", "newsletter", "privacy policy", "sign in", "sign up", "subscribe")

# Prior counts of (content, boilerplate) blocks per bin of each shape feature.
PRIOR = {
    "words": ((5, 30), (8, 40), (10, 25), (15, 15), (25, 12), (40, 6), (40, 2), (40, 1)),
    "linked": ((160, 60), (20, 10), (5, 10), (3, 15), (2, 60)),
    "sentences": ((40, 120), (50, 25), (40, 5), (60, 3)),
    "kind": ((30, 10), (120, 30), (20, 70), (10, 15), (20, 60)),
    "phrase": ((190, 110), (2, 40)),
}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
START = re.compile(r"</?[a-zA-Z]|<[!?]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``text`` with its text, ``open`` and ``close`` with a lower-case name and the attributes."""
    at, last, size = 0, page.rfind(">"), len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = size if end < 0 else end + 3
            continue
        if lt > last and START.match(page, lt):  # a tag that the page's end cuts off
            return
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        tag = TAG.match(page, lt) if lt < last else None
        if tag is None:
            yield "text", "", "<"
            at = lt + 1
            continue
        name, at = tag[2].lower(), tag.end()
        yield ("close" if tag[1] else "open"), name, tag[3]
        if not tag[1] and name in RAW:
            end = RAW_END[name].search(page, at)
            at = page.find(">", end.start()) + 1 or size if end else size


def names_of(rest: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for name, *values in ATTRIBUTE.findall(rest):
        value = "".join(values)
        if name.lower() in ("class", "id", "role"):
            for part in value.split():
                own = {w.lower() for w in TOKEN.findall(part)}
                words |= own if not own & LAYOUT else own - BOILERPLATE
        elif name.lower() == "hidden" or (name.lower() == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return words, hidden


def verdict(tag: str, rest: str, above: int, parent: str | None) -> int:
    """What the element says of the text in it: 1 content, -1 boilerplate, 0 nothing."""
    if tag in ("html", "body"):
        return above
    words, hidden = names_of(rest) if rest else (set(), False)
    if hidden or tag in BOILERPLATE_TAGS:
        return -1
    if tag == "header" or "header" in words:
        words = words - {"header"}
        above = above if above > 0 else -1
        return -1 if words & BOILERPLATE else above
    if words & BOILERPLATE:
        return -1
    if tag == "main" or "main" in words or (tag == "article" and (above >= 0 or parent == "form")):
        return 1
    return 1 if words & CONTENT and above >= 0 else above


class Block:
    __slots__ = ("text", "linked", "kind", "named", "distance", "sibling")

    def __init__(self, text: str, linked: int, kind: str, named: int, distance: int, sibling: int):
        self.text, self.linked, self.kind, self.named = text, linked, kind, named
        self.distance = distance  # steps through the tree from the block before
        self.sibling = sibling  # the block before it under the same parent, or -1

    def bins(self) -> dict[str, int]:
        words = self.text.count(" ") + 1
        letters = len(self.text)
        share = self.linked / letters
        stops = sum(map(self.text.count, ".!?…"))
        lower = self.text.lower() if words < 40 else ""
        return {
            "words": min(int(math.log2(words)), 7),
            "linked": 0 if share == 0 else 1 if share <= 0.25 else 2 if share <= 0.5 else 3 if share <= 0.9 else 4,
            "sentences": min(stops, 3),
            "kind": 0 if self.kind in HEADINGS else 1 if self.kind in ("p", "pre", "blockquote") else 2 if self.kind == "li" else 3 if self.kind in ("td", "th", "dd", "dt") else 4,
            "phrase": int(any(p in lower for p in PHRASES)),
        }


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; scripts, styles, comments, titles and controls are none."""
    found: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, verdict, number
    open_tags: Counter = Counter()
    last_under: dict[int, int] = {}
    parts: list[str] = []
    linked, link_depth, drop, number = 0, 0, [], 0
    depth, low = 1, 1  # of the block before; least since then

    def close_block():
        nonlocal linked, depth, low
        text = " ".join("".join(parts).split())
        if text:
            tag, named, own = stack[-1]
            parent = stack[-2][2] if tag in LEAF else own
            distance = max(1, depth + len(stack) - 2 * low)
            found.append(Block(text, min(linked, len(text)), tag, named, distance, last_under.get(parent, -1)))
            last_under[parent] = len(found) - 1
            depth = low = len(stack)
        parts.clear()
        linked = 0

    def pop():
        nonlocal low, link_depth
        open_tags[stack.pop()[0]] -= 1
        low = min(low, len(stack))
        if link_depth > len(stack):
            link_depth = 0

    for kind, name, rest in tokens(page or ""):
        if drop:
            if kind == "open" and name == drop[-1] and name not in VOID and not rest.endswith("/"):
                drop.append(name)
            elif kind == "close" and name == drop[-1]:
                drop.pop()
            elif name in ("body", "html") or (kind == "close" and name in BLOCK and open_tags[name]):
                drop.clear()  # an element that was never closed
            if drop or name in DROPPED:
                continue
        if kind == "text":
            text = entities.unescape(rest) if "&" in rest else rest
            parts.append(text)
            if link_depth:
                linked += len(" ".join(text.split()))
        elif name == "a":
            link_depth = len(stack) if kind == "open" else 0
        elif name == "br":
            parts.append(" ")
        elif name in DROPPED:
            if kind == "open" and not rest.endswith("/"):
                drop.append(name)
        elif name in BLOCK:
            close_block()
            if kind == "open":
                if stack[-1][0] == "p":
                    pop()
                if name in SAME and any(open_tags[s] for s in SAME[name]):
                    at = len(stack) - 1
                    while stack[at][0] not in SAME[name] and stack[at][0] not in CLOSERS[name] and at:
                        at -= 1
                    while stack[at][0] in SAME[name] and len(stack) > at:
                        pop()
                if name != "hr":
                    number += 1
                    stack.append((name, verdict(name, rest, stack[-1][1], stack[-1][0]), number))
                    open_tags[name] += 1
            elif open_tags[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
    close_block()
    return found


def prices(counts: dict[tuple[str, int, int], int]) -> dict[str, list[float]]:
    """Log odds of content per bin of each shape feature, from counts by (feature, bin, label) and the prior ones."""
    out = {}
    for name, prior in PRIOR.items():
        both = [[p[label] + counts.get((name, i, label), 0) for i, p in enumerate(prior)] for label in (0, 1)]
        out[name] = [math.log(a / sum(both[0])) - math.log(b / sum(both[1])) for a, b in zip(*both, strict=True)]
    return out


def gain(block: Block, odds: dict[str, list[float]]) -> float:
    """What the label content saves over boilerplate. The features are not independent, so their sum counts half."""
    shape = sum(odds[name][i] for name, i in block.bins().items()) / 2
    return block.named * NAMED + max(-SHAPE, min(SHAPE, shape))


def min_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves on the source's side, the most that one can leave.

    A node of positive gain hangs on the source, of negative gain on the sink; ``edges`` join two nodes both ways. The flow
    is sent along shortest paths, level graph by level graph.
    """
    n = len(gains)
    source, sink = n, n + 1
    at: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(u, v, there, back):
        at[u].append(len(to))
        at[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for i, g in enumerate(gains):
        if g > 0:
            edge(source, i, g, 0)
        elif g < 0:
            edge(i, sink, -g, 0)
    for u, v, c in edges:
        edge(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], line = 0, [source]
        for u in line:
            for e in at[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    line.append(to[e])
        if level[sink] < 0:
            break
        tried, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if not room[e])
                u = to[path[full] ^ 1]
                del path[full:]
            while tried[u] < len(at[u]):
                e = at[u][tried[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            else:
                if u == source:
                    break
                u = to[path.pop() ^ 1]
                tried[u] += 1
                continue
            path.append(e)
            u = to[e]
    reaches = [False] * (n + 2)
    reaches[sink], line = True, [sink]
    for v in line:
        for e in at[v]:
            if room[e ^ 1] > 0 and not reaches[to[e]]:
                reaches[to[e]] = True
                line.append(to[e])
    return [not r for r in reaches[:n]]


def main_text(page: str | None, odds: dict[str, list[float]]) -> str:
    """The content blocks of the page, joined by a space."""
    found = blocks(page)
    gains = [round(UNIT * gain(b, odds)) for b in found]
    edges = [(i - 1, i, round(UNIT * NEAR / b.distance)) for i, b in enumerate(found) if i]
    edges += [(b.sibling, i, round(UNIT * SIBLING)) for i, b in enumerate(found) if 0 <= b.sibling < i - 1]
    return " ".join(b.text for b, content in zip(found, min_cut(gains, edges), strict=True) if content)


def fitted(pages: DataFrame) -> dict[str, list[float]]:
    """The shape prices, learned from all blocks of all ``pages`` (html) that are named content or boilerplate.

    Tasks count, Spark adds; two counts per bin reach the driver. Without such blocks the prior counts stand.
    """

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for b in blocks(page):
                    if b.named:
                        counts.update((name, i, int(b.named < 0)) for name, i in b.bins().items())
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["feature", "bin", "label", "n"],
        )

    small_batches(pages.sparkSession)
    counted = pages.select("html").mapInArrow(run, "feature string, bin int, label int, n long")
    rows = counted.groupBy("feature", "bin", "label").agg(F.sum("n").alias("n")).collect()
    return prices({(r.feature, r.bin, r.label): r.n for r in rows})


def extracted(pages: DataFrame, odds: dict[str, list[float]]) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, from its whole html.

    Character references are decoded, white space within a block is one space, blocks follow in page order. A null or empty
    page, and one without content blocks, has the empty text. Repeated rows and null ids or urls are rows like others; broken
    markup is read as far as it goes; further columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page, odds) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    small_batches(pages.sparkSession)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"]]).add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
