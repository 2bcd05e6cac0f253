"""The main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A linear classifier, trained on blocks that
pages mark up themselves (``article`` against ``nav`` and the like) but not
looking at that mark-up, gives each block a bounded log-odds of being content.
What elements and class names say is bounded evidence besides, which classifier
and edges together can overturn; a name around most of a page says little, and none
from outside an article says anything of the article.  The sum is the block's capacity to the source or the
sink.  Neighbouring blocks, and blocks of one parent or grandparent, are tied by
smoothness edges.  The minimum cut labels all blocks of a page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages that the classifier is trained on, and blocks of them, at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 60_000
#: Smoothness of neighbours in the page, of consecutive blocks of one parent and of one grandparent, and of a block and the last one whose parent is its grandparent.
ADJACENT, SIBLING, COUSIN, UNCLE = 0.6, 0.6, 0.3, 0.25
#: Bounds of the classifier's log-odds, and log-odds that mark-up adds: less than classifier and edges come to.
TRUST = 3.0
BOILERPLATE_TAG, BOILERPLATE_NAME, CONTENT_TAG, CONTENT_NAME = -4.0, -4.0, 2.0, 1.0

#: Names of HTML elements by their part in a page, and words of class, id and role names.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head title script style noscript template iframe object svg math canvas audio video select option datalist button textarea input".split())
RAW = set("script style textarea title noscript iframe template".split())
BOILERPLATE_TAGS = set("nav aside footer form dialog menu".split())
CONTENT_TAGS = set("article main".split())
CLOSES_SELF = set("li dt dd tr td th p option".split())
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar rail aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond reply replies disqus discussion pagination pager toolbar copyright legal disclaimer skip search contentinfo complementary".split()
)
CONTENT_NAMES = set("article content main post entry story text body".split())
#: Part of an article where its own name stands beside it, as in "entry-header".
PARTS, OWNERS = set("header masthead".split()), set("article post entry story content".split())
#: Words after which a name tells of a layout, not of the element: "with-sidebar".
LAYOUT = set("with no has without".split())

FEATURES = ("one", "log_chars", "link_share", "stops", "word_length", "digits", "capitals", "heading", "item", "paragraph", "middle")
#: Used where pages mark nothing up: what training on marked-up pages usually gives, in round figures.
DEFAULT_WEIGHTS = np.array([-4.0, 1.0, -4.0, 3.0, 0.0, -1.0, -1.0, 1.0, -1.5, 1.0, 1.0])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """A block: its text, characters of it in links, element, parent and grandparent, and what the mark-up says of it.

    ``zone`` is the innermost element that says anything, ``names`` the elements
    around it whose names tell of boilerplate, ``hint`` the evidence in log-odds,
    ``marked`` 1 or -1 if elements (not names) show a side.
    """

    __slots__ = ("text", "linked", "tag", "parent", "grandparent", "zone", "names", "hint", "marked")

    def __init__(self, text, linked, tag, parent, grandparent, zone, names, hint, marked):
        self.text, self.linked, self.tag, self.parent, self.grandparent = text, linked, tag, parent, grandparent
        self.zone, self.names, self.hint, self.marked = zone, names, hint, marked


class _Open:
    """An open element, with what it has from those around it."""

    __slots__ = ("tag", "number", "dropped", "linked", "bad", "names", "good", "zone")

    def __init__(self, tag, number, dropped, linked, bad, names, good, zone):
        self.tag, self.number, self.dropped, self.linked, self.bad, self.names, self.good, self.zone = tag, number, dropped, linked, bad, names, good, zone


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role tell of boilerplate, and whether of content."""
    bad = good = False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORDS.findall(name)
            words = set(words[: next((i for i, w in enumerate(words) if w in LAYOUT), len(words))])
            telling = words & BOILERPLATE_NAMES
            if telling <= PARTS and not words.isdisjoint(OWNERS):
                telling = set()
            bad |= bool(telling)
            good |= not telling and not words.isdisjoint(CONTENT_NAMES)
    return bad, good


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in order, with character references decoded and white space made single spaces."""
    found: list[Block] = []
    stack = [_Open("", 0, False, False, "", (), 0.0, 0)]
    parts: list[str] = []
    linked = at = number = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = next(x for x in reversed(stack) if x.tag in BLOCKS or not x.tag)
                # 0 is the page itself, -1 what is around it
                chain = [-1, -1, 0, *[x.number for x in stack if x.tag in BLOCKS and x.tag not in ("html", "body")]]
                parent, grand = chain[-2], chain[-3]
                marked = -1 if top.bad else 1 if top.good >= CONTENT_TAG and not top.names else 0
                hint = BOILERPLATE_TAG if top.bad else 0.0 if top.names else top.good
                found.append(Block(text, min(linked, len(text)), top.tag, parent, grand, top.zone, top.names, hint, marked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].dropped:
            parts.append(text)
            if stack[-1].linked:
                linked += len(text.strip())

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag == "br" or tag == "wbr":
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" or (tag in CLOSES_SELF and stack[-1].tag == tag):
                stack.pop()
        if tag in VOID:
            continue
        number += 1
        top = stack[-1]
        bad, good = _named(attributes) if attributes and tag not in ("html", "body") else (False, False)
        dropped = top.dropped or tag in DROPPED or bool(attributes and _HIDDEN.search(attributes))
        within = top.good >= CONTENT_TAG and not top.bad and not top.names
        entry = _Open(tag, number, dropped, top.linked or tag == "a", top.bad, top.names, top.good, top.zone)
        if tag in CONTENT_TAGS and not bad and top.bad in ("", "form"):
            entry.bad, entry.names, entry.good, entry.zone = "", (), CONTENT_TAG, number
        elif tag in BOILERPLATE_TAGS or (tag == "header" and not within):
            entry.bad, entry.zone = top.bad if top.bad not in ("", "form") else tag, number
        elif bad:
            entry.names, entry.zone = (*top.names, number), number
        elif good and not top.good:
            entry.good, entry.zone = CONTENT_NAME, number
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.append(entry)
    flush()
    total, inside = sum(len(b.text) for b in found), {}
    for b in found:
        for e in b.names:
            inside[e] = inside.get(e, 0) + len(b.text)
    for b in found:
        if b.names:
            b.hint = min(b.hint, BOILERPLATE_NAME * max(min(1.0, 2 - 2 * inside[e] / total) for e in b.names))
    return found


def features(blocks: list[Block]) -> np.ndarray:
    rows, last = [], max(1, len(blocks) - 1)
    for i, b in enumerate(blocks):
        t = b.text
        n, split = len(t), t.split(" ")
        words = len(split)
        stops = sum(t.count(c) for c in ".,;:!?")
        digits = sum(t.count(c) for c in "0123456789")
        capitals = sum(w[:1].isupper() for w in split) / words
        rows.append((1.0, math.log1p(n), b.linked / n, min(1.0, 5 * stops / n), math.log1p(n / words), digits / n, capitals, len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(), b.tag == "li", b.tag == "p", 1 - abs(2 * i / last - 1)))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[str, int], int] = {}

    def tie(i: int, j: int, weight: float) -> None:
        edges[i, j] = edges.get((i, j), 0.0) + weight

    for i, b in enumerate(blocks):
        if i:
            tie(i - 1, i, ADJACENT)
        # siblings, cousins, and a parent's sibling either way, but what lies in the page itself isn't near for that
        for kind, key, weight in (("p", b.parent, SIBLING), ("g", b.grandparent, COUSIN), ("p", b.grandparent, UNCLE), ("g", b.parent, UNCLE)):
            before = last.get((kind, key))
            if before is not None and (key > 0 or weight != UNCLE):
                tie(before, i, weight)
        last["p", b.parent] = last["g", b.grandparent] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling of least cost: a node against its odds costs their size, an edge between unlike nodes its weight; of equally cheap ones that with the fewest True."""
    n, odds = len(odds), list(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    # a node whose odds outweigh all its edges has its label; its edges become odds of its neighbours
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(around[i].values()):
            label[i] = odds[i] > 0
            for j, w in around[i].items():
                odds[j] += w if label[i] else -w
                del around[j][i]
                todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _source_side(rest, odds, around)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _source_side(nodes: list[int], odds: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut, by Dinic's maximum flow."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if odds[i] > 0:
            room[source][i], room[i][source] = odds[i], 0.0
        elif odds[i] < 0:
            room[i][sink], room[sink][i] = -odds[i], 0.0
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in nodes if i in level}
        onward = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for v in onward[u]:
                if room[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    # a node may be passed again by another way, so the step isn't used up
                    break
            else:
                path.pop()
                level[u] = -1


def odds_of(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """Log-odds of content: the classifier's within its bounds, and the mark-up's evidence."""
    return [o + b.hint for o, b in zip(np.clip(features(blocks) @ weights, -TRUST, TRUST).tolist(), blocks, strict=True)]


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    keep = minimum_cut(odds_of(blocks, weights), edges_of(blocks)) if blocks else []
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def fit(pages: DataFrame, markup: str = "html") -> np.ndarray:
    """Classifier weights from the SAMPLE_PAGES pages with the smallest hash, and at most SAMPLE_BLOCKS of their blocks.

    DEFAULT_WEIGHTS itself, the same object, if they don't mark up blocks of both sides.
    """
    few = pages.where(F.col(markup).isNotNull()).select(F.xxhash64(markup).alias("h"), F.col(markup).alias("html"))
    rows = few.join(F.broadcast(few.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES)), "h", "left_semi").dropDuplicates(["h"]).select("html")

    def describe(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page)
                marked = np.array([b.marked for b in blocks], np.int32)
                x = features(blocks)[marked != 0]
                yield pa.RecordBatch.from_arrays([pa.array(marked[marked != 0]), *(pa.array(c) for c in x.T)], ["marked", *FEATURES])

    got = rows.mapInArrow(describe, "marked int, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy(F.xxhash64(*FEATURES)).limit(SAMPLE_BLOCKS).toArrow()
    y = (got.column(0).to_numpy() > 0).astype(np.float64)
    if not 0 < y.sum() < len(y):
        return DEFAULT_WEIGHTS
    return train(np.column_stack([got.column(f).to_numpy() for f in FEATURES]), y)


def extract(pages: DataFrame, weights: np.ndarray, markup: str = "html") -> DataFrame:
    """``pages`` without ``markup`` and with ``text`` and ``n_chars``.

    Blocks are joined by two line ends.  A null or empty page, or one without
    content, has an empty text.  Repeated rows are extracted alike; earlier
    columns named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars") if markup not in ("text", "n_chars") else pages
    kept = [c for c in pages.columns if c != markup]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches):
        for batch in batches:
            texts = [main_text(page or "", weights) for page in batch.column(batch.schema.names.index(markup)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.mapInArrow(apply, schema)
