"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags. A logistic classifier gives each
block a probability of being content, from its text (length, link share,
punctuation, ...) and from the names of its containers (tags, words of class and
id), which count less the farther out they stand. The probabilities become the
capacities of edges to the two terminals; every block is joined to the next one
by a smoothness edge, and to the next one of the same parent, stronger the nearer
the two stand in the tree. The minimum cut separates content from boilerplate, so
a block can be labelled against its names, by its text or by its neighbours.

What a name means is learned from the pages: on pages with an ``article`` or
``main`` element the blocks inside are examples of content, those outside of
boilerplate, and every example is learned twice, with and without these two
names, so that text and other names can judge pages without such marks. Word
lists are only where the weights start from.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import hash_sample

# Kinds of tags and what class or id words usually mean.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s "
                   "samp small span strike strong sub sup time tt u var br wbr img nobr "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mfenced semantics".split())
DROPPED = frozenset("script style noscript template textarea select option button iframe object svg canvas "
                    "video audio head title input datalist map annotation".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BOILER_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot copyright header masthead banner sidebar aside dialog address "
    "widget related recommended share sharing social ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "promotion popup modal overlay cookie cookies consent gdpr notice alert newsletter subscribe signup login "
    "comment comments reply replies disqus respond pagination pager toolbar toc tags "
    "contentinfo complementary search".split())
MARKS = frozenset("article main".split())
CONTENT_NAMES = MARKS | frozenset("post entry content story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STATES = frozenset("has with without no is show hide".split())      # what follows them is not what the element is
CLOSES_P = re.compile(r"p|div|ul|ol|dl|table|h[1-6]|section|article|blockquote|pre|figure|header|footer|nav|aside|form|hr|main|fieldset|address")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>|[^<]+|<", re.S)
STARTS = re.compile(r"</?[a-zA-Z]")
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
TEXT_FEATURES = 7
SMOOTH = 1.2         # capacity between siblings
FADE = 0.9           # what a name keeps on each level outward
BEYOND = 0.15        # and beyond a container that has a listed name itself
LEVELS = 12          # containers that count
TEXT_LIMIT = 2.0     # most that the text alone says: comments and notices may read like content
CERTAIN = 0.99       # most that the classifier claims
BLOCKS = 100         # blocks of one page that the classifier learns from
SUPPORT = 0.01       # share of the sampled pages that a name must stand on to be learned


def _prior(name: str) -> float:
    """The weight a name starts from."""
    return 3.0 if name in CONTENT_NAMES else -5.0 if name in BOILER_NAMES else -1.0 if name == "form" else -0.5 if name == "li" else 0.0


@dataclass
class Block:
    text: str
    linked: int                  # characters inside links
    names: dict[str, float]      # names of its containers and how much they count
    path: tuple[int, ...]        # numbers of its containers, from the nearest
    inside: int                  # 1 in an article, 0 outside, -1 inside, but under another listed name


@dataclass
class Model:
    text: np.ndarray             # weights of the text features
    names: dict[str, float]      # learned weights; other names have their prior

    def cost(self, b: Block, x: list[float]) -> float:
        """Log odds of being content."""
        said = math.tanh(float(np.dot(self.text, x)) / TEXT_LIMIT) * TEXT_LIMIT
        return said + sum(v * self.names.get(n, _prior(n)) for n, v in b.names.items())


def _names(tag: str, attrs: str) -> dict[str, float] | None:
    """Names of an element; None if it is not shown. In a compound
    (``post-comments``) the last word says what the element is."""
    out = {tag: 1.0} if _prior(tag) or tag in HEADINGS else {}       # p, div, ul, ... say nothing
    for key, value in ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return None
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return None
        elif tag not in ("html", "body") and key in ("class", "id", "role"):
            for compound in value.split():
                ws = re.findall(r"[a-z]+", compound)
                until = next((i for i, w in enumerate(ws) if w in STATES), len(ws))
                for i, w in enumerate(ws[:until]):
                    out[w] = max(out.get(w, 0.0), 1.0 if i == until - 1 else 0.25)
    return out


@dataclass
class _Open:
    tag: str
    number: int
    names: dict[str, float]
    dropped: bool


def _containers(stack: list[_Open]) -> tuple[dict[str, float], tuple[int, ...]]:
    names: dict[str, float] = {}
    scale = 1.0
    near = stack[:-LEVELS - 1:-1]
    for e in near:
        for name, v in e.names.items():
            names[name] = max(names.get(name, 0.0), v * scale)
        scale *= FADE * (BEYOND if any(v == 1 and abs(_prior(n)) >= 3 for n, v in e.names.items()) else 1)
    return names, tuple(e.number for e in near)


def _inside(stack: list[_Open], marks: int) -> int:
    if not marks:
        return 0
    for e in reversed(stack):
        if e.tag in MARKS:
            return 1
        if any(_prior(n) <= -1 for n in e.names):
            return -1
    return 1


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page with text, in page order. Broken markup is tolerated:
    unknown ends are ignored, open elements end with their container. After a
    tag that never ends because of an open quote, quotes are not heeded any
    more, so every page is read in linear time."""
    out: list[Block] = []
    stack = [_Open("", 0, {}, False)]
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = links = number = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text and not stack[-1].dropped:
            names, path = _containers(stack)
            out.append(Block(text, min(linked, len(text)), names, path, _inside(stack, sum(open_tags[m] for m in MARKS))))
        linked = 0

    def push(tag: str, attrs: str) -> None:
        nonlocal number
        number += 1
        names = _names(tag, attrs)
        if tag == "header" and names and any(open_tags[m] for m in MARKS):
            names.pop("header", None)           # the head of the article, not of the page
        open_tags[tag] += 1
        stack.append(_Open(tag, number, names or {}, stack[-1].dropped or tag in DROPPED or names is None))

    def pop(tag: str) -> None:
        if open_tags[tag]:
            while True:
                last = stack.pop().tag
                open_tags[last] -= 1
                if last == tag:
                    return

    page = page or ""
    at, token = 0, TOKEN
    while at < len(page):
        m = token.match(page, at)
        if token is TOKEN and m.group(0) == "<" and STARTS.match(page, at):
            token = LOOSE
            m = token.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            s = m.group(0)
            if not s.startswith(("<!", "<?")):
                parts.append(s)
                if links:
                    linked += len(s)
            continue
        tag, closing, attrs = name.lower(), m.group(1), m.group(3)
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        links = 0
        if closing:
            pop(tag)
            continue
        if CLOSES_P.fullmatch(tag) and stack[-1].tag == "p":
            pop("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            pop(tag)
        if tag in VOID or attrs.endswith("/"):
            continue
        push(tag, attrs)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            pop(tag)
    flush()
    return out


def features(b: Block, i: int, n: int) -> list[float]:
    """What the text of a block says."""
    size = len(b.text)
    ws = b.text.count(" ") + 1
    return [1.0, math.log1p(size), math.log1p(ws), b.linked / size, sum(map(b.text.count, ".,;:!?")) / ws,
            float(b.text[-1] in ".!?"), abs(2 * (i + 0.5) / n - 1)]


def min_cut(source: np.ndarray, sink: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the source side of a minimum cut. ``source`` and
    ``sink`` are terminal capacities, edges are undirected (a, b, capacity).
    Augments along shortest paths, level by level (Dinic)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])        # flows straight through
        if source[i] > both:
            add(s, i, float(source[i] - both), 0.0)
        if sink[i] > both:
            add(i, t, float(sink[i] - both), 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                at[u] += 1
            else:
                if u == s:
                    break
                u = to[path.pop() ^ 1]
                at[u] += 1


def _nearness(a: Block, b: Block) -> float:
    """1 for siblings, less for every further step between two blocks in the tree."""
    up = {e: i for i, e in enumerate(a.path)}
    steps = next((i + up[e] for i, e in enumerate(b.path) if e in up), 2 * LEVELS)
    return FADE ** (2 * max(steps - 2, 0))


def label(bs: list[Block], model: Model) -> np.ndarray:
    """True for the content blocks of one page."""
    if not bs:
        return np.zeros(0, bool)
    n = len(bs)
    cost = np.array([model.cost(b, features(b, i, n)) for i, b in enumerate(bs)])
    p = np.clip(1 / (1 + np.exp(-np.clip(cost, -30, 30))), 1 - CERTAIN, CERTAIN)
    edges = [(i, i + 1, SMOOTH * _nearness(bs[i], bs[i + 1])) for i in range(n - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        parent = b.path[1] if len(b.path) > 1 else -1
        if parent in last and last[parent] < i - 1:        # siblings with something between them
            edges.append((last[parent], i, SMOOTH / 2))
        last[parent] = i
    return min_cut(-np.log(1 - p), -np.log(p), edges)


def extract(page: str | None, model: Model) -> str:
    bs = blocks(page)
    return "\n".join(b.text for b, keep in zip(bs, label(bs, model)) if keep)


TEXT_PRIOR = np.array([-3.0, 0.4, 0.4, -4.0, 2.0, 1.0, -0.5])
PLAIN = Model(TEXT_PRIOR, {})            # where nothing can be learned


def examples(page: str | None) -> list[tuple[float, list[float], dict[str, float]]]:
    """(content or not, text features, names) of the blocks of a page that an
    ``article`` or ``main`` element decides; BLOCKS of them at most, evenly spaced."""
    bs = blocks(page)
    if not any(b.inside == 1 for b in bs):
        return []
    told = [i for i, b in enumerate(bs) if b.inside >= 0]
    step = max(1, -(-len(told) // BLOCKS))
    return [(float(bs[i].inside), features(bs[i], i, len(bs)), bs[i].names) for i in told[::step]]


def train(pages: DataFrame, *, sample: int = 2_000, id_col: str = "page_id", html_col: str = "html") -> Model:
    """The classifier, from about ``sample`` pages, chosen by a hash of the id,
    and at most BLOCKS blocks of each: this bounds what the driver fits. PLAIN
    if no page has both kinds of examples."""
    rows = pages.select(F.col(f"`{html_col}`").alias("h"), F.col(f"`{id_col}`").cast("string").alias("k")).filter("h is not null")
    rows = hash_sample(rows, sample, F.coalesce("k", F.col("h"))).repartition(12, "k")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for page in part["h"]:
                got = [(y, [round(v, 3) for v in x], list(names), list(names.values())) for y, x, names in examples(page)]
                yield pd.DataFrame(got, columns=["y", "x", "names", "vals"])

    got = rows.mapInPandas(run, "y double, x array<double>, names array<string>, vals array<double>").toArrow()
    y = np.asarray(got.column("y"), float)
    if not len(y) or y.min() == y.max():
        return PLAIN
    names = [dict(zip(n, v)) for n, v in zip(got.column("names").to_pylist(), got.column("vals").to_pylist())]
    seen = Counter(n for row in names for n in row)
    vocab = sorted(n for n, k in seen.items() if k >= max(2, SUPPORT * sample / 10) or _prior(n))
    at = {n: TEXT_FEATURES + i for i, n in enumerate(vocab)}
    x = np.zeros((len(y), TEXT_FEATURES + len(vocab)), np.float32)
    x[:, :TEXT_FEATURES] = np.array(got.column("x").to_pylist(), np.float32)
    for i, row in enumerate(names):
        for n, v in row.items():
            if n in at:
                x[i, at[n]] = v
    x = x[np.lexsort((*x.T[::-1], y))]          # the same sums whatever the order of the rows
    y = np.sort(y)
    return _fit(x, y, vocab, [at[n] for n in MARKS if n in at])


def _fit(x: np.ndarray, y: np.ndarray, vocab: list[str], marks: list[int], precision: float = 2.0) -> Model:
    """Newton's method for logistic regression with a normal prior around the
    weights of the lists; both kinds weigh the same, and each row counts once
    with and once without the columns ``marks``."""
    prior = np.r_[TEXT_PRIOR, [_prior(n) for n in vocab]]
    weight = np.where(y > 0, 0.25 / (y > 0).mean(), 0.25 / (y == 0).mean())
    beta = prior.copy()
    for _ in range(50):
        grad = -precision * (beta - prior)
        curve = precision * np.eye(len(beta))
        for lo in range(0, len(y), 10_000):
            for hidden in (False, True):
                part = x[lo:lo + 10_000].astype(float)
                if hidden:
                    part[:, marks] = 0
                p = 1 / (1 + np.exp(-np.clip(part @ beta, -30, 30)))
                w = weight[lo:lo + 10_000]
                grad += part.T @ (w * (y[lo:lo + 10_000] - p))
                curve += part.T @ (part * (w * p * (1 - p))[:, None])
        step = np.linalg.solve(curve, grad)
        beta += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))      # damped: no weight moves by more than two
        if np.abs(step).max() < 1e-6:
            break
    return Model(beta[:TEXT_FEATURES], dict(zip(vocab, map(float, beta[TEXT_FEATURES:]))))


def main_text(pages: DataFrame, model: Model, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``, the main text: white space inside a block is one
    space, blocks are joined by a line feed; empty if there is none (null and
    empty pages too). Text outside every tag counts as a block. Each row is
    judged by itself, so repeated rows have equal texts; very long and very deep
    pages take time in proportion to their length (the LEVELS nearest containers
    of a block count), but for the cut. A column of the same name is replaced,
    other columns pass through."""
    @F.pandas_udf("string")
    def udf(page: pd.Series) -> pd.Series:
        return page.map(lambda p: extract(p, model))

    return pages.withColumn(out, udf(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))
