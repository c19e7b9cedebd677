"""Main text of HTML pages by minimum-cut labelling.

A page becomes text blocks in page order. A linear classifier's score is a
block's capacity to the source (content) or to the sink (boilerplate);
neighbours in the page and in the DOM are joined by smoothness edges that weigh
less the farther apart they are, and little where the page itself declares them
to be of different kinds. The minimum cut, found by maximum flow, labels all
blocks of a page at once. Pages are independent, so nothing is shuffled.

What elements and their names declare has fixed weights. The weights of a block's
text and form are fitted (``fit_weights``): in about ``sample_pages`` pages, chosen
by the hash of id and html, blocks within content elements are examples of content,
those within boilerplate elements of boilerplate, and a logistic regression moves
the weights from their prior values. A corpus without such elements keeps these.

Defined cases: a null or empty html, or a page without content, has the empty
text; null ids and urls are passed through; repeated rows each get a row; empty
tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: Elements whose text is never shown as text.
RAW = frozenset("script style noscript template iframe object svg math textarea select option button canvas audio video head title datalist".split())
#: Of these, those that hold anything but their end tag as characters.
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th nav header footer aside form fieldset legend blockquote pre figure figcaption address details summary dialog menu hr center hgroup search".split())
VOID = frozenset("hr".split())
#: Elements that a start tag of the key ends, up to the nearest list, table or section.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset search".split())
CONTENT = frozenset("article main".split())
WORDS = re.compile(
    r"(?:\b|_)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|footer\w*|header\w*|masthead|topbar|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|alert|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|comments?|comment\w*|disqus|respond|replies|widgets?|popup|modal|overlay|paywall|login|signup|signin|pagination|pager|toc|skip|legal|copyright|contentinfo|navigation|complementary|search)(?:\b|_)",
    re.IGNORECASE,
)
GOOD_WORDS = re.compile(r"(?:\b|_)(?:article\w*|post(?:-?(?:content|body|text))?|entry(?:-?content)?|content|story|main|body-?text|articlebody)(?:\b|_)", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…]['\"»)”]?(?:\s|$)")

#: Log-odds of content that the page declares: a boilerplate element or name around
#: the block, a content element or name around it.
DECLARED = (-9.0, -8.0, 4.0, 1.5)
#: Prior log-odds by text and form: constant, share of link text, length, sentence,
#: heading, paragraph, item of a list or table.
PRIOR = (-1.0, -4.0, 1.5, 0.8, 0.4, 0.8, -0.4)
#: Standard deviation of the prior. Pages of a corpus share templates, so the sample
#: counts as so many independent blocks of each label only, however large it is.
PRIOR_SD, EVIDENCE = 1.0, 100.0
SAMPLE_PAGES = 2000
#: Weight of an edge between neighbours in the page, and between siblings; share of
#: it that is left where the declarations around the two differ.
SMOOTH_PAGE, SMOOTH_DOM, CONTRAST = 2.4, 1.0, 0.1


class Block(NamedTuple):
    text: str
    parent: int  # number of the element around the block's own
    climb: int  # steps in the DOM from the block before
    declared: tuple[bool, bool, bool, bool]
    form: tuple[float, ...]


class Element(NamedTuple):
    tag: str
    number: int
    declared: tuple[bool, bool, bool, bool]  # by itself or an element around it


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, each with its features."""
    out: list[Block] = []
    stack = [Element("", 0, (False, False, False, False))]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = plain = links = number = 0
    # depth of the last block, and the least depth since
    before = least = 1
    at, end = 0, len(page)

    def cut(k: int) -> None:
        nonlocal least
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]
        least = min(least, k)

    def close() -> None:
        nonlocal linked, plain, before, least
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                depth, own = len(stack), stack[-1]
                form = _form(text, own.tag, linked / max(1, linked + plain))
                out.append(Block(text, stack[-2].number if depth > 1 else 0, before + depth - 2 * least, own.declared, form))
                before = least = depth
        linked = plain = 0

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            if links:
                linked += len(piece)
            else:
                plain += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                at = _after(page, at, name)
            pieces.append(" ")
        elif name in BLOCK:
            close()
            links = 0
            if closing:
                if opened[name]:
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS.get(name, ()):
                    cut(k)
                elif stack[k].tag not in ("p",):
                    break
            if name in VOID or attributes.endswith("/"):
                continue
            number += 1
            opened[name] += 1
            around = stack[-1].declared
            stack.append(Element(name, number, tuple(x or y for x, y in zip(around, _declared(name, attributes)))))
    close()
    return out


def _after(page: str, at: int, name: str) -> int:
    """The place after the end tag of a raw element; for others than text-only
    ones, nested elements of the same name are counted."""
    pattern, depth = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.IGNORECASE), 1
    for m in pattern.finditer(page, at):
        depth += -1 if m[1] else (name not in RAW_TEXT)
        if not depth:
            return m.end()
    if name == "head":
        m = re.compile(r"<body", re.IGNORECASE).search(page, at)
        return m.start() if m else len(page)
    return len(page) if name in RAW_TEXT else at


def _declared(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is of boilerplate, is named so, is of content, is named so."""
    said = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)) if attributes and name not in ("html", "body") else ""
    bad = bool(said and WORDS.search(said))
    return name in BOILERPLATE, bad, name in CONTENT, bool(said and not bad and GOOD_WORDS.search(said))


def _form(text: str, tag: str, link_share: float) -> tuple[float, ...]:
    """Features of a block's text and form, in the order of ``PRIOR``."""
    return (
        1.0,
        link_share,
        min(1.0, len(text) / 120.0),
        1.0 if SENTENCE.search(text) else 0.0,
        1.0 if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0,
        1.0 if tag in ("p", "blockquote", "pre") else 0.0,
        1.0 if tag in ("li", "td", "th", "dd", "dt") else 0.0,
    )


def score_of(block: Block, weights: tuple[float, ...] = PRIOR) -> float:
    """Log-odds that a block is content. Of boilerplate declared twice the stronger counts."""
    element, name, content, good = block.declared
    bad = min(DECLARED[0] * element, DECLARED[1] * name)
    return bad + DECLARED[2] * content + DECLARED[3] * good + sum(w * x for w, x in zip(weights, block.form))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours in the page, by their distance in the
    DOM, and between each block and the next of the same parent."""
    out, last = [], {}

    def add(i: int, j: int, w: float) -> None:
        out.append((i, j, w if blocks[i].declared[:3] == blocks[j].declared[:3] else w * CONTRAST))

    for i, b in enumerate(blocks):
        if i:
            add(i - 1, i, SMOOTH_PAGE / (1.0 + b.climb))
        if last.get(b.parent, i) < i - 1:
            add(last[b.parent], i, SMOOTH_DOM)
        last[b.parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. ``scores``:
    capacity from the source where positive, else to the sink; edges go both ways."""
    n = len(scores)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        left.append(there)
        graph[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, s in enumerate(scores):
        add(*((source, i, s, 0.0) if s > 0 else (i, sink, -s, 0.0)))
    for a, b, w in edges:
        # between two nodes that pull the same way an edge still passes flow on
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nexts = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if left[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nexts[a] < len(graph[a]):
                e = graph[a][nexts[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nexts[a] += 1
            if nexts[a] < len(graph[a]):
                path.append(graph[a][nexts[a]])
                a = to[path[-1]]
            elif path:
                nexts[to[path[-1] ^ 1]] += 1
                a = to[path.pop() ^ 1]
            else:
                break


def examples_of(page: str) -> Iterator[tuple[tuple[float, ...], bool]]:
    """Features and label of the blocks that the page's elements label: within a
    boilerplate element, or within a content element and nothing of boilerplate."""
    for b in blocks_of(page):
        element, name, content, _ = b.declared
        if element or (content and not name):
            yield b.form, not element


def fit_weights(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights of text and form, fitted on about ``sample_pages`` pages. Tasks sum up
    the examples by features rounded to eighths, each page with the same weight, so
    the driver gets at most one row for each possible combination."""
    n = pages.count()
    share = min(1.0, sample_pages / max(n, 1))
    hashed = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col, html_col).alias("hash")).where("html is not null")
    chosen = hashed.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30))).select("html")
    names = [f"x{k}" for k in range(len(PRIOR))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: Counter[tuple] = Counter()
            for page in batch["html"]:
                found = Counter((*(int(8 * x) for x in form), int(label)) for form, label in examples_of(page))
                for key, times in found.items():
                    sums[key] += times / found.total()
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=[*names, "label", "weight"])

    sums = chosen.mapInPandas(run, ", ".join(f"{x} int" for x in [*names, "label"]) + ", weight double")
    rows = sums.groupBy(*names, "label").agg(F.sum("weight").alias("weight")).orderBy(*names, "label").collect()
    return _posterior(np.array([list(r)[:-2] for r in rows]) / 8.0, np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])) if rows else PRIOR


def _posterior(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Most likely weights of a logistic regression under the prior, by Newton's steps."""
    prior = np.array(PRIOR)
    of = [weight[label == k].sum() for k in (0, 1)]
    if not min(of) > 0:
        return PRIOR
    weight = weight * EVIDENCE / np.where(label == 1, of[1], of[0])
    w = prior.copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        slope = x.T @ (weight * (label - p)) - (w - prior) / PRIOR_SD**2
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / PRIOR_SD**2
        step = np.linalg.solve(bend, slope)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in np.round(w, 6))


def labelled(page: str, weights: tuple[float, ...] = PRIOR) -> list[tuple[str, bool]]:
    """The blocks of a page, and whether each is content."""
    blocks = blocks_of(page)
    return list(zip([b.text for b in blocks], minimum_cut([score_of(b, weights) for b in blocks], edges_of(blocks))))


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    return " ".join(text for text, content in labelled(page, weights) if content) if page else ""


def extract_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    small_batches(spark, 500)
    weights = fit_weights(spark, pages, id_col, html_col, sample_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x if isinstance(x, str) else None, weights) for x in batch["html"]]
            yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.selectExpr(f"cast({id_col} as string) as key", f"{url_col} as url", f"{html_col} as html")
    out = rows.mapInPandas(run, "key string, url string, text string, n_chars bigint")
    kind = pages.schema[id_col].dataType.simpleString()
    return out.selectExpr(f"cast(key as {kind}) as {id_col}", f"url as {url_col}", "text", "n_chars")
