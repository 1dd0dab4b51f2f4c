"""Main text of web pages: the marginals of a tree-structured graphical model over the DOM.

A page becomes a tree of block elements whose leaves are runs of text. Each node is content (1) or not (0); an element is
content if some text below it is. A node's own features give its potential, the kind of a child gives the potential of
its edge. Sum-product messages upward and downward give exact marginals; the weights maximise the likelihood of
labelled pages, by the same messages.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from callquality.llm.common import row_blocks

#: Elements of HTML by how they break text, and what is no text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noframes noembed xmp".split())
DROPPED = set("svg math object canvas audio video select button datalist".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol p pre search section summary table ul".split())
#: A start tag ends the nearest open one of these, unless one of the others is nearer.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Kinds of nodes; a tag that is in none is "other".
KINDS = {
    "text": "", "root": "html body", "article": "article main", "section": "section", "div": "div center td", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dd dt",
    "quote": "blockquote pre figure figcaption table tr th tbody thead tfoot caption address details summary", "nav": "nav", "aside": "aside dialog", "header": "header", "footer": "footer", "form": "form fieldset legend",
}
_KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
OTHER = len(KINDS)
HEADING, LIST = list(KINDS).index("heading"), list(KINDS).index("list")

#: What words in class, id and role hint at.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar tabs toc skip sitemap", "header": "header masthead logo branding top kopfzeile", "footer": "footer foot copyright legal colophon bottom contentinfo imprint impressum pie pied",
    "side": "sidebar side aside rail widget complementary related recommended more popular trending teaser teasers seitenleiste", "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast disclaimer paywall hinweis aviso avis banner",
    "advert": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted anzeige werbung publicite publicidad anuncio", "form": "form login signin signup subscribe subscription newsletter search register contact suche",
    "comments": "comment comments commentlist reply replies respond discussion disqus thread feedback responses kommentar kommentare commentaire commentaires comentario comentarios", "share": "share sharing social follow facebook twitter tools print like likes",
    "meta": "meta byline author date timestamp tags tag category categories credit", "hidden": "hidden hide invisible offscreen collapsed", "content": "article content main post entry story body text page hentry inhalt contenu contenido",
}
_HINT = {word: 1 << k for k, line in enumerate(HINTS.values()) for word in line.split()}

_TAG = re.compile(r"""<!--(?:-?>|.*?--!?>|.*)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?|<[A-Za-z][^>]*\Z""", re.S)
_SHUT = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW | DROPPED}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|data-fit)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+")


def _hints(attributes: str, known: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Bits of what an element's attributes hint at, and its label for fitting: 1, 0, or -1 where it names none."""
    got = known.get(attributes)
    if got is None:
        bits, label = 0, -1
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bits |= _HINT["hidden"]
            elif name == "data-fit":
                label = int(value != "0")
            elif name != "style":
                for word in _WORDS.findall(value):
                    bits |= _HINT.get(word.lower(), 0)
        if len(known) > 50_000:
            known.clear()
        got = known[attributes] = (bits, label)
    return got


@dataclass
class Pages:
    """Trees of several pages, nodes in page order (a parent before its children): arrays by node, and the runs of text."""

    page: list[int]
    parent: list[int]
    kind: list[int]
    bits: list[int]
    depth: list[int]
    label: list[int]
    end: list[int]
    text: list[str]
    links: list[int]


def parse_pages(htmls: Sequence[str | None]) -> Pages:
    """The block trees of pages, with runs of text as leaves. Broken markup is read as it comes: what is open at the end
    is closed, an end tag that fits nothing is ignored, a new paragraph, item, row or cell ends the one before."""
    out, known = Pages([], [], [], [], [], [], [], [], []), {}
    for k, html in enumerate(htmls):
        _parse(k, html or "", out, known)
    return out


def _parse(page: int, html: str, out: Pages, known: dict) -> None:
    def node(parent, kind, bits, depth, label, text, links):
        out.page.append(page)
        out.parent.append(parent)
        out.kind.append(kind)
        out.bits.append(bits)
        out.depth.append(depth)
        out.label.append(label)
        out.end.append(len(out.page))
        out.text.append(text)
        out.links.append(links)
        return len(out.page) - 1

    root = node(-1, 1, 0, 0, 0, "", 0)
    stack, nodes, labels = ["#root"], [root], [0]
    run: list[str] = []
    linked: list[str] = []
    anchor = 0  # size of the stack where a link was opened

    def flush():
        text = " ".join(unescape("".join(run)).split())
        if text:
            node(nodes[-1], 0, 0, len(stack), labels[-1], text, min(len(text), len(" ".join(unescape("".join(linked)).split()))) if linked else 0)
        run.clear()
        linked.clear()

    def close(size):
        nonlocal anchor
        while len(stack) > size:
            out.end[nodes[-1]] = len(out.page)
            stack.pop()
            nodes.pop()
            labels.pop()
        if anchor > size:
            anchor = 0

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if (start := m.start() if m else n) > at:
            run.append(html[at:start])
            if anchor:
                linked.append(run[-1])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        ending, attributes = html.startswith("</", start), m[3] or m[5] or ""
        if tag in INLINE:
            if tag == "a":
                anchor = 0 if ending else len(stack)
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            if tag == "br":
                run.append(" ")
            continue
        if tag in RAW or tag in DROPPED:
            if not ending and not attributes.endswith("/"):
                shut = _SHUT[tag].search(html, at)
                at = shut.end() if shut else n if tag in RAW else at
            continue
        if run:
            flush()
        if ending:
            if tag in VOID:
                continue
            if tag == "p":
                if stack[-1] == "p":
                    close(len(stack) - 1)
            elif tag in stack and tag not in ("html", "body"):
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in CLOSES_P and stack[-1] == "p":
            close(len(stack) - 1)
        if tag in VOID or tag in ("html", "body", "head") and tag in stack:
            continue
        if tag == "body" and "head" in stack:
            close(stack.index("head"))
        if tag in ENDS:
            same, others = ENDS[tag]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d] in same:
                    close(d)
                    break
                if stack[d] in others:
                    break
        kind = _KIND.get(tag, OTHER)
        if kind == HEADING and _KIND.get(stack[-1]) == HEADING:
            close(len(stack) - 1)
        bits, label = _hints(attributes, known) if attributes else (0, -1)
        label = labels[-1] if label < 0 else label
        nodes.append(node(nodes[-1], kind, bits, len(stack), label, "", 0))
        stack.append(tag)
        labels.append(label)
    if run:
        flush()
    close(0)


# Features: a row a node.

_MARKS = str.maketrans("", "", ".,;:!?¡¿…")
FEATURES = [
    "bias", *[f"kind {k}" for k in (*KINDS, "other")], *[f"hint {k}" for k in HINTS], "size", "size of text", "link share", "marks", "short text", "long text", "words a text", "links", "share of page", "begins", "ends", "deep", "copyright", "ends in a mark", "boilerplate hint and no content hint", "more than half linked",
]


def features(pages: Pages) -> np.ndarray:
    """Features of all nodes; those of an element are sums over the text below it."""
    n = len(pages.page)
    if not n:
        return np.zeros((0, len(FEATURES)))
    kind, bits, end, page = np.array(pages.kind), np.array(pages.bits), np.array(pages.end), np.array(pages.page)
    chars = np.fromiter(map(len, pages.text), np.int64, n)
    leaf = chars > 0
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in pages.text), np.int64, n)
    marks = chars - np.fromiter((len(t.translate(_MARKS)) for t in pages.text), np.int64, n)
    rights = np.fromiter(("©" in t or "(c)" in t for t in pages.text), np.int64, n)
    links = np.array(pages.links)

    def below(x):
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[:n]

    size, linked, texts = below(chars), below(links), below(leaf)
    first = np.concatenate([[True], page[1:] != page[:-1]])
    whole = np.repeat(size[first], np.diff(np.concatenate([np.flatnonzero(first), [n]])))
    start = np.concatenate([[0], np.cumsum(chars)])
    base = np.repeat(start[:n][first], np.diff(np.concatenate([np.flatnonzero(first), [n]])))
    whole, some = np.maximum(whole, 1), np.maximum(size, 1)
    hints = (bits[:, None] >> np.arange(len(HINTS))) & 1
    content = hints[:, list(HINTS).index("content")]
    share = linked / some
    columns = [
        np.ones(n), *(kind == k for k in range(OTHER + 1)), *hints.T, np.log1p(size) / 8, leaf * np.log1p(size) / 8, share, np.minimum(below(marks) / some * 20, 2), leaf & (chars < 25), leaf & (chars > 150),
        np.log1p(below(words) / np.maximum(texts, 1)) / 4, np.log1p(below(links > 0)) / 3, size / whole, (start[:n] - base) / whole, (start[:n] - base + size) / whole, np.minimum(np.array(pages.depth) / 10, 2), below(rights) > 0,
        np.fromiter((t[-1:] in tuple(".!?…\"”»") and bool(t) for t in pages.text), bool, n), (hints.sum(axis=1) > content) & (content == 0), share > 0.5,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


# The model: potentials of nodes and edges, messages, fit.


@dataclass(frozen=True)
class TreeModel:
    """node: weight of each feature for content; edge: by kind of the child, label of the parent, label of the child."""

    node: np.ndarray
    edge: np.ndarray


def marginals(score: np.ndarray, edge: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact marginals of a forest: (P(content) a node, P(parent's label, own label) a node, sum of log partition functions).

    score: log potential of content against not, by node; edge: log potentials (nodes, parent's label, own label), not
    used for roots. Levels go up and down once.
    """
    n = len(score)
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    inside = np.zeros((n, 2))
    inside[:, 1] = score
    up = np.zeros((n, 2))
    for at in reversed(levels[1:]):
        up[at] = np.logaddexp(edge[at, :, 0] + inside[at, None, 0], edge[at, :, 1] + inside[at, None, 1])
        for label in (0, 1):
            inside[:, label] += np.bincount(parent[at], up[at, label], n) if len(at) * 8 > n else 0
        if len(at) * 8 <= n:
            np.add.at(inside, parent[at], up[at])
    belief, pair = np.zeros((n, 2)), np.zeros((n, 2, 2))
    total = 0.0
    for d, at in enumerate(levels):
        if d == 0:
            z = np.logaddexp(inside[at, 0], inside[at, 1])
            total = float(z.sum())
            belief[at] = np.exp(inside[at] - z[:, None])
        else:
            given = edge[at] + inside[at][:, None, :] - up[at][:, :, None]
            pair[at] = belief[parent[at]][:, :, None] * np.exp(given)
            belief[at] = pair[at].sum(axis=1)
    return belief[:, 1], pair, total


def fit_tree_model(pages: Pages, rounds: int = 250, penalty: float = 2e-4, rate: float = 0.1) -> TreeModel:
    """Weights of greatest penalised likelihood of labelled trees, by gradients from exact marginals. The aim is concave,
    so the result doesn't depend on a start; ties and repeated pages only weigh more. Without pages all weights are 0."""
    x, kind, parent, depth = features(pages), np.array(pages.kind, np.int64), np.array(pages.parent, np.int64), np.array(pages.depth, np.int64)
    own = np.array([bool(t) and label > 0 for t, label in zip(pages.text, pages.label, strict=True)], np.int64)
    total = np.concatenate([[0], np.cumsum(own)])
    y = (total[np.array(pages.end, np.int64)] - total[: len(own)] > 0).astype(np.int64)
    n, below = max(len(y), 1), np.flatnonzero(parent >= 0)
    seen_node = x.T @ y
    seen_edge = np.zeros((OTHER + 1, 2, 2))
    np.add.at(seen_edge, (kind[below], y[parent[below]], y[below]), 1)
    weights = np.zeros(x.shape[1] + seen_edge.size)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1 if len(y) else 1):
        node, edge = weights[: x.shape[1]], weights[x.shape[1] :].reshape(seen_edge.shape)
        p, pair, _ = marginals(x @ node, edge[kind], parent, depth)
        expected = np.zeros_like(seen_edge)
        for a in (0, 1):
            for b in (0, 1):
                expected[:, a, b] = np.bincount(kind[below], pair[below, a, b], OTHER + 1)
        slope = np.concatenate([seen_node - x.T @ p, (seen_edge - expected).ravel()]) / n - penalty * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        step = rate * (1 - k / (rounds + 1)) * mean / (1 - 0.9**k) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weights = weights + step
    return TreeModel(weights[: x.shape[1]], weights[x.shape[1] :].reshape(seen_edge.shape))


def content_marginals(pages: Pages, model: TreeModel) -> np.ndarray:
    kind = np.array(pages.kind, np.int64)
    return marginals(features(pages) @ model.node, model.edge[kind], np.array(pages.parent, np.int64), np.array(pages.depth, np.int64))[0]


def main_texts(htmls: Sequence[str | None], model: TreeModel, least: float = 0.5) -> list[list[str]]:
    """The content blocks of each page, in page order."""
    pages = parse_pages(htmls)
    p = content_marginals(pages, model)
    out: list[list[str]] = [[] for _ in htmls]
    for k in np.flatnonzero(p >= least).tolist():
        if pages.text[k]:
            out[pages.page[k]].append(pages.text[k])
    return out


def extract_main_text(pages: DataFrame, model: TreeModel, html: str = "html", out_col: str = "main", block_bytes: int = 1 << 22) -> DataFrame:
    """All columns and ``out_col``: the content blocks of each page, an array of texts; none for null or empty pages.

    Nothing is shuffled; pages are parsed whole, some at a time up to ``block_bytes``, a longer one by itself.
    """
    held, names = pages.sparkSession.sparkContext.broadcast(model), pages.columns
    schema = StructType(list(pages.schema)).add(out_col, ArrayType(StringType()))

    def run(batches):
        for batch in batches:
            column = batch.column(names.index(html))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in row_blocks(sizes, block_bytes):
                found = main_texts(column.slice(a, z - a).to_pylist(), held.value)
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.string()))], [*names, out_col])

    return pages.mapInArrow(run, schema)


def labelled_pages(pages: DataFrame, html: str = "html", most: int = 400, most_chars: int = 50_000) -> list[str]:
    """A bounded sample of pages for fitting: those with an article or main element and the smallest hashes of their html,
    ``most`` of at most ``most_chars`` each."""
    text, own = F.col("html"), F.xxhash64("html").alias("own")
    given = pages.select(pages[html].cast("string").alias("html")).filter((F.length(text) <= most_chars) & text.rlike("(?i)<(article|main)[ >]"))
    least = [r["own"] for r in given.select(own).distinct().orderBy("own").limit(most).collect()]  # hashes first: no page is sent for nothing
    found = given.withColumn("own", own).filter(F.col("own").isin(least)).groupBy("own").agg(F.min("html").alias("html"))
    return [r["html"] for r in found.orderBy("own").collect()]
