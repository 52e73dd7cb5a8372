"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its stretches of text as leaves.
Each node is 1 if it holds main text. Node potentials come from features of
its tag, names and text, edge potentials tie parents and children; messages
passed up and then down the tree (sum-product) give each leaf's marginal.
Weights are trained by MAP logistic regression on labelled pages, with a
Gaussian prior about documented weights, so that what the labelled pages never
show (comments, notices, forms, ...) keeps a sensible weight.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Comments, declarations and tags; a ``<`` before anything else is text. Values end as in a browser: at their quote, or,
#: unquoted or with a quote that never closes, at white space or ``>``.
_ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)",
    re.S,
)
#: Elements that are skipped with all they hold: those whose content is no markup (and so lasts to the end if never closed), and others.
OPAQUE = {"script", "style", "noscript", "title", "iframe", "textarea", "xmp", "noembed", "noframes"}
SKIPPED = OPAQUE | {"template", "svg", "select", "button", "object", "canvas", "datalist", "audio", "video", "math"}
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre"
    " nav header footer aside form fieldset figure figcaption address details summary dialog menu hr center".split()
)
#: Blocks that an opening tag of the same family ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"ul", "ol", "dl", "table", "menu", "tbody", "thead", "tfoot"}
#: Names of what is never main text, and of parts that an article may have of its own.
NEVER = (
    r"nav\w*|menu\w*|ads?|advert\w*|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|"
    r"comments?|respond|repl(?:y|ies)|discussion|disqus|share\w*|social|related|recommend\w*|widget|popup|modal|overlay|breadcrumbs?|login|signup|subscribe|"
    r"newsletter|toolbar|pagination|pager|copyright"
)
HEADS, PARTS = r"masthead|head|header", r"foot\w*|side\w*|banner|search|tags?|legal|form"


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


AGAINST, AGAINST_HEADED, AGAINST_TEXT = _named(f"{NEVER}|{HEADS}|{PARTS}"), _named(f"{NEVER}|{PARTS}"), _named(NEVER)
#: Blocks that hold text and no other blocks.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body)(?:$|[\s_-])", re.I)

#: Features and the mean of each one's prior (fixed values).
PRIOR = {
    "bias": 0.0,
    "tag_article": 3.0,
    "tag_boiler": -14.0,
    "name_against": -14.0,
    "name_for": 1.5,
    "hidden": -14.0,
    "leaf": 0.0,
    "leaf_in_paragraph": 2.0,
    "leaf_in_heading": 1.0,
    "leaf_in_item": -0.5,
    "leaf_long": 1.0,
    "leaf_sentence": 0.5,
    "leaf_links": -4.0,
    "in_article": 1.5,
    "outside_article": -2.5,
}
#: P(child is 1 | parent) before training, the counts this weighs as, and the precision of the weights' prior (fixed values).
EDGE_PRIOR, EDGE_WEIGHT = (1e-7, 0.6), 20.0
PRIOR_PRECISION = 2.0


def speaks_against(tag: str, names: str, in_article: bool) -> bool:
    """Whether a block's names speak against it. In an article, a paragraph or heading may be called a header, a footer or a form, and a block that is named after the article its header."""
    if in_article and tag in TEXT_BLOCKS:
        return AGAINST_TEXT.search(names) is not None
    return (AGAINST_HEADED if in_article and FOR.search(names) else AGAINST).search(names) is not None


class Tree:
    """Nodes in page order: parent, tag, features, and the text of leaves (else None)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.text, self.links = [-1], ["#root"], [""], [None], [0]
        self.hidden = [False]
        stack = [0]
        parts: list[str] = []
        linked = 0
        in_link = 0

        def flush():
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self._add(stack[-1], "#text", "", False, text, linked)
                parts.clear()
            linked = 0

        at = here = 0
        open_tags: Counter[str] = Counter()
        ends: dict[str, int] = {}  # by skipped tag: the place of its next end tag, so that none is looked for twice

        def pop(k: int):
            open_tags.subtract(self.tag[i] for i in stack[k:])
            del stack[k:]

        while m := TOKEN.search(source, here):
            if m.start() > at:
                said = html.unescape(source[at : m.start()])
                parts.append(said)
                if in_link:
                    linked += len(said.strip())
            at = here = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in SKIPPED:
                if m["end"] or m["attrs"].endswith("/") and tag in ("svg", "math"):
                    continue
                if ends.get(tag, -1) < at:
                    found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    ends[tag] = found.start() if found else len(source)
                if ends[tag] < len(source):
                    close = source.find(">", ends[tag])
                    at = here = close + 1 if close >= 0 else len(source)
                elif tag in OPAQUE:
                    at = here = len(source)
                continue
            if tag not in BLOCKS:
                if tag == "br":
                    parts.append(" ")
                elif tag == "a":
                    in_link = 0 if m["end"] else 1
                continue
            flush()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                    if self.tag[stack[k]] == tag:
                        pop(k)
                        break
                in_link = 0
                continue
            if self.tag[stack[-1]] == "p":
                pop(len(stack) - 1)
            closes = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in closes) else ():
                if self.tag[stack[k]] in closes:
                    pop(k)
                    break
                if self.tag[stack[k]] in STOPS:
                    break
            attrs = m["attrs"]
            names = " ".join(filter(None, (a or b or c for a, b, c in NAMES.findall(attrs)))) if attrs else ""
            node = self._add(stack[-1], tag, names, bool(attrs and HIDDEN.search(attrs)), None, 0)
            if tag != "hr":
                stack.append(node)
                open_tags[tag] += 1
        if at < len(source):
            parts.append(html.unescape(source[at:]))
        flush()

    def _add(self, parent, tag, names, hidden, text, links) -> int:
        for column, value in zip((self.parent, self.tag, self.names, self.hidden, self.text, self.links), (parent, tag, names, hidden, text, links), strict=True):
            column.append(value)
        return len(self.parent) - 1

    def features(self) -> list[list[float]]:
        """A row of ``PRIOR``'s features for each node; what speaks against a block speaks against all under it.

        A block whose names speak against it counts as a wrapper, and not as one of these, if it holds an article or main
        element or, on pages without, four fifths of the text. An article starts anew, unless it is in another one and its names speak against it.
        """
        n = len(self.tag)
        has_main = any(t in ("article", "main") for t in self.tag)
        holds, size = [t in ("article", "main") for t in self.tag], [len(t or "") for t in self.text]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            if holds[i]:
                holds[self.parent[i]] = True
        inside, boilers, againsts, hiddens = [False] * n, [False] * n, [False] * n, [False] * n
        rows = []
        for i, tag in enumerate(self.tag):
            p = self.parent[i]
            article = tag in ("article", "main")
            nested = p >= 0 and inside[p]
            inside[i] = article or nested
            text = self.text[i]
            leaf = text is not None
            over = self.tag[p] if p >= 0 else ""
            names = self.names[i]
            boilers[i] = tag in ("nav", "footer", "aside", "form", "dialog", "menu") or (tag == "header" and not nested) or (p >= 0 and boilers[p])
            own = bool(names) and tag not in ("body", "html") and (nested or not article) and speaks_against(tag, names, nested)
            wrapper = not article and (holds[i] if has_main else 5 * size[i] > 4 * size[0])
            againsts[i] = own and not wrapper if article or own else p >= 0 and againsts[p]
            hiddens[i] = self.hidden[i] or (p >= 0 and hiddens[p])
            rows.append(
                [
                    1.0,
                    float(article),
                    float(boilers[i]),
                    float(againsts[i]),
                    float(bool(names) and FOR.search(names) is not None),
                    float(hiddens[i]),
                    float(leaf),
                    float(leaf and over in ("p", "pre", "blockquote")),
                    float(leaf and len(over) == 2 and over[0] == "h" and over != "hr"),
                    float(leaf and over in ("li", "td", "th", "dt", "dd")),
                    min(math.log1p(len(text)) / 5, 1.5) if leaf else 0.0,
                    float(leaf and text[-1] in ".!?:;…\"'”»。"),
                    min(self.links[i] / max(len(text), 1), 1.0) if leaf else 0.0,
                    float(leaf and has_main and inside[i]),
                    float(leaf and has_main and not inside[i]),
                ]
            )
        return rows

    def marginals(self, weights: np.ndarray, edge: tuple[float, float]) -> list[float]:
        """P(node is 1) of each node, by messages up and down."""
        n = len(self.parent)
        score = (np.array(self.features()) @ weights).tolist()
        # a pair (a, b) are the weights of 0 and 1, kept at a sum of 1
        one = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        up0, up1 = [1 - x for x in one], one[:]
        to0, to1 = [1.0] * n, [1.0] * n  # messages to the parent
        q0, q1 = edge
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            m0, m1 = (1 - q0) * a + q0 * b, (1 - q1) * a + q1 * b
            s = m0 + m1
            to0[i], to1[i] = m0 / s, m1 / s
            p = self.parent[i]
            x, y = up0[p] * to0[i], up1[p] * to1[i]
            s = x + y or 1e-300
            up0[p], up1[p] = x / s, y / s
        full0, full1 = up0[:], up1[:]
        for i in range(1, n):
            p = self.parent[i]
            x, y = full0[p] / max(to0[i], 1e-300), full1[p] / max(to1[i], 1e-300)
            s = x + y
            x, y = x / s, y / s
            d0, d1 = (1 - q0) * x + (1 - q1) * y, q0 * x + q1 * y
            a, b = up0[i] * d0, up1[i] * d1
            s = a + b or 1e-300
            full0[i], full1[i] = a / s, b / s
        return full1


def extract_text(source: str, weights: np.ndarray, edge: tuple[float, float]) -> str:
    tree = Tree(source)
    if len(tree.parent) == 1:
        return ""
    sure = tree.marginals(weights, edge)
    return "\n\n".join(t for t, p in zip(tree.text, sure, strict=True) if t is not None and p >= 0.5)


def prior_model() -> tuple[np.ndarray, tuple[float, float]]:
    return np.array(list(PRIOR.values())), EDGE_PRIOR


def train(labelled: DataFrame, sample_pages: int = 400) -> tuple[np.ndarray, tuple[float, float]]:
    """Weights and edge probabilities from ``html, main_text``.

    At most ``sample_pages`` labelled pages are used, by the least hash of
    their html: a bound for the fit alone. A leaf is labelled 1 if it is a line
    of the main text or, from 20 characters on, begins one; an element if any
    leaf under it is. Without labelled pages the prior stays.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for source, main in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Tree(source)
                lines = {" ".join(x.split()) for x in main.split("\n")}
                y = [t is not None and (t in lines or len(t) >= 20 and any(x.startswith(t) for x in lines)) for t in tree.text]
                for i in range(len(y) - 1, 0, -1):
                    y[tree.parent[i]] = y[tree.parent[i]] or y[i]
                out[0] += tree.features()
                out[1] += [int(v) for v in y]
                out[2] += [-1 if p < 0 else int(y[p]) for p in tree.parent]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["x", "y", "over"]
            )

    few = labelled.where("html is not null and main_text is not null").select("html", "main_text").orderBy(F.xxhash64("html")).limit(sample_pages)
    got = few.mapInArrow(rows, "x array<double>, y int, over int").groupBy("x", "y", "over").count().collect()
    w, edge = prior_model()
    if not got:
        return w, edge
    x, y, n = np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([r["count"] for r in got], float)
    over = np.array([r["over"] for r in got])
    mean = w.copy()
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - PRIOR_PRECISION * (w - mean)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + PRIOR_PRECISION * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    edge = tuple(
        float((EDGE_WEIGHT * EDGE_PRIOR[k] + n[(over == k) & (y == 1)].sum()) / (EDGE_WEIGHT + n[over == k].sum())) for k in (0, 1)
    )
    return w, edge


def extract(pages: DataFrame, model: tuple[np.ndarray, tuple[float, float]] | None = None) -> DataFrame:
    """``page_id, url, text`` of every row: main text blocks in page order, joined by a blank line.

    White space in a block is one blank; character references are decoded. A
    null or empty page, or one without main text, gives an empty text; rows
    that repeat give repeated rows; other columns are ignored.
    """
    weights, edge = model or prior_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract_text(s or "", weights, edge) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")


def labelled_pages(pages: DataFrame, documents: DataFrame, sample_pages: int = 400) -> DataFrame:
    """Pages whose address names a document, with that document's text as the label."""
    ids = F.regexp_extract("url", r"/([0-9]{1,18})(?:[/?#]|$)", 1)
    few = (
        pages.where(F.col("html").isNotNull())
        .select("url", "html", F.when(ids != "", ids).cast("long").alias("_doc"))
        .where("_doc is not null")
        .orderBy(F.xxhash64("url"), "html")
        .limit(sample_pages)
    )
    named = documents.join(F.broadcast(few.select("_doc").distinct()), F.col("doc_id") == F.col("_doc"), "left_semi").select("doc_id", F.col("text").alias("main_text"))
    return few.join(named, F.col("_doc") == F.col("doc_id")).select("html", "main_text")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = extract(pages, train(labelled_pages(pages, docs)))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
