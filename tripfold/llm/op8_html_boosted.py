"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed to its element tree (void and self-closing elements, optional end tags, unclosed and stray
tags, raw text elements, comments; a hidden box such as a button or svg without an end tag ends at the next block). Every element has features: what kind its tag is, words of class, id
and role, depth, place and number among its siblings, text and link density of its subtree, how much
text and punctuation it has itself, and whether it stands below a content or boilerplate element.
Boosted trees (logistic loss, histogram splits) say how likely an element's own text is main text. They
learn from elements whose tag or attributes tell what they are, on at most MAX_TRAIN pages; copies of
these with tag and attribute features blanked teach them to judge by text and place alone.

Decoding finds the best labelling in which a path from the root goes outside, then inside, then out
again at most once (a cut), so that no kept element stands below a dropped one within the article.
Changes cost SWITCH. The text of inside elements is put out in page order.

Cases: a null or empty html gives an empty text; html without tags is one block; an element's text ends
with the page if it isn't closed; repeated rows give repeated results; an empty table gives no rows;
without any told element in the sample, or with too few to fit trees that tell them apart, text outside
boilerplate elements is kept; of several rows with a
page_id the first html in order is learned from.
"""

from __future__ import annotations

import html
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import lean

MAX_TRAIN = 600  # pages the trees are fitted on, at most
TREES, DEPTH, BINS, RATE, LEAST = 40, 4, 24, 0.3, 20
SWITCH = 2.0
WRONG = 0.05  # share of the sample's own told elements that trees may get wrong, at most, to be used
PAGES = 64  # pages that are scored together

#: Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe")
BOXES = frozenset("svg select button template noscript".split())  # hidden with all that is in them
HIDDEN_TAGS = frozenset((*RAW, *BOXES, "head", "input", "option", "object", "canvas"))
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "button": ("button",), "select": ("select",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "button": ("template",), "select": ("template",)}
MAIN = frozenset(("article", "main"))
BOILER = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu", *HIDDEN_TAGS))
GOOD = frozenset("article articlebody body content entry main post story text".split())
BAD = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus dropdown footer form header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related replies reply search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
FEATURES = 24


class Page:
    """The element tree, parents first, as parallel lists; parts: (element, text) in page order.

    A box that has no end tag of its own ends where a block begins (it may hold one if it has): as these are
    known at the page's end only, a page with such boxes is parsed again.
    """

    def __init__(self, source: str):
        self.loose: frozenset = frozenset()  # elements that are boxes without an end tag
        self._parse(source)
        loose = frozenset(self.boxes - self.ended)
        if loose:
            self.loose = loose
            self._parse(source)

    def _parse(self, source: str) -> None:
        self.boxes, self.ended = set(), set()
        self.tag, self.parent, self.depth, self.words = [""], [-1], [0], [()]
        self.parts: list = []
        at, i, size = [0], 0, len(source)
        while i < size:
            m = _TOKEN.match(source, i)
            i = m.end() if m.end() > i else i + 1
            name = m[2]
            if m[4] is not None:
                self.parts.append((at[-1], m[4]))
            elif name is not None:
                name = name.lower()
                if m[1]:
                    self._end(at, name)
                    continue
                self._imply(at, name)
                k = self._add(at[-1], name, m[3])
                single = m[3].rstrip().endswith("/")
                if name in RAW and not (single and any(self.tag[j] == "svg" for j in at)):
                    end = _END[name].search(source, i)
                    i = end.end() if end else size
                elif name in VOID:
                    self.parts.append((at[-1], " "))
                elif not single:
                    at.append(k)
                    if name in BOXES:
                        self.boxes.add(k)
                if name not in INLINE:
                    self.parts.append((at[-1], " "))

    def _add(self, parent: int, name: str, attributes: str) -> int:
        found = _ATTRIBUTE.findall(attributes) if attributes else ()
        self.tag.append(name), self.parent.append(parent), self.depth.append(self.depth[parent] + 1)
        self.words.append(tuple(w for x in found for w in _WORD.findall(x.lower())))
        return len(self.tag) - 1

    def _end(self, at: list, name: str) -> None:
        for k in range(len(at) - 1, 0, -1):
            if self.tag[at[k]] == name:
                self.ended.add(at[k])
                self.parts.append((at[k], " " if name not in INLINE else ""))
                del at[k:]
                return
            if self.tag[at[k]] in CLOSES_P and name in INLINE:
                return  # a stray end tag of an inline element doesn't close blocks
            if self.tag[at[k]] == "template" and at[k] not in self.loose:
                return  # nor does an end tag in a template close what is around it

    def _imply(self, at: list, name: str) -> None:
        """Ends what the start of this element ends."""
        if self.loose and (name in CLOSES_P or name in SCOPES and name not in ("option", "button", "select")):
            first = 0
            for k in range(len(at) - 1, 0, -1):
                if at[k] in self.loose:
                    first = k
                elif self.tag[at[k]] in BOXES:
                    break
            if first:
                del at[first:]
        if name in CLOSES_P:
            for k in range(len(at) - 1, 0, -1):
                tag = self.tag[at[k]]
                if tag == "p":
                    del at[k:]
                    break
                if tag in CLOSES_P or tag in BOXES or tag in ("td", "th", "li", "body"):
                    break
        if name in SIBLINGS:
            for k in range(len(at) - 1, 0, -1):
                tag = self.tag[at[k]]
                if tag in SIBLINGS[name]:
                    del at[k:]
                    break
                if tag in SCOPES[name] or tag in BOXES and name not in ("option", "button", "select"):
                    break


def measured(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of each element, and its label: 1 told to be content, 0 told to be boilerplate, -1 neither."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, marks, link = np.zeros(n), np.zeros(n), np.zeros(n)
    linked, boxed = np.zeros(n, bool), np.zeros(n, bool)  # boxed: in a box, so neither text nor an element of the page's
    main, boiler, hidden, good, bad = (np.zeros(n, bool) for _ in range(5))
    for k in range(1, n):
        p, tag, words = page.parent[k], page.tag[k], page.words[k]
        g, b = not GOOD.isdisjoint(words), not BAD.isdisjoint(words)
        good[k], bad[k] = g, b
        linked[k] = linked[p] or tag == "a"
        boxed[k] = boxed[p] or page.tag[p] in BOXES
        hidden[k] = hidden[p] or tag in HIDDEN_TAGS
        main[k] = main[p] or tag in MAIN or (g and not b)
        boiler[k] = boiler[p] or tag in BOILER or (b and not g)
    for k, text in page.parts:
        if boxed[k] or page.tag[k] in BOXES:
            continue
        size = len(text) - text.count(" ")
        own[k] += size
        marks[k] += text.count(".") + text.count(",")
        if linked[k]:
            link[k] += size
    below, links, tags, paragraphs = own.copy(), link.copy(), 1.0 - boxed, np.array([t == "p" for t in page.tag]) * (1.0 - boxed)
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        below[p] += below[k]
        links[p] += links[k]
        tags[p] += tags[k]
        paragraphs[p] += paragraphs[k]
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    place, seen = np.zeros(n), np.zeros(n, int)
    for k in range(1, n):
        place[k] = seen[page.parent[k]]
        seen[page.parent[k]] += 1
    tag = np.array(page.tag)
    x = np.stack([
        main, boiler, good, bad, np.isin(tag, list(MAIN)), np.isin(tag, list(BOILER)), np.isin(tag, ["p", "blockquote", "pre"]),
        np.isin(tag, ["h1", "h2", "h3", "h4", "h5", "h6"]), np.isin(tag, ["li", "ul", "ol", "td", "tr", "table"]), np.isin(tag, list(INLINE)), linked,
        np.log1p(own), np.log1p(below), links / np.maximum(below, 1), np.log1p(below / np.maximum(tags, 1)), np.log1p(marks), np.log1p(paragraphs), page.depth,
        siblings[up], place / np.maximum(siblings[up], 1), np.log1p(below[up]), below / max(below[0], 1), links[up] / np.maximum(below[up], 1), np.log1p(tags),
    ], 1).astype(np.float32)
    x[hidden] = 0
    told = np.where(boiler, 0, np.where(main, 1, -1))
    told[hidden] = -2
    return x, told


BLANKED = list(range(10))  # features that tag and attributes give


class Trees:
    """Boosted trees of one depth: TREES x (2^DEPTH - 1) splits, TREES x 2^DEPTH leaves."""

    def __init__(self, split: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.split, self.cut, self.leaf, self.base = split, cut, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        f = np.full(len(y), base)
        splits, cuts, leaves = np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), int)
            for level in range(DEPTH):
                nodes = 2**level
                best = np.full(nodes, 1e-6)
                gain_at = [(0, np.inf)] * nodes
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = at * (BINS + 1) + binned[:, j]
                    G, H, N = (np.bincount(key, v, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(1) for v in (g, h, np.ones(len(y))))
                    value = lambda a, b: a * a / (b + 1)
                    gain = value(G, H) + value(G[:, -1:] - G, H[:, -1:] - H) - value(G[:, -1:], H[:, -1:])
                    gain[(N < LEAST) | (N[:, -1:] - N < LEAST)] = 0
                    gain = gain[:, : len(e)]
                    top = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(nodes), top] > best):
                        best[k], gain_at[k] = gain[k, top[k]], (j, float(e[top[k]]))
                first = nodes - 1
                for k, (j, c) in enumerate(gain_at):
                    splits[t, first + k], cuts[t, first + k] = j, c
                at = 2 * at + (x[np.arange(len(y)), splits[t, first + at]] > cuts[t, first + at])
            G, H = np.bincount(at, g, 2**DEPTH), np.bincount(at, h, 2**DEPTH)
            leaves[t] = -RATE * G / (H + 1)
            f += leaves[t][at]
        return cls(splits, cuts, leaves, base)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf):
            at = np.zeros(len(x), int)
            for level in range(DEPTH):
                k = 2**level - 1 + at
                at = 2 * at + (x[rows, split[k]] > cut[k])
            out += leaf[at]
        return out


def decoded(page: Page, logit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which elements are inside. Phases of a path: 0 outside, 1 inside, 2 cut; they never go back."""
    n = len(page.tag)
    inside, outside = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    weight = np.where(own > 0, 1.0, 0.25)
    best = np.stack([outside * weight, inside * weight, outside * weight], 1)
    best[[t in HIDDEN_TAGS for t in page.tag], 1] = -1e9
    go = np.zeros((n, 2), int)  # phase of an element below one of phase 0 and of phase 1
    for k in range(n - 1, 0, -1):
        b, p = best[k], page.parent[k]
        go[k, 0] = 1 if b[1] - SWITCH > b[0] else 0
        go[k, 1] = 2 if b[2] - SWITCH > b[1] else 1
        best[p] += (max(b[0], b[1] - SWITCH), max(b[1], b[2] - SWITCH), b[2])
    phase = np.zeros(n, int)
    for k in range(1, n):
        p = phase[page.parent[k]]
        phase[k] = 2 if p == 2 else go[k, p]
    if n == 1:
        phase[0] = 1  # no element at all: the page is its text
    return phase == 1


def texts_of(sources: list, trees: Trees | None) -> list:
    pages = [Page(s or "") for s in sources]
    found = [measured(p) for p in pages]
    sizes = np.cumsum([0, *(len(p.tag) for p in pages)])
    x = np.concatenate([f for f, _ in found])
    logit = trees.logits(x) if trees else np.concatenate([np.where(t == 0, -3.0, 3.0) for _, t in found])
    out = []
    for p, a, b in zip(pages, sizes, sizes[1:]):
        keep = decoded(p, logit[a:b], x[a:b, 11])
        text = html.unescape("".join([t if keep[k] else " " for k, t in p.parts]))
        out.append(_SPACE.sub(" ", text).strip())
    return out


def fitted(pages: DataFrame) -> Trees | None:
    """Trees fitted in one task on at most MAX_TRAIN pages, drawn by hash of page_id."""
    ids = pages.select(F.col("page_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(MAX_TRAIN)

    def run(batches):
        rows = sorted((r["page_id"], r["html"]) for b in batches for r in b.to_pylist())
        found = [measured(Page(h)) for _, h in rows]
        if not found:
            return
        x, told = np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found])
        x, y = x[told >= 0], told[told >= 0].astype(float)
        if len(y) and 0 < y.sum() < len(y):
            blank = x.copy()
            blank[:, BLANKED] = 0
            trees, out = Trees.fit(np.concatenate([x, blank]), np.r_[y, y]), io.BytesIO()
            if ((trees.logits(x) > 0) != (y > 0)).mean() > WRONG:
                return
            np.savez_compressed(out, split=trees.split, cut=trees.cut, leaf=trees.leaf, base=trees.base)
            yield pa.RecordBatch.from_pydict({"trees": [out.getvalue()]})

    # MAX_TRAIN ids at most, and one page for each, however many rows have it
    sample = pages.select("page_id", "html").join(F.broadcast(ids), F.col("page_id") == F.col("_id"), "left_semi").groupBy("page_id").agg(F.min(F.coalesce("html", F.lit(""))).alias("html"))
    got = sample.repartition(1).mapInArrow(run, "trees binary").collect()
    if not got:
        return None
    z = np.load(io.BytesIO(got[0]["trees"]))
    return Trees(z["split"], z["cut"], z["leaf"], float(z["base"]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    held = pages.sparkSession.sparkContext.broadcast(fitted(pages))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, PAGES):
                part = b.slice(k, PAGES)
                texts = texts_of(part.column(2).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_boosted(spark, sf_dir: str) -> DataFrame:
    lean(spark)
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
