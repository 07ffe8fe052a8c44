"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its path of tags (and class and
id names) from the root. Per path the text length per node and the punctuation
per node are taken; both sequences are smoothed over neighbouring nodes, fused
by multiplication and cut at a share of their standard deviation. The nodes
above the threshold point out the element that holds the article. What lies in
that element is the text, but for link lists on paths below the threshold and
for navigation, forms, adverts and the like, as far as elements or their class
names say so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
LABEL = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？¡¿]")

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option svg canvas object audio video dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INSIDE_ARTICLE = frozenset("article main".split())
# Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("caption dd dt legend li summary tbody td tfoot th thead tr title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
           "th": {"tr", "table"}, "option": {"select"}}
# Class and id words of what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription share sharing social related recommended comment comments "
    "disqus reply replies respond pagination pager widget toolbar copyright notice notices disclaimer "
    "alert footer masthead skip login signup paywall".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert menu menubar dialog".split())
# Names of headings and quotes come from their titles and speakers, not from their role in the page.
NAMED_FREELY = frozenset("h1 h2 h3 h4 h5 h6 blockquote q cite a".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
THRESHOLD = 0.25  # share of the standard deviation of the fused ratio
SHARE = 0.7  # of the selected text that the article's element must hold


class _Page:
    """Text nodes of a page in order, as blocks of the elements they stand in."""

    def __init__(self, source: str):
        self.texts: list[str] = []  # of each node
        self.paths: list[str] = []
        self.owners: list[tuple[int, ...]] = []  # elements around the node, from the root
        self.blocks: list[int] = []
        self._stack: list[tuple[str, int, bool, str]] = []  # name, element, dropped, path
        self._elements = self._block = 0
        at = 0
        while True:
            found = TAG.search(source, at)
            self._text(source[at : found.start() if found else len(source)])
            if not found:
                return
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            if found["close"] or found["close2"]:
                self._close(name)
            else:
                attributes = found["attributes"] or ""
                closed = attributes.endswith("/") and name in ("svg", "path")
                self._open(name, attributes)
                if name in RAW and not closed:
                    end = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                    at = end.start() if end else len(source)

    def _text(self, raw: str) -> None:
        if not raw or (self._stack and self._stack[-1][2]):
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.texts.append(text)
        self.paths.append(self._stack[-1][3] if self._stack else "")
        self.owners.append(tuple(x[1] for x in self._stack))
        self.blocks.append(self._block)

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._block += 1
        if name in ENDS_PARAGRAPH:
            self._end({"p"}, HOLDERS["td"] | {"td", "th", "li"} | INSIDE_ARTICLE)
        if name in SIBLINGS:
            self._end(SIBLINGS[name], HOLDERS[name])
        if name in VOID:
            if name == "br":
                self._text("\n")
            return
        labels = {}
        if attributes:
            for found in LABEL.finditer(attributes):
                labels[found[1].lower()] = (found[2] or found[3] or found[4] or "").lower()
        words = {w for key in ("class", "id") for w in NAME.findall(labels.get(key, ""))}
        # A paragraph is marked by its class; its id may be made of its text.
        marked = words if name != "p" else set(NAME.findall(labels.get("class", "")))
        above = self._stack[-1] if self._stack else ("", 0, False, "")
        inside = any(x[0] in INSIDE_ARTICLE for x in self._stack)
        dropped = (
            above[2]
            or name in DROPPED
            or (name == "header" and not inside)
            or (bool(marked & MARKS) and name not in ("html", "body", *INSIDE_ARTICLE, *NAMED_FREELY))
            or labels.get("role") in ROLES
        )
        self._elements += 1
        label = "".join("." + w for w in sorted(words))
        self._stack.append((name, self._elements, dropped, f"{above[3]}/{name}{label}"))

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._block += 1
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == name:
                del self._stack[k:]
                return

    def _end(self, names: set[str], limits: set[str]) -> None:
        """Close the innermost open element of ``names``, looking no further than ``limits``."""
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in names:
                del self._stack[k:]
                return
            if self._stack[k][0] in limits:
                return


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted mean of each node with its two neighbours on either side."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[2:-2]
    return np.convolve(values, kernel)[2:-2] / weight


def _selected(page: _Page) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length and path number of each node, whether it is content, and whether its path is not.

    A path's ratios are its text length and its punctuation per node, multiplied.
    Smoothed over the nodes of the page in order they tell where the content
    stands; unsmoothed they tell which paths in it hold none.
    """
    size = np.array([len(t.strip()) for t in page.texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in page.texts], float)
    names, path = np.unique(page.paths, return_inverse=True)
    nodes = np.maximum(np.bincount(path, size > 0, len(names)), 1)
    ratio = (np.bincount(path, size, len(names)) / nodes)[path] * (size > 0)
    punctuation = (np.bincount(path, marks, len(names)) / nodes)[path] * (size > 0)
    fused = _smoothed(ratio) * (1 + _smoothed(punctuation))
    least = THRESHOLD * fused.std()
    return size, path, (fused >= least) & (size > 0), ratio * (1 + punctuation) < least


def _link_lists(page: _Page, size: np.ndarray, path: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Nodes of link lists: blocks of links only, two at least, on paths that the ratios leave out.

    The links of a list share their path. A link in a sentence or a heading
    stands in a block with other text, or under a heading, and is none of them.
    """
    linked = np.array([bool({"a"} & set(_names(p))) and not HEADINGS & set(_names(p)) for p in page.paths], bool)
    counted = np.bincount(path, size > 0)
    some = size > 0
    blocks = np.array(page.blocks)
    other = set(blocks[some & ~(linked & low)].tolist())
    alone = np.array([b not in other for b in page.blocks], bool)
    return some & linked & low & alone & (counted[path] > 1)


def _names(path: str) -> list[str]:
    return [x.partition(".")[0] for x in path.split("/")[1:]]


def _article(page: _Page, size: np.ndarray, selected: np.ndarray) -> int:
    """Element that holds the selected nodes (0: the whole page)."""
    chosen = np.flatnonzero(selected)
    total: dict[int, float] = {}
    depth: dict[int, int] = {}
    for k in chosen:
        for d, element in enumerate(page.owners[k]):
            total[element] = total.get(element, 0.0) + size[k]
            depth[element] = d
    enough = [e for e in total if total[e] >= SHARE * size[chosen].sum()]
    return max(enough, key=depth.__getitem__, default=0)


def main_text(source: str | None) -> str:
    """Blocks of the article of a page, one per line; empty without any text."""
    page = _Page(source or "")
    if not any(t.strip() for t in page.texts):
        return ""
    size, path, selected, low = _selected(page)
    listed = _link_lists(page, size, path, low)
    article = _article(page, size, selected)
    # A paragraph by itself is no article: what stands beside it belongs there too.
    holder = {}
    for path, owners in zip(page.paths, page.owners):
        names = path.split("/")[1:]
        for name, element in zip(names, owners):
            holder[element] = name.split(".")[0]
    if article and holder[article] not in ("article", "main", "section", "div", "body", "html", "td"):
        for owners in page.owners:
            if article in owners:
                above = [e for e in owners[: owners.index(article)]
                         if holder[e] in ("article", "main", "section", "div", "body", "html", "td")]
                article = above[-1] if above else 0
                break
    inside = next((o for o in page.owners if article in o), ())
    for element in inside[: inside.index(article)] if article else ():
        if holder[element] in INSIDE_ARTICLE:  # a division of an article stands for all of it
            article = element
            break
    blocks: dict[int, list[str]] = {}
    for k, (text, owners, block) in enumerate(zip(page.texts, page.owners, page.blocks)):
        if (not article or article in owners) and not listed[k]:
            blocks.setdefault(block, []).append(text)
    lines = [" ".join("".join(parts).split()) for parts in blocks.values()]
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text of each page as ``text_col``.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by a line break in page order. A null or empty page, and
    one without any text, gives an empty text. An existing ``text_col`` is
    replaced. Rows are independent of each other and nothing is shuffled.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    kept = pages.select(*[f"`{c}`" for c in others], html_col)
    schema = kept.drop(html_col).selectExpr("*", f"'' AS `{text_col}`").schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(x).encode("utf-8", "replace").decode()
                for x in batch.column(html_col).cast(pa.string()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(texts, pa.string())], [*others, text_col]
            )

    return kept.mapInArrow(task, schema)
