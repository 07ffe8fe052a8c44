"""Forum pages: an index page to its entries, an article page to a document.

Input is a table with ``html`` and any key columns. All work is per row in the
JVM, so a page is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import forum_timestamp
from buzzlens.functions.elements import marks, outside, pieces, within
from buzzlens.functions.rows import computed_once
from buzzlens.functions.text import (
    decode_entities,
    file_stem,
    first_word,
    strip_space,
    strip_tags,
)


@dataclass(frozen=True)
class IndexLayout:
    """How an index page marks an entry, its anchor (href, title) and author."""

    entry: str
    anchor: str
    author: str


@dataclass(frozen=True)
class ArticleLayout:
    """How an article page marks its body and the start tags in it.

    ``labels`` and ``vote`` are blocks that are read and removed, ``removed``
    other elements that are removed. A block of ``labels`` holds a label and its
    value, one of ``vote`` a mark.
    """

    body: str
    labels: str
    label: str
    value: str
    vote: str
    vote_tag: str
    removed: str


# Mark-up of the forum's pages.
FORUM_INDEX = IndexLayout(
    entry=r"""(?i)<div\b[^>]*\bclass\s*=\s*["']r-ent["'][^>]*>""",
    anchor=(
        r"""(?is)<div\b[^>]*\bclass\s*=\s*["']title["'][^>]*>[^<]*"""
        r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    ),
    author=r"""(?is)<div\b[^>]*\bclass\s*=\s*["']author["'][^>]*>(.*?)</div>""",
)
_CLASS = r"""\b[^>]*?\sclass\s*=\s*["']%s["'][^>]*>"""
_METALINE, _PUSH = _CLASS % "[^\"']*article-metaline[^\"']*", _CLASS % "push"
FORUM_ARTICLE = ArticleLayout(
    body=r"""(?i)<div\b[^>]*\bid\s*=\s*["']main-content["'][^>]*>""",
    labels=f"(?i)^<div{_METALINE}",
    label=f"(?is)<span{_CLASS % 'article-meta-tag'}(.*?)</span>",
    value=f"(?is)<span{_CLASS % 'article-meta-value'}(.*?)</span>",
    vote=f"(?i)^<div{_PUSH}",
    vote_tag=f"(?is)<span{_CLASS % '[^\"\']*push-tag[^\"\']*'}(.*?)</span>",
    removed=f"(?i)^<[a-z][a-z0-9]*(?:{_METALINE}|{_PUSH})",
)
# Mark-up in scripts, styles and comments opens and closes nothing.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
AUTHOR_LABEL, TITLE_LABEL, TIME_LABEL = "作者", "標題", "時間"
UP_MARK, DOWN_MARK, ARROW_MARK = "推", "噓", "→"


def index_entries(
    pages: DataFrame, keys: list[str], layout: IndexLayout = FORUM_INDEX
) -> DataFrame:
    """Entries of index pages as ``(*keys, pos, article_id, title, author, href)``.

    Entries without an anchor (deleted posts) or with an empty id are dropped.
    """
    parts = F.split(F.regexp_replace("html", HIDDEN, ""), layout.entry)
    entries = pages.select(*keys, F.posexplode(F.slice(parts, F.lit(2), F.size(parts))))
    href = F.regexp_extract("col", layout.anchor, 1)
    title = decode_entities(strip_space(strip_tags(F.regexp_extract("col", layout.anchor, 2))))
    author = strip_space(strip_tags(F.regexp_extract("col", layout.author, 1)))
    rows = computed_once(
        entries.filter(F.col("col").rlike(layout.anchor)),
        **{key: F.col(key) for key in keys},
        pos=F.col("pos"),
        article_id=file_stem(href),
        title=title,
        author=author,
        href=href,
    )
    return rows.filter(F.col("article_id") != "")


def _inside_div(after_open: Column) -> Column:
    """Text up to the ``</div>`` that closes a div opened just before the text."""
    pieces = F.split(after_open, r"(?i)(?=<div\b|</div\s*>)")
    # Each piece but the first starts with a div tag; depth -1 is the closing one.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("kept"))

    def step(state: Column, part: Column) -> Column:
        depth = (
            F.when(state["depth"] < 0, state["depth"])
            .when(F.lower(F.substring(part, 1, 5)) == "</div", state["depth"] - 1)
            .when(F.lower(F.substring(part, 1, 4)) == "<div", state["depth"] + 1)
            .otherwise(state["depth"])
        )
        kept = state["kept"] + F.when(depth < 0, 0).otherwise(1)
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    kept = F.aggregate(pieces, start, step)["kept"]
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def article_documents(pages: DataFrame, layout: ArticleLayout = FORUM_ARTICLE) -> DataFrame:
    """Documents of article pages ``(document_id, url, html)``.

    A page without a body or without a readable time gives no row. Of several
    blocks with one label the last counts; an element of any name is removed
    when its class says so, with all it holds.
    """
    # Nothing follows the opening tag on a page without one. Exploding also keeps
    # the body from being worked out again for every column and the filter.
    visible = F.regexp_replace("html", HIDDEN, "")
    after_open = F.slice(F.split(visible, layout.body, 2), 2, 1)
    bodies = pages.select(
        "document_id", "url", F.explode(F.transform(after_open, _inside_div)).alias("body")
    )
    keys = {"document_id": F.col("document_id"), "url": F.col("url")}
    cut = computed_once(bodies, **keys, tags=pieces(F.col("body")))
    kinds = {"m": layout.labels, "p": layout.vote, "x": layout.removed}
    marked = computed_once(cut, **keys, marked=marks(F.col("tags"), kinds))

    def inner(block: Column, pattern: str) -> Column:
        return strip_space(strip_tags(F.regexp_extract(block, pattern, 1)))

    blocks = computed_once(
        marked,
        **keys,
        labels=F.transform(
            within(F.col("marked"), "m"),
            lambda m: F.struct(inner(m, layout.label).alias("label"), inner(m, layout.value).alias("value")),
        ),
        votes=F.transform(within(F.col("marked"), "p"), lambda v: inner(v, layout.vote_tag)),
        content=strip_space(decode_entities(strip_tags(outside(F.col("marked"))))),
    )

    def labelled(label: str) -> Column:
        named = F.filter("labels", lambda x: x["label"] == label)
        return F.coalesce(F.get(F.reverse(named), F.lit(0))["value"], F.lit(""))

    found = computed_once(
        blocks,
        **keys,
        author=first_word(labelled(AUTHOR_LABEL)),
        title=labelled(TITLE_LABEL),
        published_at=forum_timestamp(labelled(TIME_LABEL)),
        votes=F.col("votes"),
        content=F.col("content"),
    ).filter(F.col("published_at").isNotNull())

    def count(mark: str) -> Column:
        return F.size(F.filter("votes", lambda v: v.startswith(mark)))

    return found.select(
        "document_id",
        F.lit(schemas.FORUM_SOURCE).alias("source_type"),
        "author",
        "title",
        "content",
        "published_at",
        "url",
        count(UP_MARK).alias("upvotes"),
        count(DOWN_MARK).alias("downvotes"),
        count(ARROW_MARK).alias("arrows"),
    )


def tagged_text(html: Column, tag: str) -> Column:
    """Decoded inner text of the first ``<tag>`` element, trimmed; NULL if absent."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    text = strip_space(decode_entities(strip_tags(F.regexp_extract(html, pattern, 1))))
    return F.when(html.rlike(pattern), text)
