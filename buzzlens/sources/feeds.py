"""News feeds (RSS) to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import rss_timestamp
from buzzlens.functions.rows import computed_once
from buzzlens.functions.text import news_id, strip_space, strip_tags
from buzzlens.sources.quotes import CORRUPT

RSS_ITEM = "title string, link string, description string, pubDate string, guid string"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Raw ``item`` elements of the feed files below ``path``.

    An item that is not well formed has its text in ``CORRUPT``
    (``quotes.unreadable`` picks them).
    """
    reader = spark.read.format("xml").schema(f"{RSS_ITEM}, {CORRUPT} string")
    return reader.option("rowTag", "item").option("columnNameOfCorruptRecord", CORRUPT).load(path)


def decode_items(texts: DataFrame, column: str = "value") -> DataFrame:
    """Raw items of texts that hold one ``item`` element each; other columns are kept.

    A text that is not well formed has itself in ``CORRUPT``.
    """
    others = [F.col(c) for c in texts.columns if c != column]
    options = {"columnNameOfCorruptRecord": CORRUPT}
    item = F.from_xml(column, f"{RSS_ITEM}, {CORRUPT} string", options)
    return texts.select(*others, item.alias("_item")).select(*others, "_item.*")


def parse_items(items: DataFrame, source_type: str = schemas.NEWS_SOURCE) -> DataFrame:
    """Documents of raw items.

    Items without title or link, with an unreadable date or with an empty id
    are dropped. The id comes from ``guid`` where there is one, else ``link``.
    """
    title, link = strip_space(F.col("title")), strip_space(F.col("link"))
    guid = strip_space(F.col("guid"))
    documents = computed_once(
        items,
        document_id=news_id(F.coalesce(guid, link)),
        source_type=F.lit(source_type),
        title=title,
        content=strip_space(strip_tags(F.coalesce("description", F.lit("")))),
        published_at=rss_timestamp(F.col("pubDate")),
        url=link,
    )
    return documents.filter(
        (F.col("title") != "")
        & (F.col("url") != "")
        & F.col("published_at").isNotNull()
        & (F.col("document_id") != "")
    )
