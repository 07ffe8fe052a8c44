"""The document table: union, checks, batches and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import days_before, instant
from buzzlens.functions.text import too_long
from buzzlens.operators.ids import IdIndex
from buzzlens.operators.keyed import first_row, insert_if_absent
from buzzlens.operators.paging import page_of

BATCH_SIZE = 50
MEMORY_DAYS = 7
ARTICLE_PAGE = 25


def union_documents(*frames: DataFrame) -> DataFrame:
    """All documents in the common schema; columns a source lacks are NULL."""
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result.select(
        *[
            (F.col(name) if name in result.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in schemas.DOCUMENTS.items()
        ]
    )


def check_documents(documents: DataFrame) -> DataFrame:
    """Add ``error``: NULL for a document the table accepts, else the reason."""
    required = ["document_id", "source_type", "title", "content", "published_at"]
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    unknown = F.when(
        ~F.col("source_type").isin(*schemas.SOURCE_TYPES), F.lit("source_type unknown")
    )
    return documents.withColumn(
        "error", F.coalesce(*missing, unknown, too_long(["title", "url"]))
    )


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; rejected rows keep the reason in ``error``."""
    checked = check_documents(documents)
    return (
        checked.filter(F.col("error").isNull()).drop("error"),
        checked.filter(F.col("error").isNotNull()),
    )


def insert_new(batch: DataFrame, index: IdIndex, before: int | None = None) -> DataFrame:
    """Documents of ``batch`` whose id ``index`` does not hold, the first of each id.

    The stored documents are not read: the index answers from the folders that
    the ids of the batch fall into. Rows without an id are left out.
    """
    order = [F.col("published_at"), F.col("title"), F.col("content")]
    named = batch.filter(F.col("document_id").isNotNull())
    return first_row(index.absent(named, "document_id", before), ["document_id"], order)


def new_documents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of ``batch`` to append. Stored ones win, so votes stay frozen."""
    order = [F.col("published_at"), F.col("title"), F.col("content")]
    return insert_if_absent(batch, documents, "document_id", order)


def recent_ids(documents: DataFrame, source_type: str, as_of) -> DataFrame:
    """Ids of one source published in the 7 days before ``as_of`` or later."""
    return documents.filter(
        (F.col("source_type") == source_type)
        & (F.col("published_at") >= days_before(instant(as_of), MEMORY_DAYS))
    ).select("document_id")


def document(documents: DataFrame, document_id: str) -> DataFrame:
    """The document with this id, or no row."""
    return documents.filter(F.col("document_id") == document_id)


DAY = "series_day"  # the folder of a document in a table by day


def _picked(documents: DataFrame, *more: str) -> DataFrame:
    """The narrow columns that a pick works on."""
    day = [DAY] if DAY in documents.columns else []
    return documents.select("document_id", "published_at", *more, *day)


def _fetch(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Whole rows of a few chosen ids: content is read only here.

    The limit tells Spark how small ``chosen`` is, so it is broadcast. In a
    table by day (``sources.days``) the chosen days prune the folders while the
    query runs: texts of other days are not read. A document always has a day.
    """
    keys = ["document_id"]
    if DAY in documents.columns:
        keys.append(DAY)
        # Spark prunes by a side that has a filter of its own.
        chosen = chosen.filter(F.col(DAY) >= F.lit("0001-01-01").cast("date"))
    return documents.join(chosen.select(*keys), keys, "left_semi")


def unprocessed_batch(
    documents: DataFrame, status: DataFrame, size: int = BATCH_SIZE
) -> DataFrame:
    """Oldest ``size`` documents without a processed mark.

    The pick works on ids and dates; whole rows are read for the picked only.
    """
    done = status.filter(F.col("processed_at").isNotNull()).select("document_id")
    order = [F.asc("published_at"), F.asc("document_id")]
    open_ids = _picked(documents).join(done, "document_id", "left_anti")
    picked = open_ids.orderBy(*order).limit(size)
    return _fetch(documents, picked).orderBy(*order).limit(size)


def hot_documents(
    documents: DataFrame, status: DataFrame, size: int = 10, min_upvotes: int = 10
) -> DataFrame:
    """Top documents for concept extraction, most votes first, then oldest.

    Processed, with a match, not probed; forum posts need ``min_upvotes``, news
    (no votes) always qualify. The pick works on narrow columns only.
    """
    ready = status.filter(
        F.col("processed_at").isNotNull()
        & (F.col("entity_match_count") > 0)
        & F.col("probed_at").isNull()
    ).select("document_id")
    order = [
        F.coalesce("upvotes", F.lit(0)).desc(),
        F.asc("published_at"),
        F.asc("document_id"),
    ]
    hot = _picked(documents, "upvotes").filter(
        F.col("upvotes").isNull() | (F.col("upvotes") >= min_upvotes)
    )
    picked = hot.join(ready, "document_id", "left_semi").orderBy(*order).limit(size)
    return _fetch(documents, picked).orderBy(*order).limit(size)


def mark_probed(status: DataFrame, probed: DataFrame, now) -> DataFrame:
    """Status table with ``probed_at`` set for the probed ids, found or not."""
    marked = probed.select("document_id", F.lit(True).alias("_probed"))
    return status.join(marked, "document_id", "left").select(
        "document_id",
        "processed_at",
        "entity_match_count",
        F.when(F.col("_probed"), instant(now)).otherwise(F.col("probed_at")).alias("probed_at"),
    )


def matching_articles(
    documents: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    title: str | None = None,
    source_type: str = schemas.FORUM_SOURCE,
) -> DataFrame:
    """Documents of one source; each given bound narrows the result.

    ``date_to`` includes the whole day, a blank ``title`` is ignored, and the
    title search is a case-sensitive substring test.
    """
    found = documents.filter(F.col("source_type") == source_type)
    if date_from:
        found = found.filter(F.col("published_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        next_day = F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp")
        found = found.filter(F.col("published_at") < next_day)
    if title and title.strip():
        found = found.filter(F.contains("title", F.lit(title)))
    return found


def article_search(
    documents: DataFrame,
    *,
    date_from: str | None = None,
    date_to: str | None = None,
    title: str | None = None,
    sort: str = "newest",
    page: int = 1,
    size: int = ARTICLE_PAGE,
) -> DataFrame:
    """One page of forum articles, newest or most upvoted (none first) first."""
    found = matching_articles(documents, date_from, date_to, title).drop("content")
    main = "upvotes" if sort == "upvotes" else "published_at"
    order = [F.desc_nulls_first(main), F.asc("document_id")]
    return page_of(found, order, page, size, [main, "document_id"])
