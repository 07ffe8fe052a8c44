"""Named queries: every operator applied to the sample tables.

``QUERIES`` maps a name to ``(spark, directory) -> DataFrame``. Results are put
in a plain form (text for instants and days, bigint, double rounded to six
digits) so that other engines can be compared with them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buzzlens import schemas
from buzzlens.functions.dates import forum_timestamp, instant, roc_date, rss_timestamp
from buzzlens.operators import concepts as con
from buzzlens.operators import dictionary as dic
from buzzlens.operators import documents as doc
from buzzlens.operators import embeddings as emb
from buzzlens.operators import matching, mentions, paging, snapshot
from buzzlens.operators.ids import IdIndex
from buzzlens.operators.keyed import existing_keys
from buzzlens.plans import bindings as b
from buzzlens.plans.signals import alert_messages, signals
from buzzlens.session import configure, scratch_path
from buzzlens.sources import feeds, pages, series
from buzzlens.sources.days import keep_days, read_days
from buzzlens.sources.quotes import (
    CORRUPT, LISTED, OTC, bar_series, decode_quotes, parse_quotes, unreadable,
)
from buzzlens.streaming import jobs
from buzzlens.streaming.supervise import supervise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Analysis instant and window that suit the 30 days of the sample tables.
AS_OF = "2024-01-19 00:00:00"
WINDOW = timedelta(days=2)
SLOT = timedelta(hours=6)
DECIMALS = 6
READ_FROM, REWRITTEN_DAY = "2024-01-05 12:00:00", "2024-01-10"


def plain(df: DataFrame) -> DataFrame:
    """Columns in engine-neutral types."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.FractionalType):
            column = F.round(column.cast("double"), DECIMALS)
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(function: Query) -> Query:
    """Register ``function`` under its name, without a trailing ``_query``."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return plain(function(configure(spark), directory))

    run.__doc__ = function.__doc__
    QUERIES[function.__name__.removesuffix("_query")] = run
    return function


# Quotes and bars


@query
def quotes_twse(spark, directory):
    """Listed quotes parsed from text."""
    raw = b.raw_quotes(spark, directory, LISTED)
    return parse_quotes(raw, LISTED)


@query
def quotes_tpex(spark, directory):
    """OTC quotes parsed from text."""
    raw = b.raw_quotes(spark, directory, OTC)
    return parse_quotes(raw, OTC)


@query
def feed_listed_json(spark, directory):
    """Bars of listed quotes decoded from JSON polls."""
    raw = decode_quotes(b.quote_texts(spark, directory, LISTED), LISTED)
    return parse_quotes(raw, LISTED)


@query
def feed_otc_json(spark, directory):
    """Bars of OTC quotes decoded from JSON polls."""
    raw = decode_quotes(b.quote_texts(spark, directory, OTC), OTC)
    return parse_quotes(raw, OTC)


@query
def feed_rejected(spark, directory):
    """What could not be read in the JSON polls and the XML items."""

    def polls(feed):
        bad = unreadable(decode_quotes(b.quote_texts(spark, directory, feed), feed))
        key = F.concat_ws("-", "l_orderkey", "l_linenumber")
        return bad.select(F.lit(feed.market).alias("feed"), key.alias("key"), CORRUPT)

    items = unreadable(feeds.decode_items(b.item_texts(spark, directory))).select(
        F.lit("rss").alias("feed"), F.col("document_id").alias("key"), CORRUPT
    )
    rows = polls(LISTED).unionByName(polls(OTC)).unionByName(items)
    return rows.select("feed", "key", F.sha2(CORRUPT, 256).alias("text_sha256"))


@query
def bars_round_trip(spark, directory):
    """Bars written by day, one day written again, and a range read back."""
    bars = b.event_bars(spark, directory)
    path = scratch_path(spark, "bar-series")
    series.write_series(bars, path, day=F.col("trading_date"))
    again = bars.filter(F.col("trading_date") == F.lit(REWRITTEN_DAY).cast("date"))
    again = again.withColumn("volume", F.col("volume") + 1)
    series.write_series(again, path, day=F.col("trading_date"), mode="overwrite")
    columns = {c: k for c, k in bars.dtypes}
    return series.read_series(spark, path, READ_FROM, AS_OF, columns)


@query
def mentions_round_trip(spark, directory):
    """Mentions written by day, one day written again, and a range read back."""
    points = b.event_mentions(spark, directory)
    path = scratch_path(spark, "mention-series")
    day = F.to_date("ts")
    series.write_series(points, path, day=day)
    again = points.filter(day == F.lit(REWRITTEN_DAY).cast("date"))
    again = again.withColumn("mention_count", F.col("mention_count") + 1)
    series.write_series(again, path, day=day, mode="overwrite")
    columns = {c: k for c, k in points.dtypes}
    return series.read_series(spark, path, READ_FROM, AS_OF, columns)


@query
def bars_series(spark, directory):
    """Bars of both exchanges as points of the price series."""
    return bar_series(b.quote_bars(spark, directory))


@query
def bars_lww(spark, directory):
    """One bar per stock, market and day: the one written last."""
    order = [F.col(c) for c in b.BAR_WRITE_ORDER]
    return series.latest_bars(b.written_bars(spark, directory), order)


@query
def roc_dates(spark, directory):
    """ROC-calendar dates, some of them malformed."""
    day, kind = F.col("o_orderdate"), F.col("o_orderpriority")
    year = F.year(day) - 1911
    text = (
        F.when(kind == "1-URGENT", F.concat(F.lit("ABC"), F.date_format(day, "MMdd")))
        .when(kind == "2-HIGH", F.concat(year.cast("string"), F.date_format(day, "MMdd")))
        .when(kind == "3-MEDIUM", F.concat(F.lpad(year.cast("string"), 3, "0"), F.lit("0230")))
        .otherwise(F.concat(F.lpad(year.cast("string"), 3, "0"), F.date_format(day, "MMdd")))
    )
    orders = b.table(spark, directory, "orders").select("o_orderkey", text.alias("raw"))
    return orders.withColumn("trading_date", roc_date(F.col("raw")))


@query
def forum_dates(spark, directory):
    """Forum dates at UTC+8; urgent orders carry a wrong weekday."""
    local = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_custkey") % 86_400)
    weekday = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.date_format(local + F.expr("INTERVAL 1 DAY"), "EEE"),
    ).otherwise(F.date_format(local, "EEE"))
    raw = F.concat_ws(" ", weekday, F.date_format(local, "MMM  d HH:mm:ss yyyy"))
    orders = b.table(spark, directory, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select("o_orderkey", forum_timestamp(F.col("raw")).alias("published_at"))


@query
def rss_dates(spark, directory):
    """RFC 822 dates with several offsets; low-priority orders use another format."""
    local = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_custkey") % 86_400)
    offset = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "-0530")
        .when(F.col("o_orderpriority") == "2-HIGH", "+0000")
        .otherwise("+0800")
    )
    weekday = F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("")).otherwise("Mon, ")
    raw = F.when(
        F.col("o_orderpriority") == "5-LOW", F.date_format(local, "yyyy-MM-dd")
    ).otherwise(F.concat(weekday, F.date_format(local, "d MMM yyyy HH:mm:ss "), offset))
    orders = b.table(spark, directory, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select("o_orderkey", rss_timestamp(F.col("raw")).alias("published_at"))


# Pages and feeds


@query
def rss_items(spark, directory):
    """Feed items to documents."""
    return feeds.parse_items(b.rss_items(spark, directory))


# The sample pages list links in ``<li>`` and have no author.
PAGE_INDEX = pages.IndexLayout(
    entry=r"(?i)<li\b[^>]*>",
    anchor=r"""(?is)^\s*<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>""",
    author=r"(?is)<address>(.*?)</address>",
)


@query
def feed_rss_xml(spark, directory):
    """Documents of feed items decoded from XML."""
    return feeds.parse_items(feeds.decode_items(b.item_texts(spark, directory)))


@query
def page_links(spark, directory):
    """Links listed on web pages."""
    return pages.index_entries(
        b.dealt(spark, directory, "pages"), ["page_id"], PAGE_INDEX
    )


@query
def page_articles(spark, directory):
    """Title and article text of web pages."""
    html = F.col("html")
    found = b.dealt(spark, directory, "pages").select(
        "page_id",
        "url",
        pages.tagged_text(html, "title").alias("title"),
        pages.tagged_text(html, "article").alias("content"),
    )
    return found.filter(F.col("content").isNotNull())


@query
def forum_index(spark, directory):
    """Entries of forum index pages."""
    return pages.index_entries(b.forum_index_pages(spark, directory), ["doc_id"])


@query
def forum_articles(spark, directory):
    """Documents and vote counts of forum article pages."""
    return pages.article_documents(b.forum_article_pages(spark, directory))


# Mentions


@query
def keyword_hits(spark, directory):
    """Occurrences per document, entity and keyword."""
    return matching.keyword_counts(
        b.documents(spark, directory, b.dealt), b.match_aliases(spark, directory)
    )


@query
def keyword_hits_large(spark, directory):
    """The same hits on the way a dictionary takes that is too large to broadcast."""
    return matching.keyword_counts(
        b.documents(spark, directory, b.dealt),
        b.match_aliases(spark, directory),
        max_broadcast_rows=0,
    )


def _points(spark, directory, docs=None):
    return mentions.mention_points(
        b.documents(spark, directory, b.dealt) if docs is None else docs,
        b.match_aliases(spark, directory),
        b.match_entities(spark, directory),
    )


@query
def doc_entity_mentions(spark, directory):
    """Mentions per document and entity with the entity's stock code."""
    return matching.coded_counts(
        b.documents(spark, directory, b.dealt),
        b.match_aliases(spark, directory),
        b.match_entities(spark, directory),
    )


def _status(spark, directory):
    docs = b.documents(spark, directory, b.dealt)
    counts = matching.entity_counts(
        matching.keyword_hits(docs, b.match_aliases(spark, directory))
    )
    return matching.mark_processed(docs, counts, AS_OF)


@query
def doc_match_count(spark, directory):
    """Status rows of processed documents."""
    return _status(spark, directory)


@query
def mentions_series(spark, directory):
    """Mention points of documents."""
    return _points(spark, directory)


@query
def mentions_lww(spark, directory):
    """Mention points as a store with second precision keeps them."""
    order = [F.col("document_id").cast("bigint"), F.col("entity_id")]
    return series.latest_mentions(_points(spark, directory), order)


@query
def mention_counts(spark, directory):
    """Mentions per stock in one time range."""
    return mentions.mention_counts(
        b.event_mentions(spark, directory), "2024-01-05 00:00:00", AS_OF
    )


@query
def mention_delta(spark, directory):
    """Current window against the one before."""
    return mentions.mention_deltas(b.event_mentions(spark, directory), AS_OF, WINDOW)


@query
def mention_delta_history(spark, directory):
    """Every six-hour window against the one before."""
    return mentions.mention_delta_history(b.event_mentions(spark, directory), SLOT)


# Signals


@query
def ohlcv_snapshot(spark, directory):
    """Last and previous close, last and mean volume."""
    return snapshot.ohlcv_snapshot(b.event_bars(spark, directory), AS_OF)


@query
def signals_query(spark, directory):
    """Signals of the sample events."""
    return signals(
        b.event_mentions(spark, directory),
        b.event_bars(spark, directory),
        AS_OF,
        window=WINDOW,
    )


@query
def document_signals(spark, directory):
    """Signals of matched documents against the bars of the sample events."""
    docs = b.documents(spark, directory, b.dealt)
    end = instant(AS_OF)
    docs = series.time_range(docs, end - F.lit(2 * WINDOW), end, "published_at")  # of both windows
    return signals(
        _points(spark, directory, docs), b.event_bars(spark, directory), AS_OF, window=WINDOW
    )


@query
def alert_messages_query(spark, directory):
    """Messages of the alerts."""
    return alert_messages(signals_query(spark, directory))


# Documents


@query
def documents_union(spark, directory):
    """News and forum documents in one schema."""
    news = feeds.parse_items(b.rss_items(spark, directory))
    forum = pages.article_documents(b.forum_article_pages(spark, directory))
    return doc.union_documents(forum, news)


@query
def doc_validate(spark, directory):
    """Documents with the reason they would be refused, if any."""
    checked = doc.check_documents(b.documents(spark, directory))
    return checked.select("document_id", "source_type", "error")


@query
def doc_insert_if_absent(spark, directory):
    """Documents to append when the English ones are stored already."""
    docs = b.documents(spark, directory)
    index = IdIndex(spark, scratch_path(spark, "ids"))
    index.add(docs.filter(F.col("lang") == "en"), "document_id", 0)
    batch = docs.unionByName(docs.withColumn("published_at", F.lit(AS_OF).cast("timestamp")))
    return doc.insert_new(batch, index).select("document_id", "title", "published_at")


@query
def recent_ids(spark, directory):
    """Forum ids of the last seven days."""
    return doc.recent_ids(b.documents(spark, directory), schemas.FORUM_SOURCE, AS_OF)


def _part_status(spark, directory, read=b.table):
    """Status in which English documents are processed and French ones probed."""
    at = F.lit(AS_OF).cast("timestamp")
    return b.documents(spark, directory, read).select(
        "document_id",
        F.when(F.col("lang") != "es", at).alias("processed_at"),
        F.when(F.col("lang") == "de", 0).otherwise(1).alias("entity_match_count"),
        F.when(F.col("lang") == "fr", at).alias("probed_at"),
    )


def _documents_by_day(spark, directory):
    """The documents as a job stores them: by day."""
    path = scratch_path(spark, "documents-by-day")
    keep_days(b.documents(spark, directory), path, 0, F.to_date("published_at"), schemas.DOCUMENTS)
    return read_days(spark, path, schemas.DOCUMENTS)


@query
def unprocessed_batch(spark, directory):
    """Oldest 50 documents without a processed mark."""
    batch = doc.unprocessed_batch(
        _documents_by_day(spark, directory), _part_status(spark, directory)
    )
    return batch.select("document_id", "source_type", "title", "published_at")


@query
def hot_documents(spark, directory):
    """Top 10 documents for concept extraction."""
    hot = doc.hot_documents(_documents_by_day(spark, directory), _part_status(spark, directory))
    return hot.select("document_id", "source_type", "published_at", "upvotes")


@query
def doc_status_after_probe(spark, directory):
    """Status table after the hot documents were probed."""
    status = _part_status(spark, directory)
    hot = doc.hot_documents(b.documents(spark, directory), status)
    return doc.mark_probed(status, hot, "2024-02-01 00:00:00")


@query
def doc_lookup(spark, directory):
    """One document by id."""
    return doc.document(b.documents(spark, directory), "42").select(
        "document_id", "source_type", "title", "published_at"
    )


ARTICLE_FILTER = {"date_from": "2024-01-03", "date_to": "2024-01-20", "title": "e"}
_ARTICLE_COLUMNS = ["document_id", "title", "author", "published_at", "upvotes"]


@query
def article_search(spark, directory):
    """Second page of forum articles by votes, filtered."""
    found = doc.article_search(
        b.documents(spark, directory), sort="upvotes", page=2, size=5, **ARTICLE_FILTER
    )
    return found.select(*_ARTICLE_COLUMNS)


@query
def article_newest(spark, directory):
    """First page of forum articles, newest first."""
    return doc.article_search(b.documents(spark, directory)).select(*_ARTICLE_COLUMNS)


@query
def page_totals(spark, directory):
    """Rows and pages of an article search."""
    found = doc.matching_articles(b.documents(spark, directory), **ARTICLE_FILTER)
    return paging.page_totals(found, doc.ARTICLE_PAGE)


# Dictionary


def _stored_dictionary(spark, directory):
    parts = b.table(spark, directory, "part").select(
        (F.col("p_partkey") + 1).alias("entity_id"), "p_type"
    )
    kept = parts.filter(F.col("p_type") == "ECONOMY").select("entity_id")
    entities, aliases = b.entities(spark, directory), b.aliases(spark, directory)
    return (
        entities.join(kept, "entity_id", "left_semi"),
        aliases.join(kept, "entity_id", "left_semi"),
    )


@query
def whitelist_sync(spark, directory):
    """Aliases and entities to add for quoted stocks that are not stored."""
    entities, aliases = _stored_dictionary(spark, directory)
    new_entities, new_aliases = dic.sync_dictionary(
        b.quote_bars(spark, directory), entities, aliases
    )
    return new_aliases.join(new_entities, "entity_id")


@query
def entity_add(spark, directory):
    """Hand-made entities with their aliases; some requests are refused."""
    kind = (
        F.when(F.col("p_size") < 20, F.lit("Stock"))
        .when(F.col("p_size") < 40, F.lit("Concept"))
        .otherwise(F.lit("Person"))
    )
    requests = b.table(spark, directory, "part").select(
        F.col("p_partkey").alias("request_id"),
        kind.alias("type"),
        F.when(F.col("p_type") != "SMALL", F.concat(F.lit(" N"), "p_partkey", F.lit(" ")))
        .otherwise(F.lit(" "))
        .alias("stock_code"),
        F.when(F.col("p_type") != "LARGE", F.concat(F.lit("\t"), "p_name")).alias("name"),
    )
    entities, aliases = _stored_dictionary(spark, directory)
    new_entities, new_aliases = dic.add_entities(requests, entities, aliases)
    return new_aliases.join(new_entities, "entity_id")


@query
def entity_refused(spark, directory):
    """Requests for entities with the reason they are refused."""
    requests = b.table(spark, directory, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_size") < 20, F.lit("Stock")).otherwise(F.lit("Concept")).alias("type"),
        F.when(F.col("p_type") != "SMALL", F.col("p_brand")).alias("stock_code"),
        F.when(F.col("p_type") != "LARGE", F.col("p_name")).otherwise(F.lit(" ")).alias("name"),
    )
    return dic.check_entity_requests(requests)


@query
def alias_edit(spark, directory):
    """Alias table after a round of additions and deletions."""
    entities, aliases = b.entities(spark, directory), b.aliases(spark, directory)
    parts = b.table(spark, directory, "part")
    entity_id = F.col("p_partkey") + 1
    wanted = parts.select(
        F.when(F.col("p_type") == "PROMO", -entity_id * 1000).otherwise(entity_id).alias("entity_id"),
        F.when(F.col("p_type") == "SMALL", F.lit("  "))
        .when(F.col("p_type") == "LARGE", F.col("p_name"))
        .otherwise(F.concat(F.lit(" "), "p_brand", F.lit("\n")))
        .alias("keyword"),
    )
    wanted = wanted.unionByName(wanted)
    removals = parts.filter(F.col("p_size") > 25).select(
        entity_id.alias("entity_id"), (entity_id * 2 + F.col("p_size") % 3).alias("alias_id")
    )
    added = dic.add_aliases(wanted, entities, aliases)
    return dic.delete_aliases(removals, aliases).unionByName(added)


@query
def cascade_delete(spark, directory):
    """Aliases left after the large parts were deleted."""
    removals = (
        b.table(spark, directory, "part")
        .filter(F.col("p_type") == "LARGE")
        .select((F.col("p_partkey") + 1).alias("entity_id"))
    )
    entities, aliases = dic.delete_entities(
        removals, b.entities(spark, directory), b.aliases(spark, directory)
    )
    return dic.entity_aliases(entities, aliases)


@query
def entity_aliases(spark, directory):
    """Entities with their aliases."""
    return dic.entity_aliases(b.entities(spark, directory), b.aliases(spark, directory))


@query
def entity_search(spark, directory):
    """Third page of entities whose code or name contains ``1``."""
    return dic.entity_search(
        b.entities(spark, directory), b.aliases(spark, directory), "1", page=3
    )


@query
def entity_last_page(spark, directory):
    """Last page of all entities: those without a code come last."""
    return dic.entity_search(
        b.entities(spark, directory), b.aliases(spark, directory), page=1_000_000
    )


# Concepts


def _found(spark, directory, stored: bool):
    docs = b.documents(spark, directory, b.dealt)
    english = F.col("lang") == "en"
    return con.found_concepts(docs.filter(english if stored else ~english), b.capital_words)


def _no_concepts_yet(spark):
    return spark.createDataFrame([], schemas.ddl(schemas.CONCEPTS))


def _stored_concepts(spark, directory):
    first = con.upsert_concepts(
        _found(spark, directory, True), _no_concepts_yet(spark), "2024-02-01 00:00:00"
    )
    return first.withColumn("approved", F.col("appearance_count") == 2)


@query
def concept_upsert(spark, directory):
    """Concepts of the English documents merged with those of all others."""
    return con.upsert_concepts(
        _found(spark, directory, False), _stored_concepts(spark, directory), "2024-03-01 00:00:00"
    )


@query
def concept_refused(spark, directory):
    """Lines of the documents that are missing or too long as concepts."""
    lines = lambda title, content: F.split(F.concat(title, F.lit("\n"), content), "\n")
    found = con.found_concepts(b.documents(spark, directory, b.dealt), lines)
    refused = con.refused_words(con.concept_changes(found, _no_concepts_yet(spark), AS_OF))
    return refused.select(F.sha2("keyword", 256).alias("keyword_sha256"), "reason", "seen_count")


@query
def pending_concepts(spark, directory):
    """Top five concepts waiting for a verdict."""
    return con.pending_concepts(_stored_concepts(spark, directory))


@query
def concept_review_messages(spark, directory):
    """Review messages of the top five pending concepts."""
    return con.review_messages(con.pending_concepts(_stored_concepts(spark, directory)))


@query
def review_commands(spark, directory):
    """Outcome and reply of every review command."""
    commands = con.parse_commands(b.review_texts(spark, directory))
    return con.review_outcomes(commands, _stored_concepts(spark, directory))


@query
def apply_reviews(spark, directory):
    """Concept table after the review commands."""
    commands = con.parse_commands(b.review_texts(spark, directory))
    concepts, _, _ = con.apply_reviews(
        commands,
        _stored_concepts(spark, directory),
        b.entities(spark, directory),
        b.aliases(spark, directory),
    )
    return concepts.select("concept_id", "keyword", "appearance_count", "approved")


@query
def promoted_concepts(spark, directory):
    """Entities and aliases that the review commands created."""
    commands = con.parse_commands(b.review_texts(spark, directory))
    _, entities, aliases = con.apply_reviews(
        commands,
        _stored_concepts(spark, directory),
        b.entities(spark, directory),
        b.aliases(spark, directory),
    )
    return entities.join(aliases, "entity_id")


# Vectors


def _vector_facts(df):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select(
        "document_id",
        F.size("embedding").alias("dimension"),
        F.element_at("embedding", 1).cast("double").alias("first_value"),
        F.round(total, 4).alias("total"),
    )


@query
def embedding_insert(spark, directory):
    """Vectors to append: right dimension and not stored yet."""
    vectors = b.embeddings(spark, directory)
    stored = vectors.filter(F.col("label") < 3)
    return _vector_facts(emb.new_embeddings(vectors, stored, b.VECTOR_LENGTH))


@query
def existing_embeddings(spark, directory):
    """Documents that already have a vector."""
    return existing_keys(
        b.documents(spark, directory).select("document_id"),
        b.embeddings(spark, directory),
        "document_id",
    )


@query
def embed_documents(spark, directory):
    """Default vectors of matched documents that have none."""
    docs = b.documents(spark, directory, b.dealt)
    hits = matching.keyword_hits(docs, b.match_aliases(spark, directory))
    matched = hits.select("document_id").distinct()
    vectors = emb.embed_documents(docs, matched, b.embeddings(spark, directory), AS_OF)
    return _vector_facts(vectors)


# Streams: the same results from Structured Streaming jobs that run until their
# input is used up. Tables and checkpoints go to new folders in the shared folder.


def _places(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/table", f"{base}/checkpoint"


def _in_turns(spark, parts, start):
    """Let parts of a table arrive one after another; a job starts again for each.

    ``start`` gets the stream of all files so far and returns the running job,
    which goes on from its checkpoint: every part is a micro-batch of its own.
    """
    landing = scratch_path(spark, "landing")
    for part in parts:
        part.write.mode("append").parquet(landing)
        files = len(spark.read.schema(part.schema).parquet(landing).inputFiles())
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(landing)
        start(stream).awaitTermination()


def _half(number, odd):
    """Whether a document is of the odd or of the even half."""
    return (number.cast("bigint") % 2 == 1) if odd else (number.cast("bigint") % 2 == 0)


@query
def stream_quotes(spark, directory):
    """Bars kept by the quote stream, last write wins."""
    raw = b.raw_quotes(spark, directory, LISTED, read=b.stream_table)
    path, checkpoint = _places(spark, "quotes")
    jobs.keep_bars(parse_quotes(raw, LISTED), path, checkpoint).awaitTermination()
    return jobs.stored_bars(spark, path).select(
        "stock_code", "trading_date", "close", "volume"
    )


LANDED_ROWS = 1 << 19  # of a file of polls


def _quote_files(spark, directory):
    """Folder of a quote job that has read JSON files in three turns, one per return flag."""
    texts = b.quote_texts(spark, directory, LISTED).withColumn("flag", F.col("l_linenumber") % 3)
    base = scratch_path(spark, "quote-files")
    for flag in range(3):
        polls = texts.filter(F.col("flag") == flag).select("value")
        # A compressed file is read by one task: many files of one size.
        landed = polls.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", LANDED_ROWS)
        landed.text(f"{base}/landing")
        stream = jobs.quote_stream(spark, f"{base}/landing", LISTED, json_array=False)
        jobs.keep_quotes(
            stream, LISTED, f"{base}/bars", f"{base}/rejected", f"{base}/checkpoint", counters=f"{base}/counters"
        ).awaitTermination()
    return base


@query
def stream_quote_files(spark, directory):
    """Bars of a quote job that has read JSON files in three turns, and what it could not read."""
    base = _quote_files(spark, directory)
    bars = jobs.stored_bars(spark, f"{base}/bars").select("stock_code", "trading_date", "close", "volume")
    bad = jobs.read_table(spark, f"{base}/rejected", schemas.UNREADABLE)
    return bars.withColumn("text_sha256", F.lit(None).cast("string")).unionByName(
        bad.select(F.sha2(CORRUPT, 256).alias("text_sha256")), allowMissingColumns=True
    )


@query
def stream_counters(spark, directory):
    """Run counters of that job: bars kept and texts not read, by batch."""
    base = _quote_files(spark, directory)
    return jobs.stored_counters(spark, f"{base}/counters", "quotes")


@query
def stream_supervised(spark, directory):
    """Bars of two exchanges; the second one's job dies once and is started again."""
    base = scratch_path(spark, "supervised")
    trouble = iter((True, False))

    def job(feed):
        def start():
            raw = b.raw_quotes(spark, directory, feed, read=b.stream_table)
            if feed is OTC and next(trouble):
                raw = raw.withColumn(feed.name, F.raise_error(F.lit("exchange is down")).cast("string"))
            place = f"{base}/{feed.market}"
            return jobs.keep_bars(parse_quotes(raw, feed), place, f"{place}-checkpoint", name=feed.market)

        return start

    outcomes = supervise(spark, {feed.market: job(feed) for feed in (LISTED, OTC)}, restarts=1, pause=0.1)
    kept = [
        jobs.stored_bars(spark, f"{base}/{market}").withColumn("starts", F.lit(outcome.starts))
        for market, outcome in outcomes.items()
    ]
    return kept[0].unionByName(kept[1]).select("market", "stock_code", "trading_date", "close", "volume", "starts")


@query
def stream_documents(spark, directory):
    """Documents kept by the document stream, each id once, those too long refused."""
    docs = b.documents(spark, directory, read=b.stream_table)
    path, checkpoint = _places(spark, "documents")
    jobs.keep_documents(docs.unionByName(docs), path, checkpoint).awaitTermination()
    kept = jobs.stored_documents(spark, path)
    return kept.select("document_id", "source_type", "title", "published_at")


@query
def stream_seen_ids(spark, directory):
    """What the memory of ids lets through: even documents, then all, published 60 days earlier."""
    docs = b.documents(spark, directory)
    early = docs.withColumn("published_at", F.col("published_at") - F.expr("INTERVAL 60 DAYS"))
    path, checkpoint = _places(spark, "seen")
    even = docs.filter(_half(F.col("document_id"), odd=False))
    _in_turns(spark, [even, early, docs], lambda stream: jobs.keep_seen(stream, path, checkpoint))
    kept = jobs.read_table(spark, path, schemas.DOCUMENTS)
    return kept.select("document_id", "published_at")


@query
def stream_forum(spark, directory):
    """Documents that the forum job stores: index pages, unseen entries, article pages."""
    pages_of = b.forum_article_pages(spark, directory)
    index_pages = b.forum_listing_pages(spark, directory)
    path, checkpoint = _places(spark, "forum")

    def articles(entries):
        return pages_of.join(entries.select(F.col("article_id").alias("document_id")), "document_id", "left_semi")

    even = index_pages.filter(F.col("page") % 2 == 0)
    _in_turns(spark, [even, index_pages], lambda stream: jobs.keep_forum(stream, articles, path, checkpoint))
    return jobs.stored_documents(spark, path).drop("series_day")


@query
def stream_news(spark, directory):
    """Documents that the news job stores from feed items that come twice."""
    items = b.rss_items(spark, directory).drop("document_id")
    path, checkpoint = _places(spark, "news")
    _in_turns(spark, [items, items], lambda stream: jobs.keep_news(stream, path, checkpoint))
    return jobs.stored_documents(spark, path).drop("series_day")


@query
def stream_mentions(spark, directory):
    """Mention points kept by the matching stream."""
    docs = b.documents(spark, directory, read=b.stream_table)
    path, checkpoint = _places(spark, "mentions")

    def dictionary():
        return b.match_aliases(spark, directory), b.match_entities(spark, directory)

    jobs.keep_mentions(docs, dictionary, path, checkpoint).awaitTermination()
    return jobs.stored_mentions(spark, path).drop("dictionary_version")


@query
def stream_mentions_refreshed(spark, directory):
    """Mention points of two batches; entity 6 and the parts enter the dictionary between them."""
    docs = b.documents(spark, directory)
    path, checkpoint = _places(spark, "refreshed")
    versions = iter((1, 2))

    def dictionary():
        version = next(versions)
        aliases = b.match_aliases(spark, directory)
        if version == 1:
            late = (F.col("entity_id") == 6) | (F.col("entity_id") >= b.FIRST_PART_ENTITY)
            aliases = aliases.filter(~late)
        return aliases, b.match_entities(spark, directory), version

    halves = [docs.filter(_half(F.col("document_id"), odd)) for odd in (False, True)]
    _in_turns(spark, halves, lambda stream: jobs.keep_mentions(stream, dictionary, path, checkpoint))
    return jobs.stored_mentions(spark, path)


def _bars_between(spark, directory):
    def bars(start, stop):
        return series.time_range(b.event_bars(spark, directory), start, stop)

    return bars


@query
def stream_signals(spark, directory):
    """Alerts kept by the signal stream at the instant after the last event."""
    points = b.event_mentions(spark, directory, read=b.stream_table)
    path, checkpoint = _places(spark, "alerts")
    jobs.keep_alerts(points, _bars_between(spark, directory), path, checkpoint, window=WINDOW).awaitTermination()
    return jobs.stored_alerts(spark, path).drop("batch_id")


@query
def stream_signals_in_turns(spark, directory):
    """Alerts of two batches, handed over once although the second comes again."""
    events = b.event_mentions(spark, directory)
    path, checkpoint = _places(spark, "alerts-in-turns")
    cut = F.lit(AS_OF).cast("timestamp")
    told = []

    def start(stream):
        return jobs.keep_alerts(
            stream, _bars_between(spark, directory), path, checkpoint,
            notify=lambda alerts, batch_id: told.append(alerts), window=WINDOW,
        )

    _in_turns(spark, [events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut)], start)
    again = scratch_path(spark, "lost-checkpoint")  # both batches as one, under the number of the first
    stream = b.event_mentions(spark, directory, read=b.stream_table)
    jobs.keep_alerts(
        stream, _bars_between(spark, directory), path, again,
        notify=lambda alerts, batch_id: told.append(alerts), window=WINDOW,
    ).awaitTermination()
    handed = told[0]
    for more in told[1:]:
        handed = handed.unionByName(more)
    return handed


@query
def stream_review_messages(spark, directory):
    """Review messages handed over in three pushes; the last comes again and is not repeated."""
    ticks = b.review_texts(spark, directory)
    concepts = _stored_concepts(spark, directory).checkpoint()
    path, checkpoint = _places(spark, "pushed")
    told = []

    def start(stream):
        return jobs.keep_review_messages(
            stream, lambda: concepts, path, checkpoint, lambda n: f"2024-02-01 0{n}:30:00",
            send=lambda messages, batch_id: told.append(messages),
        )

    _in_turns(spark, [ticks.filter(F.col("seq") % 3 == n) for n in range(3)], start)
    jobs.keep_review_messages(
        b.review_texts(spark, directory, b.stream_table), lambda: concepts, path, scratch_path(spark, "lost"),
        lambda n: "2024-02-01 02:30:00", send=lambda messages, batch_id: told.append(messages),
    ).awaitTermination()
    handed = told[0]
    for more in told[1:]:
        handed = handed.unionByName(more)
    return handed.select("concept_id", "keyword", "message", "pushed_at")


@query
def stream_mention_deltas(spark, directory):
    """All six-hour windows against the ones before, late points included."""
    points = b.event_mentions(spark, directory, read=b.stream_table)
    path, checkpoint = _places(spark, "deltas")
    jobs.keep_window_sums(points, SLOT, path, checkpoint).awaitTermination()
    return jobs.stored_deltas(spark, path)


def _processed(spark, directory):
    """Folder of the tables that the processing stream fills."""
    path, checkpoint = _places(spark, "processed")
    jobs.store_vectors(b.embeddings(spark, directory).drop("label"), path)

    def dictionary():
        return b.match_aliases(spark, directory), b.match_entities(spark, directory)

    docs = b.documents(spark, directory, read=b.stream_table)
    jobs.keep_processed(docs, dictionary, path, checkpoint, lambda n: AS_OF).awaitTermination()
    return path


@query
def stream_process_status(spark, directory):
    """Status rows that the processing stream writes last."""
    path = _processed(spark, directory)
    return jobs.read_table(spark, f"{path}/status", schemas.DOC_STATUS).drop("batch_id")


@query
def stream_process_embeddings(spark, directory):
    """Vectors that the processing stream adds to the stored ones."""
    path = _processed(spark, directory)
    rows = jobs.read_table(spark, f"{path}/embeddings", schemas.EMBEDDINGS)
    return _vector_facts(rows.filter(F.col("batch_id") >= 0))


@query
def stream_probe_concepts(spark, directory):
    """Concepts that the probe stream finds in the hottest documents."""
    path, checkpoint = _places(spark, "probed")
    jobs.keep_probed(
        _part_status(spark, directory, b.stream_table),
        lambda: b.documents(spark, directory),
        path,
        checkpoint,
        lambda n: "2024-02-01 00:00:00",
        b.capital_words,
    ).awaitTermination()
    return jobs.stored_concepts(spark, path)


@query
def stream_reviews(spark, directory):
    """Concept table after the review stream."""
    path, checkpoint = _places(spark, "reviews")
    jobs.keep_reviews(
        b.review_texts(spark, directory, b.stream_table),
        _stored_concepts(spark, directory),
        lambda: (b.aliases(spark, directory), b.entities(spark, directory)),
        path,
        checkpoint,
    ).awaitTermination()
    concepts = jobs.stored_concepts(spark, path)
    return concepts.select("concept_id", "keyword", "appearance_count", "approved")
