"""Sample tables seen as engine tables.

The engine knows mentions, bars, documents, a dictionary and so on. These
functions derive them from the star-schema sample tables, lazily and row by
row, so every query grows with its table. ``catalog`` builds the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import session_close
from buzzlens.sources.quotes import LISTED, OTC, QuoteFeed, parse_quotes, union_quotes

# Timestamps in the files carry no zone; reading them as instants under a UTC
# session lets filters on them reach the Parquet scan.
TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


SPREAD_BYTES = 64 << 20  # of the largest table that is dealt out


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One sample table with its explicit schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}.parquet")


def dealt(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``table`` for work that takes long per row.

    A table of at most ``SPREAD_BYTES``, which Spark would read in a few splits,
    is dealt out evenly first. A larger one is worked on where it lies.
    """
    rows = table(spark, directory, name)
    return rows.repartition(spark.sparkContext.defaultParallelism) if _is_small(rows) else rows


def _is_small(rows: DataFrame) -> bool:
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= SPREAD_BYTES


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``dealt`` as a stream of the table's files."""
    stored = table(spark, directory, name)
    files = stored.inputFiles()
    reader = spark.readStream.schema(TABLES[name])
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    else:
        rows = reader.parquet(f"{directory}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism) if _is_small(stored) else rows


# Activity as mentions and bars


def event_mentions(spark: SparkSession, directory: str, read=table) -> DataFrame:
    """One mention of stock ``user_id`` per event; the event type is the source."""
    return read(spark, directory, "events").select(
        F.col("user_id").cast("string").alias("stock_code"),
        F.col("event_type").alias("source_type"),
        "ts",
        F.lit(1).cast("bigint").alias("mention_count"),
        "event_id",
    )


def event_bars(spark: SparkSession, directory: str) -> DataFrame:
    """One bar per user and day: first, highest, lowest, last and summed value."""
    amount = F.col("value").cast("decimal(18,4)")
    moment = F.struct("ts", "event_id")
    days = (
        table(spark, directory, "events")
        .groupBy(
            F.col("user_id").cast("string").alias("stock_code"),
            F.to_date("ts").alias("trading_date"),
        )
        .agg(
            F.min_by(amount, moment).alias("open"),
            F.max(amount).alias("high"),
            F.min(amount).alias("low"),
            F.max_by(amount, moment).alias("close"),
            F.floor(F.sum(amount)).cast("bigint").alias("volume"),
        )
    )
    return days.select(
        "stock_code",
        F.lit(LISTED.market).alias("market"),
        "trading_date",
        session_close(F.col("trading_date")).alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


# Order lines as quotes


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def raw_quotes(
    spark: SparkSession, directory: str, feed: QuoteFeed, read=dealt
) -> DataFrame:
    """Order lines written as text quotes of one exchange.

    Lines without discount look suspended, lines with tax 0.08 have a broken
    date; both must be dropped by the parser.
    """
    lines = read(spark, directory, "lineitem")
    suspended = F.col("l_discount") == 0
    dash = "--" if feed is LISTED else "---"
    spread = F.col("l_quantity").cast("decimal(18,2)")

    def quoted(value: Column, digits: int) -> Column:
        return F.when(suspended, F.lit(dash)).otherwise(F.format_number(value, digits))

    year = F.lpad((F.year("l_shipdate") - 1911).cast("string"), 3, "0")
    roc = F.concat(year, F.date_format("l_shipdate", "MMdd"))
    shares = (F.col("l_quantity") * 1000).cast("bigint")
    return lines.select(
        F.when(F.col("l_tax") == 0.08, F.lit("12345")).otherwise(roc).alias(feed.date),
        F.concat(F.lit("P"), F.col("l_partkey")).alias(feed.code),
        F.concat(F.lit("Supplier "), F.col("l_suppkey")).alias(feed.name),
        quoted(_money("l_extendedprice"), 2).alias(feed.open),
        quoted(_money("l_extendedprice") + spread, 2).alias(feed.high),
        quoted(_money("l_extendedprice") - spread, 2).alias(feed.low),
        quoted(_money("l_extendedprice") + _money("l_discount"), 2).alias(feed.close),
        F.when(suspended, F.lit("0" if feed is OTC else dash))
        .otherwise(F.format_number(shares, 0))
        .alias(feed.volume),
        F.format_number(shares * 7, 0).alias(feed.turnover),
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
    )


def quote_texts(spark: SparkSession, directory: str, feed: QuoteFeed) -> DataFrame:
    """Every order line as one poll of an exchange: a JSON array of its quote.

    Fifth lines show their quote twice, sixth lines are empty polls and seventh
    lines are cut in the middle.
    """
    raw = raw_quotes(spark, directory, feed)
    quote = F.to_json(F.struct(*[n for n in feed.schema.fieldNames() if n in raw.columns]))
    line = F.col("l_linenumber")
    text = (
        F.when(line == 5, F.concat(F.lit("["), quote, F.lit(", "), quote, F.lit("]")))
        .when(line == 6, F.lit("[]"))
        .when(line == 7, F.concat(F.lit("["), F.substr(quote, F.lit(1), F.lit(40))))
        .otherwise(F.concat(F.lit("["), quote, F.lit("]")))
    )
    return raw.select("l_orderkey", "l_linenumber", text.alias("value"))


def item_texts(spark: SparkSession, directory: str) -> DataFrame:
    """``rss_items`` as XML elements; each fiftieth document lost its end."""
    items = rss_items(spark, directory)
    fields = [n for n in items.columns if n != "document_id"]
    parts = [
        F.when(F.col(n).isNull(), F.lit("")).otherwise(
            F.concat(F.lit(f"<{n}>"), _escaped(F.col(n)), F.lit(f"</{n}>"))
        )
        for n in fields
    ]
    whole = F.concat(F.lit("<item>"), *parts, F.lit("</item>"))
    cut = F.concat(F.lit("<item>"), *parts[:1], F.lit("<link>"))
    text = F.when(F.col("document_id").cast("bigint") % 50 == 0, cut).otherwise(whole)
    return items.select("document_id", text.alias("value"))


def quote_bars(spark: SparkSession, directory: str) -> DataFrame:
    """Bars of both exchanges: returned lines are listed, the others OTC."""
    listed = raw_quotes(spark, directory, LISTED).filter(F.col("l_returnflag") == "R")
    otc = raw_quotes(spark, directory, OTC).filter(F.col("l_returnflag") != "R")
    return union_quotes(parse_quotes(listed, LISTED), parse_quotes(otc, OTC))


def written_bars(spark: SparkSession, directory: str) -> DataFrame:
    """Every order line as a bar, with the columns that tell the write order."""
    price = _money("l_extendedprice")
    day = F.to_date("l_shipdate")
    return dealt(spark, directory, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("stock_code"),
        F.lit(LISTED.market).alias("market"),
        day.alias("trading_date"),
        session_close(day).alias("ts"),
        price.alias("close"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        "l_orderkey",
        "l_linenumber",
    )


BAR_WRITE_ORDER = ["l_orderkey", "l_linenumber", "close", "volume"]


# Texts as documents

MINUTES_IN_30_DAYS = 43_200


def documents(spark: SparkSession, directory: str, read=table) -> DataFrame:
    """Texts as documents: first line is the title, the rest the content.

    ``lang`` and ``source`` are kept for the queries to tell rows apart.
    """
    number = F.col("doc_id")
    kinds = F.array(*[F.lit(s) for s in schemas.SOURCE_TYPES])
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    forum = number % 6 == 0
    votes = (number * 7 % 40).cast("int")
    minute = (number * 7919 % MINUTES_IN_30_DAYS).cast("int")
    return read(spark, directory, "documents").select(
        number.cast("string").alias("document_id"),
        kinds[(number % 6).cast("int")].alias("source_type"),
        F.when(forum, F.concat(F.lit("user"), number % 97)).alias("author"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minute)).alias(
            "published_at"
        ),
        F.concat(F.lit("https://example.org/id/"), number).alias("url"),
        F.when(forum, votes).alias("upvotes"),
        F.when(forum, (number % 5).cast("int")).alias("downvotes"),
        F.when(forum, (number % 3).cast("int")).alias("arrows"),
        "lang",
        "source",
    )


def rss_items(spark: SparkSession, directory: str) -> DataFrame:
    """Texts as feed items; some sources lack a title, link, date, guid or id."""
    docs = documents(spark, directory, dealt)
    source, number = F.col("source"), F.col("document_id")
    local = F.date_format(
        F.col("published_at") + F.expr("INTERVAL 8 HOURS"), "EEE, d MMM yyyy HH:mm:ss"
    )
    address = F.when(
        source == "src4", F.concat(F.lit("https://example.org/story-"), number)
    ).otherwise(F.concat(F.lit("https://example.org/news/id/"), number))
    return docs.select(
        F.when(source == "src0", F.lit(" "))
        .otherwise(F.concat(F.lit(" Story "), number, F.lit("\n")))
        .alias("title"),
        F.when(source != "src1", address).alias("link"),
        F.concat(F.lit("<p><b>"), "title", F.lit("</b></p>"), "content").alias("description"),
        F.when(source == "src2", F.lit("2026-03-24"))
        .otherwise(F.concat(local, F.lit(" +0800")))
        .alias("pubDate"),
        F.when(source != "src3", address).alias("guid"),
        "document_id",
    )


def _escaped(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    less = F.replace(amp, F.lit("<"), F.lit("&lt;"))
    return F.replace(less, F.lit(">"), F.lit("&gt;"))


def forum_index_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Texts as index pages: one entry per line, blank lines are deleted posts."""
    lines = F.split("text", "\n")
    entry = F.transform(
        lines,
        lambda line, i: F.concat(
            F.lit('<div class="r-ent">\n<div class="title">\n'),
            F.when(F.trim(line) == "", F.lit("(deleted)")).otherwise(
                F.concat(
                    F.lit('<a href="/bbs/Stock/M.'),
                    F.col("doc_id").cast("string"),
                    F.lit(".A."),
                    i.cast("string"),
                    F.lit('.html"> '),
                    _escaped(line),
                    F.lit("</a>"),
                )
            ),
            F.lit('</div><div class="meta"><div class="author">'),
            F.col("source"),
            F.lit("</div></div></div>"),
        ),
    )
    html = F.concat(F.lit("<html><body>"), F.array_join(entry, "\n"), F.lit("</body></html>"))
    return dealt(spark, directory, "documents").select("doc_id", html.alias("html"))


def forum_listing_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Index pages that list ten documents each by their ids, one of them deleted."""
    number = F.col("document_id").cast("bigint")
    entry = F.concat(
        F.lit('<div class="r-ent"><div class="title">'),
        F.when(number % 10 == 3, F.lit("(deleted)")).otherwise(
            F.concat(F.lit('<a href="/bbs/Stock/'), F.col("document_id"), F.lit('.html">x</a>'))
        ),
        F.lit('</div><div class="author">y</div></div>'),
    )
    page = F.floor(number / 10).alias("page")
    listed = documents(spark, directory).select(page, entry.alias("entry"))
    return listed.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("entry")), "").alias("html"))


def forum_article_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as article pages with labels, votes and nested blocks.

    The title comes twice, the last one counts; a ``span`` of a removed class
    holds another one, and votes hold blocks of their own.

    Pages of source ``src5`` show a wrong weekday and those of ``src6`` have no
    body, so neither gives a document.
    """
    docs = documents(spark, directory, dealt)
    local = F.col("published_at") + F.expr("INTERVAL 8 HOURS")
    wrong = F.date_format(local + F.expr("INTERVAL 1 DAY"), "EEE")
    weekday = F.when(F.col("source") == "src5", wrong).otherwise(F.date_format(local, "EEE"))
    time = F.concat_ws(" ", weekday, F.date_format(local, "MMM  d HH:mm:ss yyyy"))

    def label(css: str, name: str, value: Column) -> Column:
        return F.concat(
            F.lit(f'<div class="{css}"><span class="article-meta-tag">{name}</span>'),
            F.lit('<span class="article-meta-value">'),
            value,
            F.lit("</span></div>"),
        )

    def votes(mark: str, count: Column) -> Column:
        row = F.lit(
            f'<div class="push"><div>3.</div><span class="hl push-tag">{mark} </span>'
            '<span class="push-content">: 推<div>!</div></span></div>'
        )
        return F.array_join(F.array_repeat(row, F.coalesce(count, F.lit(0))), "")

    body_id = F.when(F.col("source") == "src6", F.lit("other")).otherwise(F.lit("main-content"))
    html = F.concat(
        F.lit('<html><body><div id="'),
        body_id,
        F.lit('" class="bbs-screen">'),
        label("article-metaline", "作者", F.concat(F.coalesce("author", F.lit("anon")), F.lit(" (x)"))),
        label("article-metaline-right", "看板", F.lit("Stock")),
        label("article-metaline", "標題", F.lit("Draft")),
        F.lit('<span class="old article-metaline-note">no <span>text</span> here</span>'),
        label("article-metaline", "標題", _escaped(F.col("title"))),
        label("article-metaline", "時間", time),
        _escaped(F.col("content")),
        F.lit('<div class="rich"><div>[inner]</div></div>'),
        votes("推", F.col("upvotes")),
        votes("噓", F.col("downvotes")),
        votes("→", F.col("arrows")),
        F.lit('</div><div id="footer">not content</div></body></html>'),
    )
    return docs.select("document_id", "url", html.alias("html"))


# Dictionary

# Keywords that occur in the sample texts: overlapping, inside each other,
# shared by two entities, listed twice, empty, across the title joint.
SAMPLE_KEYWORDS = [
    (1, "ti"), (1, "tion"), (2, "titi"), (3, "the"), (4, "the"), (5, "eau"), (5, "eau"),
    (6, "sch"), (6, "schsch"), (7, ""), (7, "é"), (8, "e t"), (9, "aux"), (9, "2330"),
]
FIRST_WORD_ENTITY = 1_000
FIRST_PART_ENTITY = 100_000


def match_aliases(spark: SparkSession, directory: str) -> DataFrame:
    """Keywords to match: sample keywords, words of ``benchmark``, all parts."""
    fixed = spark.createDataFrame(SAMPLE_KEYWORDS, "entity_id bigint, keyword string")
    words = (
        table(spark, directory, "benchmark")
        .select(
            (F.col("item_id") + FIRST_WORD_ENTITY).alias("entity_id"),
            F.explode(
                F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0))
            ).alias("keyword"),
        )
    )
    parts = table(spark, directory, "part").select(
        (F.col("p_partkey") + FIRST_PART_ENTITY).alias("entity_id"),
        F.explode(F.array(F.concat(F.lit("P"), F.col("p_partkey")), "p_name")).alias("keyword"),
    )
    return fixed.unionByName(words).unionByName(parts)


def match_entities(spark: SparkSession, directory: str) -> DataFrame:
    """Entities of ``match_aliases``; sample entities 4 and 8 have no code."""
    fixed = spark.createDataFrame(
        [(i, None if i in (4, 8) else str(i)) for i in range(1, 10)],
        "entity_id bigint, stock_code string",
    )
    words = table(spark, directory, "benchmark").select(
        (F.col("item_id") + FIRST_WORD_ENTITY).alias("entity_id"),
        (F.col("item_id") + 10).cast("string").alias("stock_code"),
    )
    parts = table(spark, directory, "part").select(
        (F.col("p_partkey") + FIRST_PART_ENTITY).alias("entity_id"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("stock_code"),
    )
    return fixed.unionByName(words).unionByName(parts)


def entities(spark: SparkSession, directory: str) -> DataFrame:
    """Dictionary entities: parts are stocks, nations are concepts."""
    stocks = table(spark, directory, "part").select(
        (F.col("p_partkey") + 1).alias("entity_id"),
        F.lit("Stock").alias("type"),
        F.col("p_name").alias("primary_name"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("stock_code"),
    )
    concepts = table(spark, directory, "nation").select(
        (-F.col("n_nationkey") - 1).cast("bigint").alias("entity_id"),
        F.lit("Concept").alias("type"),
        F.col("n_name").alias("primary_name"),
        F.lit(None).cast("string").alias("stock_code"),
    )
    return stocks.unionByName(concepts)


def aliases(spark: SparkSession, directory: str) -> DataFrame:
    """Two aliases per stock (code, name) and one per concept."""
    keyword = F.when(
        F.col("type") == "Stock", F.array("stock_code", "primary_name")
    ).otherwise(F.array("primary_name"))
    return entities(spark, directory).select(
        "entity_id", F.posexplode(keyword).alias("place", "keyword")
    ).select(
        (F.col("entity_id") * 2 + F.col("place")).alias("alias_id"), "entity_id", "keyword"
    )


# Concepts, reviews and vectors


def capital_words(title: Column, content: Column) -> Column:
    """Sample extractor: capitalised words of six letters or more."""
    text = F.concat(title, F.lit(" "), content)
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z]{5,}"), 0)


def review_texts(spark: SparkSession, directory: str, read=table) -> DataFrame:
    """Order lines as chat messages that approve or reject concepts, or neither."""
    verb = (
        F.when(F.col("o_orderstatus") == "F", F.lit(" /Approve "))
        .when(F.col("o_orderstatus") == "O", F.lit("/reject  "))
        .otherwise(F.lit("hello "))
    )
    number = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("soon")).otherwise(
        F.col("o_custkey").cast("string")
    )
    return read(spark, directory, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(verb, number).alias("text")
    )


VECTOR_LENGTH = 64


def embeddings(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors as document embeddings; those labelled 9 lost their last value."""
    short = F.slice("embedding", 1, VECTOR_LENGTH - 1)
    return table(spark, directory, "embeddings").select(
        F.col("vec_id").cast("string").alias("document_id"),
        F.when(F.col("label") == 9, short).otherwise(F.col("embedding")).alias("embedding"),
        F.lit(None).cast("float").alias("sentiment"),
        (F.lit("2024-01-01").cast("timestamp")).alias("processed_at"),
        "label",
    )
