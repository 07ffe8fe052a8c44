"""Streaming jobs.

Series and documents go to tables by day (``sources.days``), ids to an index
(``operators.ids``) and messages to a ledger (``outbox``); each of them takes a
batch as a whole or not at all, and a second time not at all. The other tables
get one folder ``batch_id=N`` per micro-batch, which a repeated batch overwrites.
So a restart after lost executors or a lost driver leaves each row once. Late
data is never dropped: it changes the day or window it belongs to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from buzzlens import schemas
from buzzlens.operators.concepts import (
    apply_reviews, no_concepts, parse_commands, pending_concepts, review_messages,
)
from buzzlens.operators.documents import insert_new, split_documents, union_documents
from buzzlens.operators.embeddings import DIMENSION, zero_vector
from buzzlens.operators.ids import IdIndex
from buzzlens.operators.keyed import counted
from buzzlens.operators.mentions import deltas_of_sums, mention_points, window_sums
from buzzlens.plans.processing import probe_documents, process_documents
from buzzlens.plans.signals import signals
from buzzlens.sources.commits import remove
from buzzlens.sources.days import is_done, keep_days, read_days
from buzzlens.sources.feeds import parse_items
from buzzlens.sources.pages import article_documents, index_entries
from buzzlens.sources.quotes import CORRUPT, QuoteFeed, kept_schema, parse_once, parsed_bars, unreadable
from buzzlens.sources.series import BAR_IDENTITY
from buzzlens.streaming.outbox import deliver, delivered

# How often each job runs.
INTERVALS = {
    "quotes": "5 minutes",
    "forum": "60 seconds",
    "news": "60 seconds",
    "processing": "30 seconds",
    "probe": "120 seconds",
    "signals": "900 seconds",
    "review": "30 minutes",
}
AVAILABLE_NOW = {"availableNow": True}
SECOND_SUMS = {"stock_code": "string", "ts": "timestamp", "mention_count": "bigint"}
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
OLD_VERSIONS = 4  # batches after which a version of a table is removed
PRICE_DAYS = 11  # days of bars a price snapshot can look back on


def every(job: str) -> dict[str, str]:
    """Trigger of a job that keeps running."""
    return {"processingTime": INTERVALS[job]}


def create_table(spark: SparkSession, path: str, columns: Mapping[str, str]) -> None:
    """Make an empty batch table unless it exists."""
    empty = spark.createDataFrame([], schemas.ddl(dict(columns)))
    empty.write.mode("ignore").parquet(f"{path}/batch_id=-1")


def read_table(
    spark: SparkSession, path: str, columns: Mapping[str, str], before: int | None = None
) -> DataFrame:
    """Rows of a batch table with their ``batch_id``, optionally of earlier batches."""
    stored = schemas.ddl({**columns, "batch_id": "bigint"})
    rows = spark.read.schema(stored).option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def _write_batch(rows: DataFrame, path: str, batch_id: int, columns: Mapping[str, str]) -> None:
    typed = rows.select(*[F.col(n).cast(k).alias(n) for n, k in columns.items()])
    typed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def compact(
    spark: SparkSession, path: str, target: str, columns: Mapping[str, str], through: int
) -> None:
    """Copy a batch table to ``target`` with batches up to ``through`` in one folder.

    Meant for a table with many small batches: stop its job, compact, and start
    the job on ``target`` with the same checkpoint. Bars need their last write
    first: write ``stored_bars`` to the target's folder instead. A target that
    holds rows is refused, so that running it again never doubles them.
    """
    create_table(spark, target, columns)
    if read_table(spark, target, columns).limit(1).count():
        raise ValueError(f"{target} already holds rows; compact into a new folder")
    rows = read_table(spark, path, columns)
    old = rows.filter(F.col("batch_id") <= through)
    _write_batch(old, target, through, columns)
    recent = rows.filter(F.col("batch_id") > through)
    recent.write.mode("append").partitionBy("batch_id").parquet(target)


def _run(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: Mapping[str, object],
    name: str,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def quote_stream(
    spark: SparkSession, landing: str, feed: QuoteFeed, *, json_array: bool = True
) -> DataFrame:
    """Raw quotes of the files that arrive in ``landing``, for ``keep_quotes``."""
    reader = spark.readStream.schema(kept_schema(feed)).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("multiLine", json_array).json(landing)


COUNTERS = {"job": "string", "metric": "string", "rows": "bigint"}


def _keep_counters(spark: SparkSession, path: str | None, batch_id: int, job: str, counts: Mapping[str, int]) -> None:
    if path is not None:
        rows = spark.createDataFrame([(job, k, n) for k, n in counts.items()], schemas.ddl(COUNTERS))
        _write_batch(rows.coalesce(1), f"{path}/{job}", batch_id, COUNTERS)


def stored_counters(spark: SparkSession, path: str, job: str) -> DataFrame:
    """Run counters of a job: one row per batch and metric."""
    return read_table(spark, f"{path}/{job}", COUNTERS)


def _keep_bar_days(bars: DataFrame, path: str, batch_id: int, stored: bool = False) -> None:
    """One bar per stock, market and day: of the last batch, within a batch of the highest volume.

    All bars of a day are a few thousand small rows, so a folder holds a month.
    """
    order = [F.col(c) for c in ("volume", "turnover", "close", "stock_name")]
    keep_days(bars, path, batch_id, F.trunc("trading_date", "month"), schemas.BARS, BAR_IDENTITY, order, stored)


def keep_quotes(
    raw: DataFrame,
    feed: QuoteFeed,
    path: str,
    rejected: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "quotes",
    counters: str | None = None,
) -> StreamingQuery:
    """Keep the bars of raw quotes by day and what is not JSON in another table.

    ``counters`` names a table for the rows each batch kept and rejected;
    they are counted as they are written. A batch's texts are read once: what is
    parsed of them lies in ``staged`` below ``path`` until the batch is kept.
    """
    create_table(raw.sparkSession, rejected, schemas.UNREADABLE)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/staged"
        parsed = parse_once(batch, feed)
        parsed.write.mode("overwrite").parquet(staged)  # written twice
        try:
            parsed = spark.read.schema(parsed.schema).parquet(staged)
            bad, n_bad = counted(unreadable(parsed), f"unreadable-{batch_id}")
            _write_batch(bad, rejected, batch_id, schemas.UNREADABLE)
            bars, n_bars = counted(parsed_bars(parsed, feed), f"bars-{batch_id}")
            if is_done(spark, path, batch_id):
                return
            _keep_bar_days(bars, path, batch_id, stored=True)
            counts = {"kept": n_bars.get["rows"], "unreadable": n_bad.get["rows"]}
            _keep_counters(spark, counters, batch_id, name, counts)
        finally:
            remove(spark, staged)

    return _run(raw, handle, checkpoint, trigger, name)


def keep_bars(
    bars: DataFrame, path: str, checkpoint: str, trigger=AVAILABLE_NOW, name: str = "bars"
) -> StreamingQuery:
    """Keep a stream of bars by day; ``stored_bars`` reads it."""
    return _run(bars, lambda df, n: _keep_bar_days(df, path, n), checkpoint, trigger, name)


def stored_bars(spark: SparkSession, path: str, start=None, stop=None) -> DataFrame:
    """One bar per stock, market and day, optionally of ``[start, stop)`` only.

    Bars are stored merged, so nothing is compared here, and other months are not read.
    """
    return read_days(spark, path, schemas.BARS, start, stop, span=timedelta(days=32)).drop("series_day")


def drop_seen(documents: DataFrame, memory: str = "7 days") -> DataFrame:
    """Drop ids that arrived within ``memory`` before, in state.

    The memory runs on the time of arrival, so a document is never too old to
    enter, whatever its publish time; ids are forgotten ``memory`` after their
    last arrival that counted. Cheap when a source shows the same items at every
    poll. Rows without an id are one id. Use the RocksDB state store for many ids.
    """
    arrived = documents.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", memory)
    return arrived.dropDuplicatesWithinWatermark(["document_id"]).drop("_arrived")


def keep_seen(
    documents: DataFrame, path: str, checkpoint: str, trigger=AVAILABLE_NOW, name: str = "seen"
) -> StreamingQuery:
    """Append what ``drop_seen`` lets through."""
    create_table(documents.sparkSession, path, schemas.DOCUMENTS)
    handle = lambda df, n: _write_batch(df, path, n, schemas.DOCUMENTS)
    return _run(drop_seen(documents), handle, checkpoint, trigger, name)


def _insert(batch: DataFrame, path: str, batch_id: int) -> dict[str, int]:
    """Store the documents of a batch whose id is new, and count them."""
    spark = batch.sparkSession
    index = IdIndex(spark, f"{path}/ids")
    if index.commits.is_done(batch_id):
        return {}
    valid, refused = split_documents(batch.persist())
    try:
        fresh = insert_new(valid, index, batch_id).persist()  # written, then indexed
        try:
            keep_days(fresh, f"{path}/rows", batch_id, F.to_date("published_at"), schemas.DOCUMENTS)
            index.add(fresh, "document_id", batch_id)
            counts = {"read": batch.count(), "added": fresh.count(), "refused": refused.count()}
        finally:
            fresh.unpersist()
    finally:
        batch.unpersist()
    return counts


def keep_documents(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "documents",
    counters: str | None = None,
) -> StreamingQuery:
    """Keep valid documents whose id the table does not hold; stored ones win.

    A batch looks its ids up in the index and writes into the days it touches.
    What the table does not accept (``documents.check_documents``) is left out
    and counted as refused.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = _insert(batch, path, batch_id)
        if counts:
            _keep_counters(batch.sparkSession, counters, batch_id, name, counts)

    return _run(documents, handle, checkpoint, trigger, name)


def stored_documents(spark: SparkSession, path: str, start=None, stop=None) -> DataFrame:
    """Documents kept so far with their ``series_day``, optionally published in ``[start, stop)``."""
    return read_days(spark, f"{path}/rows", schemas.DOCUMENTS, start, stop, "published_at")


def keep_forum(
    index_pages: DataFrame,
    articles: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "forum",
    counters: str | None = None,
) -> StreamingQuery:
    """Ingest a forum: index pages ``html``, their unseen entries, the articles behind, new documents.

    ``articles`` gets the unseen entries ``(article_id, href)``, each once, and
    returns the pages it has of them as ``(document_id, url, html)``. A page that
    is no article gives no document, and its entry is asked for again when an
    index page shows it next.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        index = IdIndex(batch.sparkSession, f"{path}/ids")
        entries = index_entries(batch, []).select("article_id", "href")
        entries = entries.groupBy("article_id").agg(F.min("href").alias("href")).persist()
        try:
            unseen = index.absent(entries, "article_id", batch_id)
            counts = _insert(article_documents(articles(unseen)), path, batch_id)
            if counts:
                counts = {"entries": entries.count(), **counts}
                _keep_counters(batch.sparkSession, counters, batch_id, name, counts)
        finally:
            entries.unpersist()

    return _run(index_pages, handle, checkpoint, trigger, name)


def keep_news(
    items: DataFrame,
    path: str,
    checkpoint: str,
    source_type: str = schemas.NEWS_SOURCE,
    trigger=AVAILABLE_NOW,
    name: str = "news",
    counters: str | None = None,
) -> StreamingQuery:
    """Ingest a stream of raw feed items: documents whose id is new."""
    documents = union_documents(parse_items(items, source_type))
    return keep_documents(documents, path, checkpoint, trigger, name, counters)


STAMPED = {**schemas.MENTIONS, "dictionary_version": "bigint"}


def keep_mentions(
    documents: DataFrame,
    dictionary: Callable[[], tuple],
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "mentions",
) -> StreamingQuery:
    """Match a stream of documents and keep their mention points by day.

    ``dictionary`` returns ``(aliases, entities)`` or ``(aliases, entities,
    version)`` and is called per batch, so new entities match from the next
    batch on; each point is stamped with the version that matched.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        aliases, entities, *version = dictionary()
        points = mention_points(batch, aliases, entities)
        stamped = points.withColumn("dictionary_version", F.lit(version[0] if version else None).cast("bigint"))
        keep_days(stamped, path, batch_id, F.to_date("ts"), STAMPED)

    return _run(documents, handle, checkpoint, trigger, name)


def stored_mentions(spark: SparkSession, path: str, start=None, stop=None) -> DataFrame:
    """Mention points kept so far, optionally of ``[start, stop)`` only."""
    return read_days(spark, path, STAMPED, start, stop).drop("series_day")


def keep_processed(
    documents: DataFrame,
    dictionary: Callable[[], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    now: Callable[[int], str],
    embed: Callable[[Column], Column] = zero_vector,
    dimension: int = DIMENSION,
    trigger=AVAILABLE_NOW,
    name: str = "processing",
) -> StreamingQuery:
    """Match a stream of documents; append mentions, then vectors, then status.

    The tables are ``mentions``, ``embeddings`` and ``status`` below ``path``. A
    document has a status row only when its mentions and its vector are stored.
    ``now`` gives the instant of a batch by its number, so that a repeated batch
    writes the same rows.
    """
    spark = documents.sparkSession
    create_table(spark, f"{path}/embeddings", schemas.EMBEDDINGS)
    create_table(spark, f"{path}/status", schemas.DOC_STATUS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by each of the three
        try:
            index = IdIndex(batch.sparkSession, f"{path}/vector_ids")
            vectors = index.held(batch, "document_id", before=batch_id)
            aliases, entities = dictionary()
            done = process_documents(
                batch, aliases, entities, vectors, now(batch_id), embed, dimension
            )
            keep_days(done.mentions, f"{path}/mentions", batch_id, F.to_date("ts"), schemas.MENTIONS)
            _write_batch(done.embeddings, f"{path}/embeddings", batch_id, schemas.EMBEDDINGS)
            written = read_table(batch.sparkSession, f"{path}/embeddings", schemas.EMBEDDINGS)
            index.add(written.filter(F.col("batch_id") == batch_id), "document_id", batch_id)
            _write_batch(done.status, f"{path}/status", batch_id, schemas.DOC_STATUS)
        finally:
            batch.unpersist()

    return _run(documents, handle, checkpoint, trigger, name)


def store_vectors(vectors: DataFrame, path: str) -> None:
    """Make ``vectors`` the stored ones that ``keep_processed`` starts from."""
    _write_batch(vectors, f"{path}/embeddings", -1, schemas.EMBEDDINGS)
    IdIndex(vectors.sparkSession, f"{path}/vector_ids").add(vectors, "document_id", -1)


def _next_version(concepts: DataFrame, path: str, batch_id: int) -> None:
    """Write the concept table after a batch, and then that it is whole."""
    _write_batch(concepts, f"{path}/concepts", batch_id, schemas.CONCEPTS)
    number = concepts.sparkSession.createDataFrame([(batch_id,)], schemas.ddl(schemas.VERSIONS))
    _write_batch(number, f"{path}/versions", batch_id, schemas.VERSIONS)
    remove(concepts.sparkSession, f"{path}/concepts/batch_id={batch_id - OLD_VERSIONS}")


def _version(
    spark: SparkSession, path: str, version: int, table: str = "concepts", columns: Mapping[str, str] = schemas.CONCEPTS
) -> DataFrame:
    return spark.read.schema(schemas.ddl(dict(columns))).parquet(f"{path}/{table}/batch_id={version}")


def stored_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Newest whole version of a concept table that a job keeps."""
    newest = read_table(spark, f"{path}/versions", schemas.VERSIONS).agg(F.max("version")).first()[0]
    return _version(spark, path, -1 if newest is None else newest)


def keep_probed(
    status: DataFrame,
    documents: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    now: Callable[[int], str],
    extract: Callable[[Column, Column], Column] = no_concepts,
    size: int = 10,
    min_upvotes: int = 10,
    trigger=AVAILABLE_NOW,
    name: str = "probe",
) -> StreamingQuery:
    """Probe the hottest documents whenever status rows arrive and keep the concepts.

    ``status`` is a stream of status rows. Below ``path``, ``open`` has one
    version per batch of the documents that can still be picked, ``probed`` what
    was probed and ``concepts`` one version of the table per batch. A batch reads
    the versions of the batch before, however long the job has run, so a repeat
    gives the same; old versions are removed.
    """
    spark = status.sparkSession
    create_table(spark, f"{path}/open", schemas.DOC_STATUS)
    create_table(spark, f"{path}/probed", schemas.PROBED)
    create_table(spark, f"{path}/concepts", schemas.CONCEPTS)
    create_table(spark, f"{path}/versions", schemas.VERSIONS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Votes are frozen when a document is stored: what cannot be picked now never can.
        hot = F.col("upvotes").isNull() | (F.col("upvotes") >= min_upvotes)
        fresh = batch.filter(
            F.col("processed_at").isNotNull() & (F.col("entity_match_count") > 0) & F.col("probed_at").isNull()
        ).join(documents().filter(hot).select("document_id"), "document_id", "left_semi")
        before = _version(session, path, batch_id - 1, "open", schemas.DOC_STATUS)
        waiting = before.unionByName(fresh.select(*schemas.DOC_STATUS)).dropDuplicates(["document_id"])
        done = probe_documents(
            documents(), waiting, _version(session, path, batch_id - 1), now(batch_id),
            extract, size, min_upvotes,
        )
        marked = done.status.filter(F.col("probed_at").isNotNull())
        _write_batch(marked, f"{path}/probed", batch_id, schemas.PROBED)
        _write_batch(done.status.filter(F.col("probed_at").isNull()), f"{path}/open", batch_id, schemas.DOC_STATUS)
        _next_version(done.concepts, path, batch_id)
        remove(session, f"{path}/open/batch_id={batch_id - OLD_VERSIONS}")

    return _run(status, handle, checkpoint, trigger, name)


def keep_reviews(
    messages: DataFrame,
    concepts: DataFrame,
    dictionary: Callable[[], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "review",
) -> StreamingQuery:
    """Apply a stream of review messages ``(seq, text)`` batch by batch.

    ``concepts`` is the table to start from, written once; ``dictionary``
    returns the stored ``(aliases, entities)``. Below ``path``, ``concepts``
    has a version of the table per batch, ``entities`` and ``aliases`` the rows
    that approvals add.
    """
    spark = messages.sparkSession
    typed = concepts.select(*[F.col(n).cast(k).alias(n) for n, k in schemas.CONCEPTS.items()])
    typed.write.mode("ignore").parquet(f"{path}/concepts/batch_id=-1")
    create_table(spark, f"{path}/versions", schemas.VERSIONS)
    create_table(spark, f"{path}/entities", schemas.ENTITIES)
    create_table(spark, f"{path}/aliases", schemas.ALIASES)

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        aliases, entities = dictionary()
        added = read_table(session, f"{path}/entities", schemas.ENTITIES, before=batch_id)
        named = read_table(session, f"{path}/aliases", schemas.ALIASES, before=batch_id)
        commands = parse_commands(batch).persist()  # read by each of the three
        try:
            left, new_entities, new_aliases = apply_reviews(
                commands,
                _version(session, path, batch_id - 1),
                entities.select("entity_id").unionByName(added.select("entity_id")),
                aliases.select("alias_id").unionByName(named.select("alias_id")),
            )
            _write_batch(new_entities, f"{path}/entities", batch_id, schemas.ENTITIES)
            _write_batch(new_aliases, f"{path}/aliases", batch_id, schemas.ALIASES)
            _next_version(left, path, batch_id)
        finally:
            commands.unpersist()

    return _run(messages, handle, checkpoint, trigger, name)


def keep_window_sums(
    mentions: DataFrame,
    window: timedelta,
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    name: str = "window_sums",
) -> StreamingQuery:
    """Append what each batch adds to the sums of its windows; ``stored_deltas`` reads them.

    There is no watermark: a late point counts in its window whenever it comes,
    and the last windows are there too. No state is kept between batches.
    """
    create_table(mentions.sparkSession, path, schemas.WINDOW_SUMS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(window_sums(batch, window), path, batch_id, schemas.WINDOW_SUMS)

    return _run(mentions, handle, checkpoint, trigger, name)


def stored_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Each window against the one before, as far as points have come."""
    parts = read_table(spark, path, schemas.WINDOW_SUMS).groupBy("stock_code", "window_start")
    counts = ("current_count", "previous_count")
    return deltas_of_sums(parts.agg(*[F.sum(c).alias(c) for c in counts]))


def keep_alerts(
    mentions: DataFrame,
    bars: Callable[[str, str], DataFrame],
    path: str,
    checkpoint: str,
    trigger=AVAILABLE_NOW,
    notify: Callable[[DataFrame, int], None] | None = None,
    name: str = "alerts",
    window: timedelta = timedelta(minutes=15),
    **options,
) -> StreamingQuery:
    """Judge the newest window whenever mentions arrive; store and hand over the alerts.

    The job keeps its own sums per stock and second, by day, as of each batch. A
    batch is judged at the second after its newest mention, from the days of its
    two windows alone; what arrives later has no part in it, so a repeated batch
    gives the same alerts, and the ledger hands none over twice. ``bars`` returns
    the bars of ``[start, stop)``; ``notify`` gets the new alerts of a batch;
    ``options`` go to ``signals``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        second = F.date_trunc("second", "ts").alias("ts")
        sums = batch.groupBy("stock_code", second).agg(F.sum("mention_count").alias("mention_count"))
        keep_days(sums, f"{path}/sums", batch_id, F.to_date("ts"), SECOND_SUMS)
        newest = batch.agg(F.date_format(F.date_trunc("second", F.max("ts")), SECOND_FORMAT)).first()[0]
        if newest is None:
            return
        at = datetime.fromisoformat(newest) + timedelta(seconds=1)
        points = read_days(spark, f"{path}/sums", SECOND_SUMS, at - 2 * window, at)
        start = at - timedelta(days=PRICE_DAYS)
        alerts = signals(points, bars(str(start), str(at)), str(at), window=window, **options)
        deliver(alerts, f"{path}/outbox", batch_id, schemas.ALERTS, "alert_id", notify)

    return _run(mentions, handle, checkpoint, trigger, name)


def stored_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of all batches with their ``batch_id``."""
    return delivered(spark, f"{path}/outbox", schemas.ALERTS)


REVIEW_MESSAGES = {
    "message_id": "string", "concept_id": "bigint", "keyword": "string", "message": "string", "pushed_at": "timestamp",
}


def keep_review_messages(
    ticks: DataFrame,
    concepts: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    now: Callable[[int], str],
    send: Callable[[DataFrame, int], None] | None = None,
    size: int = 5,
    trigger=AVAILABLE_NOW,
    name: str = "review_messages",
) -> StreamingQuery:
    """Push the most frequent pending concepts for review, once per micro-batch of ``ticks``.

    Run it with the trigger of ``every("review")`` on any stream whose rows show
    that time passes. ``now`` gives the instant of a batch by its number; a
    concept is pushed again at a later instant until it has a verdict.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        waiting = pending_concepts(concepts(), size)
        at = F.lit(now(batch_id)).cast("timestamp")
        pushed = review_messages(waiting).withColumn("pushed_at", at)
        identity = F.concat_ws("|", "concept_id", F.date_format("pushed_at", SECOND_FORMAT))
        deliver(pushed.withColumn("message_id", identity), path, batch_id, REVIEW_MESSAGES, "message_id", send)

    return _run(ticks, handle, checkpoint, trigger, name)
