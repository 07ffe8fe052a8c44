"""Concept words found in documents, and their review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import instant
from buzzlens.functions.messages import REPLY_FORMATS, review_message
from buzzlens.functions.text import strip_space, too_long
from buzzlens.operators.keyed import dense_ids, max_id
from buzzlens.session import shared_dir

REVIEW_SIZE = 5


def no_concepts(title: Column, content: Column) -> Column:
    """Default extractor: finds nothing."""
    return F.array().cast("array<string>")


def found_concepts(
    documents: DataFrame, extract: Callable[[Column, Column], Column] = no_concepts
) -> DataFrame:
    """One row ``(document_id, published_at, keyword)`` per extracted word.

    ``extract`` maps title and content to an array of words: an expression, or a
    ``pandas_udf`` that calls a model.
    """
    words = F.explode(extract(F.col("title"), F.col("content")))
    return documents.select("document_id", "published_at", words.alias("keyword"))


def check_words() -> Column:
    """Why a ``keyword`` cannot be a concept, NULL when it can."""
    word = F.col("keyword")
    return F.when(word.isNull() | (strip_space(word) == ""), "keyword missing").otherwise(too_long(["keyword"]))


def concept_changes(found: DataFrame, concepts: DataFrame, now) -> DataFrame:
    """What the words in ``found``, seen at ``now``, do to the concept table.

    One row per stored concept and per new or refused word, with the columns of
    the table, the ``action`` (``keep``, ``update``, ``insert`` or ``refuse``),
    ``reason`` of a refusal and, for words, ``seen_count``. Both inputs are read
    once: stored rows and words meet in one aggregate. The result is
    checkpointed, so all tables made from it agree.
    """
    shared_dir(found.sparkSession)
    at = instant(now)
    stored = F.struct(*[F.col(c) for c in schemas.CONCEPTS])
    first = F.struct("published_at", "document_id")
    # A stored row that could not be stored today is left alone, each for itself.
    tagged = concepts.select(
        "keyword", F.when(check_words().isNotNull(), F.col("concept_id")).alias("own"), stored.alias("stored")
    ).unionByName(
        found.select("keyword", F.lit(None).cast("bigint").alias("own"), first.alias("seen")), allowMissingColumns=True
    )
    merged = tagged.groupBy("keyword", "own").agg(
        F.collect_list("stored").alias("rows"), F.count("seen").alias("seen_count"), F.min("seen").alias("first_seen")
    )
    # A stored word is one row; a table that holds it twice keeps both.
    each = merged.select(
        "keyword", "seen_count", "first_seen",
        F.explode(F.when(F.size("rows") > 0, F.col("rows")).otherwise(F.array(F.lit(None).cast(merged.schema["rows"].dataType.elementType)))).alias("row"),
    )
    known, seen = F.col("row").isNotNull(), F.col("seen_count") > 0
    action = (
        F.when(known & ~seen, "keep").when(known, "update").when(check_words().isNotNull(), "refuse").otherwise("insert")
    )
    return each.select(
        F.col("row.concept_id").alias("concept_id"),
        F.coalesce("row.source_document_id", "first_seen.document_id").alias("source_document_id"),
        "row.associated_stock_code",
        "keyword",
        (F.coalesce("row.appearance_count", F.lit(0)) + F.col("seen_count")).cast("int").alias("appearance_count"),
        F.when(known, F.col("row.first_discovered_at")).otherwise(at).alias("first_discovered_at"),
        F.when(seen, at).otherwise(F.col("row.last_seen_at")).alias("last_seen_at"),
        F.when(known, F.col("row.approved")).otherwise(F.lit(False)).alias("approved"),
        action.alias("action"),
        F.when(action == "refuse", check_words()).alias("reason"),
        "seen_count",
    ).checkpoint()


def after_changes(changes: DataFrame) -> DataFrame:
    """The concept table after ``concept_changes``; new words get the next ids."""
    table = list(schemas.CONCEPTS)
    stays = changes.filter(F.col("action").isin("keep", "update")).select(*table)
    fresh = changes.filter(F.col("action") == "insert").drop("concept_id")
    added = dense_ids(fresh, F.col("keyword"), "concept_id", max_id(stays, "concept_id"))
    return stays.unionByName(added.select(*table))


def refused_words(changes: DataFrame) -> DataFrame:
    """Words that cannot be concepts, with the reason and how often they came."""
    return changes.filter(F.col("action") == "refuse").select("keyword", "reason", "seen_count")


def upsert_concepts(found: DataFrame, concepts: DataFrame, now) -> DataFrame:
    """Concept table after the words in ``found`` were seen at ``now``.

    A known word gains its appearances and ``last_seen_at``; a new one starts
    with them and remembers its earliest document. Words are counted before the
    merge, so one word never gives two rows. Missing, blank and too long words
    are left out (``concept_changes`` tells them). Runs the merge at once.
    """
    return after_changes(concept_changes(found, concepts, now))


def pending_concepts(concepts: DataFrame, size: int = REVIEW_SIZE) -> DataFrame:
    """Concepts waiting for a verdict, most frequent first."""
    waiting = concepts.filter(~F.col("approved"))
    return waiting.orderBy(F.desc("appearance_count"), F.asc("concept_id")).limit(size)


def review_messages(concepts: DataFrame) -> DataFrame:
    """One message per concept, ready for a chat sink."""
    return concepts.select("concept_id", "keyword", review_message().alias("message"))


def parse_commands(messages: DataFrame) -> DataFrame:
    """Review commands of messages ``(seq, text)``.

    ``command`` is the first word in lower case and ``concept_id`` the rest as a
    number, NULL when it is not one. Other messages are dropped.
    """
    parts = F.split(strip_space(F.col("text")), " ", 2)
    argument = strip_space(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return messages.select(
        "seq",
        F.lower(parts[0]).alias("command"),
        argument.try_cast("int").cast("bigint").alias("concept_id"),
    ).filter(F.col("command").isin("/approve", "/reject"))


def _reviewed(commands: DataFrame, concepts: DataFrame) -> DataFrame:
    """Existing concepts under review with the first approval and rejection."""
    approve, reject = F.col("command") == "/approve", F.col("command") == "/reject"
    firsts = (
        commands.filter(F.col("concept_id").isNotNull())
        .groupBy("concept_id")
        .agg(
            F.min(F.when(approve, F.col("seq"))).alias("first_approve"),
            F.min(F.when(reject, F.col("seq"))).alias("first_reject"),
        )
    )
    known = concepts.select("concept_id", "keyword", "approved")
    return known.join(firsts, "concept_id")


def review_outcomes(commands: DataFrame, concepts: DataFrame) -> DataFrame:
    """Outcome and reply of every parsed command, applied in ``seq`` order.

    What happened before a command follows from the first approval and the
    first rejection of its concept, so no command waits for another and a
    concept with most of the commands needs no ordered group.
    """
    seq = F.col("seq")
    gone = F.col("keyword").isNull() | (seq > F.coalesce("first_reject", seq))
    already = F.col("approved") | (seq > F.coalesce("first_approve", seq))
    outcome = (
        F.when(F.col("concept_id").isNull(), "usage")
        .when(gone, "missing")
        .when(F.col("command") == "/reject", "removed")
        .when(already, "already")
        .otherwise("promoted")
    )
    reply = F.lit(None).cast("string")
    for name, text in REPLY_FORMATS.items():
        value = {"usage": "command", "missing": "concept_id"}.get(name, "keyword")
        filled = F.format_string(text, F.col(value).cast("string"))
        reply = F.when(F.col("outcome") == name, filled).otherwise(reply)
    return (
        commands.join(_reviewed(commands, concepts), "concept_id", "left")
        .withColumn("outcome", outcome)
        .select("seq", "command", "concept_id", "outcome", reply.alias("reply"))
    )


def apply_reviews(
    commands: DataFrame, concepts: DataFrame, entities: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(concepts, new entities, new aliases)`` after the parsed commands.

    The first approval of an unapproved concept makes it an entity with one
    alias; a rejection deletes the concept and leaves such an entity alone.
    """
    reviewed = _reviewed(commands, concepts)
    promoted = reviewed.filter(
        ~F.col("approved")
        & F.col("first_approve").isNotNull()
        & (F.col("first_approve") < F.coalesce("first_reject", F.col("first_approve") + 1))
    )
    rejected = reviewed.filter(F.col("first_reject").isNotNull()).select("concept_id")
    flags = promoted.select("concept_id", F.lit(True).alias("_promoted"))
    left = (
        concepts.join(rejected, "concept_id", "left_anti")
        .join(flags, "concept_id", "left")
        .withColumn("approved", F.col("approved") | F.coalesce("_promoted", F.lit(False)))
        .drop("_promoted")
    )
    numbered = dense_ids(promoted, F.col("concept_id"), "number").select(
        (F.lit(max_id(entities, "entity_id")) + F.col("number")).alias("entity_id"),
        (F.lit(max_id(aliases, "alias_id")) + F.col("number")).alias("alias_id"),
        "keyword",
    )
    new_entities = numbered.select(
        "entity_id",
        F.lit("Concept").alias("type"),
        F.col("keyword").alias("primary_name"),
        F.lit(None).cast("string").alias("stock_code"),
    )
    return left, new_entities, numbered.select("alias_id", "entity_id", "keyword")
