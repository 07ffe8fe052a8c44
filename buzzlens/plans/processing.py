"""Document processing: matches, mention points, status rows and vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.operators.concepts import found_concepts, no_concepts, upsert_concepts
from buzzlens.operators.documents import hot_documents, mark_probed
from buzzlens.operators.embeddings import DIMENSION, embed_documents, zero_vector
from buzzlens.operators.matching import mark_processed
from buzzlens.operators.mentions import mention_points
from buzzlens.session import scratch_path, shared_dir


@dataclass(frozen=True)
class Processed:
    """Rows to append after a batch of documents was processed."""

    mentions: DataFrame
    status: DataFrame
    embeddings: DataFrame


def process_documents(
    batch: DataFrame,
    aliases: DataFrame,
    entities: DataFrame,
    embeddings: DataFrame,
    now,
    embed: Callable[[Column], Column] = zero_vector,
    dimension: int = DIMENSION,
) -> Processed:
    """Match a batch once and derive everything the processed documents need.

    The points are written to a folder in the shared folder: status rows and
    vectors are built from them, and texts are not matched again. As columns
    they take a fraction of the rows that a checkpoint keeps.
    """
    spark = batch.sparkSession
    points, path = mention_points(batch, aliases, entities), scratch_path(spark, "points")
    points.write.parquet(path)
    mentions = spark.read.schema(points.schema).parquet(path)
    matched = mentions.select("document_id").distinct()
    return Processed(
        mentions,
        mark_processed(batch, mentions, now),
        embed_documents(batch, matched, embeddings, now, embed, dimension),
    )


@dataclass(frozen=True)
class Probed:
    """Tables after the hot documents were probed."""

    concepts: DataFrame
    status: DataFrame


def probe_documents(
    documents: DataFrame,
    status: DataFrame,
    concepts: DataFrame,
    now,
    extract: Callable[[Column, Column], Column] = no_concepts,
    size: int = 10,
    min_upvotes: int = 10,
) -> Probed:
    """Extract concepts from the hottest documents, merge and mark them probed.

    The extracted words are checkpointed, so a costly extractor runs once.
    """
    shared_dir(documents.sparkSession)
    hot = hot_documents(documents, status, size, min_upvotes)
    found = found_concepts(hot, extract).checkpoint()
    return Probed(
        upsert_concepts(found, concepts, now),
        mark_probed(status, hot.select(F.col("document_id")), now),
    )
