"""Document vectors: a pluggable embedding column and insert-if-absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.functions.dates import instant
from buzzlens.functions.text import full_text
from buzzlens.operators.keyed import insert_if_absent

DIMENSION = 1536


def zero_vector(text: Column, dimension: int = DIMENSION) -> Column:
    """Default embedding: zeros."""
    return F.when(text.isNotNull(), F.array_repeat(F.lit(0.0).cast("float"), dimension))


def embed_documents(
    documents: DataFrame,
    matched: DataFrame,
    embeddings: DataFrame,
    now,
    embed: Callable[[Column], Column] = zero_vector,
    dimension: int = DIMENSION,
) -> DataFrame:
    """Vectors to append for matched documents that have none yet.

    ``embed`` maps the text to ``array<float>``: an expression, or a
    ``pandas_udf`` that calls a model. Documents without a match and documents
    already embedded are removed before it runs. A vector of another dimension
    stops the job.
    """
    ids = matched.select("document_id").join(
        embeddings.select("document_id"), "document_id", "left_anti"
    )
    todo = documents.join(ids, "document_id", "left_semi")
    vectors = todo.select(
        "document_id", embed(full_text(F.col("title"), F.col("content"))).alias("embedding")
    )
    checked = F.when(
        has_dimension(F.col("embedding"), dimension), F.col("embedding")
    ).otherwise(F.raise_error(F.lit(f"embedding must have {dimension} values")))
    return vectors.select(
        "document_id",
        checked.cast("array<float>").alias("embedding"),
        F.lit(None).cast("float").alias("sentiment"),
        instant(now).alias("processed_at"),
    )


def has_dimension(embedding: Column, dimension: int) -> Column:
    """Whether the vector has exactly ``dimension`` values."""
    return F.coalesce(F.size(embedding) == dimension, F.lit(False))


def new_embeddings(batch: DataFrame, embeddings: DataFrame, dimension: int) -> DataFrame:
    """Rows of ``batch`` to append: right dimension, id not stored yet."""
    valid = batch.filter(has_dimension(F.col("embedding"), dimension))
    return insert_if_absent(valid, embeddings, "document_id", [F.col("processed_at")])
