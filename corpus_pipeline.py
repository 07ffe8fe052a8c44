"""Cleaning of a document table, stage by stage; each stage is one operator of ``buzzlens.llm``.

Every stage gets all rows its predecessor kept, as a table read back from
Parquet, and all but the last return the columns of ``documents``; other columns
are dropped, whatever their names. An empty table goes through all stages as one.
Whole texts are read, however long they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens.llm import language, lines, packing, simhash, substrings
from buzzlens.llm.queries import BATCH_ROWS, tokenizer
from buzzlens.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SHARE = 0.5  # of its main language, in a document that stays


def _documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of the table and a length that fits the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; texts without a letter (null, empty) and mixtures without one go.

    The languages are learned from the rows with a text and a ``lang``; without
    any, every document goes. Equal shares go to the first language by name.
    Repeated rows and null ids are judged row by row.
    """
    _short_batches(spark)
    names, logs = language.learn(docs)
    found = language.identify(docs.select(*COLUMNS), names, logs)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line blocks of earlier ones; those with no line left go, null texts too.

    Earlier is the smaller id, then the smaller text hash. Rows with a null id
    keep their lines; rows equal in id and text lose the same lines.
    """
    _short_batches(spark)
    cut = lines.remove_common_blocks(docs.select(*COLUMNS))
    return _documents(cut.filter("n_lines > n_removed_lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: smallest id (null last), then smallest text hash.

    Of rows equal in id and text one stays; all texts without a word are one group.
    """
    _short_batches(spark)
    return simhash.keep_first(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of earlier ones (smaller ids); those with no word left go, null texts too.

    Rows of one id take nothing from each other, and a null id is later than all others.
    """
    _short_batches(spark)
    cut = substrings.remove_repeats(docs.select(*COLUMNS))
    return _documents(cut.filter("n_words > n_removed"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens; a null text is its end token.

    Repeated rows and null ids are packed like any others.
    """
    _short_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

# Language models, alignments and token ids have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
