"""Delivery ledger: messages of a job, each handed over at most once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.operators.ids import IdIndex
from buzzlens.operators.keyed import first_row
from buzzlens.sources.commits import Commits, folders

SENT = {"messages": "bigint"}


def _sent(spark: SparkSession, path: str) -> Commits:
    return Commits(spark, f"{path}/sent", SENT)


def deliver(
    rows: DataFrame,
    path: str,
    batch_id: int,
    columns: dict[str, str],
    key: str,
    send: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Store the rows of a batch whose ``key`` is new and hand them to ``send``.

    The keys are in the ledger before ``send`` is called, so neither a repeated
    batch nor a key that comes again is handed over twice; a batch whose ``send``
    failed is stored, and ``unsent`` lists it. Rows without a key are left out.
    """
    spark = rows.sparkSession
    ledger = IdIndex(spark, f"{path}/keys")
    if ledger.commits.is_done(batch_id):
        return
    typed = rows.select(*[F.col(n).cast(k).alias(n) for n, k in columns.items()])
    typed = first_row(typed.filter(F.col(key).isNotNull()), [key], [F.col(c) for c in columns if c != key])
    typed = typed.persist()  # looked up, then written
    try:
        place = f"{path}/rows/batch_id={batch_id}"
        ledger.absent(typed, key, before=batch_id).write.mode("overwrite").parquet(place)
    finally:
        typed.unpersist()
    new = spark.read.schema(schemas.ddl(columns)).parquet(place)
    ledger.add(new, key, batch_id)
    if send is not None:
        send(new, batch_id)
    _sent(spark, path).write([(new.count(),)], batch_id)


def delivered(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """All stored messages with their ``batch_id``."""
    stored = schemas.ddl({**columns, "batch_id": "bigint"})
    if not folders(spark, f"{path}/rows"):
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def unsent(spark: SparkSession, path: str) -> list[int]:
    """Batches that are stored but were not handed over, oldest first."""
    stored = {int(f.removeprefix("batch_id=")) for f in folders(spark, f"{path}/rows")}
    known = IdIndex(spark, f"{path}/keys").commits
    done = _sent(spark, path)
    return sorted(n for n in stored if known.is_done(n) and not done.is_done(n))
