"""Keyed tables on plain files.

Parquet has no keys and no MERGE, so each operator returns either the rows to
append or the new full table, and the caller writes them to a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# Rows of up to a few hundred bytes each: small enough to send to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 24  # of a row besides its texts


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes.

    Runs one aggregate, to which each task adds one row.
    """
    texts = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, k in df.dtypes if k == "string"]
    wide = sum(texts, F.lit(ROW_BYTES * max(1, len(df.columns))).cast("bigint"))
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(wide), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast after its size has been checked.

    A larger ``df`` comes back as it is, and the join shuffles both sides; AQE
    splits its hot keys. Meant for stored tables, where the count is cheap; a
    small derived frame is left to AQE, which sees its size at run time.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``.

    Filtering ``row_number`` lets Spark cut each key to one row per task before
    the shuffle, so a key with a third of all rows does no harm.
    """
    newest = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    oldest = Window.partitionBy(*keys).orderBy(*[c.asc() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(oldest))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def existing_keys(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys of ``batch`` that ``table`` already holds.

    Only the key column of ``table`` is read. A batch of checked size is
    broadcast, so the large table is scanned once and not shuffled. The check
    counts the batch: write a batch that is costly to compute first.
    """
    wanted = batch.select(key).distinct()
    return table.select(key).join(broadcast_if_small(wanted), key, "left_semi").distinct()


def insert_if_absent(
    batch: DataFrame, table: DataFrame, key: str, order: list[Column]
) -> DataFrame:
    """Rows of ``batch`` to append: first row per new key, stored rows win.

    Known keys leave first, and of a batch of checked size without a shuffle,
    so only rows with new keys are shuffled whole. Counts the keys of the batch.
    """
    wanted = batch.select(key).distinct()
    small = fits_broadcast(wanted)
    known = table.select(key).join(F.broadcast(wanted) if small else wanted, key, "left_semi").distinct()
    fresh = batch.join(F.broadcast(known) if small else known, key, "left_anti")
    return first_row(fresh, [key], order)


def dense_ids(df: DataFrame, key: Column, name: str, after: Column | int = 0) -> DataFrame:
    """Number rows ``after + 1, after + 2, ...`` in the order of ``md5(key)``.

    ``key`` must be unique. Rows are numbered inside 4,096 hash buckets in
    parallel and shifted by the sizes of the buckets before; only those sizes
    (4,096 rows at most) meet in one place. The numbers depend on the rows
    alone, so a retried job gives the same ones. A null key is numbered too.
    """
    # A null key goes before all others, an empty one by its own hash.
    hashed = df.withColumn("_hash", F.coalesce(F.md5(key.cast("string")), F.lit("000"))).withColumn(
        "_bucket", F.substring("_hash", 1, 3)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash")
    start = F.lit(after) if isinstance(after, int) else after
    numbered = hashed.withColumn("_number", F.row_number().over(inside)).join(
        F.broadcast(shifts), "_bucket"
    )
    return numbered.withColumn(
        name, (start + F.col("_shift") + F.col("_number")).cast("bigint")
    ).drop("_hash", "_bucket", "_number", "_shift")


def max_id(table: DataFrame, name: str) -> int:
    """Highest id in use, 0 for an empty table. Runs one aggregate."""
    return table.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Write ``df`` as a catalog table bucketed and sorted by ``key``.

    Tables with the same key and number of buckets (documents, their status,
    their embeddings) then join and anti-join without a shuffle.
    """
    by_key = df.repartition(buckets, key)
    by_key.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and a counter of its rows, filled by whatever action runs first."""
    counter = Observation(name)
    return df.observe(counter, F.count("*").alias("rows")), counter
