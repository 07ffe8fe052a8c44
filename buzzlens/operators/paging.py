"""Search pages: totals and one page of an ordered result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.session import shared_dir

# Up to here each task keeps the rows before the page in a heap.
HEAP_ROWS = 50_000


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Number of rows and of pages; an empty result has one page."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint").alias("pages")
    )


def page_of(df: DataFrame, order: list[Column], page: int, size: int, keys: list[str]) -> DataFrame:
    """Page ``page`` (from 1) of ``df``; numbers out of range go to the nearest page.

    ``keys`` are the columns that ``order`` uses; together they are unique. The
    page is found by them alone, and whole rows are read for its ``size`` keys
    only. Pages after the first run a count. A page behind more than
    ``HEAP_ROWS`` rows is found by a distributed sort of the keys: they are range
    partitioned and cut from lineage, partitions are counted, and only
    partitions that overlap the page are read again.
    """
    page = max(1, page)
    if page > 1:
        page = min(page, page_totals(df, size).first()["pages"])
    chosen = _keys_between(df.select(*keys), order, (page - 1) * size, size)
    named = chosen.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)])
    same = [df[k].eqNullSafe(named[f"_key{n}"]) for n, k in enumerate(keys)]
    return df.join(F.broadcast(named), same, "left_semi").orderBy(*order)


def _keys_between(keys: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """``size`` rows of ``keys`` after the first ``skip`` by ``order``."""
    if skip + size <= HEAP_ROWS:
        return keys.orderBy(*order).offset(skip).limit(size)

    shared_dir(keys.sparkSession)
    placed = (
        keys.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    shifts, seen = {}, 0
    for row in sorted(counts.collect()):  # one row per partition
        if seen < skip + size and seen + row["n"] > skip:
            shifts[row["part"]] = seen
        seen += row["n"]
    if not shifts:
        return keys.limit(0)
    shift = F.create_map(*[F.lit(v) for pair in shifts.items() for v in pair])[part]
    rank = shift + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    on_page = placed.filter(part.isin(list(shifts)) & (rank >= skip) & (rank < skip + size))
    return on_page.drop("_place").limit(size)
