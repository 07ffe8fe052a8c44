"""Time-series tables: range scans, writing, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens.functions.dates import days_before, instant
from buzzlens.operators.keyed import last_row
from buzzlens.schemas import ddl

BAR_IDENTITY = ["stock_code", "market", "ts"]
MENTION_IDENTITY = ["stock_code", "source_type", "ts"]


def time_range(series: DataFrame, start, stop, ts: str = "ts") -> DataFrame:
    """Points in ``[start, stop)``. Both bounds reach the Parquet scan."""
    return series.filter((F.col(ts) >= instant(start)) & (F.col(ts) < instant(stop)))


def trailing_days(series: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Points of the last ``days`` times 24 hours before ``as_of``."""
    end = instant(as_of)
    return time_range(series, days_before(end, days), end, ts)


def latest_bars(bars: DataFrame, write_order: list[Column]) -> DataFrame:
    """One bar per stock, market and day: the one written last."""
    return last_row(bars, BAR_IDENTITY, write_order)


def latest_mentions(mentions: DataFrame, write_order: list[Column]) -> DataFrame:
    """One point per stock, source and second: the one written last.

    This is how a store with second precision keeps the points: two documents
    of one source that mention a stock in the same second become one point.
    ``mention_windows`` does not need it; use it to get that store's numbers.
    """
    truncated = mentions.withColumn("ts", F.date_trunc("second", "ts"))
    return last_row(truncated, MENTION_IDENTITY, write_order)


def write_series(
    series: DataFrame, path: str, *, day: Column, mode: str = "append", files: int | None = None
) -> None:
    """Write points partitioned by ``series_day`` and sorted within files.

    Range partitioning on (day, code, instant) spreads one busy day or code
    over many files and gives row groups narrow code and time bounds.
    ``mode="overwrite"`` replaces only the days present in ``series``.
    """
    keys = ["series_day", "stock_code", "ts"]
    dated = series.withColumn("series_day", day)
    ranged = (
        dated.repartitionByRange(files, *keys) if files else dated.repartitionByRange(*keys)
    )
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode).partitionBy("series_day")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_series(
    spark: SparkSession, path: str, start, stop, columns: dict[str, str]
) -> DataFrame:
    """Points in ``[start, stop)`` of a written series; other days are not read."""
    stored = ddl({**columns, "series_day": "date"})
    points = spark.read.schema(stored).parquet(path)
    days = F.col("series_day").between(
        instant(start).cast("date"), instant(stop).cast("date")
    )
    return time_range(points.filter(days), start, stop).drop("series_day")
