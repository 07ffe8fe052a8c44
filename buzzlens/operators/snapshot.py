"""Latest price and volume per stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buzzlens.functions.dates import days_before, instant
from buzzlens.sources.series import trailing_days

CLOSE_DAYS = 10
VOLUME_DAYS = 6


def ohlcv_snapshot(bars: DataFrame, as_of) -> DataFrame:
    """Last close, close before it, last volume and mean volume per stock.

    Closes are looked up in the last 10 days, the mean volume covers the last 6
    (0 when that is empty), both in days of 24 hours before ``as_of``. With one
    bar only, the close before is that bar's own.

    ``bars`` must hold one bar per stock, market and day (``latest_bars``), so a
    stock has at most 11 bars per market in reach and the rank below never
    sorts a large group. Rank and aggregate share one shuffle on the stock.
    """
    recent = trailing_days(bars, as_of, CLOSE_DAYS).filter(
        F.col("stock_code").isNotNull() & (F.col("stock_code") != "")
    )
    newest = Window.partitionBy("stock_code").orderBy(
        F.col("ts").desc(), F.col("market").desc()
    )
    ranked = recent.select("stock_code", "market", "ts", "close", "volume").withColumn(
        "rank", F.row_number().over(newest)
    )
    in_mean = F.col("ts") >= days_before(instant(as_of), VOLUME_DAYS)
    last = F.max(F.when(F.col("rank") == 1, F.col("close")))
    before = F.max(F.when(F.col("rank") == 2, F.col("close")))
    return ranked.groupBy("stock_code").agg(
        last.alias("close"),
        F.coalesce(before, last).alias("prev_close"),
        F.max(F.when(F.col("rank") == 1, F.col("volume"))).alias("latest_volume"),
        F.coalesce(F.avg(F.when(in_mean, F.col("volume"))), F.lit(0.0)).alias("avg_volume"),
    )
