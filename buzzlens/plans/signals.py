"""Signals: a surge of mentions checked against price and volume."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens.functions.dates import instant
from buzzlens.functions.messages import alert_message, summary
from buzzlens.functions.numbers import pct_change
from buzzlens.operators.keyed import broadcast_if_small
from buzzlens.operators.mentions import mention_deltas
from buzzlens.operators.snapshot import ohlcv_snapshot


def signals(
    mentions: DataFrame,
    bars: DataFrame,
    as_of,
    *,
    window: timedelta = timedelta(minutes=15),
    mention_delta_min: float = 50.0,
    volume_delta_min: float = 50.0,
    resonance_price_min: float = 2.0,
    bearish_price_max: float = -1.0,
    names: DataFrame | None = None,
) -> DataFrame:
    """Alerts of the window that ends at ``as_of``.

    All thresholds are inclusive and the first rule that holds gives the type:
    Resonance when volume and price rise, BearishDivergence when price falls.
    Stocks without bars (and entities without code) never fire. ``names`` is an
    optional ``(stock_code, stock_name)`` table; by default the name is the code.
    """
    surging = mention_deltas(mentions, as_of, window).filter(
        F.col("mention_delta") >= mention_delta_min
    )
    judged = surging.join(ohlcv_snapshot(bars, as_of), "stock_code").select(
        "stock_code",
        "mention_delta",
        pct_change(F.col("latest_volume"), F.col("avg_volume"), 0).alias("volume_delta"),
        pct_change(F.col("close"), F.col("prev_close"), 0).alias("price_delta"),
    )
    kind = F.when(
        (F.col("volume_delta") >= volume_delta_min)
        & (F.col("price_delta") >= resonance_price_min),
        "Resonance",
    ).when(F.col("price_delta") <= bearish_price_max, "BearishDivergence")
    fired = judged.withColumn("type", kind).filter(F.col("type").isNotNull())
    if names is None:
        named = fired.withColumn("stock_name", F.col("stock_code"))
    else:
        known = broadcast_if_small(names.select("stock_code", "stock_name"))
        named = fired.join(known, "stock_code", "left").withColumn(
            "stock_name", F.coalesce("stock_name", "stock_code")
        )
    at = instant(as_of)
    identity = F.concat_ws(
        "|", "type", "stock_code", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    return named.select(
        F.sha2(identity, 256).alias("alert_id"),
        at.alias("triggered_at"),
        "type",
        "stock_code",
        "stock_name",
        "mention_delta",
        "volume_delta",
        "price_delta",
        F.lit(None).cast("float").alias("sentiment_avg"),
        summary(
            F.col("type"),
            F.col("stock_code"),
            F.col("mention_delta"),
            F.col("volume_delta"),
            F.col("price_delta"),
        ).alias("summary"),
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """One message per alert, ready for a chat sink."""
    return alerts.select("alert_id", "type", "stock_code", alert_message().alias("message"))
