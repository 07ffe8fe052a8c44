"""Mention points and their sums over windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzlens.functions.dates import instant
from buzzlens.functions.numbers import pct_change
from buzzlens.operators.matching import coded_counts
from buzzlens.sources.series import time_range


def mention_points(documents: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Mention series of documents: one point per document and entity.

    Source and publish time travel with the hits as grouping keys, so documents
    are read once and never joined back. An entity without stock code is filed
    under ``entity_<id>``.
    """
    keys = ("document_id", "source_type", "published_at")
    return coded_counts(documents, aliases, entities, keys).select(
        "document_id",
        "entity_id",
        F.coalesce(
            "stock_code", F.concat(F.lit("entity_"), F.col("entity_id").cast("string"))
        ).alias("stock_code"),
        "source_type",
        F.date_trunc("second", "published_at").alias("ts"),
        "mention_count",
    )


def _named(code: Column) -> Column:
    return code.isNotNull() & (code != "")


def mention_counts(mentions: DataFrame, start, stop) -> DataFrame:
    """Mentions per stock in ``[start, stop)`` over all sources."""
    return (
        time_range(mentions, start, stop)
        .groupBy("stock_code")
        .agg(F.sum("mention_count").alias("mention_count"))
        .filter(_named(F.col("stock_code")) & F.col("mention_count").isNotNull())
    )


def mention_deltas(mentions: DataFrame, as_of, window: timedelta) -> DataFrame:
    """Mentions in ``[as_of - w, as_of)`` against ``[as_of - 2w, as_of - w)``.

    One scan and one aggregate answer both windows. Stocks without a mention in
    the current window have no row; one without any before it has delta 100.
    """
    end, width = instant(as_of), F.lit(window)
    middle = end - width
    recent = time_range(mentions, middle - width, end)
    current = F.when(F.col("ts") >= middle, F.col("mention_count"))
    previous = F.when(F.col("ts") < middle, F.col("mention_count"))
    sums = recent.groupBy("stock_code").agg(
        F.coalesce(F.sum(current), F.lit(0)).alias("current_count"),
        F.coalesce(F.sum(previous), F.lit(0)).alias("previous_count"),
    )
    return sums.filter(_named(F.col("stock_code")) & (F.col("current_count") != 0)).withColumn(
        "mention_delta", pct_change(F.col("current_count"), F.col("previous_count"), 100)
    )


def window_sums(mentions: DataFrame, window: timedelta) -> DataFrame:
    """Mentions of each stock in each window of a fixed grid and in the one before.

    A sliding window of twice the width holds a window and the one before it,
    so one grouped sum does it: no dense grid and no ordering per stock, and a
    stock with a third of all points is still summed before the shuffle. Sums of
    parts of the points can be added up.
    """
    seconds = int(window.total_seconds())
    both = F.window("ts", f"{2 * seconds} seconds", f"{seconds} seconds")
    middle = F.col("both.end") - F.lit(window)
    own, count = F.col("ts") >= middle, F.col("mention_count")
    return (
        mentions.filter(_named(F.col("stock_code")))
        .select("stock_code", "ts", "mention_count", both.alias("both"))
        .groupBy("stock_code", "both")
        .agg(
            F.coalesce(F.sum(F.when(own, count)), F.lit(0)).alias("current_count"),
            F.coalesce(F.sum(F.when(~own, count)), F.lit(0)).alias("previous_count"),
        )
        .select("stock_code", middle.alias("window_start"), "current_count", "previous_count")
    )


def deltas_of_sums(sums: DataFrame) -> DataFrame:
    """Change of each window with a mention against the one before."""
    return sums.filter(F.col("current_count") != 0).select(
        "stock_code",
        "window_start",
        "current_count",
        "previous_count",
        pct_change(F.col("current_count"), F.col("previous_count"), 100).alias("mention_delta"),
    )


def mention_delta_history(mentions: DataFrame, window: timedelta) -> DataFrame:
    """``mention_deltas`` for every window of a fixed grid at once."""
    return deltas_of_sums(window_sums(mentions, window))
