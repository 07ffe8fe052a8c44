"""Message texts of alerts and concept reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message formats and icons.
SUMMARY_FORMATS = {
    "Resonance": "【共振】%s 聲量+%.1f%% / 量比+%.1f%% / 股價+%.2f%%",
    "BearishDivergence": "【背離】%s 聲量+%.1f%% 但股價%.2f%%，留意出貨風險",
}
ICONS = {
    "Resonance": "🚀",
    "BearishDivergence": "⚠️",
    "StealthStrength": "🛡",
    "SectorRotation": "🔄",
}
OTHER_ICON = "📊"
ALERT_FORMAT = (
    "%s *%s*\n\n股票代號：`%s`\n觸發時間：%s UTC\n"
    "聲量變化：+%.1f%%\n量比變化：%s%%\n股價變化：%s%%"
)
REVIEW_FORMAT = (
    "🔍 *發現新概念詞彙審核*\n\n關鍵字：`%s`\n出現次數：%s\n首次發現：%s UTC\n"
    "關聯股票：%s\n\n請回覆：\n`/approve %s` 加入白名單\n`/reject %s` 忽略"
)
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
REPLY_FORMATS = {
    "usage": "用法：%s <id>",
    "missing": "找不到 concept id=%s",
    "promoted": "✅ 已將「%s」加入白名單",
    "already": "「%s」已經升級過了",
    "removed": "🗑 已忽略「%s」",
}


def summary(kind: Column, code: Column, mention: Column, volume: Column, price: Column) -> Column:
    """One-line summary of a signal; NULL for kinds without a format."""
    mention, volume, price = F.round(mention, 1), F.round(volume, 1), F.round(price, 2)
    return F.when(
        kind == "Resonance",
        F.format_string(SUMMARY_FORMATS["Resonance"], code, mention, volume, price),
    ).when(
        kind == "BearishDivergence",
        F.format_string(SUMMARY_FORMATS["BearishDivergence"], code, mention, price),
    )


def icon(kind: Column) -> Column:
    """Icon of a signal kind."""
    chosen = F.lit(OTHER_ICON)
    for name, mark in ICONS.items():
        chosen = F.when(kind == name, F.lit(mark)).otherwise(chosen)
    return chosen


def signed(value: Column, digits: int) -> Column:
    """Number with its sign always shown; a plain ``0`` for zero."""
    rounded = F.round(value, digits)
    return F.when(rounded == 0, F.lit("0")).otherwise(F.format_string(f"%+.{digits}f", rounded))


def alert_message() -> Column:
    """Message of one row of the alerts table."""
    return F.format_string(
        ALERT_FORMAT,
        icon(F.col("type")),
        F.col("summary"),
        F.col("stock_code"),
        F.date_format("triggered_at", MINUTE_FORMAT),
        F.round("mention_delta", 1),
        signed(F.col("volume_delta"), 1),
        signed(F.col("price_delta"), 2),
    )


def review_message() -> Column:
    """Message asking for a verdict on one row of the concepts table."""
    identity = F.col("concept_id").cast("string")
    return F.format_string(
        REVIEW_FORMAT,
        F.col("keyword"),
        F.col("appearance_count").cast("string"),
        F.date_format("first_discovered_at", MINUTE_FORMAT),
        F.coalesce(F.col("associated_stock_code"), F.lit("—")),
        identity,
        identity,
    )
