"""Explicit schemas of the engine tables and the closed value sets they use."""

from __future__ import annotations


def ddl(columns: dict[str, str]) -> str:
    """Schema text, as ``spark.read.schema`` and ``createDataFrame`` take it."""
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


BARS = {
    "stock_code": "string",
    "stock_name": "string",
    "market": "string",
    "data_source": "string",
    "trading_date": "date",
    "ts": "timestamp",
    "open": "decimal(18,4)",
    "high": "decimal(18,4)",
    "low": "decimal(18,4)",
    "close": "decimal(18,4)",
    "volume": "bigint",
    "turnover": "bigint",
}
BAR_SERIES = {
    "stock_code": "string",
    "market": "string",
    "data_source": "string",
    "ts": "timestamp",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "volume": "bigint",
    "turnover": "double",
    "trading_date": "date",
}
DOCUMENTS = {
    "document_id": "string",
    "source_type": "string",
    "author": "string",
    "title": "string",
    "content": "string",
    "published_at": "timestamp",
    "url": "string",
    "upvotes": "int",
    "downvotes": "int",
    "arrows": "int",
}
DOC_STATUS = {
    "document_id": "string",
    "processed_at": "timestamp",
    "entity_match_count": "int",
    "probed_at": "timestamp",
}
ENTITIES = {
    "entity_id": "bigint",
    "type": "string",
    "primary_name": "string",
    "stock_code": "string",
}
ALIASES = {
    "alias_id": "bigint",
    "entity_id": "bigint",
    "keyword": "string",
}
MENTIONS = {
    "document_id": "string",
    "entity_id": "bigint",
    "stock_code": "string",
    "source_type": "string",
    "ts": "timestamp",
    "mention_count": "bigint",
}
EMBEDDINGS = {
    "document_id": "string",
    "embedding": "array<float>",
    "sentiment": "float",
    "processed_at": "timestamp",
}
CONCEPTS = {
    "concept_id": "bigint",
    "source_document_id": "string",
    "associated_stock_code": "string",
    "keyword": "string",
    "appearance_count": "int",
    "first_discovered_at": "timestamp",
    "last_seen_at": "timestamp",
    "approved": "boolean",
}
ALERTS = {
    "alert_id": "string",
    "triggered_at": "timestamp",
    "type": "string",
    "stock_code": "string",
    "stock_name": "string",
    "mention_delta": "double",
    "volume_delta": "double",
    "price_delta": "double",
    "sentiment_avg": "float",
    "summary": "string",
}
WINDOW_SUMS = {
    "stock_code": "string",
    "window_start": "timestamp",
    "current_count": "bigint",
    "previous_count": "bigint",
}
PROBED = {"document_id": "string", "probed_at": "timestamp"}
VERSIONS = {"version": "bigint"}
UNREADABLE = {"_corrupt_record": "string"}

# Names stored in the tables.
SOURCE_TYPES = ("PttStock", "NewsYahoo", "NewsCnyes", "NewsUdn", "Mops", "Threads")
FORUM_SOURCE = "PttStock"
NEWS_SOURCE = "NewsCnyes"
ENTITY_TYPES = ("Stock", "Concept", "Person")
SIGNAL_TYPES = ("Resonance", "BearishDivergence", "StealthStrength", "SectorRotation")

# Longest text each stored column accepts.
MAX_LENGTHS = {
    "primary_name": 100,
    "stock_code": 10,
    "keyword": 100,
    "title": 500,
    "url": 1000,
    "associated_stock_code": 10,
}
