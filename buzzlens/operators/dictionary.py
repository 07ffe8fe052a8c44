"""The dictionary: entities and their alias keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.text import strip_space, too_long
from buzzlens.operators.keyed import (
    broadcast_if_small,
    dense_ids,
    first_row,
    max_id,
)
from buzzlens.operators.paging import page_of
from buzzlens.session import shared_dir

ENTITY_PAGE = 20


def _with_aliases(
    numbered: DataFrame, first_alias: int
) -> tuple[DataFrame, DataFrame]:
    """Split ``(entity_id, type, primary_name, stock_code, number)`` in two tables.

    A stock gets its code and its name as keywords, anything else its name. The
    keyword ids leave room for two per entity, so they follow from the number.
    """
    entities = numbered.select("entity_id", "type", "primary_name", "stock_code")
    keywords = F.when(
        F.col("type") == "Stock", F.array("stock_code", "primary_name")
    ).otherwise(F.array("primary_name"))
    aliases = numbered.select(
        "entity_id", "number", F.posexplode(keywords).alias("place", "keyword")
    ).select(
        (F.lit(first_alias) + (F.col("number") - 1) * 2 + F.col("place") + 1)
        .cast("bigint")
        .alias("alias_id"),
        "entity_id",
        "keyword",
    )
    return entities, aliases


def dictionary_changes(
    bars: DataFrame, entities: DataFrame, markets: tuple[str, ...] = ("TWSE", "TPEX")
) -> DataFrame:
    """Quoted stocks that are not in the dictionary: ``stock_code``, ``primary_name``, ``error``.

    A code quoted more than once is taken from the first market in ``markets``,
    its earliest day and smallest name. ``error`` is NULL for a stock that can
    be added, else the column that is missing or too long. Checkpointed: the
    quotes are read and parsed once, whatever is made from the result.
    """
    shared_dir(bars.sparkSession)
    rank = F.lit(len(markets))
    for place, market in enumerate(markets):
        rank = F.when(F.col("market") == market, place).otherwise(rank)
    quoted = bars.select("stock_code", "stock_name", "trading_date", rank.alias("market_rank"))
    order = [F.col("market_rank"), F.col("trading_date"), F.col("stock_name")]
    unique = first_row(quoted, ["stock_code"], order)
    known = entities.filter(F.col("stock_code").isNotNull()).select("stock_code")
    new = unique.join(broadcast_if_small(known), "stock_code", "left_anti")
    named = new.select("stock_code", F.col("stock_name").alias("primary_name"))
    missing = [
        F.when(F.coalesce(strip_space(F.col(c)), F.lit("")) == "", F.lit(f"{c} missing"))
        for c in ("stock_code", "primary_name")
    ]
    return named.withColumn("error", F.coalesce(*missing, too_long(["primary_name", "stock_code"]))).checkpoint()


def sync_dictionary(
    bars: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    markets: tuple[str, ...] = ("TWSE", "TPEX"),
) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases to add for stocks that are not in the dictionary.

    Known codes are skipped and keep their name; stocks without a code or name,
    or with one that is too long, are left out (``dictionary_changes`` tells
    them). Reads the quotes at once, and the highest ids.
    """
    changes = dictionary_changes(bars, entities, markets)
    valid = changes.filter(F.col("error").isNull()).drop("error")
    numbered = dense_ids(valid, F.col("stock_code"), "number").select(
        (F.lit(max_id(entities, "entity_id")) + F.col("number")).alias("entity_id"),
        F.lit("Stock").alias("type"),
        "primary_name",
        "stock_code",
        "number",
    )
    return _with_aliases(numbered, max_id(aliases, "alias_id"))


def check_entity_requests(requests: DataFrame) -> DataFrame:
    """Trim requests ``(request_id, type, stock_code, name)`` and add ``error``.

    ``error`` is NULL for a request that can be applied, else ``name`` (blank
    name), ``type`` (not an entity type), ``code`` (stock without code) or the
    column that is too long. Only stocks keep a code.
    """
    name = strip_space(F.coalesce("name", F.lit("")))
    code = strip_space(F.coalesce("stock_code", F.lit("")))
    is_stock = F.col("type") == "Stock"
    trimmed = requests.select(
        "request_id",
        "type",
        name.alias("primary_name"),
        F.when(is_stock, code).alias("stock_code"),
    )
    error = (
        F.when(F.col("primary_name") == "", "name")
        .when(~F.coalesce(F.col("type").isin(*schemas.ENTITY_TYPES), F.lit(False)), "type")
        .when(F.col("stock_code") == "", "code")
        .otherwise(too_long(["primary_name", "stock_code"]))
    )
    return trimmed.withColumn("error", error)


def add_entities(
    requests: DataFrame, entities: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases to add for hand-made requests without error."""
    valid = check_entity_requests(requests).filter(F.col("error").isNull())
    numbered = dense_ids(valid, F.col("request_id"), "number").withColumn(
        "entity_id", F.lit(max_id(entities, "entity_id")) + F.col("number")
    )
    return _with_aliases(numbered, max_id(aliases, "alias_id"))


def add_aliases(requests: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases to add for requests ``(entity_id, keyword)``.

    Blank or too long keywords, unknown entities and keywords the entity already
    has are refused; another entity may have the same keyword.
    """
    wanted = (
        requests.select("entity_id", strip_space(F.col("keyword")).alias("keyword"))
        .filter((F.col("keyword") != "") & too_long(["keyword"]).isNull())
        .distinct()
        .join(entities.select("entity_id"), "entity_id", "left_semi")
        .join(aliases.select("entity_id", "keyword"), ["entity_id", "keyword"], "left_anti")
    )
    key = F.concat_ws("|", F.col("entity_id").cast("string"), "keyword")
    return dense_ids(wanted, key, "alias_id", max_id(aliases, "alias_id")).select(
        "alias_id", "entity_id", "keyword"
    )


def delete_aliases(removals: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases left after removals ``(entity_id, alias_id)``; ids of others stay."""
    gone = removals.select("entity_id", "alias_id")
    return aliases.join(gone, ["entity_id", "alias_id"], "left_anti")


def delete_entities(
    removals: DataFrame, entities: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entities in ``removals``; aliases go with them."""
    gone = removals.select("entity_id")
    return (
        entities.join(gone, "entity_id", "left_anti"),
        aliases.join(gone, "entity_id", "left_anti"),
    )


def entity_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each entity with its aliases, one row per alias; without any, one with NULLs.

    An entity's rows are next to each other and sorted by keyword. The entities
    are in no order: sorting all of them would be a shuffle of its own.
    """
    rows = entities.join(aliases, "entity_id", "left")
    return rows.repartition("entity_id").sortWithinPartitions("entity_id", "keyword", "alias_id")


def matching_entities(entities: DataFrame, search: str = "") -> DataFrame:
    """Entities whose code or name contains ``search``; all when it is empty."""
    if not search:
        return entities
    return entities.filter(
        F.coalesce(F.contains("stock_code", F.lit(search)), F.lit(False))
        | F.contains("primary_name", F.lit(search))
    )


def entity_search(
    entities: DataFrame,
    aliases: DataFrame,
    search: str = "",
    page: int = 1,
    size: int = ENTITY_PAGE,
) -> DataFrame:
    """One page of matching entities with the number of their aliases.

    Sorted by code (none last), then name. Aliases are counted for the entities
    on the page only; Spark knows how few they are and does not shuffle the rest.
    """
    order = [F.asc_nulls_last("stock_code"), F.asc("primary_name"), F.asc("entity_id")]
    keys = ["stock_code", "primary_name", "entity_id"]
    shown = page_of(matching_entities(entities, search), order, page, size, keys)
    counts = (
        aliases.select("entity_id")
        .join(shown.select("entity_id"), "entity_id", "left_semi")
        .groupBy("entity_id")
        .agg(F.count("*").alias("alias_count"))
    )
    return (
        shown.join(counts, "entity_id", "left")
        .select(
            "entity_id",
            "stock_code",
            "primary_name",
            "type",
            F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
        )
        .orderBy(*order)
    )
