"""Exchange quote feeds to daily bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buzzlens.functions.dates import roc_date, session_close
from buzzlens.functions.numbers import price, quantity
from buzzlens.functions.rows import computed_once


CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class QuoteFeed:
    """Names one exchange uses: fields of a quote, market and data source.

    Another exchange is added by making another instance.
    """

    market: str
    data_source: str
    date: str
    code: str
    name: str
    open: str
    high: str
    low: str
    close: str
    volume: str
    turnover: str
    extra: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        """Every field of a feed is text."""
        names = (
            self.date, self.code, self.name, self.open, self.high, self.low,
            self.close, self.volume, self.turnover, *self.extra,
        )
        return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Field names of the two public feeds.
LISTED = QuoteFeed(
    market="TWSE", data_source="TwseApi", date="Date", code="Code", name="Name",
    open="OpeningPrice", high="HighestPrice", low="LowestPrice", close="ClosingPrice",
    volume="TradeVolume", turnover="TradeValue", extra=("Change", "Transaction"),
)
OTC = QuoteFeed(
    market="TPEX", data_source="TpexApi", date="Date", code="SecuritiesCompanyCode",
    name="CompanyName", open="Open", high="High", low="Low", close="Close",
    volume="TradingShares", turnover="TransactionAmount",
    extra=("Change", "TransactionNumber"),
)


def read_quotes(
    spark: SparkSession, path: str, feed: QuoteFeed, *, json_array: bool = True
) -> DataFrame:
    """Raw quotes below ``path``: one JSON array per file, or one object per line.

    Files are read in parallel; one array file holds one poll of one exchange,
    a few thousand quotes. What is not JSON comes as a row with its text in
    ``CORRUPT``: see ``unreadable``.
    """
    reader = spark.read.schema(kept_schema(feed)).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("multiLine", json_array).json(path)


def decode_quotes(texts: DataFrame, feed: QuoteFeed, column: str = "value") -> DataFrame:
    """Raw quotes of texts that hold one JSON array each; other columns are repeated.

    For polls that arrive as table rows. A text that is no such array comes as
    one row with it in ``CORRUPT`` (a null text as an empty one); an empty array
    gives no row.
    """
    others = [F.col(c) for c in texts.columns if c != column]
    text = F.coalesce(F.col(column), F.lit(""))
    none = F.array(F.lit(None).cast(feed.schema))
    parsed = texts.withColumn("_quotes", F.from_json(text, T.ArrayType(feed.schema)))
    return parsed.select(
        *others,
        F.when(F.col("_quotes").isNull(), text).alias(CORRUPT),
        F.explode(F.coalesce("_quotes", none)).alias("_quote"),
    ).select(*others, "_quote.*", CORRUPT)


def kept_schema(feed: QuoteFeed) -> T.StructType:
    """Fields of a feed and the text of what could not be read."""
    return feed.schema.add(CORRUPT, T.StringType())


def unreadable(raw: DataFrame) -> DataFrame:
    """Rows of a raw feed that could not be read, with their text in ``CORRUPT``.

    Spark wants the other columns of a file read too: write the rows, don't count them.
    """
    return raw.filter(F.col(CORRUPT).isNotNull())


NEEDED = ["trading_date", "open", "high", "low", "close", "volume", "turnover"]


def _parsed(raw: DataFrame, feed: QuoteFeed, *others: str) -> DataFrame:
    return computed_once(
        raw,
        **{name: F.col(name) for name in others},
        stock_code=F.coalesce(F.col(feed.code), F.lit("")),
        stock_name=F.coalesce(F.col(feed.name), F.lit("")),
        trading_date=roc_date(F.col(feed.date)),
        open=price(F.col(feed.open)),
        high=price(F.col(feed.high)),
        low=price(F.col(feed.low)),
        close=price(F.col(feed.close)),
        volume=quantity(F.col(feed.volume)),
        turnover=quantity(F.col(feed.turnover)),
    )


def parse_quotes(raw: DataFrame, feed: QuoteFeed) -> DataFrame:
    """Bars of a raw feed; a quote with any unreadable number or date is dropped."""
    return parsed_bars(_parsed(raw, feed), feed)


def parse_once(raw: DataFrame, feed: QuoteFeed) -> DataFrame:
    """What ``parsed_bars`` and ``unreadable`` need of a raw feed, which so is read once; other rows are left out."""
    whole = F.lit(True)
    for name in NEEDED:
        whole = whole & F.col(name).isNotNull()
    return _parsed(raw, feed, CORRUPT).filter(whole | F.col(CORRUPT).isNotNull())


def parsed_bars(parsed: DataFrame, feed: QuoteFeed) -> DataFrame:
    """Bars of ``parse_once``."""
    return parsed.dropna(how="any", subset=NEEDED).select(
        "stock_code",
        "stock_name",
        F.lit(feed.market).alias("market"),
        F.lit(feed.data_source).alias("data_source"),
        "trading_date",
        session_close(F.col("trading_date")).alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "turnover",
    )


def union_quotes(*bars: DataFrame) -> DataFrame:
    """All bars of all exchanges."""
    result = bars[0]
    for other in bars[1:]:
        result = result.unionByName(other)
    return result


def bar_series(bars: DataFrame) -> DataFrame:
    """Bars as points of the price series: tags, double fields, instant."""
    return bars.select(
        "stock_code",
        "market",
        "data_source",
        "ts",
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        "volume",
        F.col("turnover").cast("double").alias("turnover"),
        "trading_date",
    )


