"""Dates as the feeds write them. Text that does not parse becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buzzlens.functions.text import strip_space


def roc_date(raw: Column) -> Column:
    """``YYYMMDD`` in the ROC calendar (year 1 = 1912) to a date."""
    western = (F.substring(raw, 1, 3).try_cast("int") + 1911).cast("string")
    return F.when(
        raw.rlike(r"^\d{7}$"),
        F.try_to_date(F.concat(western, F.substring(raw, 4, 4)), "yyyyMMdd"),
    )


def forum_timestamp(raw: Column) -> Column:
    """``Tue Mar  4 09:53:01 2026`` at UTC+8 to an instant.

    Runs of blanks count as one, and a weekday that contradicts the date makes
    the text invalid. The offset is part of the parsed text, so the result does
    not depend on the session time zone.
    """
    text = F.initcap(F.regexp_replace(strip_space(raw), r"(?U)\s+", " "))
    word = [F.split_part(text, F.lit(" "), F.lit(i)) for i in range(1, 6)]
    day = F.try_to_date(F.concat_ws(" ", word[1], word[2], word[4]), "MMM d yyyy")
    instant = F.try_to_timestamp(
        F.concat(F.concat_ws(" ", word[1], word[2], word[3], word[4]), F.lit(" +0800")),
        F.lit("MMM d HH:mm:ss yyyy Z"),
    )
    well_formed = text.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} \d{4}$")
    return F.when(well_formed & (F.date_format(day, "EEE") == word[0]), instant)


def rss_timestamp(raw: Column) -> Column:
    """RFC 822 ``Mon, 24 Mar 2026 10:00:00 +0800`` to an instant.

    The weekday is optional and is not compared with the date.
    """
    text = F.regexp_replace(strip_space(raw), r"^[^,]{2,4},\s*", "")
    well_formed = text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    return F.when(
        well_formed, F.try_to_timestamp(F.initcap(text), F.lit("d MMM yyyy HH:mm:ss Z"))
    )


def session_close(trading_date: Column) -> Column:
    """Instant a daily bar is stamped with: 05:30 UTC of its trading date."""
    return F.timestamp_seconds(F.unix_date(trading_date) * F.lit(86_400) + F.lit(19_800))


def instant(value) -> Column:
    """A literal point in time, from text, a ``datetime`` or a Column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def days_before(as_of: Column, days: int) -> Column:
    """``as_of`` minus whole days of 24 hours."""
    return as_of - F.expr(f"INTERVAL '{days}' DAY")
