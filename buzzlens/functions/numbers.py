"""Numbers as the feeds write them, and the percent change used by signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(raw: Column) -> Column:
    """Drop thousands separators; ``(5)`` and ``5-`` mean minus five."""
    text = F.trim(F.replace(raw, F.lit(","), F.lit("")))
    marked = text.endswith(")") | text.endswith("-")
    return F.when(
        marked, F.regexp_replace(text, r"^(?:\((.*)\)|(.*)-)$", "-$1$2")
    ).otherwise(text)


def price(raw: Column) -> Column:
    """Quoted price to ``decimal(18,4)``; NULL when it is not a number."""
    return _plain(raw).try_cast("decimal(18,4)")


def quantity(raw: Column) -> Column:
    """Quoted whole number to ``bigint``; a fraction other than zero is NULL.

    Plain digits are read directly; only ``3.0`` or ``1e3`` take the decimal way.
    """
    text = _plain(raw)
    value = text.try_cast("decimal(38,6)")
    return F.coalesce(
        text.try_cast("bigint"), F.when(value % 1 == 0, value.try_cast("bigint"))
    )


def pct_change(current: Column, base: Column, when_zero: float) -> Column:
    """Change in percent of ``base``; ``when_zero`` where there is no base."""
    now, before = current.cast("double"), base.cast("double")
    return F.when(before == 0, F.lit(float(when_zero))).otherwise((now - before) / before * 100)
