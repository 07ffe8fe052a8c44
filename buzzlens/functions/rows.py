"""Row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df.select(...)`` whose columns are not worked out again by a later filter.

    A filter on a computed column is normally pushed below the projection, and
    the expression then runs twice. Unpacking a one-row array stops that and
    stays inside the generated code.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(row.alias("_row")).select(F.inline(F.array("_row")))
