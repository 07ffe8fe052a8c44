"""Which files of a table count: the whole list, written anew by every batch.

A batch first writes its files into folders that nobody reads yet and then the
list of all folders that count from now on. Readers take the newest finished
list, so they see a batch as a whole or not at all. A batch that is repeated
finds its list finished and has nothing to do, or starts again from the list of
the batch before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Row, SparkSession

from buzzlens.schemas import ddl

KEPT = 4  # finished lists that stay; folders none of them names are removed


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``, none where it does not exist."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return []
    # One call, however many folders there are.
    found = spark._jvm.org.apache.hadoop.util.functional.RemoteIterators.toList(system.listStatusIterator(place))
    return [p.rpartition("/")[2] for p in re.findall("path=([^;]*); isDirectory=true", found.toString())]


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


class Commits:
    """Finished lists below ``path``; a list has the columns ``columns`` and fits the driver."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str]):
        self.spark, self.path, self.columns = spark, path, columns

    def _folder(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def is_done(self, batch_id: int) -> bool:
        return exists(self.spark, f"{self._folder(batch_id)}/_SUCCESS")

    def done(self, before: int | None = None) -> list[int]:
        """Numbers of the finished batches, newest first."""
        numbers = sorted((int(f.removeprefix("batch_id=")) for f in folders(self.spark, self.path)), reverse=True)
        return [n for n in numbers if (before is None or n < before) and self.is_done(n)]

    def rows(self, before: int | None = None) -> list[Row]:
        """The newest finished list, optionally of a batch before ``before``."""
        numbers = self.done(before)
        return self.of(numbers[0]) if numbers else []

    def of(self, batch_id: int) -> list[Row]:
        return self.spark.read.schema(ddl(self.columns)).parquet(self._folder(batch_id)).collect()

    def write(self, rows: Iterable[tuple], batch_id: int) -> None:
        listed = self.spark.createDataFrame(list(rows), ddl(self.columns))
        listed.coalesce(1).write.mode("overwrite").parquet(self._folder(batch_id))

    def forget(self, data: str, column: str) -> None:
        """Drop old lists, and the folders of ``data`` that no list names in ``column``.

        A folder of a batch after the newest list is one being written and stays.
        """
        numbers = self.done()
        for number in numbers[KEPT:]:
            remove(self.spark, self._folder(number))
        named = {r[column] for n in numbers[:KEPT] for r in self.of(n)}
        for folder in folders(self.spark, data):
            name = folder.partition("=")[2]
            if name not in named and int(re.match(r"-?\d+", name)[0]) <= numbers[0]:
                remove(self.spark, f"{data}/{folder}")
