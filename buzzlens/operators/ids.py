"""Index of the ids a growing table holds.

Ids lie in segments. A batch adds a small one; ``MOST`` segments of a level are
merged into one of the next level, so an id is rewritten once per level and a
table has few segments. A segment of more than ``FILE_IDS`` ids is dealt to
folders by the ids' hash, and a look-up reads the folders of its own ids only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens.operators.keyed import broadcast_if_small
from buzzlens.sources.commits import Commits

SEGMENTS = {"segment": "string", "level": "int", "ids": "bigint", "folders": "int"}
MOST = 16  # segments of a level
FILE_IDS = 1 << 18  # ids of a folder
FOLDERS = 4096  # most folders of a segment


def _hash(folders: int) -> Column:
    """Folder of an id. The numbers of folders are powers of 2, so few folders are unions of many."""
    return F.pmod(F.xxhash64("id"), F.lit(folders)).cast("int")


class IdIndex:
    """The index at ``path``. Ids are compared as text; null ids are not kept and never found."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.commits = Commits(spark, f"{path}/commits", SEGMENTS)

    def _segment(self, name: str) -> str:
        return f"{self.path}/data/segment={name}"

    def held(self, keys: DataFrame, key: str, before: int | None = None) -> DataFrame:
        """The distinct ids of ``keys`` that the index holds, in the column ``key``.

        ``before`` asks for the state before a batch. Runs small jobs: the size
        of ``keys`` decides whether they are broadcast, and the folders they
        fall into (``FOLDERS`` numbers at most) come to the driver. ``keys`` is
        read several times; persist or write what is costly.
        """
        wanted = keys.select(F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
        segments = self.commits.rows(before)
        if not segments:
            return wanted.limit(0).withColumnRenamed("id", key)
        most = max(s["folders"] for s in segments)
        near = [r[0] for r in wanted.select(_hash(most)).distinct().collect()] if most > 1 else [0]
        stored = None
        for s in segments:
            rows = self.spark.read.schema("id string, folder int").parquet(self._segment(s["segment"]))
            if s["folders"] > 1:
                rows = rows.filter(F.col("folder").isin(sorted({n % s["folders"] for n in near})))
            stored = rows.select("id") if stored is None else stored.union(rows.select("id"))
        found = stored.join(broadcast_if_small(wanted), "id", "left_semi").distinct()
        return found.withColumnRenamed("id", key)

    def absent(self, batch: DataFrame, key: str, before: int | None = None) -> DataFrame:
        """Rows of ``batch`` whose id the index does not hold, rows without an id included."""
        known = self.held(batch, key, before).withColumnRenamed(key, "_known")
        return batch.join(broadcast_if_small(known), F.col(key).cast("string") == F.col("_known"), "left_anti")

    def add(self, keys: DataFrame, key: str, batch_id: int) -> None:
        """Add the ids of a batch, which the index must not hold yet; a repeated batch adds nothing."""
        if self.commits.is_done(batch_id):
            return
        live = [tuple(r) for r in self.commits.rows(before=batch_id)]
        ids = keys.select(F.col(key).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
        live.append(self._write(ids, f"{batch_id}", 0))
        level = 0
        while sum(s[1] == level for s in live) >= MOST:
            parts = [s for s in live if s[1] == level]
            together = None
            for name, *_ in parts:
                rows = self.spark.read.schema("id string, folder int").parquet(self._segment(name)).select("id")
                together = rows if together is None else together.union(rows)
            level += 1
            merged = self._write(together, f"{batch_id}-{level}", level, sum(s[2] for s in parts))
            live = [s for s in live if s not in parts] + [merged]
        self.commits.write(live, batch_id)
        self.commits.forget(f"{self.path}/data", "segment")

    def _write(self, ids: DataFrame, name: str, level: int, size: int | None = None) -> tuple:
        """Write a segment and describe it. A batch's own segment is one folder whatever its size,
        unless its size is known to be larger."""
        place = self._segment(name)
        if size is None:
            ids = ids.persist()
        try:
            size = ids.count() if size is None else size
            folders = 1
            while folders < FOLDERS and size > folders * FILE_IDS:
                folders *= 2
            dealt = ids.withColumn("folder", _hash(folders))
            dealt = dealt.repartition(min(folders, 256), "folder") if folders > 1 else dealt
            writer = dealt.sortWithinPartitions("folder", "id").write.mode("overwrite")
            writer.option("partitionOverwriteMode", "static").partitionBy("folder").parquet(place)
        finally:
            ids.unpersist()
        return name, level, size, folders
