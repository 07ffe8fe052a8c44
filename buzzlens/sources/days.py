"""Tables of a stream by day: a late row changes its own day only, and as a whole.

``data/version=V/series_day=D`` holds the rows a batch wrote for a day, and
``commits`` which of these folders count. A table with an identity is merged: a
batch writes the days it touches anew, one row per identity. Others are added
to; a day that has collected ``MOST`` versions is written anew by the next batch
that touches it, so a day never has more. Rows are dealt by ranges of day and
key: a busy day has several files, a quiet one a single file.
"""

from __future__ import annotations

from collections import Counter
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.functions.dates import instant
from buzzlens.operators.keyed import last_row
from buzzlens.session import shuffles_removed
from buzzlens.sources.commits import Commits, folders

LIVE = {"day": "date", "version": "string"}
MOST = 16  # versions of a day
HOT, BUCKETS = 64, 4_096
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name for a null


def _commits(spark: SparkSession, path: str) -> Commits:
    return Commits(spark, f"{path}/commits", LIVE)


def _name(day: date | None) -> str:
    return NO_DAY if day is None else day.isoformat()


def _read(spark: SparkSession, path: str, columns: dict[str, str], live: list[tuple]) -> DataFrame:
    """Rows of the listed versions with their ``version`` and ``series_day``; only their folders are listed."""
    stored = schemas.ddl({**columns, "version": "string", "series_day": "date"})
    if not live:
        return spark.createDataFrame([], stored)
    by_version: dict[str, set[str]] = {}
    for d, v in live:
        by_version.setdefault(v, set()).add(f"series_day={_name(d)}")
    paths = []
    for v, days in by_version.items():
        place = f"{path}/data/version={v}"
        # A folder that counts as a whole is named as a whole: Spark lists it in parallel.
        whole = len(days) > 1 and days == set(folders(spark, place))
        paths += [place] if whole else [f"{place}/{d}" for d in sorted(days)]
    return spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*paths)


def is_done(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the table has this batch already."""
    return _commits(spark, path).is_done(batch_id)


def _has_hot_identity(rows: DataFrame, identity: list[str]) -> bool:
    """Whether one identity may hold more than 1/``HOT`` of the rows, judged by hashed buckets of them."""
    buckets = rows.groupBy(F.pmod(F.xxhash64(*identity), F.lit(BUCKETS))).agg(F.count("*").alias("n"))
    largest, total = buckets.agg(F.max("n"), F.sum("n")).first()
    return largest is not None and largest * HOT > total


def keep_days(
    rows: DataFrame,
    path: str,
    batch_id: int,
    day: Column,
    columns: dict[str, str],
    identity: list[str] | None = None,
    order: list[Column] | None = None,
    stored: bool = False,
) -> None:
    """Add the rows of a batch to the table at ``path``; a batch that is in it already changes nothing.

    ``identity`` and ``order`` make it a merged table: of the rows with equal
    ``identity`` the one of the later batch stays, within a batch the last by
    ``order``. Only the days of the batch are read and written. Rows that are
    ``stored`` in files are read again rather than kept in memory and on disk.
    """
    spark, commits = rows.sparkSession, _commits(rows.sparkSession, path)
    if commits.is_done(batch_id):
        return
    live = [(r["day"], r["version"]) for r in commits.rows(before=batch_id)]
    typed = rows.select(*[F.col(n).cast(k).alias(n) for n, k in columns.items()]).withColumn("series_day", day)
    typed = typed if stored else typed.persist()  # its days are listed and its ranges sampled before it is written
    try:
        touched = [r[0] for r in typed.select("series_day").distinct().collect()]
        of_day = Counter(d for d, _ in live)
        again = {d for d in touched if identity or of_day[d] >= MOST}
        kept = [x for x in live if x[0] not in again] + [(d, f"{batch_id}") for d in touched]
        together = typed.withColumn("version", F.lit(f"{batch_id}"))
        old = [x for x in live if x[0] in again]
        if old:
            together = together.unionByName(_read(spark, path, columns, old))
        keys = ["series_day", *(identity or list(columns)[:2])]
        # Spark sizes the tasks of a few days; many days are many files, for all cores to write.
        cores = spark.sparkContext.defaultParallelism
        tasks = [max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))] if len(touched) > cores else []
        newest = [F.col("version").cast("bigint"), *(order or [])]
        times = [n for n in identity or [] if columns[n] in ("timestamp", "date")]
        if times and not _has_hot_identity(typed, identity):
            # Ranges of the identity, time first, hold whole days and whole identities: one shuffle.
            by_time = times + [n for n in identity if n not in times]
            ranged = last_row(together.repartitionByRange(*tasks, *by_time), identity, newest).drop("version")
        else:
            if identity:
                together = last_row(together, identity, newest)
            ranged = together.drop("version").repartitionByRange(*tasks, *keys)
        writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "static")
        with shuffles_removed(spark):
            writer.partitionBy("series_day").parquet(f"{path}/data/version={batch_id}")
    finally:
        if not stored:
            typed.unpersist()
    commits.write(kept, batch_id)
    commits.forget(f"{path}/data", "version")


def read_days(
    spark: SparkSession,
    path: str,
    columns: dict[str, str],
    start=None,
    stop=None,
    ts: str = "ts",
    span: timedelta = timedelta(days=1),
) -> DataFrame:
    """Rows of the table as of its newest batch, with their ``series_day``.

    Given both bounds, points in ``[start, stop)`` of ``ts``: other days' files
    are not even listed. Bounds are texts or datetimes in UTC; ``span`` is the
    longest time from a row's ``series_day`` to its ``ts``.
    """
    live = [(r["day"], r["version"]) for r in _commits(spark, path).rows()]
    if start is None or stop is None:
        return _read(spark, path, columns, live).drop("version")
    first, last = date.fromisoformat(str(start)[:10]), date.fromisoformat(str(stop)[:10])
    # A day more at the end: it may be one of another clock.
    chosen = [x for x in live if x[0] is not None and first - span <= x[0] <= last + timedelta(days=1)]
    points = _read(spark, path, columns, chosen).drop("version")
    return points.filter((F.col(ts) >= instant(start)) & (F.col(ts) < instant(stop)))
