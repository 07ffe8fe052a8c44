"""Tables that streams fill: days, id index, ledger, and the watch over sources."""

import random
import re
import threading
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from buzzlens.operators import ids as id_index
from buzzlens.operators.ids import IdIndex
from buzzlens.sources import days
from buzzlens.sources.commits import Commits, folders
from buzzlens.sources.days import keep_days, read_days
from buzzlens.streaming.outbox import deliver, delivered, unsent
from buzzlens.streaming.supervise import supervise

POINTS = {"code": "string", "ts": "timestamp", "n": "bigint"}


def points(spark, *rows):
    return spark.createDataFrame(rows, "code string, ts timestamp, n bigint")


def at(day, hour=0):
    return datetime(2026, 3, day, hour)


def keep(spark, path, batch_id, *rows, **options):
    keep_days(points(spark, *rows), path, batch_id, F.to_date("ts"), POINTS, **options)


def stored(spark, path, *bounds):
    return sorted((r["code"], r["ts"], r["n"]) for r in read_days(spark, path, POINTS, *bounds).collect())


def test_a_late_point_rewrites_its_day_and_no_other(spark, tmp_path):
    path, merged = str(tmp_path / "t"), {"identity": ["code", "ts"], "order": [F.col("n")]}
    keep(spark, path, 0, ("a", at(1), 1), ("a", at(1), 2), ("b", at(2), 5), **merged)
    keep(spark, path, 1, ("a", at(2), 7), **merged)
    keep(spark, path, 2, ("a", at(1), 1), ("c", at(1, 9), 3), **merged)
    expected = [("a", at(1), 1), ("a", at(2), 7), ("b", at(2), 5), ("c", at(1, 9), 3)]
    assert stored(spark, path) == expected
    live = {(r["day"], r["version"]) for r in Commits(spark, f"{path}/commits", days.LIVE).rows()}
    assert live == {(date(2026, 3, 1), "2"), (date(2026, 3, 2), "1")}
    # A batch that comes again, with other rows even, changes nothing.
    keep(spark, path, 2, ("z", at(1), 9), **merged)
    assert stored(spark, path) == expected
    assert stored(spark, path, at(1, 1), at(2)) == [("c", at(1, 9), 3)]


def test_readers_open_the_days_they_ask_for(spark, tmp_path):
    path = str(tmp_path / "t")
    keep(spark, path, 0, *[("a", at(d, 5), d) for d in range(1, 29)])
    found = read_days(spark, path, POINTS, "2026-03-10 00:00:00", "2026-03-11 00:00:00")
    assert [r["n"] for r in found.collect()] == [10]
    assert len(found.inputFiles()) <= 4  # those days and their neighbours


def test_an_unfinished_batch_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keep(spark, path, 0, ("a", at(1), 1))

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as broken, pytest.raises(OSError):
        broken.setattr(Commits, "write", lost)
        keep(spark, path, 1, ("b", at(1), 2))
    assert stored(spark, path) == [("a", at(1), 1)]
    keep(spark, path, 1, ("b", at(1), 2))
    assert stored(spark, path) == [("a", at(1), 1), ("b", at(1), 2)]


def test_days_with_many_versions_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(days, "MOST", 3)
    path = str(tmp_path / "t")
    for k in range(9):
        keep(spark, path, k, ("a", at(1), k), (None, None, k))
    live = Commits(spark, f"{path}/commits", days.LIVE).rows()
    assert all(sum(r["day"] == d for r in live) <= 3 for d in (date(2026, 3, 1), None))
    assert sorted(r["n"] for r in read_days(spark, path, POINTS).collect()) == sorted([*range(9)] * 2)
    assert len(folders(spark, f"{path}/data")) < 9  # what nobody names is gone
    assert read_days(spark, str(tmp_path / "none"), POINTS).count() == 0


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_id_index_against_a_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "MOST", 3)
    monkeypatch.setattr(id_index, "FILE_IDS", 4)
    index, known, rng = IdIndex(spark, str(tmp_path / "ids")), set(), random.Random(1)
    assert index.held(keys(spark, "x"), "id").count() == 0
    for batch in range(10):
        wanted = {str(rng.randrange(120)) for _ in range(12)}
        rows = keys(spark, *wanted, None, *list(wanted)[:2])
        assert {r[0] for r in index.held(rows, "id", before=batch).collect()} == wanted & known
        fresh = index.absent(rows, "id", before=batch)
        assert {r[0] for r in fresh.collect()} == (wanted - known) | {None}
        index.add(fresh, "id", batch)
        index.add(keys(spark, "never"), "id", batch)  # the batch is in already
        known |= wanted
    segments = index.commits.rows()
    assert sum(s["ids"] for s in segments) == len(known)
    assert max(s["level"] for s in segments) >= 2 and max(s["folders"] for s in segments) > 1


def test_look_ups_read_the_folders_of_their_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "FILE_IDS", 10)
    index = IdIndex(spark, str(tmp_path / "ids"))
    index.add(spark.range(3000).select(F.col("id").cast("string").alias("id")), "id", 0)
    assert index.commits.rows()[0]["folders"] == 512
    found = index.held(keys(spark, "17", "nowhere"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*folder#\d+ IN \(\d+,\d+\)", plan)  # two of 512
    assert [r[0] for r in found.collect()] == ["17"]


MESSAGES = {"key": "string", "text": "string"}


def test_nothing_is_handed_over_twice(spark, tmp_path):
    path, told = str(tmp_path / "box"), []
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b"), (None, "c")], "key string, text string")
    send = lambda df, n: told.extend((n, r["key"]) for r in df.collect())
    deliver(rows, path, 0, MESSAGES, "key", send)
    deliver(rows, path, 0, MESSAGES, "key", send)  # the batch again
    deliver(rows.union(spark.createDataFrame([("3", "d")], rows.schema)), path, 1, MESSAGES, "key", send)  # the keys again
    assert sorted(told) == [(0, "1"), (0, "2"), (1, "3")]

    def down(df, n):
        raise OSError("sink is down")

    with pytest.raises(OSError):
        deliver(spark.createDataFrame([("4", "e")], rows.schema), path, 2, MESSAGES, "key", down)
    assert unsent(spark, path) == [2]
    deliver(spark.createDataFrame([("4", "e")], rows.schema), path, 2, MESSAGES, "key", send)
    assert len(told) == 3 and delivered(spark, path, MESSAGES).count() == 4


def test_a_source_that_dies_later_is_started_again(spark, tmp_path):
    landing = str(tmp_path / "in")
    for k in range(5):
        spark.createDataFrame([(k,)], "k long").coalesce(1).write.mode("append").parquet(landing)
    seen = {"flaky": [], "steady": [], "hopeless": []}
    gate = threading.Event()

    def source(name, trouble):
        def handle(batch, batch_id):
            trouble(batch_id)
            seen[name].append(batch_id)

        def start():
            stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(landing)
            writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / name))
            return writer.trigger(availableNow=True).start()

        return start

    def third_batch_fails_once(batch_id):
        if batch_id == 2 and not gate.is_set():
            gate.set()
            raise OSError("no route to exchange")

    def never(batch_id):
        raise OSError("always down")

    def cannot_start():
        raise ValueError("bad address")

    found = supervise(
        spark,
        {"steady": source("steady", lambda n: None), "hopeless": source("hopeless", never),
         "flaky": source("flaky", third_batch_fails_once), "unborn": cannot_start},
        restarts=2, pause=0.1, seconds=120,
    )
    assert seen == {"flaky": [0, 1, 2, 3, 4], "steady": [0, 1, 2, 3, 4], "hopeless": []}
    assert (found["flaky"].starts, len(found["flaky"].errors), found["flaky"].failed) == (2, 1, False)
    assert "no route to exchange" in found["flaky"].errors[0]
    assert (found["steady"].starts, found["steady"].errors) == (1, [])
    assert found["hopeless"].failed and found["hopeless"].starts == 3
    assert found["unborn"].failed and found["unborn"].errors == ["bad address"] * 3


def test_a_merged_table_is_shuffled_once_unless_an_identity_is_hot(spark, tmp_path, monkeypatch):
    many = [(f"c{n % 50}", at(n % 28 + 1, 10), n) for n in range(1_400)] * 2
    hot = many + [("c1", at(2, 10), 5_000 + n) for n in range(200)]
    plans, plain = [], days.last_row

    def last_row(df, *args):
        rows = plain(df, *args)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(days, "last_row", last_row)
    for name, rows in (("many", many), ("hot", hot)):
        path, merged = str(tmp_path / name), {"identity": ["code", "ts"], "order": [F.col("n")]}
        keep(spark, path, 0, *rows, **merged)
        keep(spark, path, 1, ("c1", at(2, 10), 1), **merged)
        best = {}
        for code, ts, n in rows:
            best[code, ts] = max(n, best.get((code, ts), n))
        best["c1", at(2, 10)] = 1
        assert stored(spark, path) == sorted((*key, n) for key, n in best.items())
    assert "rangepartitioning(ts" in plans[0] and "hashpartitioning" not in plans[0].split("InMemory")[0]
    assert "hashpartitioning" in plans[2].split("InMemory")[0]  # rows of a hot identity leave before the shuffle


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = set(re.findall(r"\d+", manager.shuffleStatuses().keySet().toString()))
    rows = spark.range(200).selectExpr("CAST(id % 3 AS STRING) AS code", "id AS n", "timestamp'2025-07-01' AS ts")
    columns = {"code": "string", "n": "bigint", "ts": "timestamp"}
    keep_days(rows, str(tmp_path / "t"), 0, F.to_date("ts"), columns, ["code"], [F.col("n")], stored=True)
    left = set(re.findall(r"\d+", manager.shuffleStatuses().keySet().toString())) - before
    kept = {r["code"]: r["n"] for r in read_days(spark, str(tmp_path / "t"), columns).collect()}
    assert kept == {"0": 198, "1": 199, "2": 197}
    assert len(left) <= 1  # what lists the days; not the shuffles of the rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
