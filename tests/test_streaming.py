import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.operators.mentions import mention_delta_history, mention_points
from buzzlens.plans import catalog
from buzzlens.plans.signals import signals
from buzzlens.sources.quotes import LISTED, parse_quotes, read_quotes, unreadable
from buzzlens.streaming import jobs


def quote(code, volume, close="10.5"):
    fields = ("OpeningPrice", "HighestPrice", "LowestPrice")
    return {"Date": "1150323", "Code": code, "Name": code, "ClosingPrice": close,
            "TradeVolume": volume, "TradeValue": "9", **{f: "1" for f in fields}}


def test_quotes_last_poll_wins_and_restart_adds_nothing(spark, tmp_path):
    landing, table, rejected, checkpoint = (str(tmp_path / n) for n in ("in", "bars", "bad", "check"))
    (tmp_path / "in").mkdir()

    def poll(name, rows):
        (tmp_path / "in" / name).write_text(json.dumps(rows))

    def run():
        stream = jobs.quote_stream(spark, landing, LISTED)
        jobs.keep_quotes(stream, LISTED, table, rejected, checkpoint).awaitTermination()
        stored = jobs.stored_bars(spark, table).collect()
        return {r["stock_code"]: (r["volume"], float(r["close"])) for r in stored}

    poll("1.json", [quote("2330", "2,000"), quote("9999", "--")])
    assert run() == {"2330": (2000, 10.5)}
    poll("2.json", [quote("2330", "1,000", "11"), quote("2454", "5")])
    (tmp_path / "in" / "3.json").write_text('[{"Code": "cut')
    expected = {"2330": (1000, 11.0), "2454": (5, 10.5)}
    assert run() == expected and run() == expected
    [bad] = jobs.read_table(spark, rejected, schemas.UNREADABLE).collect()
    assert "cut" in bad["_corrupt_record"]


def test_quotes_are_read_once_and_nothing_is_cached(spark, tmp_path, monkeypatch):
    """A batch is parsed to files that go when it is kept; counts and tables are those of the texts."""
    landing, table, rejected, counters = (str(tmp_path / n) for n in ("in", "bars", "bad", "counters"))
    (tmp_path / "in").mkdir()
    lines = [json.dumps(quote(code, "2,000")) for code in ("2330", "2454", "2330")]
    lines += [json.dumps(quote("9999", "--")), '{"Code": "cut', json.dumps(quote("2330", "1"))[:-1] + " x"]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    cached = []
    kind = type(spark.range(1))
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: cached.append(self.columns) or persist(self, *a))
    stream = jobs.quote_stream(spark, landing, LISTED, json_array=False)
    jobs.keep_quotes(stream, LISTED, table, rejected, str(tmp_path / "check"), counters=counters).awaitTermination()
    assert cached == [] and not (tmp_path / "bars/staged").exists()
    raw = read_quotes(spark, landing, LISTED, json_array=False).localCheckpoint()
    bars, bad = parse_quotes(raw, LISTED).collect(), unreadable(raw).collect()
    assert len(bars) >= 3 and len(bad) == 2
    assert {tuple(r) for r in jobs.stored_bars(spark, table).select(*schemas.BARS).collect()} <= {tuple(r) for r in bars}
    assert {r["stock_code"] for r in jobs.stored_bars(spark, table).collect()} == {r["stock_code"] for r in bars}
    found = jobs.read_table(spark, rejected, schemas.UNREADABLE).collect()
    assert sorted(r["_corrupt_record"] for r in found) == sorted(r["_corrupt_record"] for r in bad)
    counts = {r["metric"]: r["rows"] for r in jobs.stored_counters(spark, counters, "quotes").collect()}
    assert counts == {"kept": len(bars), "unreadable": len(bad)}


def test_polls_land_compressed(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(n, n, f"[{json.dumps(quote(str(n), '5'))}]") for n in range(1, 7)],
                                  "l_orderkey bigint, l_linenumber int, value string")
    monkeypatch.setattr(catalog.b, "quote_texts", lambda *a: texts.coalesce(1))
    monkeypatch.setattr(catalog, "LANDED_ROWS", 1)
    monkeypatch.setattr(catalog, "scratch_path", lambda *a: str(tmp_path))
    catalog._quote_files(spark, "")
    landed = [f.name for f in (tmp_path / "landing").iterdir() if f.name.startswith("part-")]
    assert len(landed) == 6 and all(n.endswith(".txt.gz") for n in landed)
    assert {r["stock_code"] for r in jobs.stored_bars(spark, f"{tmp_path}/bars").collect()} == set("123456")


def test_window_sums_keep_late_points_and_the_last_window(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "sums", "check"))
    window, columns = timedelta(minutes=10), "stock_code string, ts timestamp, mention_count bigint"
    old, new = datetime(2025, 7, 1), datetime(2025, 7, 11)
    polls = [[("a", new, 3), ("b", new, 1)], [("a", old, 2), ("a", new + window, 6), (None, new, 9)]]
    for rows in polls:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(columns).parquet(landing)
        jobs.keep_window_sums(stream, window, table, checkpoint).awaitTermination()
    found = jobs.stored_deltas(spark, table).collect()
    assert sorted(found) == sorted(mention_delta_history(spark.read.parquet(landing), window).collect())
    assert {r["window_start"] for r in found} == {old, new, new + window}


def document_files(spark, path, rows):
    frame = spark.createDataFrame(rows, schemas.ddl(schemas.DOCUMENTS))
    frame.coalesce(1).write.mode("append").parquet(path)


def document_stream(spark, path, files=1):
    reader = spark.readStream.schema(schemas.ddl(schemas.DOCUMENTS))
    return reader.option("maxFilesPerTrigger", files).parquet(path)


def row(number, title, minute=0, up=None):
    at = datetime(2026, 3, 24, 5, minute)
    return (str(number), "PttStock", None, title, "c", at, None, up, None, None)


def test_documents_are_kept_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "docs", "check"))
    document_files(spark, landing, [row(1, "a", up=1), row(1, "a", up=1), row(2, "b")])
    jobs.keep_documents(document_stream(spark, landing), table, checkpoint).awaitTermination()
    document_files(spark, landing, [row(1, "changed", up=99), row(3, "c")])
    jobs.keep_documents(document_stream(spark, landing), table, checkpoint).awaitTermination()
    kept = {r["document_id"]: r["title"] for r in jobs.stored_documents(spark, table).collect()}
    assert kept == {"1": "a", "2": "b", "3": "c"}


def test_compaction_keeps_rows_and_the_job_goes_on(spark, tmp_path):
    landing, table, target = (str(tmp_path / n) for n in ("in", "sums", "compact"))
    checkpoint, columns = str(tmp_path / "check"), "stock_code string, ts timestamp, mention_count bigint"
    window = timedelta(minutes=10)

    def run(path, hour):
        spark.createDataFrame([("a", datetime(2026, 3, 24, hour), 1)], columns).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(columns).parquet(landing)
        jobs.keep_window_sums(stream, window, path, checkpoint).awaitTermination()

    for hour in range(4):
        run(table, hour)
    jobs.compact(spark, table, target, schemas.WINDOW_SUMS, through=2)
    run(target, 9)
    kept = jobs.read_table(spark, target, schemas.WINDOW_SUMS).filter("current_count > 0").collect()
    assert sorted((r["window_start"].hour, r["batch_id"]) for r in kept) == [(0, 2), (1, 2), (2, 2), (3, 3), (9, 4)]


def test_a_repeated_batch_gives_the_same_table(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "docs")
    document_files(spark, landing, [row(1, "a"), row(2, "b")])
    for attempt in ("first", "lost checkpoint"):
        stream = document_stream(spark, landing)
        jobs.keep_documents(stream, table, str(tmp_path / attempt)).awaitTermination()
        assert jobs.stored_documents(spark, table).count() == 2


def test_refused_documents_are_counted_and_not_stored(spark, tmp_path):
    landing, table, counters = (str(tmp_path / n) for n in ("in", "docs", "counters"))
    document_files(spark, landing, [row(1, "a"), row(1, "a"), row(2, "x" * 501), (None, *row(3, "no id")[1:])])
    jobs.keep_documents(document_stream(spark, landing), table, str(tmp_path / "c"), counters=counters).awaitTermination()
    assert [r["document_id"] for r in jobs.stored_documents(spark, table).collect()] == ["1"]
    counts = {r["metric"]: r["rows"] for r in jobs.stored_counters(spark, counters, "documents").collect()}
    assert counts == {"read": 4, "added": 1, "refused": 2}


def test_seen_ids_are_remembered_by_arrival(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "docs", "check"))
    old = (*row(7, "old")[:5], datetime(2020, 1, 1), *row(7, "old")[6:])

    def run(rows):
        document_files(spark, landing, rows)
        jobs.keep_seen(document_stream(spark, landing), table, checkpoint).awaitTermination()
        return sorted(r["document_id"] for r in jobs.read_table(spark, table, schemas.DOCUMENTS).collect())

    assert run([row(1, "a"), row(1, "a"), row(2, "b")]) == ["1", "2"]
    assert run([row(2, "b"), row(3, "c"), old]) == ["1", "2", "3", "7"]  # six years late, and it enters
    assert run([old, row(1, "a"), row(4, "d")]) == ["1", "2", "3", "4", "7"]  # once; the state outlived two restarts


def test_forum_ingest_asks_for_unseen_articles_only(spark, tmp_path):
    landing, table = str(tmp_path / "in"), str(tmp_path / "docs")
    entry = '<div class="r-ent"><div class="title"><a href="/b/{0}.html">t</a></div></div>'
    page = (
        '<div id="main-content"><div class="article-metaline"><span class="article-meta-tag">時間</span>'
        '<span class="article-meta-value">Tue Mar 24 09:53:01 2026</span></div>text {0}</div>'
    )
    asked = []

    def articles(entries):
        ids = sorted(r["article_id"] for r in entries.collect())
        asked.append(ids)
        rows = [(i, f"u/{i}", page.format(i) if i != "broken" else "<p>gone") for i in ids]
        return spark.createDataFrame(rows, "document_id string, url string, html string")

    for ids in (["A.1", "A.1", "broken"], ["A.1", "B.2", "broken"]):
        html = [("".join(entry.format(i) for i in ids),)]
        spark.createDataFrame(html, "html string").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("html string").parquet(landing)
        jobs.keep_forum(stream, articles, table, str(tmp_path / "check")).awaitTermination()
    assert asked == [["A.1", "broken"], ["B.2", "broken"]]
    assert {r["document_id"]: r["content"] for r in jobs.stored_documents(spark, table).collect()} == {
        "A.1": "text A.1", "B.2": "text B.2",
    }


def test_mentions_match_batch_form_and_see_new_entities(spark, tmp_path):
    landing = str(tmp_path / "in")
    entities = spark.createDataFrame([(1, "2330"), (2, None)], "entity_id long, stock_code string")
    words = [(1, "台積電")]

    def dictionary():
        return spark.createDataFrame(words, "entity_id long, keyword string"), entities

    def run():
        stream = document_stream(spark, landing)
        table = str(tmp_path / "mentions")
        jobs.keep_mentions(stream, dictionary, table, str(tmp_path / "check")).awaitTermination()
        return jobs.stored_mentions(spark, table)

    document_files(spark, landing, [row(1, "台積電 台積電"), row(2, "AI")])
    assert [r["mention_count"] for r in run().collect()] == [2]
    words.append((2, "AI"))
    document_files(spark, landing, [row(3, "AI")])
    found = run().collect()
    assert {(r["document_id"], r["stock_code"]) for r in found} == {("1", "2330"), ("3", "entity_2")}
    documents = spark.read.schema(schemas.ddl(schemas.DOCUMENTS)).parquet(landing)
    batch = mention_points(documents.filter("document_id != '2'"), *dictionary()).collect()
    key = lambda r: (r["document_id"], r["entity_id"], r["ts"], r["mention_count"])
    assert sorted(map(key, found)) == sorted(map(key, batch))


def test_alerts_equal_batch_signals_and_are_told_once(spark, tmp_path):
    last = datetime(2026, 3, 24, 5, 59, 59)
    kinds = schemas.ddl(schemas.MENTIONS)
    points = spark.createDataFrame(
        [("1", 1, "a", "PttStock", last - timedelta(minutes=m), n) for m, n in ((0, 3), (20, 2), (2000, 9))], kinds
    )
    landing, told, asked = str(tmp_path / "mentions"), [], []
    points.write.parquet(landing)
    bars = spark.createDataFrame(
        [("a", "TWSE", datetime(2026, 3, d, 5, 30), p, 1) for d, p in ((23, 90.0), (22, 100.0))],
        "stock_code string, market string, ts timestamp, close double, volume long",
    )

    def run(checkpoint):
        jobs.keep_alerts(
            spark.readStream.schema(kinds).parquet(landing),
            lambda start, stop: asked.append((start, stop)) or bars,
            str(tmp_path / "alerts"),
            str(tmp_path / checkpoint),
            notify=lambda df, batch_id: told.append((batch_id, df.count())),
        ).awaitTermination()
        return [r["alert_id"] for r in jobs.stored_alerts(spark, str(tmp_path / "alerts")).collect()]

    expected = [r["alert_id"] for r in signals(points, bars, "2026-03-24 06:00:00").collect()]
    assert run("check") == expected and told == [(0, 1)]
    assert asked == [("2026-03-13 06:00:00", "2026-03-24 06:00:00")]
    # The batch comes again with more mentions of its windows: same alert, not told again.
    more = [("9", 1, "a", "PttStock", last - timedelta(minutes=18), 500)]
    spark.createDataFrame(more, kinds).write.mode("append").parquet(landing)
    assert run("lost checkpoint") == expected and told == [(0, 1)]


def test_window_state_equals_batch(spark, tmp_path):
    start = datetime(2026, 3, 24)
    rows = [(str(i), 1, "ab"[i % 2], "PttStock", start + timedelta(minutes=i * 11), 1 + i % 3)
            for i in range(60)]
    path = str(tmp_path / "mentions")
    points = spark.createDataFrame(rows, schemas.ddl(schemas.MENTIONS))
    points.write.parquet(path)
    window = timedelta(hours=1)
    stream = spark.readStream.schema(schemas.ddl(schemas.MENTIONS)).parquet(path)
    deltas = mention_delta_history(stream.withWatermark("ts", "10 minutes"), window)
    running = (
        deltas.writeStream.format("memory").queryName("deltas").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    closed = rows[-1][4] - timedelta(minutes=10)
    batch = mention_delta_history(points, window).filter(
        F.col("window_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(closed)
    )
    assert sorted(spark.table("deltas").collect()) == sorted(batch.collect())


@pytest.mark.parametrize("job", sorted(jobs.INTERVALS))
def test_triggers(job):
    assert jobs.every(job)["processingTime"].split()[1] in ("seconds", "minutes")


def test_reviews_go_on_from_the_version_before(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "reviews")
    concepts = spark.createDataFrame(
        [(n, "d", None, f"word{n}", n, None, None, False) for n in (1, 2, 3)], schemas.ddl(schemas.CONCEPTS)
    )
    aliases = spark.createDataFrame([(40, 7, "x")], "alias_id long, entity_id long, keyword string")
    entities = spark.createDataFrame([(7, "Stock", "x", "1")], schemas.ddl(schemas.ENTITIES))

    def run(rows):
        messages = spark.createDataFrame(rows, "seq long, text string")
        messages.coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("seq long, text string").parquet(landing)
        jobs.keep_reviews(
            stream, concepts, lambda: (aliases, entities), path, str(tmp_path / "check")
        ).awaitTermination()
        return {r["concept_id"]: r["approved"] for r in jobs.stored_concepts(spark, path).collect()}

    assert run([(1, "/approve 1"), (2, "hello")]) == {1: True, 2: False, 3: False}
    assert run([(3, "/reject 1"), (4, "/approve 2"), (5, "/approve 9")]) == {2: True, 3: False}
    added = jobs.read_table(spark, f"{path}/entities", schemas.ENTITIES).collect()
    assert {(r["entity_id"], r["primary_name"]) for r in added} == {(8, "word1"), (9, "word2")}
    named = jobs.read_table(spark, f"{path}/aliases", schemas.ALIASES).collect()
    assert {(r["alias_id"], r["entity_id"]) for r in named} == {(41, 8), (42, 9)}


def test_processing_writes_status_of_matched_documents_last(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "processed")
    aliases = spark.createDataFrame([(1, "AI")], "entity_id long, keyword string")
    entities = spark.createDataFrame([(1, "2330")], "entity_id long, stock_code string")
    document_files(spark, landing, [row(1, "AI AI"), row(2, "none")])
    jobs.keep_processed(
        document_stream(spark, landing), lambda: (aliases, entities), path,
        str(tmp_path / "check"), lambda n: "2026-03-24 06:00:00", dimension=1536,
    ).awaitTermination()
    status = jobs.read_table(spark, f"{path}/status", schemas.DOC_STATUS).collect()
    assert {(r["document_id"], r["entity_match_count"]) for r in status} == {("1", 1), ("2", 0)}
    vectors = jobs.read_table(spark, f"{path}/embeddings", schemas.EMBEDDINGS).collect()
    assert [(r["document_id"], len(r["embedding"])) for r in vectors] == [("1", 1536)]


def test_probing_goes_on_from_what_is_open(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "probe")
    docs = spark.createDataFrame([row(k, f"Word{k}", up=20 + k) for k in range(6)] + [row(9, "cold", up=1)], schemas.ddl(schemas.DOCUMENTS))
    words = lambda title, content: F.array(title)

    def run(*ids):
        at = datetime(2026, 3, 24, 6)
        rows = [(str(k), at, 0 if k == 5 else 1, None) for k in ids]
        spark.createDataFrame(rows, schemas.ddl(schemas.DOC_STATUS)).coalesce(1).write.mode("append").parquet(landing)
        jobs.keep_probed(
            spark.readStream.schema(schemas.ddl(schemas.DOC_STATUS)).parquet(landing), lambda: docs, path,
            str(tmp_path / "check"), lambda n: f"2026-03-24 0{n}:00:00", words, size=2,
        ).awaitTermination()
        newest = max(int(f.name.split("=")[1]) for f in (tmp_path / "probe/open").iterdir())
        still = spark.read.parquet(f"{path}/open/batch_id={newest}").collect()
        return {r["keyword"] for r in jobs.stored_concepts(spark, path).collect()}, {r["document_id"] for r in still}

    assert run(0, 1, 2, 5, 9) == ({"Word2", "Word1"}, {"0"})  # no match, no votes: never open
    assert run(3) == ({"Word2", "Word1", "Word3", "Word0"}, set())
    for k in range(4):
        run(9)
    assert len(list((tmp_path / "probe/concepts").iterdir())) <= 6  # old versions are gone
