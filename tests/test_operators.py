from datetime import datetime

import pytest
from pyspark.sql import functions as F

from buzzlens import schemas
from buzzlens.operators import concepts as con
from buzzlens.operators import dictionary as dic
from buzzlens.operators import documents as doc
from buzzlens.operators import embeddings as emb
from buzzlens.operators import keyed, paging
from buzzlens.plans.processing import probe_documents, process_documents

NOW = "2026-04-01 00:00:00"


def make(spark, rows, columns):
    return spark.createDataFrame(rows, schemas.ddl(columns))


def document(number, source="PttStock", title="t", content="c", day=1, up=None):
    at = datetime(2026, 3, day)
    return (str(number), source, None, title, content, at, None, up, None, None)


def documents(spark, *rows):
    return make(spark, list(rows), schemas.DOCUMENTS)


# Keyed tables


def test_insert_if_absent_keeps_stored_and_first(spark):
    stored = documents(spark, document(1, title="old"))
    batch = documents(
        spark, document(1, title="new"), document(2, title="b", day=2), document(2, title="a")
    )
    rows = doc.new_documents(batch, stored).collect()
    assert [(r["document_id"], r["title"]) for r in rows] == [("2", "a")]
    again = doc.new_documents(batch, stored.unionByName(doc.new_documents(batch, stored)))
    assert again.count() == 0


def test_large_batches_are_not_broadcast(spark):
    batch = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert keyed.fits_broadcast(batch, 100)
    assert not keyed.fits_broadcast(batch, 99)
    found = keyed.insert_if_absent(batch, batch.filter("k < '5'"), "k", [F.col("k")])
    assert found.count() == 100 - batch.filter("k < '5'").count()


def test_one_row_per_key_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    last = keyed.last_row(rows, ["k"], [F.col("id")])
    assert {r["id"] for r in last.collect()} == {997, 998, 999}
    assert {r["id"] for r in keyed.first_row(rows, ["k"], [F.col("id")]).collect()} == {0, 1, 2}
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_dense_ids_have_no_gaps_and_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    first = {r["k"]: r["n"] for r in keyed.dense_ids(rows, F.col("k"), "n", 10).collect()}
    mixed = rows.repartition(13, "k")
    second = {r["k"]: r["n"] for r in keyed.dense_ids(mixed, F.col("k"), "n", 10).collect()}
    assert first == second
    assert sorted(first.values()) == list(range(11, 5011))
    assert keyed.max_id(rows.select(F.lit(None).cast("long").alias("x")), "x") == 0


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("left_docs", "right_docs"):
        rows = spark.range(1000).select(F.col("id").cast("string").alias("document_id"))
        keyed.save_bucketed(rows, name, "document_id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = spark.table("left_docs").join(spark.table("right_docs"), "document_id", "left_anti")
        assert joined.count() == 0
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE left_docs")
        spark.sql("DROP TABLE right_docs")


def test_counters_need_no_extra_job(spark):
    rows, counter = keyed.counted(spark.range(7), "added")
    assert rows.count() == 7 and counter.get["rows"] == 7


# Paging


@pytest.mark.parametrize("heap", [50_000, 0], ids=["heap", "distributed sort"])
def test_pages(spark, monkeypatch, heap):
    monkeypatch.setattr(paging, "HEAP_ROWS", heap)
    rows = spark.range(1, 203).repartition(7)
    order = [F.col("id").desc()]

    def page(number):
        return [r["id"] for r in paging.page_of(rows, order, number, 25, ["id"]).collect()]

    assert page(1) == page(0) == page(-3) == list(range(202, 177, -1))
    assert page(4) == list(range(127, 102, -1))
    assert page(9) == page(1000) == [2, 1]
    assert paging.page_of(rows.limit(0), order, 5, 25, ["id"]).count() == 0
    [totals] = paging.page_totals(rows, 25).collect()
    assert (totals["total"], totals["pages"]) == (202, 9)
    assert paging.page_totals(rows.limit(0), 25).first()["pages"] == 1


# Documents


def test_union_and_checks(spark):
    news = documents(spark, document("n", "NewsCnyes")).drop("upvotes", "downvotes", "arrows")
    forum = documents(spark, document("f", up=88))
    union = doc.union_documents(forum, news)
    assert union.columns == list(schemas.DOCUMENTS)
    assert {r["document_id"]: r["upvotes"] for r in union.collect()} == {"f": 88, "n": None}
    bad = documents(
        spark,
        document(1, title="x" * 501),
        document(2, source="Blog"),
        document(3, title=None),
        document(4, title="x" * 500),
    )
    valid, rejected = doc.split_documents(bad)
    assert [r["document_id"] for r in valid.collect()] == ["4"]
    assert {r["document_id"]: r["error"] for r in rejected.collect()} == {
        "1": "title too long", "2": "source_type unknown", "3": "title missing",
    }


def test_recent_ids_bound_is_inclusive(spark):
    docs = documents(spark, document(1, day=24), document(2, day=25), document(3, "Mops", day=30))
    assert [r[0] for r in doc.recent_ids(docs, "PttStock", NOW).collect()] == ["2"]


def test_batches_and_marks(spark):
    docs = documents(
        spark,
        document(1, day=3, up=50),
        document(2, day=1, up=9),
        document(3, "NewsUdn", day=2),
        document(4, day=1, up=50),
        document(5, day=1, up=99),
        document(6, day=1),
    )
    status = make(
        spark,
        [(i, datetime(2026, 3, 9), 0 if i == "5" else 1, None) for i in "12345"],
        schemas.DOC_STATUS,
    )
    assert [r["document_id"] for r in doc.unprocessed_batch(docs, status).collect()] == ["6"]
    hot = doc.hot_documents(docs, status)
    assert [r["document_id"] for r in hot.collect()] == ["4", "1", "3"]
    assert [r["document_id"] for r in doc.hot_documents(docs, status, size=2).collect()] == ["4", "1"]
    plan = hot._jdf.queryExecution().executedPlan().toString()
    # The picked ids are broadcast; the first exchange below the sort is theirs.
    final_sort, join = plan.split("TakeOrderedAndProject")[:2]  # then comes the pick
    assert "BroadcastHashJoin" in join and "rangepartitioning" not in plan
    assert "SortMergeJoin" not in join
    marked = doc.mark_probed(status, hot, NOW)
    probed = {r["document_id"] for r in marked.filter("probed_at IS NOT NULL").collect()}
    assert probed == {"1", "3", "4"}
    assert doc.hot_documents(docs, marked).count() == 0


def test_article_search(spark):
    docs = documents(
        spark,
        document(1, title="[新聞] a", day=1, up=5),
        document(2, title="b", day=2),
        document(3, title="[新聞] c", day=3, up=9),
        document(4, "Mops", title="[新聞] d", day=4),
    )

    def ids(**options):
        return [r["document_id"] for r in doc.article_search(docs, **options).collect()]

    assert ids() == ["3", "2", "1"]
    assert ids(sort="upvotes") == ["2", "3", "1"]  # no votes first
    assert ids(title="新聞") == ["3", "1"] and ids(title="  ") == ["3", "2", "1"]
    assert ids(title="%") == [] and ids(title="B") == []
    assert ids(date_from="2026-03-02", date_to="2026-03-02") == ["2"]
    assert ids(size=2, page=2) == ["1"] and ids(size=2, page=9) == ["1"]
    assert [r["title"] for r in doc.document(docs, "2").collect()] == ["b"]
    assert doc.document(docs, "9").count() == 0


# Dictionary


def bars(spark, *rows):
    return spark.createDataFrame(
        list(rows), "stock_code string, stock_name string, market string, trading_date string"
    ).withColumn("trading_date", F.col("trading_date").cast("date"))


def test_sync_is_idempotent_and_skips_known_codes(spark):
    entities = make(spark, [(5, "Stock", "old name", "1101")], schemas.ENTITIES)
    aliases = make(spark, [(8, 5, "1101"), (9, 5, "old name")], schemas.ALIASES)
    quoted = bars(
        spark,
        ("1101", "new name", "TWSE", "2026-03-23"),
        ("2330", "otc name", "TPEX", "2026-03-20"),
        ("2330", "台積電", "TWSE", "2026-03-23"),
        ("6547", "高端", "TPEX", "2026-03-23"),
    )
    new_entities, new_aliases = dic.sync_dictionary(quoted, entities, aliases)
    found = {r["stock_code"]: r for r in new_entities.collect()}
    assert set(found) == {"2330", "6547"} and found["2330"]["primary_name"] == "台積電"
    assert {r["entity_id"] for r in found.values()} == {6, 7}
    rows = new_aliases.collect()
    assert {r["alias_id"] for r in rows} == {10, 11, 12, 13}
    assert {r["keyword"] for r in rows} == {"2330", "台積電", "6547", "高端"}
    again, _ = dic.sync_dictionary(
        quoted, entities.unionByName(new_entities), aliases.unionByName(new_aliases)
    )
    assert again.count() == 0


def test_hand_made_entities_and_aliases(spark):
    entities = make(spark, [], schemas.ENTITIES)
    aliases = make(spark, [], schemas.ALIASES)
    requests = spark.createDataFrame(
        [(1, "Stock", " 2330 ", " 台積電\n"), (2, "Concept", "9", "AI"), (3, "Stock", " ", "x"),
         (4, "Person", None, "  "), (5, "Person", None, "黃仁勳"), (6, "Person", None, "x" * 101)],
        "request_id long, type string, stock_code string, name string",
    )
    errors = {r["request_id"]: r["error"] for r in dic.check_entity_requests(requests).collect()}
    assert errors == {1: None, 2: None, 3: "code", 4: "name", 5: None, 6: "primary_name too long"}
    new_entities, new_aliases = dic.add_entities(requests, entities, aliases)
    kept = {r["primary_name"]: r for r in new_entities.collect()}
    assert {n: r["stock_code"] for n, r in kept.items()} == {"台積電": "2330", "AI": None, "黃仁勳": None}
    listed = dic.entity_aliases(new_entities, new_aliases).collect()
    assert sorted(r["keyword"] for r in listed) == ["2330", "AI", "台積電", "黃仁勳"]

    stock = kept["台積電"]["entity_id"]
    wanted = spark.createDataFrame(
        [(stock, " GG "), (stock, "GG"), (stock, "2330"), (stock, " "), (99, "GG"), (stock, "x" * 101),
         (kept["AI"]["entity_id"], "GG")],
        "entity_id long, keyword string",
    )
    added = dic.add_aliases(wanted, new_entities, new_aliases)
    assert sorted((r["entity_id"], r["keyword"]) for r in added.collect()) == sorted(
        [(stock, "GG"), (kept["AI"]["entity_id"], "GG")]
    )
    everything = new_aliases.unionByName(added)
    ids = [r["alias_id"] for r in everything.collect()]
    assert len(set(ids)) == len(ids)
    one = everything.filter((F.col("entity_id") == stock) & (F.col("keyword") == "GG"))
    left = dic.delete_aliases(one, everything)
    assert left.count() == len(ids) - 1
    foreign = one.withColumn("entity_id", F.lit(12345).cast("long"))
    assert dic.delete_aliases(foreign, everything).count() == len(ids)
    gone = new_entities.filter(F.col("entity_id") == stock)
    e, a = dic.delete_entities(gone, new_entities, everything)
    assert e.count() == 2 and a.filter(F.col("entity_id") == stock).count() == 0


def test_entity_search_order_and_counts(spark):
    entities = make(
        spark,
        [(1, "Concept", "AI 30", None), (2, "Stock", "b", "30"), (3, "Stock", "a", "1303"),
         (4, "Concept", "other", None)],
        schemas.ENTITIES,
    )
    aliases = make(spark, [(1, 2, "x"), (2, 2, "y"), (3, 4, "z")], schemas.ALIASES)
    rows = dic.entity_search(entities, aliases, "30").collect()
    assert [(r["entity_id"], r["alias_count"]) for r in rows] == [(3, 0), (2, 2), (1, 0)]
    assert [r["entity_id"] for r in dic.entity_search(entities, aliases).collect()] == [3, 2, 1, 4]


# Concepts


def words(title, content):
    return F.split(content, " ")


def test_concept_upsert_counts_before_merging(spark):
    none = make(spark, [], schemas.CONCEPTS)
    docs = documents(
        spark, document(1, content="AI AI 矽光子", day=2), document(2, content="AI", day=1)
    )
    first = con.upsert_concepts(con.found_concepts(docs, words), none, "2026-03-10 00:00:00")
    rows = {r["keyword"]: r for r in first.collect()}
    assert rows["AI"]["appearance_count"] == 3 and rows["AI"]["source_document_id"] == "2"
    assert rows["矽光子"]["appearance_count"] == 1
    assert {r["concept_id"] for r in rows.values()} == {1, 2}
    later = con.found_concepts(documents(spark, document(3, content="AI 電力")), words)
    second = {r["keyword"]: r for r in con.upsert_concepts(later, first, NOW).collect()}
    assert second["AI"]["appearance_count"] == 4
    assert second["AI"]["first_discovered_at"] == datetime(2026, 3, 10)
    assert second["AI"]["last_seen_at"] == datetime(2026, 4, 1)
    assert second["矽光子"]["last_seen_at"] == datetime(2026, 3, 10)
    assert second["電力"]["concept_id"] == 3
    assert con.found_concepts(docs).count() == 0


def concepts(spark):
    at = datetime(2026, 3, 1)
    return make(
        spark,
        [(i, "d", None, f"w{i}", n, at, at, i == 5) for i, n in enumerate([3, 9, 9, 1, 7, 2, 8, 4], 1)],
        schemas.CONCEPTS,
    )


def test_pending_top_five(spark):
    pending = con.pending_concepts(concepts(spark))
    assert [r["concept_id"] for r in pending.collect()] == [2, 3, 7, 8, 1]
    text = con.review_messages(pending).first()["message"]
    assert "`/approve 2` 加入白名單" in text and "關聯股票：—" in text


def test_reviews(spark):
    texts = [
        "/approve 1", " /APPROVE   1 ", "/approve", "/approve x", "/approve 99", "hello 1",
        "/reject 2", "/approve 2", "/approve 3", "/reject 3", "/approve 5", "/reject 5", "/reject 99",
        "/approve 4 now",
    ]
    messages = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    commands = con.parse_commands(messages)
    table = concepts(spark)
    rows = {r["seq"]: r for r in con.review_outcomes(commands, table).collect()}
    assert {s: r["outcome"] for s, r in rows.items()} == {
        0: "promoted", 1: "already", 2: "usage", 3: "usage", 4: "missing", 6: "removed",
        7: "missing", 8: "promoted", 9: "removed", 10: "already", 11: "removed", 12: "missing",
        13: "usage",
    }
    assert rows[0]["reply"] == "✅ 已將「w1」加入白名單" and rows[2]["reply"] == "用法：/approve <id>"
    entities = make(spark, [(7, "Stock", "s", "1")], schemas.ENTITIES)
    aliases = make(spark, [(3, 7, "s")], schemas.ALIASES)
    left, new_entities, new_aliases = con.apply_reviews(commands, table, entities, aliases)
    assert {r["concept_id"]: r["approved"] for r in left.collect()} == {
        1: True, 4: False, 6: False, 7: False, 8: False,
    }
    made = {r["primary_name"]: r for r in new_entities.collect()}
    assert set(made) == {"w1", "w3"} and {r["entity_id"] for r in made.values()} == {8, 9}
    assert {(r["alias_id"] - 3, r["entity_id"] - 7) for r in new_aliases.collect()} == {(1, 1), (2, 2)}


# Vectors and whole jobs


def test_embeddings(spark):
    docs = documents(spark, document(1), document(2), document(3))
    matched = spark.createDataFrame([("1",), ("2",)], "document_id string")
    stored = make(spark, [("2", [0.0, 0.0], None, datetime(2026, 1, 1))], schemas.EMBEDDINGS)
    [row] = emb.embed_documents(docs, matched, stored, NOW).collect()
    assert (row["document_id"], len(row["embedding"]), row["sentiment"]) == ("1", 1536, None)
    wrong = emb.embed_documents(docs, matched, stored, NOW, lambda t: F.array(F.lit(1.0)), 2)
    with pytest.raises(Exception, match="embedding must have 2 values"):
        wrong.collect()
    batch = make(
        spark,
        [("2", [1.0, 1.0], None, None), ("4", [1.0, 1.0], 0.5, None), ("5", [1.0], None, None)],
        schemas.EMBEDDINGS,
    )
    assert [r["document_id"] for r in emb.new_embeddings(batch, stored, 2).collect()] == ["4"]


def test_processing_then_probing(spark):
    docs = documents(
        spark,
        document(1, title="台積電", content="AI 起飛", up=20),
        document(2, title="x", content="nothing", up=30),
    )
    aliases = spark.createDataFrame([(1, "台積電"), (2, "AI")], "entity_id long, keyword string")
    entities = spark.createDataFrame([(1, "2330"), (2, None)], "entity_id long, stock_code string")
    stored = make(spark, [], schemas.EMBEDDINGS)
    done = process_documents(
        docs, aliases, entities, stored, NOW, lambda t: F.array(F.length(t).cast("float")), 1
    )
    assert {r["stock_code"] for r in done.mentions.collect()} == {"2330", "entity_2"}
    assert {r["document_id"]: r["entity_match_count"] for r in done.status.collect()} == {"1": 2, "2": 0}
    assert [r["document_id"] for r in done.embeddings.collect()] == ["1"]
    empty = make(spark, [], schemas.CONCEPTS)
    probed = probe_documents(docs, done.status, empty, NOW, words)
    assert {r["keyword"] for r in probed.concepts.collect()} == {"AI", "起飛"}
    assert probed.status.filter("probed_at IS NOT NULL").count() == 1


def test_null_keys_are_numbered(spark):
    from buzzlens.operators.keyed import dense_ids

    rows = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    assert sorted(r.n for r in dense_ids(rows, F.col("k"), "n").collect()) == [1, 2, 3]


def test_unknown_entity_types_are_refused(spark):
    from buzzlens.operators.dictionary import check_entity_requests

    rows = spark.createDataFrame(
        [(1, "Foo", None, "x"), (2, "Person", None, "y"), (3, None, None, "z")],
        "request_id long, type string, stock_code string, name string",
    )
    errors = {r.request_id: r.error for r in check_entity_requests(rows).collect()}
    assert errors == {1: "type", 2: None, 3: "type"}


def test_lone_angle_brackets_are_text(spark):
    from buzzlens.functions.text import strip_tags

    rows = spark.createDataFrame([("price < 30 and EPS > 5 <b>good</b><!-- x -->",)], "t string")
    assert rows.select(strip_tags(F.col("t"))).first()[0] == "price < 30 and EPS > 5 good"


def test_broadcast_check_counts_bytes(spark):
    from buzzlens.operators.keyed import fits_broadcast

    wide = spark.range(100).selectExpr("repeat('x', 1000000) AS t")
    assert not fits_broadcast(wide) and fits_broadcast(spark.range(100).toDF("n"))
    assert not fits_broadcast(spark.range(100).toDF("n"), 99)


# Merges that read once


def test_words_that_cannot_be_concepts_are_refused_with_a_reason(spark):
    words = [("d1", None), ("d1", " "), ("d2", "x" * 101), ("d2", "AI"), ("d3", "AI"), ("d3", None)]
    found = spark.createDataFrame(
        [(d, datetime(2026, 3, 1), w) for d, w in words], "document_id string, published_at timestamp, keyword string"
    )
    stored = make(spark, [(7, "d0", None, None, 4, None, None, False), (8, "d0", None, "", 1, None, None, True)], schemas.CONCEPTS)
    changes = con.concept_changes(found, stored, NOW)
    refused = {(r["keyword"], r["reason"], r["seen_count"]) for r in con.refused_words(changes).collect()}
    assert refused == {(None, "keyword missing", 2), (" ", "keyword missing", 1), ("x" * 101, "keyword too long", 1)}
    once = con.after_changes(changes)
    again = con.upsert_concepts(found, once, NOW)  # on its own result: counts grow, no row is added
    for table, count in ((once, 2), (again, 4)):
        rows = {r["concept_id"]: (r["keyword"], r["appearance_count"], r["approved"]) for r in table.collect()}
        assert rows == {7: (None, 4, False), 8: ("", 1, True), 9: ("AI", count, False)}


def test_a_merge_reads_each_side_once(spark, tmp_path):
    make(spark, [(1, "d", None, "AI", 1, None, None, False)], schemas.CONCEPTS).write.parquet(str(tmp_path / "c"))
    columns = "document_id string, published_at timestamp, keyword string"
    spark.createDataFrame([("d", datetime(2026, 3, 1), "AI")], columns).write.parquet(str(tmp_path / "f"))
    scans = []
    found = spark.read.schema(columns).parquet(str(tmp_path / "f"))
    stored = spark.read.schema(schemas.ddl(schemas.CONCEPTS)).parquet(str(tmp_path / "c"))
    checkpoint = type(found).checkpoint

    def watched(df, *args, **kwargs):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return checkpoint(df, *args, **kwargs)

    type(found).checkpoint = watched
    try:
        table = con.upsert_concepts(found, stored, NOW)
    finally:
        type(found).checkpoint = checkpoint
    assert scans == [2]
    assert "FileScan" not in table._jdf.queryExecution().executedPlan().toString()


def test_stocks_with_unusable_codes_or_names_are_left_out(spark):
    day = datetime(2026, 3, 1).date()
    rows = [("1", "One", "TWSE", day), ("", "Nameless", "TWSE", day), (None, "None", "TWSE", day),
            ("2" * 11, "Long code", "TPEX", day), ("3", "n" * 101, "TPEX", day), ("4", " ", "TPEX", day)]
    bars = spark.createDataFrame(rows, "stock_code string, stock_name string, market string, trading_date date")
    none = make(spark, [], schemas.ENTITIES), make(spark, [], schemas.ALIASES)
    errors = {r["stock_code"]: r["error"] for r in dic.dictionary_changes(bars, none[0]).collect()}
    assert errors == {
        "1": None, "": "stock_code missing", None: "stock_code missing", "2" * 11: "stock_code too long",
        "3": "primary_name too long", "4": "primary_name missing",
    }
    entities, aliases = dic.sync_dictionary(bars, *none)
    assert [r["stock_code"] for r in entities.collect()] == ["1"] and aliases.count() == 2


def test_picks_read_the_texts_of_picked_days(spark, tmp_path):
    from buzzlens.sources.days import keep_days, read_days

    docs = documents(spark, *[document(k, day=k, up=20) for k in range(1, 21)])
    keep_days(docs, str(tmp_path / "d"), 0, F.to_date("published_at"), schemas.DOCUMENTS)
    stored = read_days(spark, str(tmp_path / "d"), schemas.DOCUMENTS)
    status = make(spark, [(str(k), datetime(2026, 3, 30), 1, None) for k in range(3, 9)], schemas.DOC_STATUS)
    for picked, ids in (
        (doc.unprocessed_batch(stored, status, 2), ["1", "2"]),
        (doc.hot_documents(stored, status, 2), ["3", "4"]),
    ):
        assert [r["document_id"] for r in picked.collect()] == ids
        assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString()


def test_null_and_empty_keys_are_numbered_alike_on_every_run(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",)], "k string")
    first = {r["k"]: r["n"] for r in keyed.dense_ids(rows, F.col("k"), "n").collect()}
    assert first[None] == 1
    for parts in (1, 3):
        assert {r["k"]: r["n"] for r in keyed.dense_ids(rows.repartition(parts), F.col("k"), "n").collect()} == first
