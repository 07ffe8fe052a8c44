import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from buzzlens.operators import matching
from buzzlens.operators.matching import entity_counts, keyword_hits, match_counts, with_stock_code


def frames(spark, words, texts):
    aliases = spark.createDataFrame(words, "entity_id long, keyword string")
    documents = spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "document_id string, text string"
    )
    return documents, aliases


def brute_force(words, texts):
    found = Counter()
    for i, text in enumerate(texts):
        for entity, word in words:
            for start in range(len(text) - len(word) + 1):
                if word and text.startswith(word, start):
                    found[str(i), entity, word] += 1
    return found


def hits(spark, words, texts, **options):
    documents, aliases = frames(spark, words, texts)
    rows = keyword_hits(documents, aliases, F.col("text"), **options).collect()
    return Counter((r["document_id"], r["entity_id"], r["keyword"]) for r in rows)


MANY = [(i, f"詞{i * 37 % 101:03d}末") for i in range(60)]


@pytest.mark.parametrize(
    "words,text,expected",
    [
        ([(1, "鋼鐵")], "鋼鐵股與鋼鐵業", 2),
        ([(1, "ab"), (2, "bc")], "abcab", 3),
        ([(1, "海"), (1, "海運")], "海運 海", 3),
        ([(1, "綠能")], "綠 能", 0),
        ([(1, "x")], "", 0),
        ([], "abc", 0),
        ([(1, ""), (2, "運")], "航運", 1),
        ([(1, "77")], "777 77", 3),
        ([(1, "油"), (2, "油")], "油", 2),
        ([(1, "油"), (1, "油")], "油", 2),
        ([(1, "aa")], "aaaa", 3),
        ([(1, "A")], "aAa", 1),
        ([(1, " ")], "a b c", 2),
        (MANY, "|".join(w for _, w in MANY), 60),
    ],
)
def test_cases(spark, words, text, expected):
    found = hits(spark, words, [text])
    assert sum(found.values()) == expected
    assert found == brute_force(words, [text])


@pytest.mark.parametrize("limit", [1_000, 0], ids=["broadcast", "shuffle"])
def test_random_texts_against_brute_force(spark, limit):
    rng = random.Random(7)
    letters = "ab台😀\n"
    def word(longest):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
    words = [(rng.randint(1, 9), word(12)) for _ in range(60)]
    texts = [word(n) for n in (1, 2, 9, 63, 64, 65, 128, 130, 500, 700)] + ["", "a", "ab"]
    assert hits(spark, words, texts, max_broadcast_rows=limit) == brute_force(words, texts)


def test_every_piece_boundary(spark):
    word = "needle in hay"
    texts = ["x" * n + word + "y" * 70 for n in range(matching.PIECE - 15, matching.PIECE + 3)]
    assert hits(spark, [(1, word)], texts) == brute_force([(1, word)], texts)


def test_counts_codes_and_status(spark):
    documents = spark.createDataFrame(
        [("d1", "台積", "電 台積電"), ("d2", "", "none"), ("d3", "聯發科", "")],
        "document_id string, title string, content string",
    )
    aliases = spark.createDataFrame(
        [(1, "台積電"), (1, "台積"), (2, "聯發科"), (2, "積 電")], "entity_id long, keyword string"
    )
    entities = spark.createDataFrame([(1, "2330"), (2, None)], "entity_id long, stock_code string")
    counts = entity_counts(keyword_hits(documents, aliases))
    rows = with_stock_code(counts, entities).collect()
    found = {(r["document_id"], r["stock_code"]): r["mention_count"] for r in rows}
    assert found == {("d1", "2330"): 3, ("d1", None): 1, ("d3", None): 1}
    status = {r[0]: r[1] for r in match_counts(documents, counts).collect()}
    assert status == {"d1": 2, "d2": 0, "d3": 1}


def test_texts_are_not_shuffled(spark):
    documents, aliases = frames(spark, [(1, "ab")], ["abab"])
    plan = (
        entity_counts(keyword_hits(documents, aliases, F.col("text")))
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("BroadcastHashJoin") == 2
    first = plan.index("BroadcastHashJoin")
    assert "Exchange hashpartitioning(document_id" in plan[:first]


@pytest.mark.parametrize("limit", [1_000, 0], ids=["broadcast", "shuffle"])
def test_keywords_longer_than_a_piece(spark, limit):
    rng = random.Random(11)
    body = "".join(rng.choice("abc") for _ in range(900))
    words = [(1, body[100:400]), (2, body[330:400]), (3, body[63:129]), (4, "ab"), (5, "a"), (6, body[500:509])]
    texts = [body, body[:399], body[100:400], "c" * 200 + body[100:400] + "a" * 63]
    assert hits(spark, words, texts, max_broadcast_rows=limit) == brute_force(words, texts)


def test_large_dictionary_shuffles_what_the_heads_let_through(spark):
    documents, aliases = frames(spark, [(1, "ab"), (2, "abcdefghij")], ["abab"])
    plan = (
        keyword_hits(documents, aliases, F.col("text"), max_broadcast_rows=0)
        ._jdf.queryExecution().executedPlan().toString()
    )
    heads = plan.index("BroadcastHashJoin")
    assert plan.index("Exchange hashpartitioning(anchor_key") < heads  # the head filter is below the exchange
    exchanged = plan[plan.index("Exchange hashpartitioning(anchor_key"):heads]
    assert "section" not in exchanged.split("Project")[0]


def many_words(rng):
    """Codes that no text holds, one of them almost, and words that texts do hold, some twice."""
    codes = [(1_000 + n, f"Q{n}") for n in range(10_000, 10_400)] + [(7, "aab"), (7, "aab"), (8, "aab"), (9, "aabb")]
    return codes + [(rng.randint(1, 9), "".join(rng.choice("ab台") for _ in range(rng.randint(1, 11)))) for _ in range(40)]


def test_keywords_that_do_not_occur_leave_a_large_dictionary(spark):
    rng = random.Random(5)
    words = many_words(rng)
    texts = ["".join(rng.choice("ab台") for _ in range(n)) for n in (1, 5, 64, 200)] + ["Q1000 Q10399 Q1", ""]
    documents, aliases = frames(spark, words, texts)
    expected = brute_force(words, texts)
    left = matching.occurring(documents, aliases, F.col("text"), max_broadcast_rows=100).collect()
    assert Counter(map(tuple, left)) == Counter(w for w in words if w in {(e, k) for _, e, k in expected})
    assert hits(spark, words, texts, max_broadcast_rows=100) == expected
    counts = matching.keyword_counts(documents, aliases, F.col("text"), max_broadcast_rows=100).collect()
    assert {tuple(r)[:3]: r["hits"] for r in counts} == expected and len(counts) == len(expected)


@pytest.mark.parametrize("cut", [8, 4, None])
def test_anchors_are_cut_until_they_fit(spark, monkeypatch, cut):
    rng = random.Random(6)
    words = many_words(rng)
    texts = ["".join(rng.choice("ab台") for _ in range(n)) for n in (3, 70, 150)] + ["Q10399Q103999"]
    monkeypatch.setattr(matching, "GATE_LENGTHS", (cut or 4,))
    if cut is None:
        monkeypatch.setattr(matching, "fits_broadcast", lambda df: False)
    assert hits(spark, words, texts, max_broadcast_rows=0) == brute_force(words, texts)


def test_a_large_dictionary_shuffles_counts(spark):
    words = [(n, f"w{n}") for n in range(10)]
    documents, aliases = frames(spark, words, [" ".join(w for _, w in words) * 500])
    counts = matching.keyword_counts(documents, aliases, F.col("text"), max_broadcast_rows=0)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(document_id"):]
    assert "partial_count(1)" in below.split("BroadcastHashJoin")[0]
    assert {r["hits"] for r in counts.collect()} == {500}


def test_codes_of_a_large_dictionary(spark, monkeypatch):
    documents = spark.createDataFrame([("d1", "ab", "abc")], "document_id string, title string, content string")
    aliases = spark.createDataFrame([(1, "ab"), (2, "bc"), (3, "zz"), (4, "c")], "entity_id long, keyword string")
    entities = spark.createDataFrame([(1, "A"), (1, "B"), (2, None), (3, "Z")], "entity_id long, stock_code string")
    monkeypatch.setattr(matching, "_is_small", lambda words, rows: words.size <= 3)
    rows = matching.coded_counts(documents, aliases, entities).select("entity_id", "mention_count", "stock_code")
    assert {tuple(r) for r in rows.collect()} == {(1, 2, "A"), (1, 2, "B"), (2, 1, None), (4, 1, None)}


def test_entities_of_a_keyword_are_added_after_the_exchange(spark):
    words = [(n, "ab") for n in range(40)] + [(3, "ab"), (5, "b"), (6, "zz")]
    documents, aliases = frames(spark, words, ["abab", "b", "", "abab"])
    documents = documents.unionByName(documents.filter("document_id = '0'")).unionByName(
        documents.filter("document_id = '3'").withColumn("document_id", F.lit(None).cast("string"))
    )
    counts = matching.keyword_counts(documents, aliases, F.col("text"))
    found = {tuple(r)[:3]: r["hits"] for r in counts.collect()}
    each = Counter(map(tuple, keyword_hits(documents, aliases, F.col("text")).collect()))
    assert found == each and found["0", 3, "ab"] == 8 and found[None, 5, "b"] == 2 and ("0", 6, "zz") not in found
    plan = counts._jdf.queryExecution().executedPlan().toString()
    exchanged = plan[plan.index("Exchange hashpartitioning(document_id"):]
    assert "entity_id" not in exchanged.split("\n")[1]


def test_parts_of_a_dictionary_share_one_run_over_the_texts(spark, monkeypatch):
    documents, aliases = frames(spark, [(1, "ab"), (2, "zz")], ["abab", "b", ""])
    more = [spark.createDataFrame([(n, w)], "entity_id long, keyword string") for n, w in ((3, "b"), (4, "ab"), (5, "y"))]
    for part in more:
        aliases = aliases.unionByName(part)
    documents, plans = documents.persist(), []
    keep = type(documents).checkpoint

    def checkpoint(frame, *options):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return keep(frame, *options)

    monkeypatch.setattr(type(documents), "checkpoint", checkpoint)
    found = matching.occurring(documents, aliases, F.col("text"), max_broadcast_rows=4)
    documents.unpersist()
    assert sorted(map(tuple, found.collect())) == [(1, "ab"), (3, "b"), (4, "ab")]
    assert sum(plan.count("regexp_extract_all") for plan in plans) == 1
