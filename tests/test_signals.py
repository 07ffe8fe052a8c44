from datetime import datetime, timedelta

from pyspark.sql import functions as F

from buzzlens.operators.mentions import mention_counts, mention_delta_history, mention_deltas
from buzzlens.operators.snapshot import ohlcv_snapshot
from buzzlens.plans.signals import alert_messages, signals

NOW = datetime(2026, 3, 24, 6, 0)
AS_OF = "2026-03-24 06:00:00"
WINDOW = timedelta(minutes=15)


def mentions(spark, *rows):
    """Rows (code, minutes before now, count)."""
    return spark.createDataFrame(
        [(c, "PttStock", NOW - timedelta(minutes=m), n) for c, m, n in rows],
        "stock_code string, source_type string, ts timestamp, mention_count long",
    )


def bars(spark, *rows):
    """Rows (code, days before now, close, volume)."""
    close = datetime(2026, 3, 24, 5, 30)
    return spark.createDataFrame(
        [(c, "TWSE", close - timedelta(days=d), p, v) for c, d, p, v in rows],
        "stock_code string, market string, ts timestamp, close double, volume long",
    ).withColumn("close", F.col("close").cast("decimal(18,4)"))


def test_windows_are_half_open(spark):
    points = mentions(spark, ("a", 0, 100), ("a", 15, 2), ("a", 14, 1), ("a", 30, 4), ("a", 31, 50))
    [row] = mention_deltas(points, AS_OF, WINDOW).collect()
    assert (row["current_count"], row["previous_count"], row["mention_delta"]) == (3, 4, -25.0)
    counts = mention_counts(points, "2026-03-24 05:30:00", "2026-03-24 05:46:00").collect()
    assert [r["mention_count"] for r in counts] == [6]


def test_missing_previous_and_missing_current(spark):
    points = mentions(spark, ("new", 1, 1), ("gone", 20, 5), ("zero", 1, 0), ("", 1, 1), (None, 1, 1))
    rows = mention_deltas(points, AS_OF, WINDOW).collect()
    assert [(r["stock_code"], r["mention_delta"]) for r in rows] == [("new", 100.0)]


def test_history_equals_single_windows(spark):
    points = mentions(spark, *[("ab"[i % 2], i * 7 % 200, i % 5) for i in range(60)])
    history = mention_delta_history(points, WINDOW).collect()
    found = {(r["stock_code"], r["window_start"]): r["mention_delta"] for r in history}
    expected = {}
    for step in range(0, 20):
        end = NOW + WINDOW - step * WINDOW
        for r in mention_deltas(points, str(end), WINDOW).collect():
            expected[r["stock_code"], end - WINDOW] = r["mention_delta"]
    assert found == expected


def test_snapshot(spark):
    table = bars(
        spark,
        ("a", 0, 110.0, 300), ("a", 1, 100.0, 100), ("a", 5, 90.0, 200), ("a", 9, 80.0, 999),
        ("one", 0, 50.0, 10),
        ("old", 7, 5.0, 10), ("old", 8, 4.0, 10),
        ("older", 11, 5.0, 10),
        ("future", -1, 5.0, 10),
    )
    rows = {r["stock_code"]: r for r in ohlcv_snapshot(table, AS_OF).collect()}
    assert set(rows) == {"a", "one", "old"}
    a = rows["a"]
    assert (float(a["close"]), float(a["prev_close"])) == (110.0, 100.0)
    assert (a["latest_volume"], a["avg_volume"]) == (300, 200.0)
    assert rows["one"]["prev_close"] == rows["one"]["close"]
    assert rows["old"]["avg_volume"] == 0.0


def surge(code):
    return [(code, 1, 3), (code, 20, 2)]  # exactly +50 %


def fired(spark, points, table, **options):
    rows = signals(mentions(spark, *points), bars(spark, *table), AS_OF, **options).collect()
    return {r["stock_code"]: r for r in rows}


def test_rules(spark):
    codes = ["both", "fall", "flat", "quiet", "onebar", "novol", "calm", "entity_7"]
    points = [p for c in codes if c != "calm" for p in surge(c)] + [("calm", 1, 2), ("calm", 20, 2)]
    table = [
        ("both", 0, 102.0, 300), ("both", 1, 100.0, 100),  # volume +50 %, price +2 %
        ("fall", 0, 99.0, 100), ("fall", 1, 100.0, 100),  # price -1 %
        ("flat", 0, 101.9, 300), ("flat", 1, 100.0, 100),
        ("quiet", 0, 110.0, 100), ("quiet", 1, 100.0, 100),
        ("onebar", 0, 90.0, 900),
        ("novol", 7, 110.0, 900), ("novol", 8, 100.0, 1),  # no volume in six days
        ("calm", 0, 50.0, 900), ("calm", 1, 100.0, 1),
    ]
    found = fired(spark, points, table)
    assert {c: r["type"] for c, r in found.items()} == {
        "both": "Resonance", "fall": "BearishDivergence",
    }
    both = found["both"]
    assert (both["mention_delta"], both["volume_delta"], both["price_delta"]) == (50.0, 50.0, 2.0)
    assert both["summary"] == "【共振】both 聲量+50.0% / 量比+50.0% / 股價+2.00%"
    assert found["fall"]["summary"] == "【背離】fall 聲量+50.0% 但股價-1.00%，留意出貨風險"
    assert both["stock_name"] == "both" and both["sentiment_avg"] is None


def test_first_rule_wins_and_ids_repeat(spark):
    table = [("a", 0, 98.0, 300), ("a", 1, 100.0, 100)]
    loose = {"resonance_price_min": -5.0}
    first, second = (fired(spark, surge("a"), table, **loose)["a"] for _ in range(2))
    assert first["type"] == "Resonance" and first["alert_id"] == second["alert_id"]
    assert fired(spark, surge("a"), table, mention_delta_min=50.1) == {}


def test_zero_base_price(spark):
    table = [("a", 0, 5.0, 300), ("a", 1, 0.0, 100)]
    assert fired(spark, surge("a"), table) == {}
    assert fired(spark, surge("a"), table, bearish_price_max=0.0)["a"]["price_delta"] == 0.0


def test_names_and_messages(spark):
    names = spark.createDataFrame([("a", "台積電")], "stock_code string, stock_name string")
    points = mentions(spark, *surge("a"), *surge("b"))
    table = bars(spark, *[(c, d, p, 1) for c in "ab" for d, p in ((0, 90.0), (1, 100.0))])
    alerts = signals(points, table, AS_OF, names=names)
    assert {r["stock_name"] for r in alerts.collect()} == {"台積電", "b"}
    text = alert_messages(alerts).filter("stock_code = 'a'").first()["message"]
    assert text.startswith("⚠️ *【背離】a") and "觸發時間：2026-03-24 06:00 UTC" in text
    assert "聲量變化：+50.0%" in text and "量比變化：0%" in text and "股價變化：-10.00%" in text


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "mentions")
    mentions(spark, *surge("a")).write.parquet(path)
    stored = spark.read.schema(
        "stock_code string, source_type string, ts timestamp, mention_count long"
    ).parquet(path)
    plan = mention_deltas(stored, AS_OF, WINDOW)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2026-03-24 05:30:00" in plan
    assert "LessThan(ts,2026-03-24 06:00:00" in plan
    assert "ReadSchema: struct<stock_code:string,ts:timestamp,mention_count:bigint>" in plan
    assert plan.count("Exchange hashpartitioning") == 1
