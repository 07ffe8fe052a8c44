from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from buzzlens.functions import dates, messages, numbers, text


def values(spark, function, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    found = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in found]


def test_roc_dates(spark):
    inputs = ["1140711", "0991231", "1050229", "", "99", "11407XY", "1140230", None, "0850101"]
    expected = [date(2025, 7, 11), date(2010, 12, 31), date(2016, 2, 29)] + [None] * 5
    assert values(spark, dates.roc_date, inputs) == [*expected, date(1996, 1, 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_forum_dates_do_not_depend_on_the_session_zone(spark, zone):
    inputs = [
        "Fri Jul 11 17:45:30 2025",
        "Tue Feb  4 08:00:00 2025",
        " Sat Feb 29 20:30:00 2020\n",
        "sat FEB 29 20:30:00 2020",
        "Mon Jul 11 17:45:30 2025",  # it was a Friday
        "Fri Jul 11 7:45:30 2025",
        "",
        "later",
        "2025/07/11",
        None,
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = values(spark, lambda c: F.unix_seconds(dates.forum_timestamp(c)), inputs)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    leap_day = 1582979400
    assert found == [1752227130, 1738627200, leap_day, leap_day] + [None] * 6


def test_rss_dates(spark):
    inputs = [
        "Fri, 11 Jul 2025 09:15:00 +0800",
        "Sun, 2 Jul 2025 18:30:00 +0800",
        "Sat, 29 Feb 2020 23:59:59 +0000",
        "11 Jul 2025 10:00:00 -0130",
        None,
        "",
        "later",
        "2025/07/11",
        "Fri, 11 Jul 2025 10:00:00 GMT",
        "Tue, 31 Jun 2025 10:00:00 +0800",
    ]
    expected = [
        datetime(2025, 7, 11, 1, 15),
        datetime(2025, 7, 2, 10, 30),
        datetime(2020, 2, 29, 23, 59, 59),
        datetime(2025, 7, 11, 11, 30),
    ]
    assert values(spark, dates.rss_timestamp, inputs) == expected + [None] * 6


def test_session_close(spark):
    close = values(spark, lambda c: dates.session_close(c.cast("date")), ["2025-07-11"])
    assert close == [datetime(2025, 7, 11, 5, 30)]


def test_prices_and_quantities(spark):
    inputs = ["41.20", "1,234.5", " 7 ", "--", "---", "", None, "1e3", "(5)", "5-", "-2", "1.2.3"]
    expected = ["41.2", "1234.5", "7", None, None, None, None, "1000", "-5", "-5", "-2", None]
    found = values(spark, numbers.price, inputs)
    assert found == [None if e is None else Decimal(e) for e in expected]
    inputs = ["1,250,000", "7,000,000,012", "3.0", "1e3", "3.5", "--", "", None, "(5)"]
    expected = [1250000, 7000000012, 3, 1000, None, None, None, None, -5]
    assert values(spark, numbers.quantity, inputs) == expected


def test_percent_change(spark):
    rows = spark.createDataFrame([(3, 2), (5, 0), (0, 4)], "a int, b int")
    found = rows.select(numbers.pct_change(F.col("a"), F.col("b"), 100).alias("r")).collect()
    assert [r["r"] for r in found] == [50.0, 100.0, -100.0]


def test_entities_are_decoded_once(spark):
    inputs = [
        "a &amp; b", "&amp;lt;", "&lt;p&gt;", "&#21488;&#x7A4D;", "&nope; &", "plain", "",
        "&nbsp;|&quot;&apos;", "&#0;&#xD800;", "&#128640;", None,
    ]
    expected = [
        "a & b", "&lt;", "<p>", "台積", "&nope; &", "plain", "", " |\"'", "&#0;&#xD800;",
        "🚀", None,
    ]
    assert values(spark, text.decode_entities, inputs) == expected


def test_text_helpers(spark):
    assert values(spark, text.strip_space, [" \n a b　", ""]) == ["a b", ""]
    assert values(spark, text.strip_tags, ["<p>a<br/>b</p><!-- <x> -->&amp;"]) == ["ab&amp;"]
    assert values(spark, text.file_stem, ["/bbs/M.9.A.77C.html", "x", "/a/b/", ""]) == [
        "M.9.A.77C", "x", "", "",
    ]
    assert values(spark, text.news_id, ["https://n/id/58?x", "https://n/x"]) == [
        "cnyes_58", "https://n/x",
    ]
    assert values(spark, text.first_word, ["maple7 (nick)", "solo"]) == ["maple7", "solo"]


def test_signed_numbers(spark):
    found = values(spark, lambda c: messages.signed(c.cast("double"), 1), ["1.25", "-3", "0.01"])
    assert found == ["+1.3", "-3.0", "0"]
