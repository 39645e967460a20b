from datetime import datetime

from mailweave.operators import timestamps as ts

BOXES = [("de", "Europe/Berlin", "dmy"), ("us", "America/New_York", "mdy"), ("jp", "Asia/Tokyo", "ymd"), ("none", None, None)]


def instants(spark, *pairs):
    m = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(pairs)], "delivery_id long, mailbox string, date_str string")
    d = spark.createDataFrame(BOXES, "mailbox string, tz_name string, date_order string")
    out = ts.normalise_timestamps(m, d).orderBy("delivery_id").collect()
    return [r["instant_utc"] for r in out]


def test_forms(spark):
    cases = [
        ("de", "Tue, 02 Jul 2024 08:39:22 -0700", datetime(2024, 7, 2, 15, 39, 22)), ("de", "2024-07-02T19:14:06.989Z", datetime(2024, 7, 2, 19, 14, 6, 989000)), ("de", "01/07/2024 18:56", datetime(2024, 7, 1, 16, 56)),
        ("us", "6/27/2024 6:27:55 PM", datetime(2024, 6, 27, 22, 27, 55)), ("us", "12/01/2024 12:00:01 AM", datetime(2024, 12, 1, 5, 0, 1)), ("jp", "2025/03/02 23:47", datetime(2025, 3, 2, 14, 47)),
        ("us", "09.07.2024 23:24:45", datetime(2024, 7, 10, 3, 24, 45)), ("us", "1720332423", datetime(2024, 7, 7, 6, 7, 3)), ("us", "1720317178274", datetime(2024, 7, 7, 1, 52, 58, 274000)),
        ("jp", "20240804110453", datetime(2024, 8, 4, 2, 4, 53)), ("jp", "20240718T102926Z", datetime(2024, 7, 18, 10, 29, 26)), ("de", "30 Jun 24 11:31 +0200", datetime(2024, 6, 30, 9, 31)),
        ("de", "2024-07-11 03:01:15.371869-03", datetime(2024, 7, 11, 6, 1, 15, 371869)), ("us", "2024-07-24 04:15 Europe/Berlin", datetime(2024, 7, 24, 2, 15)), ("us", "Jan 21, 2025 8:35:45 AM IST", datetime(2025, 1, 21, 3, 5, 45)),
        ("de", "Mar 24, 2025 8:44:36 PM -03", datetime(2025, 3, 24, 23, 44, 36)), ("de", " Sun, 3 Nov 2024 18:09:33 GMT ", datetime(2024, 11, 3, 18, 9, 33)), ("de", "Fri, 23 Aug 2024 09:29:01 -0400 (New York)", datetime(2024, 8, 23, 13, 29, 1)),
    ]
    assert instants(spark, *[c[:2] for c in cases]) == [c[2] for c in cases]


def test_clock_changes(spark):
    # twice: the first; skipped: read with the offset before
    assert instants(spark, ("us", "2024-11-03 01:30:00"), ("us", "2024-03-10 02:30:00"), ("de", "2024-03-31 02:15:00")) == [datetime(2024, 11, 3, 5, 30), datetime(2024, 3, 10, 7, 30), datetime(2024, 3, 31, 1, 15)]


def test_no_instant(spark):
    assert instants(spark, *[("de", t) for t in (None, "", "n/a", "Jul 27", "sent yesterday", "31/02/2024 10:00", "2024-07-01", "99/99/2024 10:00")]) == [None] * 8


def test_unknown_source_and_learning(spark):
    # without declaration the unambiguous dates of a source decide the ambiguous ones; without any it stays marked
    m = spark.createDataFrame([(i, "none", t) for i, t in enumerate(["3/25/2024 10:00", "4/26/2024 10:00", "5/28/2024 10:00", "3/4/2024 10:00"])] + [(9, "ghost", "3/4/2024 10:00")], "delivery_id long, mailbox string, date_str string")
    d = spark.createDataFrame(BOXES, "mailbox string, tz_name string, date_order string")
    r = {x["delivery_id"]: x for x in ts.normalise_timestamps(m, d).collect()}
    assert r[3]["instant_utc"] == datetime(2024, 3, 4, 10) and r[3]["time_format"] == "slash_mdy"
    assert r[9]["time_ambiguous"] and not r[0]["time_ambiguous"]


def test_stored_dates(spark):
    m = spark.createDataFrame([(1, "de", datetime(2024, 7, 2, 15, 39, 22), "Tue, 02 Jul 2024 08:39:22 -0700"), (2, "de", datetime(2024, 7, 2, 15, 39, 23), "Tue, 02 Jul 2024 08:39:22 -0700"), (3, "de", None, "2024-07-02T19:14:06Z"), (4, "de", datetime(2024, 1, 1), "Jul 27")], "delivery_id long, mailbox string, date timestamp_ntz, date_str string")
    d = spark.createDataFrame(BOXES, "mailbox string, tz_name string, date_order string")
    assert [r[0] for r in ts.wrong_stored_dates(m, d).collect()] == [2]
    assert ts.wrong_stored_dates(m.limit(0), d).count() == 0


def test_declared_order_holds_at_every_size(spark):
    # the same shares give the same reading: one day-first value beside few or very many month-first ones
    d = spark.createDataFrame(BOXES, "mailbox string, tz_name string, date_order string")
    for n in (500, 200_000):
        many = spark.range(n).selectExpr("id + 1 AS delivery_id", "'de' AS mailbox", "'03/25/2024 10:00' AS date_str")
        m = many.unionByName(spark.createDataFrame([(0, "de", "03/04/2024 10:00")], "delivery_id long, mailbox string, date_str string"))
        r = ts.normalise_timestamps(m, d).where("delivery_id = 0").first()
        assert r["instant_utc"] == datetime(2024, 4, 3, 8) and r["time_format"] == "slash_dmy" and r["time_ambiguous"]


def test_year_first_with_two_digits(spark):
    assert instants(spark, ("jp", "24/03/05 10:00"), ("de", "24/03/05 10:00"), ("us", "03/04/24 10:00"), ("de", "24/3/5 10:00")) == [datetime(2024, 3, 5, 1), datetime(2005, 3, 24, 9), datetime(2024, 3, 4, 15), datetime(2024, 3, 5, 9)]


def test_unknown_zones(spark):
    m = spark.createDataFrame([(1, "bad", "2024-01-01 10:00:00"), (2, "de", "2024-01-01 10:00:00 Foo/Bar"), (3, "de", "2024-01-01 10:00:00 QQQ"), (4, "de", "2024-01-01 10:00:00 America/Argentina/Ushuaia")], "delivery_id long, mailbox string, date_str string")
    d = spark.createDataFrame([*BOXES, ("bad", "No/Where", "dmy")], "mailbox string, tz_name string, date_order string")
    assert [r["instant_utc"] for r in ts.normalise_timestamps(m, d).orderBy("delivery_id").collect()] == [None, None, None, datetime(2024, 1, 1, 13)]


def test_stored_dates_are_read_with_all_rows(spark):
    # the unambiguous texts that decide have no stored date
    m = spark.createDataFrame([(i, "none", None, f"3/{i}/2024 10:00") for i in range(20, 29)] + [(1, "none", datetime(2024, 3, 4, 10), "3/4/2024 10:00")], "delivery_id long, mailbox string, date timestamp_ntz, date_str string")
    d = spark.createDataFrame(BOXES, "mailbox string, tz_name string, date_order string")
    assert ts.wrong_stored_dates(m, d).count() == 0
