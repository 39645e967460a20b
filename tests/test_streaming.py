from datetime import datetime, timedelta

from mailweave.functions import tables
from mailweave.operators import records
from mailweave.streaming import streams

DAY = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, make):
    """What a stream gives for files that arrive one by one."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.stream_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        q = streams.write_once(make(source), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_rate_limit_on_a_stream_is_that_of_a_batch(spark, tmp_path):
    at = lambda s: DAY + timedelta(seconds=s)
    rows = [(i, "ab"[i % 2], at(s)) for i, s in enumerate([0, 1, 2, 3, 20, 30, 58, 59, 61, 62, 90, 95])]
    schema = "id long, client string, ts timestamp"
    got = {r["id"]: r["accepted"] for r in run(spark, tmp_path, [rows[:5], rows[5:9], rows[9:]], schema, lambda s: streams.rate_limited_stream(s, "client", "ts", 2, 60))}
    want = {r["id"]: r["accepted"] for r in records.rate_limited(spark.createDataFrame(rows, schema), "client", "ts", 2, 60).collect()}
    assert got == want and not all(got.values())


def test_similar_paragraphs_across_batches(spark, tmp_path):
    words = [f"w{k}" for k in range(20)]
    first, near, far = " ".join(words), " ".join([*words[:19], "other"]), " ".join([*words[:9], *[f"z{k}" for k in range(11)]])
    rows = [("t", 1, f"{first}\n\nshort", DAY), ("t", 2, f"{near}\n\n{far}\n\nshort", DAY + timedelta(hours=1)), ("u", 3, near, DAY + timedelta(hours=2))]
    schema = "thread_id string, mail_id long, body string, ts timestamp"
    got = sorted((r["mail_id"], r["paragraph"]) for r in run(spark, tmp_path, [rows[:1], rows[1:]], schema, lambda s: streams.distinct_paragraphs(s, "ts")))
    assert got == sorted([(1, first), (1, "short"), (2, far), (2, "short"), (3, near)])


def test_people_once_and_late_events(spark, tmp_path):
    rows = [("t", 1, "a@x.example", ["Bob <b@x.example>"], None, DAY), ("t", 2, "b@x.example", ["A@X.example"], ["c@x.example"], DAY + timedelta(hours=1))]
    schema = "thread_id string, mail_id long, sender_address string, recipients array<string>, cc array<string>, ts timestamp"
    got = sorted((r["address"], r["mail_id"]) for r in run(spark, tmp_path / "p", [rows[:1], rows[1:]], schema, lambda s: streams.first_mentions(s, "ts")))
    assert got == [("a@x.example", 1), ("b@x.example", 1), ("c@x.example", 2)]
    events = [[("x", 1.0, DAY)], [("x", 1.0, DAY + timedelta(days=5))], [("x", 100.0, DAY), ("x", 1.0, DAY + timedelta(days=9))], [("x", 1.0, DAY + timedelta(days=20))]]
    out = run(spark, tmp_path / "e", events, "event_type string, value double, ts timestamp", lambda s: streams.window_counts(s, window="1 day", delay="1 day"))
    assert {r["start"].day: r["total"] for r in out}[1] == 1.0  # what comes after the watermark isn't counted


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "The bore is 5 mm in brass."), (2, None)], "id long, body string").createOrReplaceTempView("mw_mails")
    got = [tuple(r) for r in spark.sql("SELECT m.id, s.category, s.value, s.unit FROM mw_mails m, LATERAL mail_specs(m.body) s").collect()]
    assert (1, "Dimensions", "5", "mm") in got and (1, "Material", "brass", "") in got and all(r[0] == 1 for r in got)
    r = spark.sql("SELECT p.* FROM (SELECT encode('From: a@x.example\r\nSubject: s\r\n\r\nhello', 'utf-8') AS c), LATERAL parsed_mail(c) p").collect()
    assert [(x["sender_address"], x["subject"], x["body"]) for x in r] == [("a@x.example", "s", "hello")]
