import json
import zipfile

from pyspark.sql import functions as F

from mailweave.sinks import reports
from mailweave.sources import crm
from mailweave.sources.config import DEFAULTS, load_config
from mailweave.sources.mailfiles import read_mail_files, read_uploads
from mailweave.sources.requests import parse_requests
from mailweave.streaming import streams

PLAIN = b'From: "Ann B" <ann@x.example>\r\nTo: Bob <bob@y.example>, c@z.example\r\nDate: Tue, 02 Jul 2024 08:39:22 +0530\r\nSubject: =?utf-8?q?Gr=C3=B6=C3=9Fe?=\r\nMessage-ID: <1@x>\r\nContent-Type: text/plain; charset="utf-8"\r\n\r\nDie W\xc3\xa4rme: 55\xc2\xb0C\r\n'
MULTI = b'From: ann@x.example\r\nContent-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<p>Hi&nbsp;<b>you</b></p>\r\n--q\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="a.pdf"\r\n\r\nx\r\n--q--\r\n'


def test_eml(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(PLAIN)
    (tmp_path / "b.eml").write_bytes(MULTI)
    (tmp_path / "c.txt").write_bytes(b"no mail")
    r = {x["source_file"]: x for x in read_mail_files(spark, str(tmp_path)).collect()}
    assert set(r) == {"a.eml", "b.eml"}
    a, b = r["a.eml"], r["b.eml"]
    assert (a["sender_name"], a["sender_address"], a["recipients"], a["subject"], a["date_str"], a["message_id"]) == ("Ann B", "ann@x.example", ["Bob <bob@y.example>", "c@z.example"], "Größe", "Jul 02", "<1@x>")
    assert "55°C" in a["body"] and a["date"].hour == 3
    assert b["body"] == "Hi you" and b["attachments"] == ["a.pdf"] and b["sender_name"] == "ann" and len(b["message_id"]) == 64 and b["date"] is None


def test_uploads_capture_errors(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(PLAIN)
    (tmp_path / "b.msg").write_bytes(b"not an outlook file")
    (tmp_path / "big.eml").write_bytes(PLAIN * 50)
    r = {x["source_file"]: x["error"] for x in read_uploads(spark, str(tmp_path), max_bytes=5000).collect()}
    assert r["a.eml"] is None and r["b.msg"] and "bytes" in r["big.eml"]


def test_requests(spark):
    ok = {"emails": [{"message_id": "1", "subject": "s\x01", "body": "b\x00c", "sender_email": "a@x", "date_str": "2024-07-02T08:00:00Z"}, {"message_id": "2", "subject": "", "body": "", "sender_email": "a@x", "date_str": "bad"}]}
    lines = [("r1", json.dumps(ok)), ("r2", json.dumps({"emails": []})), ("r3", json.dumps({"emails": ok["emails"][:1] * 501})), ("r4", "no json"), ("r5", None)]
    rows = parse_requests(spark.createDataFrame(lines, "request_id string, value string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["request_id"], []).append(r)
    assert {k: v[0]["status"] for k, v in by.items()} == {"r1": 200, "r2": 400, "r3": 413, "r4": 400, "r5": 400}
    assert [r["subject"] for r in by["r1"]] == ["s", ""] and by["r1"][0]["date"] is not None and by["r1"][1]["date"] is None and by["r1"][0]["body"] == "bc"


def test_crm(spark):
    parents = spark.createDataFrame([("p1", "100"), ("p2", "100"), ("p3", "200")], "id string, case_number string")
    m = spark.createDataFrame([("1", "p1", None, "a@x", "A", "b@x; c@x", None, "s", "text", None, None), ("2", "p3", None, "a@x", "A", None, None, "s", "", "<p>h</p>", None)], "id string, parent_id string, related_to_id string, from_address string, from_name string, to_address string, cc_address string, subject string, text_body string, html_body string, message_date timestamp")
    r = crm.from_tables(m, parents, "100").collect()
    assert [(x["message_id"], x["recipients"], x["source_file"]) for x in r] == [("1", ["b@x", "c@x"], "SF-Case-100")]
    assert crm.from_tables(m, parents, "999").count() == 0


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("# comment\nmaterials:\n  - \"tin\"\n  - lead\nother: 1\n")
    c = load_config(str(f))
    assert c["materials"] == ["tin", "lead"] and c["role_keywords"] == DEFAULTS["role_keywords"]
    assert load_config(str(tmp_path / "none.yaml")) == DEFAULTS


def test_sinks(spark, tmp_path):
    people = spark.createDataFrame([("A <b>", "a@x", "X", "")], "name string, address string, company string, role string")
    none = spark.createDataFrame([], "date string, sentence string, mentioned_by string")
    sections = {"People": people, "Timeline": none}
    files = reports.write_report(str(tmp_path), sections)
    assert len(files) == 3
    page = (tmp_path / "report.html").read_text()
    assert "A &lt;b&gt;" in page and "Nothing found." in page
    book = zipfile.ZipFile(tmp_path / "report.xlsx")
    assert "A &lt;b&gt;" in book.read("xl/worksheets/sheet1.xml").decode() and "mentioned_by" in book.read("xl/worksheets/sheet2.xml").decode()
    assert "Nothing found." in zipfile.ZipFile(tmp_path / "report.docx").read("word/document.xml").decode()
    reports.write_report(str(tmp_path / "t"), sections, "tables")
    assert spark.read.parquet(str(tmp_path / "t" / "people")).count() == 1


def test_streams(spark, tmp_path):
    rows = [(1, "<A>", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 02:00:00"), (4, None, "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "delivery_id long, message_id string, t string").select("delivery_id", "message_id", F.to_timestamp("t").alias("received_at"))
    df.write.parquet(str(tmp_path / "in"))
    s = streams.deliveries_once(streams.stream_table(spark, str(tmp_path / "in"), df.schema))
    q = streams.write_once(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    ids = {r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(ids) == 3 and {3, 4} <= ids
    mails = spark.createDataFrame([("t", 1, "Alpha beta gamma delta.\n\nok", "2024-01-01 00:00:00"), ("t", 2, "alpha  BETA gamma delta.", "2024-01-01 01:00:00")], "thread_id string, mail_id long, body string, t string").select("thread_id", "mail_id", "body", F.to_timestamp("t").alias("ts"))
    mails.write.parquet(str(tmp_path / "in2"))
    q = streams.write_once(streams.first_paragraphs(streams.stream_table(spark, str(tmp_path / "in2"), mails.schema), "ts"), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 1


def test_stream_windows(spark, root, tmp_path):
    e = spark.read.parquet(f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "ev"))
    s = streams.window_counts(streams.stream_table(spark, str(tmp_path / "ev"), e.schema), window="1 day")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
