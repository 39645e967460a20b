import json
import threading
import urllib.error
import urllib.request

from mailweave import cli, service
from mailweave.operators import summary
from mailweave.plans.analyze import analyze, ordered
from mailweave.sinks import reports
from mailweave.sources import crm, mailfiles

MAILS = [
    {"message_id": "2", "subject": "Re: Bore", "body": "The shaft bore is 60 mm now. The flange should be approximately 12 - 14 mm thick.", "sender_name": "Bob", "sender_email": "bob@beta.example", "recipients": ["ann@acme.example"], "cc": [], "date_str": "2024-03-05T10:00:00Z"},
    {"message_id": "1", "subject": "Bore", "body": "The shaft bore is 42 mm in brass. Please confirm the torque?", "sender_name": "Ann", "sender_email": "ann@acme.example", "recipients": None, "cc": None, "date_str": "2024-03-04T10:00:00Z"},
]


def test_answer(spark):
    status, out = service.answer(spark, json.dumps({"emails": MAILS}))
    m = out["metrics"]
    assert status == 200 and out["status"] == "success" and m["emails_processed"] == 2
    assert {s["value"] for s in m["specs"]} >= {"42", "60"} and [c["severity"] for c in m["conflicts"] if c["category"] == "Dimensions"]
    assert {p["address"]: p["mails_sent"] for p in m["people"]} == {"ann@acme.example": 1, "bob@beta.example": 1}
    assert m["unresolved_items"] and m["tagged_sentences"] and "**Mails:** 2" in m["summary"]
    assert service.answer(spark, json.dumps({"emails": []}))[0] == 400 and service.answer(spark, "nonsense")[0] == 400
    assert service.answer(spark, json.dumps({"emails": MAILS[:1] * 501}))[0] == 413
    status, out = service.answer(spark, json.dumps({"emails": MAILS, "use_local_ai": True}))
    assert status == 200 and "reachable" in out["metrics"]["summary"]


def test_server(spark):
    server = service.serve(spark, "secret", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, data=None, key="secret"):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, data, {"X-API-Key": key})) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/health") == (200, {"status": "ok", "model_reachable": False})
        assert ask("/none")[0] == 404 and ask("/analyze", b"{}", "wrong")[0] == 403 and ask("/analyze", b"{}")[0] == 400
    finally:
        server.shutdown()
        server.server_close()


def test_limiter():
    limit = service.Limiter(2, 60)
    assert [limit.accept("a", t) for t in (0, 1, 2, 59, 60, 61, 62)] == [True, True, False, False, True, True, False] and limit.accept("b", 2)


class Client:
    def __init__(self, given=None):
        self.sent = []

    def query(self, table, where):
        if table in ("Case", "Opportunity"):
            return [{"id": "p1", "case_number": "7", "name": "7"}] if "7" in where.values() else []
        text = "The shaft bore is 42 mm."
        return [{"id": f"m{k}", "parent_id": "p1", "related_to_id": "p1", "from_name": "Ann", "from_address": "ann@acme.example", "to_address": "bob@beta.example; x@y.example", "subject": "s", "text_body": text if k else "", "html_body": "<p>h</p>"} for k in range(2)] if "p1" in where.values() else []


def test_crm(spark, tmp_path, monkeypatch, capsys):
    assert crm.connect({}) is None and crm.connect({"crm": {"username": "u", "password": "p", "client": "no.such"}}) is None
    assert type(crm.connect({"crm": {"username": "u", "password": "p", "client": f"{__name__}.Client"}})).__name__ == "Client"
    rows = crm.read_crm(spark, Client(), "7").orderBy("message_id").collect()
    assert [(r["message_id"], r["body"], r["recipients"]) for r in rows] == [("m0", "<p>h</p>", ["bob@beta.example", "x@y.example"]), ("m1", "The shaft bore is 42 mm.", ["bob@beta.example", "x@y.example"])]
    assert crm.read_crm(spark, Client(), "8").count() == 0
    monkeypatch.setattr(cli, "connect", lambda config: Client())
    files = cli.main(["--sf-case", "7", "--sf-opportunity", "7", "-o", str(tmp_path / "out"), "-f", "json"])
    out = json.load(open(files[0]))
    assert {s["value"] for s in out["Specifications"]} == {"42", "is 42"} and [p["mails_sent"] for p in out["People"] if p["address"] == "ann@acme.example"] == [4]
    monkeypatch.setattr(cli, "connect", lambda config: None)
    assert cli.main(["--sf-case", "7", "-o", str(tmp_path / "none")]) == []


def test_unreadable_files_are_told(spark, tmp_path, capsys):
    (tmp_path / "a.msg").write_bytes(b"no such format")
    assert cli.main(["-i", str(tmp_path), "-o", str(tmp_path / "out")]) == [] and "a.msg is left out" in capsys.readouterr().out


def test_hybrid_adds_token_windows(spark):
    body = "The flange should be approximately 12 - 14 mm thick. The shaft needs at least 30 of mm."
    m = spark.createDataFrame([("a", "t", 1, "Ann", "ann@x", [], [], "s", body, "", "a")], "mail_id string, thread_id string, mail_ord long, sender_name string, sender_address string, recipients array<string>, cc array<string>, subject string, body string, date_str string, source_file string")
    regex = {(r["category"], r["value"]) for r in analyze(m)["Specifications"].collect()}
    both = {(r["category"], r["value"]): r for r in analyze(m, extractor="hybrid")["Specifications"].collect()}
    assert set(both) > regex and ("Dimensions", "12-14") in both and both["Dimensions", "30"]["subject"] == "Shaft" and "at least 30" in both["Dimensions", "30"]["context"]


def test_mail_source_and_downloads(spark, tmp_path):
    (tmp_path / "b.eml").write_bytes(b"From: a@x.example\r\nSubject: s\r\n\r\nThe bore is 5 mm.")
    (tmp_path / "a.eml").write_bytes(b"From: a@x.example\r\nSubject: t\r\n\r\nhello")
    spark.dataSource.register(mailfiles.MailFileSource)
    assert sorted(r["subject"] for r in spark.read.format("mail").load(str(tmp_path)).collect()) == ["s", "t"]
    assert [r["source_file"] for r in mailfiles.read_mail_files(spark, str(tmp_path), in_order=True).collect()] == ["a.eml", "b.eml"]
    sections = analyze(ordered(mailfiles.read_mail_files(spark, str(tmp_path))))
    sections.pop("Mails")
    import io

    files = reports.report_files(sections)
    assert reports.read_xlsx(io.BytesIO(files["report.xlsx"]))["Specifications"][1][1] == "5" and reports.read_docx(io.BytesIO(files["report.docx"]))
    long = spark.createDataFrame([("x" * 40_000,)], "sentence string")
    held = io.BytesIO()
    reports.write_docx(held, {"Eng Sentences": long})
    assert len(reports.read_docx(held)[0][1][0]) == 40_000


def test_write_back(spark, tmp_path):
    path = str(tmp_path / "sent")

    def make():
        class W:
            def update(self, ident, fields):
                with open(path, "a") as f:
                    f.write(json.dumps([ident, fields]) + "\n")

        return W()

    reports.write_back(spark.createDataFrame([("t", "text")], "thread_id string, summary string"), make)
    assert json.loads(open(path).read()) == ["t", {"summary": "text"}]


def test_model_client():
    m = summary.LocalModel("http://127.0.0.1:9", probe_seconds=0.2)
    assert not m.reachable() and "reachable" in m.complete("x")
