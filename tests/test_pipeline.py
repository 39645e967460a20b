from mailweave import cli
from mailweave.plans.analyze import analyze, ordered
from mailweave.sources.mailfiles import read_mail_files

FIRST = b"From: Ann <ann@acme.example>\r\nTo: bob@beta.example\r\nDate: Mon, 04 Mar 2024 10:00:00 +0000\r\nSubject: Bore\r\nMessage-ID: <1>\r\n\r\nHello.\r\n\r\nThe shaft bore is 42 mm in brass. Please confirm the torque?\r\n\r\nBest regards\r\nAnn\r\n"
SECOND = b"From: Bob <bob@beta.example>\r\nTo: ann@acme.example\r\nDate: Tue, 05 Mar 2024 10:00:00 +0000\r\nSubject: Re: Bore\r\nMessage-ID: <2>\r\n\r\nThe shaft bore is 60 mm now.\r\n\r\nThe shaft bore is 42 mm in brass. Please confirm the torque?\r\n"


def write(folder):
    (folder / "a.eml").write_bytes(FIRST)
    (folder / "b.eml").write_bytes(SECOND)


def test_sections(spark, tmp_path):
    write(tmp_path)
    s = analyze(ordered(read_mail_files(spark, str(tmp_path))))
    bodies = {r["mail_id"]: r["body"] for r in s["Mails"].collect()}
    assert "Ann" not in bodies["a.eml"] and "42" not in bodies["b.eml"]
    found = {(r["mail_id"], r["category"], r["value"], r["subject"]) for r in s["Specifications"].collect()}
    assert ("a.eml", "Dimensions", "42", "Bore") in found and ("b.eml", "Dimensions", "60", "Bore") in found and ("a.eml", "Material", "brass", "") not in found
    assert [r["severity"] for r in s["Conflicts"].where("category = 'Dimensions'").collect()] == ["high"]
    assert {r["address"]: (r["company"], r["mails_sent"]) for r in s["People"].collect()} == {"ann@acme.example": ("Acme", 1), "bob@beta.example": ("Beta", 1)}
    assert [r["marker"] for r in s["Unresolved"].collect()] == ["?"]
    assert s["Timeline"].first()["date"] == "Mar 04"
    text = s["Summary"].first()["summary"]
    assert "**Mails:** 2" in text and "Action Items" in text


def test_cli(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    files = cli.main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-f", "html"])
    page = open(files[0]).read()
    assert "Specifications" in page and "42" in page
    (tmp_path / "none").mkdir()
    assert cli.main(["-i", str(tmp_path / "none"), "-o", str(tmp_path / "out")]) == []
