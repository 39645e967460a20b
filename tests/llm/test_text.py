"""Markup, encoding, quoted text and truncation: hand-made cases, round trips, defined results for odd input."""

import random

import pytest
from pyspark.sql import functions as F

from mailweave.llm import encoding as E
from mailweave.llm import markup as M
from mailweave.llm import quoted as Q
from mailweave.llm import truncation as T

MARKED = [
    "<b>x</b>", "a<br>b", "<!-- c -->", "&nbsp;x", "&lt;p&gt;x&lt;/p&gt;", "## Head", "> ### Head", "```\ncode\n```", "a **bold** b", "a __bold__ b", "~~x~~", "[a](http://x)", "![s](i.png)", "| a | b |\n|---|---|\n| 1 | 2 |", "use `x 1`",
    "== Head ==", "[[Page|text]]", "[[File:a.png|thumb]]", "{{tpl}}", "{| class=x\n|-\n| a\n|}", "''it''", "{code}x{code}", "h2. Note", "||a||b||", "\\section{A}", "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\emph{x}", "$$a=b$$", "$d_1 = 3$",
    "\\[ x \\]", "\\noindent Text", "Temp is\n`reset\n3`",
]
PLAIN = [
    "- item\n- item", "1. item", "> quoted", "________", "***", "========", "a_b_c naming is fine for folder 3 | folder 7.", "gap <89 and the load >9, see R&D log", "Crate size is 4 * 31 * 3, item #11 goes on top.", "Sizes {a, b or c} = 1, 2; ~30 guess",
    "D:\\plans\\new\\text.", "It costs $ 38 each or $ 42 [1].", "<stores@depot.example>", "C> set drive", "| quoted by pipe\n| again", "v = pi * d * n", "FWD >>>", "*** Gateway notice: sender not verified ***", "", None,
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_found(text):
    assert M.constructs(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_left_alone(text):
    assert M.clean(text) == (text, [])


def test_markup_cleaned():
    html = "<html><head><style>x{}</style></head><body><h2>Scope</h2><p>Two <i>big</i> wheels&nbsp;&amp; more.</p><ul><li>one</li><li>two</li></ul><pre><code>a  b\nc</code></pre><table><tr><td>p</td><td>q</td></tr></table></body></html>"
    out, _ = M.clean(html)
    for part in ("## Scope", "Two big wheels\xa0& more.", "- one\n- two", "```\na  b\nc\n```", "p | q"):
        assert part in out
    assert "<" not in out and "x{}" not in out
    assert M.clean("&lt;p&gt;x &lt;b&gt;y&lt;/b&gt;&lt;/p&gt;")[0] == "x y"
    assert M.clean("\\section{A}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\begin{verbatim}\n**k**\n\\end{verbatim}\n\\emph{z}")[0] == "# A\n- a\n```\n**k**\n```\nz"
    assert M.clean("== Head ==\n[[P|text]] ''it'' {{m}}")[0] == "# Head\ntext it m"
    assert M.clean("a **b** [c](http://x) ~~d~~")[0] == "a b c d"
    assert M.clean("$$x = y$$")[0] == "$x = y$"


REWRITTEN = [
    ("See Fig.~\\ref{fig:37}.", "See Fig. fig:37."), ("as in \\cite[p. 3]{smith} \\label{a}", "as in smith a"), ("\\author{Ann}", "Ann"), ("\\paragraph{Scope} x", "#### Scope x"), ("\\documentclass[a4paper]{article}\n\\usepackage{siunitx}\nText", "Text"),
    ("an _old_ gear", "an old gear"), ("an *old\ngrey* gear", "an old\ngrey gear"), ("an _old\ngrey_ gear", "an old\ngrey gear"), ("> == Head ==\n> x", "> # Head\n> x"), ("> h2. Note", "> ## Note"), ("AB> bq. said", "AB> > said"), ("> {| class=x\n> |-\n> | a\n> |}", "> | a"),
    ("> ||a||b||", "> a | b"), ("> | a | b |\n> |---|---|\n> | 1 | 2 |", "> a | b\n> 1 | 2"), ("\\SI{5}{\\newton\\metre} and $x_1 = \\frac{a}{b}$", "5 newton metre and $x_1 = \\frac{a}{b}$"), ("_a_ then $_b_ = 2$", "a then $_b_ = 2$"),
]


@pytest.mark.parametrize("text, want", REWRITTEN)
def test_all_that_is_found_is_rewritten(text, want):
    assert M.clean(text)[0] == want


@pytest.mark.parametrize("text", MARKED + [t for t, _ in REWRITTEN])
def test_only_the_plain_form_is_left(text):
    out = M.clean(text)[0]
    assert set(M.constructs(M.CONSTRUCTS["formula"][2].sub("", out))) <= {"heading", "fence"}


def test_boilerplate_falls_away():
    text = "<div><div><a href='1'>home</a> <a href='2'>about us</a> <a href='3'>contact</a></div><div>" + "".join(f"<p>Paragraph {i} speaks at length, with commas, of the gear and the shaft it drives.</p>" for i in range(4)) + "</div></div>"
    out, _ = M.clean(text)
    assert "Paragraph 3" in out and "about us" not in out


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "koi8_r"])
@pytest.mark.parametrize("text", ["Für größere Höhe – später", "pièce prête, à l’atelier", "Wałek wyważony", "Муфта готова", "歯車の図面", "±0.05 °C"])
def test_round_trip(text, codec):
    try:
        wrong = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        pytest.skip("not decodable")
    assert E.repair("Some words " + wrong + " and more") == (True, "Some words " + text + " and more")


def test_repeated_damage_and_partial():
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert E.repair(f"Für {twice}") == (True, "Für Größe")
    assert E.repair("Ram�n")[0] and E.repair("Gehдuse")[0] and E.repair("rÈception")[0] and E.repair("Grⁿ▀en")[0]


@pytest.mark.parametrize("text", ["REVISÃO DO EIXO Â-3", "ATENÇÃO À REVISÃO", "CÂMP ȘI ÎNCĂRCARE", "Größe ±0,1 / 65 °C", "“été”", "À: project list", "N·m, µm, min⁻¹, ℃", "歯車の図面を確認してください。", "Муфта готова, чертёж", "1’050 mm – ok…", "RAMÓN", "plain", "", None])
def test_right_text_left_alone(text):
    assert E.repair(text) == (False, text)


def test_spans_are_maximal():
    assert E.spans([0xC3, 0xA9, 0x41, 0xE2, 0x82, 0xAC, 0xC3, 0xA4, 0xC3]) == [(0, 2), (3, 8)]
    assert E.spans([0xC0, 0x80, 0xED, 0xA0, 0x80]) == []


def test_repaired_fields(spark):
    df = spark.createDataFrame([(1, "fÃ¼r", None), (2, None, "ok"), (3, "", "Grün"), (4, "x" * 200000 + " Ã©", "Ã©")], "delivery_id long, body string, subject string").withColumn("field", F.lit("clash"))
    assert sorted((r["delivery_id"], r["field"]) for r in E.repaired_fields(df, "delivery_id", ["body", "subject"]).collect()) == [(1, "body"), (4, "body"), (4, "subject")]


def new(body, sender="Ann Berg", address="ann.berg@x.example"):
    return [line for line, k in zip(body.split("\n"), Q.line_kinds(body, sender, address)) if k == Q.NEW and line.strip()]


def test_structure():
    assert new("Hi\n\nText here.\n\nKind regards\nAnn Berg\nBuyer\n\nOn 1 May 2024 at 10:00, Bob wrote:\n> old\n>\n> older") == ["Hi", "Text here."]
    assert new("BC> old\nBC> older\n\nNew text.\n\n--\nAnn Berg") == ["New text."]
    assert new("New.\n\nVon: Bob <b@x.example>\nGesendet: 1 Mai 2024\nBetreff: x\n\nold text without mark") == ["New."]
    assert new("New.\n\nLe 19 Dec 2024, Bob a\nécrit :\n>old") == ["New."]
    assert new("New.\n\nBob (bob@x.example) writes:\n\n    old\n    older\n\nMore new.") == ["New.", "More new."]
    assert new("[EXTERNAL] This message came from outside.\n\nNew.\n\nRegistered office: Dock 4, Harbour\nRow. Register no. 5.") == ["New."]
    assert new("Kindly look.\n\nBest regards from the night shift, by the way, who finished 9 sets.") == ["Kindly look.", "Best regards from the night shift, by the way, who finished 9 sets."]
    assert new("Keep the gap <3 and the load\n>9 as noted, see log.") == ["Keep the gap <3 and the load", ">9 as noted, see log."]
    assert new("Text.\n\nFrom: hub face To: shaft end we counted 4 steps.\nMore text.") == ["Text.", "From: hub face To: shaft end we counted 4 steps.", "More text."]
    assert new("Text.<br>\n<blockquote type=\"cite\">\nold<br>\n</blockquote>\n<p>after</p>") == ["Text.<br>", "<p>after</p>"]
    assert new("| pos | part |\n|---|---|\n| 1 | hub |") == ["| pos | part |", "|---|---|", "| 1 | hub |"]
    assert new("Done.\n\n- Ann") == ["Done."] and new("Do:\n\n- measure the hub") == ["Do:", "- measure the hub"]


MESSAGES = "delivery_id long, thread_id string, message_ord int, message_id string, sender_name string, sender_address string, date timestamp_ntz, received_at timestamp_ntz, body string"


def test_first_authorship_and_copies(spark):
    long1 = "The first long line of the first message speaks of the gear unit in detail."
    long2 = "The second long line of the first message speaks of the shaft at some length."
    rows = [
        (1, "t", 0, "<a>", "Ann", "ann@x", None, None, f"{long1}\n{long2}"), (2, "t", 0, " A ", "Ann", "ann@x", None, None, f"{long1}\n{long2}"), (3, "t", 1, "b", "Bob", "bob@x", None, None, f"I agree.\n{long1}\n{long2}"),
        (4, "u", 1, "c", "Cid", "cid@x", None, None, f"{long1}\n{long2}"), (5, "t", 2, "d", "Dan", "dan@x", None, None, f"{long1}\nand something else"), (6, None, None, None, None, None, None, None, f"{long1}\n{long2}"), (7, "t", 3, "e", "Eve", "eve@x", None, None, None), (8, "t", 3, "f", "Eve", "eve@x", None, None, ""),
    ]
    got = sorted(tuple(r) for r in Q.not_new_lines(spark.createDataFrame(rows, MESSAGES)).collect())
    assert got == [(3, 2), (3, 3)]
    text = {r["delivery_id"]: r["new_text"] for r in Q.newly_written(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert text[3] == "I agree." and text[7] is None and text[8] == ""
    assert Q.not_new_lines(spark.createDataFrame([], MESSAGES)).count() == 0


def test_recurrent_closing_lines(spark):
    rows = [(i, f"t{i}", 0, f"m{i}", "Zed", "zed@x", None, None, f"Text number {i} is here.\n\nOmega Works Hall Nine") for i in range(3)] + [(9, "t9", 0, "m9", "Yan", "yan@x", None, None, "Text.\n\nOmega Works hall seven. ok")]
    assert sorted(tuple(r) for r in Q.not_new_lines(spark.createDataFrame(rows, MESSAGES)).collect()) == [(0, 3), (1, 3), (2, 3)]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("All is well.", T.END), ("a\nRef. TA-3620", T.END), ("a\nPage 1 of 1", T.END), ("a\nhttps://files.x.example/64298", T.END), ("We will see…", T.END), ("確認してください。", T.END), ("The offer for the", T.PROSE), ("x\ufffd", T.LOST), ("the insp...", T.DOTS),
        ("a\n- guard bracket, 5 pieces", T.ITEM), ("a\n- guard bracket, 5", T.PROSE), ("a.\nKind regards\nNastya", T.SIGNED), ("see attachment", T.END),
    ],
)
def test_endings(text, kind):
    assert T.ending(text)[0] == kind


def test_cut_documents(spark):
    r = random.Random(1)
    nouns = ["guard bracket", "shrink disc", "motor stool", "cooling fan", "oil seal"]
    sentence = lambda: f"The {r.choice(nouns)} on unit {r.randint(1, 99)} is ready for the inspection of the motor."
    whole = [(i, "free", "".join(f"- {n}\n" for n in nouns) + " ".join(sentence() for _ in range(5)) + "\n- " + r.choice(nouns)) for i in range(60)]
    cut = [(100, "free", "First line.\n- replace the bracke"), (101, "free", "First line. The motor on"), (102, "free", "Text. Then gon\ufffd")]
    fixed = [(200 + i, "form", ("word " * 40)[:97] + "...") for i in range(8)]
    odd = [(300, "free", None), (301, "free", ""), (302, None, "Good."), (303, "free", "Let us see..."), (303, "free", "Let us see...")]
    df = spark.createDataFrame(whole + cut + fixed + odd, "doc_id long, source string, text string").withColumn("word", F.lit("clash"))
    x = T.cut_documents(df)
    assert x.count() == df.count()
    assert {r["doc_id"] for r in x.where("cut").collect()} == {100, 101, 102, *range(200, 208)}
    share = {r["source"]: (r["n_docs"], r["n_cut"]) for r in T.cut_share(df).collect()}
    assert share["form"] == (8, 8) and share[None] == (1, 0)
    assert T.cut_documents(df.limit(0)).count() == 0


def test_deep_and_unclosed_markup():
    for source in ("<div>" * 100_000 + "text, of the mail" + "</div>" * 100_000, "<font>" * 100_000 + "text", "<p><font>" * 50_000 + "text", "</div>" * 100_000 + "<b>text</b>", "<table><tr><td>" * 30_000 + "text"):
        out, kinds = M.clean(source)
        assert "text" in out and "tag" in kinds


def test_container_of_a_page():
    nav = "<ul>" + "".join(f'<li><a href="/{k}">Section number {k}</a></li>' for k in range(8)) + "</ul>"
    body = "".join(f"<p>Paragraph {k} tells, at some length, what the pump did, and why it was stopped.</p>" for k in range(4))
    page = f'<html><head><title>t</title></head><body><div>{nav}</div><div><h1>Report</h1>{body}<p>See <a href="x">this</a>.</p></div><div>Short note</div><div>{nav}</div></body></html>'
    out, _ = M.clean(page)
    assert "Section number" not in out and all(f"Paragraph {k}" in out for k in range(4)) and "# Report" in out and "See this." in out and "Short note" in out
    assert M.clean(f"<body>{nav}{body}</body>")[0].count("Section") == 0
    assert M.clean(nav)[0].count("Section") == 8  # nothing else: kept whole
    text = "\n".join(f"* [Section {k}](http://a.example/{k})" for k in range(5)) + "\n\nThe pump, as we wrote, was stopped after two hours of work.\n\nSee [the report](http://a.example/r), please."
    assert M.clean(text)[0] == "The pump, as we wrote, was stopped after two hours of work.\n\nSee the report, please."


def test_long_spans_are_markup():
    long = "word " * 100 + "end"
    for mark in ("*{}*", "_{}_", "**{}**", "__{}__", "~~{}~~", "[{}](http://a.example)"):
        out, kinds = M.clean("so " + mark.format(long) + " on")
        assert kinds and out == f"so {long} on"


def test_trie_and_length_decide(spark):
    prose = "The gearbox housing was cleaned and the shaft was aligned with the motor."
    docs = [(i, "a", f"{prose} Unit {i} is next.") for i in range(60)]
    docs += [(100, "a", prose + " We ordered a new gearb"), (101, None, "- check the gearb"), (102, "a", "word " * 60 + "shaft aligned with the gearb"), (103, "a", "word " * 60 + "motor")]
    docs += [(200 + i, "b", ("The motor was checked by hand, as " + "agreed " * 60)[:300]) for i in range(12)] + [(300, "b", "The motor was checked. " * 40)]
    docs += [(400 + i, None, ("- item " + "x" * i + " " + "motor " * 80)[:200]) for i in range(12)]
    got = {r["doc_id"]: r["reason"] for r in T.cut_documents(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()}
    assert got[100] == got[101] == got[102] == "broken_word" and got[103] is None
    assert got[200] in ("at_limit", "no_ending", "broken_word") and got[300] is None  # one longer text doesn't hide the limit
    assert all(got[400 + i] for i in range(12))  # a source without name has a limit too
    assert not any(got[i] for i in range(60))


def test_first_authors_by_date_and_place(spark):
    from datetime import datetime

    a, b = "The crate with the drive-end bearing left purchasing and should arrive tomorrow.", "Nothing has changed on the spacer tube; revision 90 of MN-4044 stays valid for all."
    own = "We have received the crate with the drive-end bearing in good order, many parts are missing."
    day = lambda n: datetime(2024, 1, n)
    rows = [
        (1, "t", 0, "m1", "Ann", "ann@x", day(1), None, f"{a}\n{b}"), (2, "t", 1, "m2", "Bob", "bob@x", day(2), None, f"{own}\n\n{a}\n{b}"), (3, "t", 2, "m3", "Ann", "ann@x", day(3), None, f"{a}\n{b}"),
        (4, "t", 3, "m4", "Cid", "cid@x", day(4), None, f"> {a.upper()}\n> {own}\n> never written before\nfine"), (5, "u", 0, "m5", "Bob", "bob@x", day(5), None, f"{a}\n{b}"), (6, None, 0, "m6", "Bob", "bob@x", day(6), None, f"{a}\n{b}"),
        (7, "t", 1, "m2", "Bob", "bob@x", day(9), None, f"{own}\n\n{a}\n{b}"), (8, "v", 5, "m8", "Ann", "ann@x", day(1), None, f"{a}\n{b}"), (9, "v", 1, "m9", "Bob", "bob@x", day(2), None, f"{a}\n{b}"),
    ]
    got = {(r["delivery_id"], r["line_no"]): r["evidence"] for r in Q.judged_lines(spark.createDataFrame(rows, MESSAGES)).collect()}
    # a copy is no quotation, nor what the author repeats, another thread, or what stands later in the thread by place
    assert got == {(2, 3): "first_author", (2, 4): "first_author", (7, 3): "first_author", (7, 4): "first_author", (4, 1): "first_author", (4, 2): "first_author", (4, 3): "structure"}


@pytest.mark.parametrize("text", ["Việt Nam", "مرحبا بكم", "שלום עולם", "नमस्ते", "สวัสดี", "Đường", "Привет", "日本語"])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1"])
def test_scripts_come_back(text, codec):
    table = E._bytes_of(codec)
    back = {b: c for c, b in table.items()}
    wrong = "".join(back.get(b, chr(b)) if b > 127 else chr(b) for b in text.encode("utf-8"))
    if any(c in "\x85\x1c\xa0\x0b" for c in wrong):
        pytest.skip("a byte reads as white space, so the word falls into tokens")
    assert E.repair(wrong) == (True, text)


def test_damage_of_any_number_of_rounds():
    text = wrong = "Prüfstück für Größe"
    for _ in range(6):
        wrong = wrong.encode("utf-8").decode("latin-1")
        assert E.repair(wrong) == (True, text)


@pytest.mark.parametrize("piece", ["*a", "_a", "[", "<a ", "&amp", "==", "|a", "{{a", "\\a", "''a", "---|", "![a", "[http://a ", "> a\n", "é", "x", "1 ", " \n"])
def test_long_odd_texts_take_linear_time(piece):
    import time

    text = piece * (120_000 // len(piece))
    began = time.time()
    M.clean(text)
    E.repair(text)
    Q.line_kinds(text)
    T.ending(text)
    assert time.time() - began < 20
