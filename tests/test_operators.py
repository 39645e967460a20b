"""Hand-made cases per operator, and small brute-force versions of those that SQL can't express."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mailweave.operators import cleaning as C
from mailweave.operators import paragraphs as P
from mailweave.operators import people as Pe
from mailweave.operators import ranking as Ra
from mailweave.operators import records as R
from mailweave.operators import sentences as S
from mailweave.operators import specs as X
from mailweave.operators import summary as Su


def one(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t")).alias("x")).first()["x"]


def mails(spark, bodies, threads=None):
    return spark.createDataFrame([(f"t{(threads or [0] * len(bodies))[i]}", i, i, b) for i, b in enumerate(bodies)], "thread_id string, mail_ord int, mail_id long, body string")


def test_cleaning(spark):
    assert one(spark, C.strip_forwarded, "a\n---- Original Message ----\nFrom: x\nSent: y\nTo: z\nSubject: torque\nOn Monday Bob wrote:\n==========\nb") == "a\n\ntorque\n\nb"
    assert one(spark, C.strip_crm_refs, "see ref:_00D1._5001:ref and [ ref: A-1 ] Case# 123456 x\n SF-Case-9\ny") == "see  and   x\n\ny"
    assert one(spark, C.strip_calendar, "When: today\nx\n─────\n") == "\nx\n\n"
    assert one(spark, C.strip_auto_reply, "Sent from my phone today") == " today"
    assert one(spark, C.strip_disclaimer, "a\n\nThis is PRIVILEGED AND CONFIDENTIAL\nx\n\nb") == "a\n\nb"
    assert one(spark, C.strip_signature, "a\nb\nc\nBest regards\nX\nTel: +91 98765 43210") == "a\nb\nc"
    assert one(spark, C.strip_signature, "a\nb\nBest regards\nc\nX\nTel: +91 98765 43210") == "a\nb\nBest regards\nc\nX"
    assert one(spark, C.html_to_text, "<p>a&amp;lt;b</p>&#65;&#x42;<script>x</script>  <br/>c &#99999999;") == "a<b\nAB  \nc &#99999999;"
    assert one(spark, C.sanitise, "a\x00b\tc\x7f") == "ab\tc"
    assert one(spark, C.drop_quoted_lines, " > q\nOn 1 May, X wrote: \na") == "a"
    assert one(spark, C.clean_body, None) == "" and one(spark, C.clean_body, "") == ""
    assert one(spark, C.preview, None) == "(empty)" and one(spark, C.preview, "x" * 600).endswith("...")


def test_exact_dedup(spark):
    m = mails(spark, ["Alpha beta gamma delta epsilon.\n\nok\n\nok", "ALPHA  beta gamma delta epsilon.\n\nok", None, ""], [0, 0, 0, 0])
    kept = [(r["mail_id"], r["para_ord"]) for r in P.first_occurrences(P.paragraphs(m)).orderBy("mail_id", "para_ord").collect()]
    assert kept == [(0, 0), (0, 1), (0, 2), (1, 1)]
    again = P.first_occurrences(P.first_occurrences(P.paragraphs(m)))
    assert again.count() == len(kept)


def greedy(paragraphs, threshold=0.85):
    """(mail, para) kept by the scan that the distributed version replaces: exact repetitions first, then similar ones in order."""
    seen, kept, sets = set(), [], []
    for key, text in paragraphs:
        n = re.sub(r"\s+", " ", text.strip().lower())
        if len(n) >= 10:
            if n in seen:
                continue
            seen.add(n)
        w = set(re.findall("[a-z0-9]+", text.lower()))
        if len(n) < 10 or len(w) < 5:
            kept.append(key)
            continue
        if not any(len(w & s) / len(w | s) >= threshold for s in sets):
            kept.append(key)
            sets.append(w)
    return kept


def test_fuzzy(spark):
    base = [f"w{i}" for i in range(20)]
    chain = [" ".join([f"z{j}" for j in range(k)] + base[k:]) for k in range(6)]  # each similar to the next, ends not similar
    bodies = ["\n\n".join([" ".join(base), " ".join(base[:19] + ["other"]), "short one", "short one"]), "\n\n".join(chain), " ".join(reversed(base)), "ok"]
    m = mails(spark, bodies)
    paras = P.paragraphs(m)
    got = sorted((r["mail_id"], r["para_ord"]) for r in P.fuzzy_within_thread(paras).collect())
    rows = [((r["mail_id"], r["para_ord"]), r["paragraph"]) for r in paras.orderBy("mail_ord", "mail_id", "para_ord").collect()]
    assert got == sorted(greedy(rows))
    within = sorted((r["mail_id"], r["para_ord"]) for r in P.fuzzy_within_mail(paras).collect())
    assert (0, 1) not in within and (2, 0) in within


def test_fuzzy_chain_takes_few_jobs(spark):
    base = [f"w{i}" for i in range(20)]
    chain = [" ".join([f"z{j}" for j in range(k)] + base[k:]) for k in range(20)] + [" ".join([f"y{j}" for j in range(k)] + [f"z{j}" for j in range(k, 20)]) for k in range(21)]
    paras = P.paragraphs(mails(spark, ["\n\n".join(chain)]))
    spark.sparkContext.setJobGroup("fuzzy chain", "")
    got = [r["para_ord"] for r in P.fuzzy_within_thread(paras).orderBy("para_ord").collect()]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fuzzy chain")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [k for _, k in greedy([((0, i), t) for i, t in enumerate(chain)])]
    assert len(jobs) < 20  # a round of jobs for each link took hundreds


def test_fuzzy_long_threads(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([6, 12, 25, 45, 80]))] for _ in range(12)]
    threads = {}
    for t, n in (("long", 220), ("short", 9), (None, 9)):
        threads[t] = []
        for _ in range(n):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(6)}"
            threads[t].append(" ".join(w) if rnd.random() < 0.9 else "Short ok")
    rows = [(t, i // 4, f"{t}{i // 4}" if t != "long" or i > 3 else None, i % 4, x, i) for t, xs in threads.items() for i, x in enumerate(xs)]  # one mail without an id
    paras = spark.createDataFrame(rows, "thread_id string, mail_ord int, mail_id string, para_ord int, paragraph string, extra int")
    want = [(t, k) for t in ("long", "short") for k in greedy(list(enumerate(threads[t])))]
    for in_memory in (3, 12, 10_000):  # rounds to the end, then a scan of what is left, then only scans
        kept = P.fuzzy_within_thread(paras, in_memory=in_memory)
        assert kept.columns == paras.columns
        got = [(r["thread_id"], r["extra"]) for r in kept.collect()]
        assert sorted(x for x in got if x[0]) == sorted(want)
        exact = list(dict.fromkeys(x for x in threads[None] if len(x) >= 10))
        assert len([x for x in got if x[0] is None]) == len(exact) + sum(len(x) < 10 for x in threads[None])  # no thread: nothing to compare with


def test_similar_sets_share_a_key():
    rnd = random.Random(7)
    words = [f"v{i}" for i in range(400)]
    for threshold in (1.0, 0.85, 0.6):
        keys, pairs = P.SetKeys(threshold), 0
        for _ in range(4000):
            a = set(rnd.sample(words, rnd.choice([5, 6, 7, 9, 12, 14, 17, 21, 22, 25, 40, 120])))
            b = set(a)
            for _ in range(rnd.randrange(1 + len(a) // 4)):
                b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 else b.add(rnd.choice(words))
            if len(b) >= 5 and len(a & b) / len(a | b) >= threshold:
                pairs += 1
                assert set(keys(frozenset(a))) & set(keys(frozenset(b)))
        assert pairs > 300


def test_fuzzy_on_table(spark, root):
    m = spark.read.parquet(f"{root}/messages.parquet").select("thread_id", F.col("message_ord").alias("mail_ord"), F.col("delivery_id").alias("mail_id"), F.coalesce("body", F.lit("")).alias("body"))
    paras = P.paragraphs(m)
    got = sorted((r["mail_id"], r["para_ord"]) for r in P.fuzzy_within_thread(paras).collect())
    want = []
    by = {}
    for r in paras.orderBy("mail_ord", "mail_id", "para_ord").collect():
        by.setdefault(r["thread_id"], []).append(((r["mail_id"], r["para_ord"]), r["paragraph"]))
    for rows in by.values():
        want += greedy(rows)
    assert got == sorted(want)


def test_specs(spark):
    m = mails(spark, ["Service factor is 1.5 minimum.", "Motor power: 7.5 kW", "Tighten to 50 Nm. Use SS316 and brass.\nTel: +91 98765 43210", None, ""])
    x = {(r["mail_id"], r["category"], r["value"], r["unit"]) for r in X.extract_specs(m).collect()}
    assert (0, "Dimensions", "1.5", "m") in x and (0, "Standards", "is 1", "") in x
    assert not any(k[0] == 1 for k in x)  # "po" of power counts as a reference
    assert (2, "Torque", "50", "Nm") in x and (2, "Material", "SS316", "") in x and (2, "Material", "brass", "") in x
    assert {(r["category"], r["value"]) for r in X.extract_specs(m, whole_words=True).where("mail_id = 1").collect()} == {("Power", "7.5")}


def test_both_extractions_agree(spark, root):
    """The JVM's matches and those of the one-pass extraction are the same."""
    m = spark.read.parquet(f"{root}/messages.parquet").select(F.col("delivery_id").alias("mail_id"), F.coalesce("body", F.lit("")).alias("body"))
    a = {(r["mail_id"], r["category"], r["raw_match"].lower(), r["value"].lower()) for r in X.category_matches(m).collect()}
    b = {(r["mail_id"], r["category"], r["raw_match"].lower(), r["value"].lower()) for r in X.extract_matches(m).where("category <> 'Material'").collect()}
    assert a == b and a


def test_token_units(spark):
    m = mails(spark, ["The bore is 42 approximately of mm. Length 10 kg", "7 big red mm", "9. mm"])
    got = [(r["mail_id"], r["raw_match"]) for r in X.token_window_matches(m).orderBy("mail_id", "token_ord").collect()]
    assert got == [(0, "42 mm"), (0, "10 kg"), (1, "7 mm")] or got == [(0, "42 mm"), (0, "10 kg")]


def test_sentences(spark):
    m = mails(spark, ["See Fig. 3 of Dr. X. Is the torque fine? How are you?\nPending: hub bore 45 mm.", None])
    s = [r["sentence"] for r in S.sentences(m).orderBy("sent_ord").collect()]
    assert s == ["See Fig. 3 of Dr. X.", "Is the torque fine?", "How are you?", "Pending: hub bore 45 mm."]
    tags = {r["sentence"]: r for r in S.tag_sentences(m).collect()}
    assert tags["Is the torque fine?"]["is_unresolved"] and tags["Pending: hub bore 45 mm."]["trigger_keywords"] == ["bore", "hub", "hub bore"]
    assert {r["sentence"]: r["marker"] for r in S.open_items(m).collect()} == {"Is the torque fine?": "?", "Pending: hub bore 45 mm.": "pending"}


def test_confidence(spark):
    def c(text, words):
        return spark.createDataFrame([(text, words)], "t string, w array<string>").select(S.confidence(F.col("t"), F.col("w"))).first()[0]

    assert abs(c("Rated torque: 450 Nm", ["torque", "rated"]) - 0.75) < 1e-9
    assert abs(c("Check the disc coupling clearance before shipment today", ["coupling", "disc coupling", "clearance"]) - 0.55) < 1e-9
    assert abs(c("bore?", ["bore"]) - 0.1) < 1e-9


def test_people(spark):
    assert one(spark, Pe.name_of, "john.smith_x@x.com") == "John Smith X"
    assert [one(spark, Pe.company_of, a) for a in ("a@mail.acme.co.uk", "a@gmail.com", "a@localhost", "x")] == ["Co", "Gmail", "Localhost", ""]
    df = spark.createDataFrame(
        [("t", 0, 1, "A", "a@x.com", ["B <b@y.com>"], None, "Chief\nboss"), ("t", 1, 2, "B", "b@y.com", [], ["a@x.com"], "Engineer"), ("t", 2, 3, None, None, None, None, None)],
        "thread_id string, mail_ord int, mail_id long, sender_name string, sender_address string, recipients array<string>, cc array<string>, body string",
    )
    p = {r["address"]: r for r in Pe.people_table(df).collect()}
    assert (p["b@y.com"]["role"], p["b@y.com"]["mails_sent"], p["a@x.com"]["role"]) == ("", 1, "Chief")


def specs(spark, rows):
    full = [(i, "t", c, s, v, u, by, "Mar 03") for i, (c, s, v, u, by) in enumerate(rows)]
    return spark.createDataFrame(full, "spec_id long, thread_id string, category string, subject string, value string, unit string, mentioned_by string, date_str string")


def test_conflicts(spark):
    def sev(*rows):
        return sorted(r["severity"] for r in R.conflicts(specs(spark, rows)).collect())

    d = "Dimensions"
    assert sev((d, "Bore", "42", "mm", "A"), (d, "bore", "60", "mm", "B")) == ["high"]
    assert sev((d, "Bore", "80", "mm", "A"), (d, "bore", "100", "mm", "B")) == ["medium"]
    assert sev((d, "Bore", "42", "mm", "A"), (d, "bore", "43", "mm", "B")) == ["low"]
    assert sev((d, "Bore", "42", "mm", "A"), (d, "bore", "1.65", "in", "B")) == []
    assert sev((d, "Bore", "42", "mm", "A"), (d, "bore", "50", "", "B")) == ["medium"]
    assert sev((d, "Bore", "42", "mm", "A"), (d, "bore", "42.0", "mm", "B")) == []
    assert sev((d, "Bore", "1", "mm", "A"), (d, "bore", "2", "mm", "B"), (d, "Hub", "1", "mm", "A"), (d, "hub", "2", "mm", "B")) == ["high"]
    assert sev((d, None, "1", "mm", "A"), (d, "", "2", "mm", "B")) == []
    assert R.conflict_lines(R.conflicts(specs(spark, [(d, "Bore", "42", "mm", "A"), (d, "bore", "60", "mm", "B")]))).first()["line"] == "[HIGH] Bore (Dimensions): 42 mm by A vs 60 mm by B"


def test_timeline_order(spark):
    s = spark.createDataFrame([(1, "c", "r", "p", "Mar 30"), (2, "c", "r", "p", "Apr 01"), (3, "c", "r", "p", "")], "spec_id long, category string, raw_match string, mentioned_by string, date_str string")
    t = spark.createDataFrame([(1, "x" * 200, "q", "Apr 01", True)], "sentence_id long, sentence string, mentioned_by string, date_str string, is_unresolved boolean")
    assert [(r["date"], r["kind"]) for r in R.timeline(s, t).collect()] == [("Apr 01", "spec"), ("Apr 01", "tagged"), ("Mar 30", "spec")]
    assert [r["date"] for r in R.timeline(s, t, chronological=True).collect()] == ["Mar 30", "Apr 01", "Apr 01"]


def test_summary_is_whole(spark):
    m = spark.createDataFrame([("a", "Bore")], "thread_id string, subject string")
    s = spark.createDataFrame([("a", f"Cat{i:02d}", str(i), "mm", "", i, "Mar 01" if i == 3 else "Mar 20" if i == 7 else "") for i in range(25)], "thread_id string, category string, value string, unit string, subject string, spec_id long, date_str string")
    t = spark.createDataFrame([("a", i, f"open {i}", "Ann", "Mar 10", True) for i in range(7)] + [("a", 9, "done", "Ann", "Jan 01", False)], "thread_id string, ord long, sentence string, mentioned_by string, date_str string, is_unresolved boolean")
    p = spark.createDataFrame([("a", f"p{i:02d}@x.example", f"P{i:02d}" if i else None, "X" if i else None, 1 + (i == 29)) for i in range(30)] + [("a", "q@x.example", "Quiet", "X", 0)], "thread_id string, address string, name string, company string, mails_sent long")
    lines = Su.thread_summary(m, s, t, p).first()["summary"].split("\n")
    assert [x for x in lines if x.startswith("- **Cat")] == [f"- **Cat{i:02d}:** {i} mm" for i in range(25)]
    who = [x for x in lines if x.endswith("mail(s)")]
    assert who == ["- **P29** (X) — 2 mail(s)", "- **Unknown** — 1 mail(s)"] + [f"- **P{i:02d}** (X) — 1 mail(s)" for i in range(1, 29)]
    assert [x for x in lines if x.startswith("- open")] == [f"- open {i} (Ann)" for i in range(5)] and "... and 2 more" in lines
    assert lines[-1] == "Mar 01 to Mar 20"


def test_rate_limit(spark, root):
    e = spark.read.parquet(f"{root}/events.parquet").select("event_id", "user_id", "ts")
    got = {r["event_id"]: r["accepted"] for r in R.rate_limited(e, "user_id", "ts", 2, 86400).collect()}
    state, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        q = [t for t in state.get(r["user_id"], []) if (r["ts"] - t).total_seconds() < 86400]
        want[r["event_id"]] = len(q) < 2
        state[r["user_id"]] = q + [r["ts"]] if len(q) < 2 else q
    assert got == want and not all(want.values())


def test_textrank(spark):
    texts = ["The rotor torque rises with load.", "Load and torque of the rotor were measured.", "A spare crate left the stores.", "The stores sent a crate.", "Nothing."]
    s = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)] + [("b", 9, "alone here")], "thread_id string, sent_id int, sentence string")
    small = {(r["thread_id"], r["sent_id"]): r["score"] for r in Ra.rank_sentences(s).collect()}
    large = {(r["thread_id"], r["sent_id"]): r["score"] for r in Ra.rank_sentences(s, in_memory=0).collect()}
    assert small[("b", 9)] == 1.0 and small.keys() == large.keys()
    assert all(math.isclose(small[k], large[k], abs_tol=1e-6) for k in small)
    vec = Ra.vectors_of(texts)
    n = len(texts)
    sim = [[Ra.cosine(vec[i], vec[j]) if i != j else 0.0 for j in range(n)] for i in range(n)]
    score = [1 / n] * n
    for _ in range(100):
        new = [0.15 / n + 0.85 * sum(sim[j][i] * score[j] / sum(sim[j]) for j in range(n) if sum(sim[j]) > 0) for i in range(n)]
        done = max(abs(a - b) for a, b in zip(new, score)) < 1e-4
        score = new
        if done:
            break
    assert all(math.isclose(small[("a", i)], score[i], abs_tol=1e-9) for i in range(n))
    top = [r["sent_id"] for r in Ra.diverse_top(s, Ra.rank_sentences(s), top=2).where("thread_id = 'a'").collect()]
    assert len(top) == 2 and top == sorted(top)


def test_diverse_top_of_whole_ranking(spark):
    texts = ["Rotor torque load test."] * 140 + ["Rotor torque load crate.", "", "A spare crate left the stores.", "The stores sent pumps.", "Rotor load crate seal.", "Seal torque."]
    s = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "thread_id string, sent_id int, sentence string")
    scores = s.select("thread_id", "sent_id", (1.0 / (1 + F.col("sent_id"))).alias("score"))
    vec = Ra.vectors_of(texts)
    for top in (2, 4, 20):
        want: list[int] = []
        for i in range(len(texts)):
            if len(want) < top and all(Ra.cosine(vec[i], vec[k]) <= 0.7 for k in want):
                want.append(i)
        assert len(want) == min(top, 6)
        for in_memory in (Ra.IN_MEMORY, 0):
            assert sorted(r["sent_id"] for r in Ra.diverse_top(s, scores, top=top, in_memory=in_memory).collect()) == want


def test_empty_tables(spark):
    m = mails(spark, [])
    assert P.paragraphs(m).count() == 0 and P.first_occurrences(P.paragraphs(m)).count() == 0 and P.fuzzy_within_thread(P.paragraphs(m)).count() == 0
    assert X.category_matches(m).count() == 0 and X.extract_specs(m).count() == 0 and S.tag_sentences(m).count() == 0
    assert R.conflicts(specs(spark, [])).count() == 0
    assert Counter() == Counter()


def test_summary_has_roles_flags_and_organisations(spark):
    m = spark.createDataFrame([("a", "Bore"), ("a", None)], "thread_id string, subject string")
    s = spark.createDataFrame([("a", "Torque", "5", "Nm", "Shaft", 1, "")], "thread_id string, category string, value string, unit string, subject string, spec_id long, date_str string")
    t = spark.createDataFrame([("a", 1, "who?", "Ann", "", True, ["torque", "rpm"])], "thread_id string, ord long, sentence string, mentioned_by string, date_str string, is_unresolved boolean, trigger_keywords array<string>")
    p = spark.createDataFrame([("a", "ann@x.example", "Ann", "X", "Engineer", 2, 3)], "thread_id string, address string, name string, company string, role string, mails_sent long, specs_mentioned long")
    lines = Su.thread_summary(m, s, t, p).first()["summary"].split("\n")
    assert "**Thread:** Bore | **Mails:** 2 | **Participants:** 1 | **Specs:** 1 | **Open:** 1" in lines and "**Organizations:** X" in lines
    assert "- **Ann** (X) — Engineer — 2 mail(s), mentioned 3 spec(s)" in lines and "- who? (Ann) — flags: torque, rpm" in lines and "- **Torque:** Shaft: 5 Nm" in lines
    chosen = spark.createDataFrame([("a", 1, "> We agreed on 5 Nm."), ("a", 2, "The torque is high."), ("a", 3, "It was approved."), ("a", 4, "Also confirmed.")], "thread_id string, sent_id long, sentence string")
    text = Su.extractive_summary(m, s, t, p, chosen).first()["summary"]
    assert "across 1 organization(s) (X)" in text and "- **Torque:** 5 Nm" in text and '- "We agreed on 5 Nm."' in text and '- "It was approved."' in text and "Also" not in text and "*(Asked by Ann)*" in text
    none = Su.extractive_summary(m, s.limit(0), t.limit(0), p.limit(0), chosen.limit(0)).first()["summary"]
    assert "No specific engineering parameters" in none


def test_numbered_is_a_window_over_all(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 50 = 1 THEN 'small' ELSE 'hot' END AS k", "(id * 7919) % 5000 AS v")
    got = {(r["k"], r["v"]): r["n"] for r in R.numbered(df, ["k"], ["v"]).collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["k"], []).append(r["v"])
    assert got == {(k, v): n for k, vs in rows.items() for n, v in enumerate(sorted(vs), 1)}
    assert R.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_token_windows_give_ranges_once(spark):
    m = mails(spark, ["Use 10 - 20 mm, then 10-20 mm. A 65 ° C oil, 5 is the kW. 7 bolts of nice steel mm", None, ""])
    got = [(r["category"], r["raw_match"], r["value"]) for r in X.token_window_matches(m).orderBy("token_ord").collect()]
    assert got == [("Dimensions", "10–20 mm", "10-20"), ("Dimensions", "20 mm", "20"), ("Temperature", "65 °C", "65"), ("Power", "5 kW", "5")]
