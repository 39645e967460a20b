"""Queries of the mail operators over the whole tables, with their SQL (DuckDB dialect).

A mail is a delivery: mail_id is delivery_id, mail_ord message_ord. SQL takes the same fixed patterns, as RE2 reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.text import WS, strip
from mailweave.operators import cleaning as C
from mailweave.operators import paragraphs as P
from mailweave.operators import people as Pe
from mailweave.operators import ranking as Ra
from mailweave.operators import records as R
from mailweave.operators import sentences as S
from mailweave.operators import specs as X
from mailweave.operators import summary as Su
from mailweave.sinks.reports import html_rows, json_lines
from mailweave.sources.tables import spread, table
from mailweave.streaming.streams import session_counts, window_counts
from mailweave.words import ABBREVIATIONS, BOOST_WORDS, DECISION_WORDS, DISCLAIMER_PHRASES, ENGINEERING_KEYWORDS, MATERIALS, PROVIDERS, REFERENCE_WORDS, ROLE_KEYWORDS, STOP_WORDS, SUBJECTS, UNRESOLVED_MARKERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def mails(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "messages")).select(
        F.col("delivery_id").alias("mail_id"), "thread_id", F.col("message_ord").alias("mail_ord"), "sender_name", "sender_address", "recipients", "cc", F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("body", F.lit("")).alias("body"), "date_str", "source_file",
    )


MAILS = "m AS (SELECT delivery_id AS mail_id, thread_id, message_ord AS mail_ord, sender_name, sender_address, recipients, cc, coalesce(subject, '') AS subject, coalesce(body, '') AS body FROM messages)"


# ---- SQL pieces


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"


def steps(expr: str, todo: list[tuple[str, str]]) -> str:
    for p, t in todo:
        expr = rx(expr, p, t)
    return expr


def s_strip(expr: str) -> str:
    return rx(expr, rf"^{WS}+|{WS}+\z")


def s_rstrip(expr: str) -> str:
    return rx(expr, rf"{WS}+\z")


def s_lines(expr: str) -> str:
    return f"string_split({expr}, chr(10))"


def s_any(expr: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(p)})" for p in parts) + ")"


def s_capital(expr: str) -> str:
    return f"(upper(left({expr}, 1)) || lower(substr({expr}, 2)))"


def s_match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def text_query(name: str, make: Callable[[Column], Column], sql: str) -> None:
    """A query that applies one body transformation to all mails."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        return mails(spark, root).select("mail_id", make(F.col("body")).alias("text"))

    QUERIES[name] = run
    SQL[name] = f"WITH {MAILS} SELECT mail_id, {sql} AS text FROM m"


# ---- cleaning

text_query("c1_strip_forwarded", C.strip_forwarded, s_strip(steps("body", C.FORWARDED)))
text_query("c2_strip_crm_refs", C.strip_crm_refs, steps("body", C.CRM_REFS))
text_query("c3_strip_calendar", C.strip_calendar, steps("body", C.CALENDAR))
text_query("c4_strip_auto_reply", C.strip_auto_reply, steps("body", C.AUTO_REPLY))


def s_disclaimer(expr: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array({expr}, {lit(C.PARAGRAPH_BREAK)}), lambda p: NOT {s_any('lower(p)', DISCLAIMER_PHRASES)}), chr(10) || chr(10))"


text_query("c5_strip_disclaimer", C.strip_disclaimer, s_disclaimer("body"))


def s_signal(line: str) -> str:
    bare = s_strip(line)
    return (
        f"CASE WHEN length({bare}) = 0 THEN '' WHEN {s_match(line, C.PHONE)} OR {s_match(line, C.BARE_PHONE)} THEN 'phone' WHEN {s_match(bare, C.ADDRESS_ONLY)} THEN 'mail' WHEN {s_match(bare, C.URL)} THEN 'url' "
        f"WHEN {s_match(bare, C.STREET)} AND length({bare}) < 120 THEN 'address' WHEN length({bare}) < 80 AND {s_match(f'lower({bare})', C.ROLE)} THEN 'role' ELSE '' END"
    )


def signature_sql(source: str) -> str:
    """CTEs a..d from a table `source`(mail_id, body): d has mail_id and the text without signature."""
    return f"""
    sa AS (SELECT mail_id, {s_lines('body')} AS l FROM {source}),
    sb AS (SELECT mail_id, l, coalesce(
        list_min(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN i >= len(l) // 2 AND {s_match('l[i + 1]', C.marker_pattern())} THEN i END), lambda i: i IS NOT NULL)),
        list_max(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN i > len(l) // 2 AND {s_match('l[i + 1]', C.PHONE)} THEN i END), lambda i: i IS NOT NULL)), len(l)) AS cut FROM sa),
    sc AS (SELECT mail_id, l[1:cut] AS l FROM sb),
    sd AS (SELECT mail_id, l, list_transform(range(len(l)), lambda i: CASE WHEN i >= greatest(0, len(l) - 15) THEN {s_signal('l[i + 1]')} ELSE '' END) AS s FROM sc),
    se AS (SELECT mail_id, CASE WHEN len(list_filter(s, lambda x: x <> '')) >= 3 AND len(list_distinct(list_filter(s, lambda x: x <> ''))) >= 2
        THEN l[1:list_min(list_filter(list_transform(range(len(s)), lambda i: CASE WHEN s[i + 1] <> '' THEN i END), lambda i: i IS NOT NULL))] ELSE l END AS l FROM sd),
    sf AS (SELECT mail_id, l, list_transform(list_reverse(l[greatest(1, len(l) - 9):]), lambda x: length({s_strip('x')}) >= 5) AS tail FROM se),
    sg AS (SELECT mail_id, l, coalesce(list_position(tail, true) - 1, len(tail)) AS short FROM sf),
    sh AS (SELECT mail_id, {s_rstrip("array_to_string(CASE WHEN len(l) > 10 AND short >= 5 THEN l[1:len(l) - short] ELSE l END, chr(10))")} AS text FROM sg)"""


QUERIES["c6_strip_signature"] = lambda spark, root: mails(spark, root).select("mail_id", C.strip_signature(F.col("body")).alias("text"))
SQL["c6_strip_signature"] = f"WITH {MAILS}, {signature_sql('m')} SELECT mail_id, text FROM sh"
_BEFORE = s_disclaimer(steps(steps(steps(s_strip(steps("body", C.FORWARDED)), C.CRM_REFS), C.CALENDAR), C.AUTO_REPLY))
CLEAN = f"{MAILS}, pre AS (SELECT mail_id, {_BEFORE} AS body FROM m), {signature_sql('pre')}, clean AS (SELECT mail_id, {s_strip(f'''array_to_string(list_transform({s_lines(rx('text', chr(10) + '{3,}', chr(10) * 2))}, lambda x: {s_rstrip('x')}), chr(10))''')} AS text FROM sh)"
QUERIES["c7_clean_body"] = lambda spark, root: mails(spark, root).select("mail_id", C.clean_body(F.col("body")).alias("text"))
SQL["c7_clean_body"] = f"WITH {CLEAN} SELECT mail_id, text FROM clean"
text_query("c8_sanitise", C.sanitise, steps("body", C.CONTROLS))


def s_html(expr: str) -> str:
    expr = steps(expr, C.HTML_TAGS)
    for e, t in C.ENTITIES:
        expr = f"replace({expr}, {lit(e)}, {lit(t)})"
    for pattern, code in ((r"&#(\d{1,7});", "x[3:len(x) - 1]::INT"), (r"&#x([0-9a-fA-F]{1,6});", "('0x' || x[4:len(x) - 1])::INT")):
        expr = f"(SELECT list_reduce(list_concat([t], list_distinct(regexp_extract_all(t, {lit(pattern)}))), lambda acc, x: replace(acc, x, chr({code}))) FROM (SELECT {expr} AS t))"
    return s_strip(steps(expr, [(r"[ \t]{3,}", "  "), (r"\n{3,}", "\n\n")]))


text_query("h1_html_to_text", C.html_to_text, s_html("body"))
text_query("q1_drop_quoted_lines", C.drop_quoted_lines, f"array_to_string(list_filter({s_lines('body')}, lambda l: NOT (starts_with({s_strip('l')}, '>') OR {s_match(s_strip('l'), C.QUOTE_INTRO)})), chr(10))")
PREFILTER = f"array_to_string(list_filter({s_lines(steps('body', X.SKIP_REFS))}, lambda l: NOT {s_match(s_strip('l'), X.PHONE_LINE)}), chr(10))"
text_query("p1x_prefilter", X.prefilter, PREFILTER)


def _escaped(expr: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


_DECODED = "(SELECT list_reduce(list_concat([t], list_filter(list_distinct(regexp_extract_all(t, '\\\\u[0-9a-fA-F]{4}')), lambda x: lower(x) NOT BETWEEN '\\ud800' AND '\\udfff' AND x <> '\\u0000')), lambda acc, x: replace(acc, x, chr(('0x' || x[3:6])::INT))) FROM (SELECT body AS t))"
_SHOWN = _escaped(rx(_DECODED, r"\\u[0-9a-fA-F]{4}"))
text_query("u1_preview", C.preview, f"CASE WHEN length({s_strip('body')}) = 0 THEN '(empty)' WHEN length({_SHOWN}) > 500 THEN left({_SHOWN}, 500) || '...' ELSE {_SHOWN} END")

# ---- paragraphs

_QUOTELESS = f"array_to_string(list_filter({s_lines('body')}, lambda l: NOT (starts_with({s_strip('l')}, '>') OR {s_match(s_strip('l'), C.QUOTE_INTRO)})), chr(10))"
PARAS = f"""{MAILS}, pl AS (SELECT thread_id, mail_ord, mail_id, regexp_split_to_array({_QUOTELESS}, {lit(C.PARAGRAPH_BREAK)}) AS l FROM m),
    pu AS (SELECT thread_id, mail_ord, mail_id, unnest(range(len(l))) AS para_ord, unnest(l) AS paragraph FROM pl),
    p AS (SELECT *, {rx(f"lower({s_strip('paragraph')})", WS + '+', ' ')} AS norm FROM pu WHERE length({s_strip('paragraph')}) > 0)"""


@query
def t1_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return P.paragraphs(mails(spark, root)).select("mail_id", F.col("para_ord").cast("long").alias("para_ord"), "paragraph")


SQL["t1_paragraphs"] = f"WITH {PARAS} SELECT mail_id, para_ord, paragraph FROM p"


@query
def d3_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return P.first_occurrences(P.paragraphs(mails(spark, root))).select("thread_id", "mail_id", F.col("para_ord").cast("long").alias("para_ord"), F.md5("paragraph").alias("paragraph_md5"))


SQL["d3_exact_dedup"] = f"WITH {PARAS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, CASE WHEN length(norm) >= 10 THEN md5(norm) ELSE mail_id || '-' || para_ord END ORDER BY mail_ord, mail_id, para_ord) AS n FROM p) SELECT thread_id, mail_id, para_ord, md5(paragraph) AS paragraph_md5 FROM r WHERE n = 1"


@query
def d8_unique_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return P.paragraphs(mails(spark, root)).groupBy("thread_id").agg(F.count("*").alias("n"), F.countDistinct(P.paragraph_hash(F.col("paragraph"))).alias("n_unique"))


SQL["d8_unique_paragraphs"] = f"WITH {PARAS} SELECT thread_id, count(*) AS n, count(DISTINCT CASE WHEN length(norm) >= 10 THEN md5(norm) END) AS n_unique FROM p GROUP BY 1"


@query
def t6_word_sets(spark: SparkSession, root: str) -> DataFrame:
    return P.paragraphs(mails(spark, root)).select("mail_id", F.col("para_ord").cast("long").alias("para_ord"), F.array_join(F.array_sort(P.word_set(F.col("paragraph"))), " ").alias("words"))


SQL["t6_word_sets"] = f"WITH {PARAS} SELECT mail_id, para_ord, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(paragraph), '[a-z0-9]+'))), ' ') AS words FROM p"


@query
def d6_jaccard_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Similarity of each paragraph to the next one of its mail."""
    p = P.paragraphs(mails(spark, root)).select("mail_id", "para_ord", P.word_set(F.col("paragraph")).alias("w"))
    g = p.groupBy("mail_id").agg(F.array_sort(F.collect_list(F.struct("para_ord", "w"))).alias("a"))
    pairs = F.transform(F.slice("a", 1, F.size("a") - 1), lambda x, i: F.struct(x["para_ord"].cast("long").alias("para_ord"), F.round(P.jaccard(x["w"], F.get("a", i + 1)["w"]), 6).alias("similarity")))
    return g.where(F.size("a") > 1).select("mail_id", F.explode(pairs).alias("x")).select("mail_id", "x.para_ord", "x.similarity")


SQL["d6_jaccard_neighbours"] = f"""WITH {PARAS}, w AS (SELECT mail_id, para_ord, list_distinct(regexp_extract_all(lower(paragraph), '[a-z0-9]+')) AS a FROM p),
    n AS (SELECT *, lead(a) OVER (PARTITION BY mail_id ORDER BY para_ord) AS b FROM w)
    SELECT mail_id, para_ord, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM n WHERE b IS NOT NULL"""


@query
def d4_fuzzy_within_mail(spark: SparkSession, root: str) -> DataFrame:
    return P.fuzzy_within_mail(P.first_occurrences(P.paragraphs(mails(spark, root)))).select("mail_id", F.col("para_ord").cast("long").alias("para_ord"), F.md5("paragraph").alias("paragraph_md5"))


@query
def d5_fuzzy_within_thread(spark: SparkSession, root: str) -> DataFrame:
    return P.fuzzy_within_thread(P.paragraphs(mails(spark, root))).select("mail_id", F.col("para_ord").cast("long").alias("para_ord"), F.md5("paragraph").alias("paragraph_md5"))


_EXACT = f"{PARAS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, CASE WHEN length(norm) >= 10 THEN md5(norm) ELSE mail_id || '-' || para_ord END ORDER BY mail_ord, mail_id, para_ord) AS n FROM p), x AS (SELECT thread_id, mail_ord, mail_id, para_ord, paragraph, length(norm) < 10 AS short, list_distinct(regexp_extract_all(lower(paragraph), '[a-z0-9]+')) AS w FROM r WHERE n = 1)"
_JACCARD = "len(list_intersect({a}, {b})) >= 0.85 * len(list_distinct(list_concat({a}, {b})))"
# the scan itself, one paragraph of each mail a step
SQL["d4_fuzzy_within_mail"] = f"""WITH RECURSIVE {_EXACT}, o AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY para_ord) AS i FROM x),
    g AS (SELECT mail_id, para_ord, paragraph, i, CASE WHEN short THEN [] ELSE [w] END AS seen, true AS kept FROM o WHERE i = 1 UNION ALL
        SELECT mail_id, para_ord, paragraph, i, CASE WHEN short OR rep THEN seen ELSE list_append(seen, w) END, NOT rep FROM (SELECT o.*, g.seen, NOT o.short AND len(o.w) >= 5 AND len(list_filter(g.seen, lambda s: len(s) > 0 AND {_JACCARD.format(a='o.w', b='s')})) > 0 AS rep FROM g JOIN o ON o.mail_id = g.mail_id AND o.i = g.i + 1))
    SELECT mail_id, para_ord, md5(paragraph) AS paragraph_md5 FROM g WHERE kept"""
# the scan over paragraphs that are similar to an earlier one, one of each thread a step
SQL["d5_fuzzy_within_thread"] = f"""WITH RECURSIVE {_EXACT}, o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY mail_ord, mail_id, para_ord) AS i FROM x), c AS (SELECT * FROM o WHERE NOT short AND len(w) >= 5),
    e AS (SELECT b.thread_id, b.i, list(a.i) AS earlier FROM c a JOIN c b ON a.thread_id = b.thread_id AND a.i < b.i AND len(a.w) >= 0.85 * len(b.w) AND len(b.w) >= 0.85 * len(a.w) AND {_JACCARD.format(a='a.w', b='b.w')} GROUP BY 1, 2),
    q AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY i) AS k FROM e),
    g AS (SELECT DISTINCT thread_id, 0::BIGINT AS k, []::BIGINT[] AS gone FROM q UNION ALL
        SELECT q.thread_id, q.k, CASE WHEN len(list_filter(q.earlier, lambda a: NOT list_contains(g.gone, a))) > 0 THEN list_append(g.gone, q.i) ELSE g.gone END FROM g JOIN q ON q.thread_id = g.thread_id AND q.k = g.k + 1),
    f AS (SELECT thread_id, arg_max(gone, k) AS gone FROM g GROUP BY 1)
    SELECT mail_id, para_ord, md5(paragraph) AS paragraph_md5 FROM o LEFT JOIN f USING (thread_id) WHERE f.gone IS NULL OR NOT list_contains(f.gone, o.i)"""


@query
def d7_rebuilt_bodies(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root)
    return P.rebuilt_bodies(m, P.first_occurrences(P.paragraphs(m)))


SQL["d7_rebuilt_bodies"] = f"WITH {PARAS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, CASE WHEN length(norm) >= 10 THEN md5(norm) ELSE mail_id || '-' || para_ord END ORDER BY mail_ord, mail_id, para_ord) AS n FROM p), k AS (SELECT mail_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY para_ord) AS body FROM r WHERE n = 1 GROUP BY 1) SELECT m.mail_id, coalesce(k.body, '') AS body FROM m LEFT JOIN k USING (mail_id)"

# ---- specifications


def _re2(category: str, pattern: str) -> str:
    """RE2 has no lookahead: the character after a one-letter unit is matched too and cut off afterwards."""
    return "(?i)" + X.portable(pattern).replace("W(?![a-zA-Z])", "W(?:[^a-zA-Z]|$)").replace("V(?![a-zA-Z])", "V(?:[^a-zA-Z]|$)").replace("A(?![a-zA-Z])", "A(?:[^a-zA-Z]|$)").replace("g(?!a)", "g(?:[^aA]|$)")


def _raw(category: str) -> str:
    unit, after = {"Power": ("W", "^a-zA-Z"), "Voltage": ("V", "^a-zA-Z"), "Current": ("A", "^a-zA-Z"), "Weight/Mass": ("g", "^aA")}.get(category, ("", ""))
    pattern = r"(?is)^(\d+(?:\.\d+)?" + WS + f"*{unit})[{after}]$"
    return f"regexp_replace(raw, {lit(pattern)}, '\\1')" if unit else "raw"


def _matches_sql() -> str:
    parts = []
    for n, (category, pattern) in enumerate(X.PATTERNS):
        p = _re2(category, pattern)
        value = "raw_match" if category == "Thread/Bolt" else f"regexp_extract(raw_match, {lit(p)}, 1)"
        unit = "''" if category in X.UNITLESS else f"regexp_extract(raw_match, {lit(p)}, 2)"
        parts.append(
            f"SELECT mail_id, {lit(category)} AS category, {n} AS category_ord, raw_match, {value} AS value, {unit.replace('regexp_extract', 'regexp_extract')} AS unit FROM ("
            f"SELECT mail_id, arg_min(r, pos) AS raw_match FROM (SELECT mail_id, pos, {s_strip(_raw(category))} AS r FROM (SELECT mail_id, unnest(range(len(x))) AS pos, unnest(x) AS raw FROM (SELECT mail_id, regexp_extract_all(t, {lit(p)}) AS x FROM f))) GROUP BY mail_id, lower(r))"
        )
    return f"WITH {MAILS}, f AS (SELECT mail_id, {PREFILTER} AS t FROM m) " + " UNION ALL ".join(parts)


@query
def x1_category_matches(spark: SparkSession, root: str) -> DataFrame:
    x = X.category_matches(mails(spark, root))
    trim = F.regexp_replace("unit", r"[^A-Za-z°µ%\"/.\-\s]$", "")
    return x.select("mail_id", "category", "category_ord", "raw_match", "value", trim.alias("unit"))


SQL["x1_category_matches"] = f"SELECT mail_id, category, category_ord, raw_match, value, regexp_replace(CASE WHEN category IN ('Power', 'Voltage', 'Current', 'Weight/Mass') THEN {s_strip('unit')} ELSE unit END, '[^A-Za-z°µ%\"/.\\-\\s]$', '') AS unit FROM ({_matches_sql()})"


@query
def x4_materials(spark: SparkSession, root: str) -> DataFrame:
    return X.material_mentions(mails(spark, root)).select("mail_id", "material", F.col("position").cast("long").alias("position"))


SQL["x4_materials"] = f"WITH {MAILS}, k AS (SELECT unnest([{', '.join(lit(x) for x in MATERIALS)}]) AS material) SELECT mail_id, material, instr(lower(body), lower(material)) - 1 AS position FROM m JOIN k ON contains(lower(body), lower(material))"


@query
def x_extract_specs(spark: SparkSession, root: str) -> DataFrame:
    x = X.extract_specs(mails(spark, root)).withColumn("match_ord", F.col("match_ord").cast("long"))
    return x.select("mail_id", "match_ord", "category", "raw_match", "value", "unit", "context", "subject")


@query
def x3_subject(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "specs")
    return s.select("spec_id", X.subject_of(F.coalesce("context", F.lit("")), F.coalesce("value", F.lit(""))).alias("found_subject"))


_CTX, _VAL = "lower(coalesce(context, ''))", "lower(coalesce(value, ''))"


def _around(text: str) -> str:
    """The sentence of text that holds the offset `off` (characters before it)."""
    left, right = f"left({text}, off)", f"substr({text}, off + 1)"
    end = rf"(?s)^(.*?[.!?\n]){WS}"
    return s_strip(f"(regexp_replace({left}, {lit(rf'(?s)^.*[.!?\n]{WS}+')}, '') || CASE WHEN {s_match(right, end)} THEN regexp_extract({right}, {lit(end)}, 1) ELSE {right} END)")


def _located() -> str:
    """CTE `lm`: matches with their offsets, from the lengths of the pieces between matches and of the matches before."""
    parts = []
    for n, (category, pattern) in enumerate(X.PATTERNS):
        p = _re2(category, pattern)
        value = "raw_match" if category == "Thread/Bolt" else f"regexp_extract(raw_match, {lit(p)}, 1)"
        unit = "''" if category in X.UNITLESS else f"regexp_extract(raw_match, {lit(p)}, 2)"
        parts.append(
            f"SELECT mail_id, t, {n} AS n, {lit(category)} AS category, raw_match, {value} AS value, {unit} AS unit, off FROM (SELECT mail_id, any_value(t) AS t, arg_min(r, pos) AS raw_match, arg_min(off, pos) AS off FROM ("
            f"SELECT mail_id, t, pos, {s_strip(_raw(category))} AS r, off FROM (SELECT mail_id, t, unnest(range(len(x))) AS pos, unnest(x) AS raw, unnest(list_transform(range(len(x)), lambda i: coalesce(list_sum(list_transform(b[1:i + 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(x[1:i], lambda y: length(y))), 0)))::BIGINT AS off "
            f"FROM (SELECT mail_id, t, regexp_extract_all(t, {lit(p)}) AS x, regexp_split_to_array(t, {lit(p)}) AS b FROM f))) GROUP BY mail_id, lower(r))"
        )
    return "lm AS (" + " UNION ALL ".join(parts) + ")"


_MATERIAL_LIST = ", ".join(lit(k) for k in dict((m.lower(), m) for m in reversed(MATERIALS)).values())
_FALSE = lambda: f"((coalesce({_NEAR}, false)) OR (coalesce(unit, '') = '' AND regexp_matches({_V}, '^\\d+$') AND length({_V}) >= 5) OR regexp_matches(coalesce(raw_match, ''), {lit('(?i)' + X.SKIP_PHONE)}) OR (regexp_matches(coalesce(context, ''), {lit(_PIN)}) AND regexp_matches({_V}, '^\\d+$') AND length({_V}) BETWEEN 5 AND 6))"


def extracted() -> str:
    """CTEs up to `xe`: (mail_id, match_ord, category, raw_match, value, unit, context, subject), false positives taken out."""
    return f"""{MAILS}, f AS (SELECT mail_id, {PREFILTER} AS t FROM m WHERE length(body) > 0), {_located()},
    ml AS (SELECT unnest([{_MATERIAL_LIST}]) AS material, unnest(range({len(set(x.lower() for x in MATERIALS))})) AS mo), mm AS (SELECT mail_id, body AS t, 100 + {len(MATERIALS)} - mo AS n, 'Material' AS category, material AS raw_match, material AS value, '' AS unit, instr(lower(body), lower(material)) - 1 AS off FROM m JOIN ml ON contains(lower(body), lower(material))),
    la AS (SELECT *, row_number() OVER (PARTITION BY mail_id ORDER BY n, off) - 1 AS match_ord, {_around('t')} AS context FROM (SELECT * FROM lm UNION ALL SELECT * FROM mm)),
    kw AS (SELECT unnest([{', '.join(lit(x) for x in SUBJECTS)}]) AS k, unnest(range({len(SUBJECTS)})) AS i),
    sc AS (SELECT mail_id, match_ord, k, CASE WHEN instr({_CTX}, {_VAL}) > 0 THEN i ELSE 0 END AS i, CASE WHEN instr({_CTX}, {_VAL}) > 0 THEN abs(instr({_CTX}, k) - instr({_CTX}, {_VAL})) ELSE instr({_CTX}, k) - 1 END AS d FROM la, kw WHERE contains({_CTX}, k)),
    sb AS (SELECT mail_id, match_ord, k FROM sc QUALIFY row_number() OVER (PARTITION BY mail_id, match_ord ORDER BY d, i, k) = 1),
    xe AS (SELECT mail_id, match_ord, category, raw_match, value, unit, context, coalesce({s_capital('k')}, '') AS subject FROM la LEFT JOIN sb USING (mail_id, match_ord) WHERE category = 'Material' OR NOT {_FALSE()})"""


SQL["x3_subject"] = f"""WITH k AS (SELECT unnest([{', '.join(lit(x) for x in SUBJECTS)}]) AS k, unnest(range({len(SUBJECTS)})) AS i),
    c AS (SELECT spec_id, k, CASE WHEN instr({_CTX}, {_VAL}) > 0 THEN i ELSE 0 END AS i, CASE WHEN instr({_CTX}, {_VAL}) > 0 THEN abs(instr({_CTX}, k) - instr({_CTX}, {_VAL})) ELSE instr({_CTX}, k) - 1 END AS d FROM specs, k WHERE contains({_CTX}, k)),
    b AS (SELECT spec_id, k FROM c QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY d, i, k) = 1)
    SELECT s.spec_id, coalesce({s_capital('k')}, '') AS found_subject FROM specs s LEFT JOIN b USING (spec_id)"""


@query
def x5_false_positives(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "specs")
    c = lambda n: F.coalesce(n, F.lit(""))
    return s.select("spec_id", X.false_positive(F.col("category"), c("raw_match"), c("value"), c("unit"), c("context")).alias("rejected"))


_V = f"lower({s_strip(chr(99) + 'oalesce(value, ' + chr(39) * 2 + ')')})"
_NEAR = " OR ".join(f"(contains({_CTX}, {lit(w)}) AND contains({_CTX}, {_V}) AND abs(instr({_CTX}, {lit(w)}) - instr({_CTX}, {_V})) < 50)" for w in REFERENCE_WORDS)
_PIN = r"(?i)(?:pin|zip|postal)\s*[:.\-]?\s*\d{5,6}|\b\d{6}\b\s*(?:india|us|uk|$)"
SQL["x5_false_positives"] = f"SELECT spec_id, (({_NEAR}) OR (coalesce(unit, '') = '' AND regexp_matches({_V}, '^\\d+$') AND length({_V}) >= 5) OR regexp_matches(coalesce(raw_match, ''), {lit('(?i)' + X.SKIP_PHONE)}) OR (regexp_matches(coalesce(context, ''), {lit(_PIN)}) AND regexp_matches({_V}, '^\\d+$') AND length({_V}) BETWEEN 5 AND 6)) AS rejected FROM specs"


SQL["x_extract_specs"] = f"WITH {extracted()} SELECT * FROM xe"


@query
def a2_person_specs(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root)
    return Pe.specs_of_people(m, X.extract_specs(m)).select("thread_id", "address", "mail_ord", "mail_id", F.col("match_ord").cast("long").alias("match_ord"), "raw_match")


@query
def f11_highlighted(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "specs")
    return s.select("spec_id", X.highlighted(F.col("context"), F.col("raw_match")).alias("shown"))


SQL["f11_highlighted"] = "SELECT spec_id, CASE WHEN length(raw_match) > 0 THEN replace(context, raw_match, '<mark>' || raw_match || '</mark>') ELSE context END AS shown FROM specs"


@query
def n2_token_units(spark: SparkSession, root: str) -> DataFrame:
    return X.token_window_matches(mails(spark, root)).withColumn("token_ord", F.col("token_ord").cast("long"))


_UNIT_KEYS, _UNIT_VALUES = "[" + ", ".join(lit(k) for k in X.UNIT_TOKENS) + "]", "[" + ", ".join(lit(f"{c}|{u}") for c, u in X.UNIT_TOKENS.values()) + "]"
_LISTED = lambda words: "(" + ", ".join(lit(w) for w in words) + ")"
TOKENS = f"""tk AS (SELECT mail_id, regexp_extract_all({steps('body', X.TOKEN_STEPS)}, {lit(X.TOKEN)}) AS k FROM m), tu AS (SELECT mail_id, k, unnest(range(len(k))) AS i FROM tk),
    tw AS (SELECT *, k[i + 1] AS value, k[i + 2:i + 6] AS ahead FROM tu WHERE regexp_matches(k[i + 1], '^-?\\d')),
    th AS (SELECT *, list_min(list_filter(range(len(ahead)), lambda j: list_contains({_UNIT_KEYS}, lower(ahead[j + 1])))) AS hit, list_min(list_filter(range(len(ahead)), lambda j: ahead[j + 1] IN ('.', '!', '?', ';') OR (j >= 2 AND ahead[j + 1] NOT IN {_LISTED(X.RANGE_SIGNS)} AND lower(ahead[j + 1]) NOT IN {_LISTED(X.CONNECTORS)} AND NOT list_contains({_UNIT_KEYS}, lower(ahead[j + 1]))))) AS stop,
        coalesce(lower(k[i + 2]) IN {_LISTED(X.RANGE_SIGNS)} AND regexp_matches(k[i + 3], '^\\d'), false) AS span FROM tw),
    tz AS (SELECT mail_id, i AS token_ord, {_UNIT_VALUES}[list_position({_UNIT_KEYS}, lower(ahead[hit + 1]))] AS cu, CASE WHEN span THEN value || '-' || k[i + 3] ELSE value END AS value, CASE WHEN span THEN value || k[i + 2] || k[i + 3] ELSE value END AS shown FROM th WHERE hit IS NOT NULL AND (stop IS NULL OR stop > hit)),
    tq AS (SELECT mail_id, token_ord, split_part(cu, '|', 1) AS category, shown || ' ' || split_part(cu, '|', 2) AS raw_match, value, split_part(cu, '|', 2) AS unit FROM tz QUALIFY row_number() OVER (PARTITION BY mail_id, category, lower(raw_match) ORDER BY token_ord) = 1)"""
SQL["n2_token_units"] = f"WITH {MAILS}, {TOKENS} SELECT * FROM tq"


@query
def n5_hybrid(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root)
    cols = ("mail_id", "category", "raw_match", "value", "unit")
    trim = F.regexp_replace("unit", r"[^A-Za-z°µ%\"/.\-\s]$", "")
    return X.hybrid(X.category_matches(m).withColumn("unit", trim).select(*cols), X.token_window_matches(m).select(*cols))


SQL["n5_hybrid"] = f"""WITH g AS (SELECT mail_id, category, raw_match, value, unit FROM ({SQL['x1_category_matches']})), {MAILS}, {TOKENS},
    h AS (SELECT mail_id, category, raw_match, value, unit FROM tq t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.mail_id = t.mail_id AND lower(g.category) = lower(t.category) AND lower(coalesce(g.value, '')) = lower(t.value) AND lower(coalesce(g.unit, '')) = lower(t.unit))
        QUALIFY row_number() OVER (PARTITION BY mail_id, lower(category), lower(value), lower(unit) ORDER BY category, raw_match, value, unit) = 1)
    SELECT *, 'regex' AS origin FROM g UNION ALL SELECT *, 'tokens' FROM h"""


# ---- sentences


def _split_sql(expr: str) -> str:
    for i, a in enumerate(ABBREVIATIONS):
        expr = f"replace({expr}, {lit(a)}, {lit(f'{chr(1)}{i}{chr(2)}')})"
    expr = f"regexp_split_to_array({rx(expr, f'([.!?]){WS}+', chr(92) + '1' + chr(10))}, '\\n+')"
    back = "x"
    for i, a in enumerate(ABBREVIATIONS):
        back = f"replace({back}, {lit(f'{chr(1)}{i}{chr(2)}')}, {lit(a)})"
    return f"list_filter(list_transform({expr}, lambda x: {s_strip(back)}), lambda x: length(x) > 0)"


SENTENCES = f"{MAILS}, sl AS (SELECT mail_id, {_split_sql('body')} AS l FROM m WHERE length(body) > 0), s AS (SELECT mail_id, unnest(range(len(l))) AS sent_ord, unnest(l) AS sentence FROM sl)"


@query
def t4_sentences(spark: SparkSession, root: str) -> DataFrame:
    return S.sentences(mails(spark, root)).select("mail_id", F.col("sent_ord").cast("long").alias("sent_ord"), "sentence")


SQL["t4_sentences"] = f"WITH {SENTENCES} SELECT mail_id, sent_ord, sentence FROM s"


@query
def w1_sentence_context(spark: SparkSession, root: str) -> DataFrame:
    return S.sentences(mails(spark, root)).select("mail_id", F.col("sent_ord").cast("long").alias("sent_ord"), "context")


SQL["w1_sentence_context"] = f"WITH {SENTENCES} SELECT mail_id, sent_ord, concat_ws(' ', lag(sentence) OVER w, sentence, lead(sentence) OVER w) AS context FROM s WINDOW w AS (PARTITION BY mail_id ORDER BY sent_ord)"


@query
def t5_summary_sentences(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root).where(F.length("body") > 0)
    return m.select("mail_id", F.posexplode(S.summary_sentences(F.col("body"))).alias("sent_ord", "sentence")).select("mail_id", F.col("sent_ord").cast("long").alias("sent_ord"), "sentence")


_SUMMARY_SPLIT = f"list_filter(list_transform(regexp_split_to_array({rx('body', f'([.!?]){WS}+', chr(92) + '1' + chr(10))}, '\\n+'), lambda x: {s_strip('x')}), lambda x: length(x) > 15)"
SQL["t5_summary_sentences"] = f"WITH {MAILS}, l AS (SELECT mail_id, {_SUMMARY_SPLIT} AS l FROM m WHERE length(body) > 0) SELECT mail_id, unnest(range(len(l))) AS sent_ord, unnest(l) AS sentence FROM l"


def _words_sql(words: list[str], expr: str = "sentence") -> str:
    from mailweave.functions.text import word_pattern

    return "list_filter([" + ", ".join(f"CASE WHEN {s_match(expr, word_pattern(w))} THEN {lit(w)} END" for w in words) + "], lambda w: w IS NOT NULL)"


def _marker_sql(keywords_hit: str) -> str:
    from mailweave.functions.text import word_pattern

    arms = [f"WHEN contains(sentence, '?') AND NOT {s_match('sentence', S.GREETING)} AND {keywords_hit} THEN '?'" if m == "?" else f"WHEN {s_match('sentence', word_pattern(m))} THEN {lit(m)}" for m in UNRESOLVED_MARKERS]
    return "CASE " + " ".join(arms) + " END"


@query
def g2_tagged_sentences(spark: SparkSession, root: str) -> DataFrame:
    x = S.tag_sentences(mails(spark, root))
    return x.select("mail_id", F.col("sent_ord").cast("long").alias("sent_ord"), F.array_join("trigger_keywords", ",").alias("keywords"), "is_unresolved", F.round("confidence", 6).alias("confidence"))


# \b of RE2 knows ASCII letters only; a number beside any letter isn't one
_ANY_NUMBER = r"(?:^|[^\p{L}\p{N}_])\d+(?:\.\d+)?(?:$|[^\p{L}\p{N}_])"
_SCORE = f"(least(len(k) * 0.2::DOUBLE, 0.4::DOUBLE) + CASE WHEN {s_match('sentence', S.WITH_UNIT)} THEN 0.35::DOUBLE WHEN {s_match('sentence', _ANY_NUMBER)} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(k, lambda w: contains(w, ' '))) > 0 THEN 0.1::DOUBLE ELSE 0 END)"
_NWORDS = f"len(list_filter(regexp_split_to_array(sentence, {lit(WS + '+')}), lambda w: length(w) > 0))"
SQL["g2_tagged_sentences"] = f"WITH {SENTENCES}, t AS (SELECT *, {_words_sql(ENGINEERING_KEYWORDS)} AS k FROM s) SELECT mail_id, sent_ord, array_to_string(k, ',') AS keywords, ({_marker_sql('true')}) IS NOT NULL AS is_unresolved, round(least(1.0::DOUBLE, CASE WHEN {_NWORDS} < 4 THEN {_SCORE} * 0.5 WHEN {_NWORDS} > 5 THEN {_SCORE} + 0.05::DOUBLE ELSE {_SCORE} END), 6) AS confidence FROM t WHERE len(k) > 0"


@query
def g5_open_items(spark: SparkSession, root: str) -> DataFrame:
    return S.open_items(mails(spark, root)).select("mail_id", F.col("sent_ord").cast("long").alias("sent_ord"), "sentence", "marker")


SQL["g5_open_items"] = f"WITH {SENTENCES}, t AS (SELECT *, {_marker_sql(f'len({_words_sql(S.QUESTION_KEYWORDS)}) > 0')} AS marker FROM s) SELECT mail_id, sent_ord, sentence, marker FROM t WHERE marker IS NOT NULL"


@query
def g6_sentence_category(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tagged_sentences").where("sentence IS NOT NULL").select("sentence_id", S.sentence_category(F.col("sentence")).alias("kind"))


_TOKENS = "regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\\.[a-z0-9]+)*')"
SQL["g6_sentence_category"] = f"SELECT sentence_id, CASE WHEN {s_any('lower(sentence)', DECISION_WORDS)} THEN 'decision' WHEN {s_match('sentence', S.WITH_UNIT)} THEN 'spec' WHEN contains(sentence, '?') OR {s_any('lower(sentence)', ['tbd', 'pending'])} THEN 'open_item' WHEN len(list_filter({_TOKENS}, lambda w: w IN ({', '.join(lit(w) for w in BOOST_WORDS)}))) >= 2 THEN 'engineering' ELSE 'general' END AS kind FROM tagged_sentences WHERE sentence IS NOT NULL"

# ---- people

_ADDRESS = f"CASE WHEN regexp_extract(text, '<([^>]+)>', 1) <> '' THEN lower(regexp_extract(text, '<([^>]+)>', 1)) WHEN contains(text, '@') THEN lower({s_strip('text')}) ELSE '' END"
MENTIONS = f"""{MAILS}, mu AS (SELECT thread_id, mail_ord, mail_id, -1 AS slot, sender_address AS text, true AS is_sender, sender_name FROM m
    UNION ALL SELECT thread_id, mail_ord, mail_id, unnest(range(len(a))) AS slot, unnest(a) AS text, false, NULL FROM (SELECT *, list_concat(coalesce(recipients, []), coalesce(cc, [])) AS a FROM m)),
    mt AS (SELECT *, {_ADDRESS} AS found FROM mu WHERE length(text) > 0), mx AS (SELECT *, CASE WHEN found <> '' THEN found ELSE lower(text) END AS address FROM mt)"""
_BEFORE_LT = rx(rx(s_strip("split_part(text, '<', 1)"), '^"+|"+$'), "^'+|'+$")
_LOCAL = f"array_to_string(list_transform(regexp_split_to_array(split_part(found, '@', 1), '[._]'), lambda x: {s_capital('x')}), ' ')"
_NAME = f"CASE WHEN contains(text, '<') AND {_BEFORE_LT} <> '' THEN {_BEFORE_LT} WHEN found <> '' THEN {_LOCAL} ELSE {s_strip('text')} END"
_DOMAIN = "lower(split_part(address, '@', 2))"
_COMPANY = f"CASE WHEN NOT contains(address, '@') THEN '' WHEN {_DOMAIN} IN ({', '.join(lit(p) for p in PROVIDERS)}) THEN {s_capital(f'split_part({_DOMAIN}, {lit(chr(46))}, 1)')} WHEN contains({_DOMAIN}, '.') THEN {s_capital(f'split_part({_DOMAIN}, {lit(chr(46))}, -2)')} ELSE {s_capital(_DOMAIN)} END"


def _role_sql() -> str:
    arms = []
    for r in ROLE_KEYWORDS:
        k = r.lower()
        line = f"list_filter(list_transform(list_filter({s_lines('body')}, lambda l: contains(lower(l), {lit(k)})), lambda l: {s_strip(rx(s_strip('l'), '^[-|:]+|[-|:]+$'))}), lambda l: length(l) < 80)[1]"
        arms.append(f"WHEN contains(lower(body), {lit(k)}) THEN coalesce({line}, {lit(k[:1].upper() + k[1:])})")
    return "CASE " + " ".join(arms) + " ELSE '' END"


@query
def f1_mentions(spark: SparkSession, root: str) -> DataFrame:
    x = Pe.mentions(mails(spark, root))
    return x.select("mail_id", F.col("slot").cast("long").alias("slot"), "address", Pe.name_of(F.col("text")).alias("name"), Pe.company_of(F.col("address")).alias("company"))


SQL["f1_mentions"] = f"WITH {MENTIONS} SELECT mail_id, slot, address, {_NAME} AS name, {_COMPANY} AS company FROM mx"


@query
def f4_roles(spark: SparkSession, root: str) -> DataFrame:
    return mails(spark, root).select("mail_id", Pe.role_of(F.col("body")).alias("role"))


SQL["f4_roles"] = f"WITH {MAILS} SELECT mail_id, {_role_sql()} AS role FROM m"


SQL["a2_person_specs"] = f"WITH {extracted()}, {MENTIONS.removeprefix(MAILS + ', ')} SELECT thread_id, address, mail_ord, mail_id, match_ord, raw_match FROM mx JOIN xe USING (mail_id) WHERE is_sender"


@query
def a1_mails_sent(spark: SparkSession, root: str) -> DataFrame:
    return Pe.mentions(mails(spark, root)).where("is_sender").groupBy("address").agg(F.count("*").alias("n"))


SQL["a1_mails_sent"] = f"WITH {MENTIONS} SELECT address, count(*) AS n FROM mx WHERE is_sender GROUP BY 1"


@query
def a3_people(spark: SparkSession, root: str) -> DataFrame:
    return Pe.people_table(mails(spark, root)).drop("specs_mentioned")


SQL["a3_people"] = f"""WITH {MENTIONS}, f AS (SELECT *, count(*) FILTER (WHERE is_sender) OVER (PARTITION BY thread_id, address) AS mails_sent, row_number() OVER (PARTITION BY thread_id, address ORDER BY mail_ord, mail_id, slot) AS n FROM mx),
    g AS (SELECT f.*, m.body FROM f JOIN m USING (mail_id) WHERE n = 1)
    SELECT thread_id, address, CASE WHEN is_sender AND length(sender_name) > 0 THEN sender_name ELSE {_NAME} END AS name, {_COMPANY} AS company, CASE WHEN is_sender THEN {_role_sql()} ELSE '' END AS role, mails_sent FROM g"""


@query
def a2_specs_mentioned(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root)
    return Pe.people_table(m, X.category_matches(m)).where("specs_mentioned > 0").select("thread_id", "address", "specs_mentioned")


SQL["a2_specs_mentioned"] = f"WITH g AS (SELECT mail_id, count(*) AS n FROM ({SQL['x1_category_matches']}) GROUP BY 1), {MENTIONS} SELECT thread_id, address, sum(n)::BIGINT AS specs_mentioned FROM mx JOIN g USING (mail_id) WHERE is_sender GROUP BY 1, 2"


# ---- records


def _records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "specs"), table(spark, root, "tagged_sentences")


@query
def e3_timeline(spark: SparkSession, root: str) -> DataFrame:
    return R.timeline(*_records(spark, root)).select("date", "sentence", "mentioned_by", "kind", "ord")


SQL["e3_timeline"] = "SELECT date_str AS date, '[' || category || '] ' || raw_match AS sentence, mentioned_by, 'spec' AS kind, spec_id AS ord FROM specs WHERE length(date_str) > 0 UNION ALL SELECT date_str, left(sentence, 120), mentioned_by, 'tagged', sentence_id FROM tagged_sentences WHERE length(date_str) > 0 AND is_unresolved ORDER BY 1, 4, 5"


@query
def conflicts(spark: SparkSession, root: str) -> DataFrame:
    return R.conflicts(table(spark, root, "specs")).select("thread_id", "category", "subject", "spec_a", "spec_b", "a_value", "a_by", "b_value", "b_by", "severity")


_S = "coalesce({0}, '')"
SQL["conflicts"] = f"""WITH x AS (SELECT thread_id, lower({s_strip("coalesce(subject, '')")}) AS subject, category, try_cast(replace(coalesce(value, ''), ',', '') AS DOUBLE) AS num, lower({s_strip("coalesce(value, '')")}) AS txt, lower({s_strip("coalesce(unit, '')")}) AS unit, coalesce(mentioned_by, '') AS by_, spec_id, coalesce(value, '') AS value FROM specs),
    y AS (SELECT *, CASE WHEN num IS NOT NULL THEN '' ELSE txt END AS norm FROM x WHERE length(subject) > 0),
    c AS (SELECT thread_id, subject, category, norm, num, unit, by_, min(spec_id) AS id, arg_min(value, spec_id) AS value FROM y GROUP BY ALL),
    g AS (SELECT *, min(id) OVER (PARTITION BY thread_id, subject, category) AS grp, CASE WHEN num IS NOT NULL THEN '#' || num ELSE norm END || '_' || by_ AS side FROM c),
    p AS (SELECT a.thread_id, a.category, a.subject, a.id AS spec_a, b.id AS spec_b, a.value AS a_value, a.by_ AS a_by, b.value AS b_value, b.by_ AS b_by, a.num AS na, b.num AS nb, a.grp, least(a.side, b.side) AS k1, greatest(a.side, b.side) AS k2
        FROM g a JOIN g b ON a.thread_id = b.thread_id AND a.subject = b.subject AND a.category = b.category AND a.id < b.id WHERE NOT (a.num IS NOT DISTINCT FROM b.num AND a.norm = b.norm) AND (a.unit = '' OR b.unit = '' OR a.unit = b.unit)),
    r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, k1, k2 ORDER BY grp, spec_a, spec_b) AS n, abs(na - nb) / greatest(abs(na), abs(nb), 1.0) * 100 AS pct FROM p)
    SELECT thread_id, category, {s_capital('subject')} AS subject, spec_a, spec_b, a_value, a_by, b_value, b_by, CASE WHEN pct IS NULL THEN 'medium' WHEN pct > 20 THEN 'high' WHEN pct < 5 THEN 'low' ELSE 'medium' END AS severity FROM r WHERE n = 1"""


@query
def conflict_severities(spark: SparkSession, root: str) -> DataFrame:
    return R.conflicts(table(spark, root, "specs")).groupBy("severity").agg(F.count("*").alias("n"))


SQL["conflict_severities"] = f"SELECT severity, count(*) AS n FROM ({SQL['conflicts']}) GROUP BY 1"


@query
def conflict_lines(spark: SparkSession, root: str) -> DataFrame:
    return R.conflict_lines(R.conflicts(table(spark, root, "specs"))).select("thread_id", "n", "line")


SQL["conflict_lines"] = f"""WITH c AS ({SQL['conflicts']}), s AS (SELECT c.*, {s_strip("concat_ws(' ', a_value, lower(" + s_strip("coalesce(x.unit, '')") + "))")} AS sa, {s_strip("concat_ws(' ', b_value, lower(" + s_strip("coalesce(y.unit, '')") + "))")} AS sb, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM c JOIN specs x ON x.spec_id = c.spec_a JOIN specs y ON y.spec_id = c.spec_b)
    SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY rank, spec_a, spec_b) AS n, format('[{{}}] {{}} ({{}}): {{}} by {{}} vs {{}} by {{}}', upper(severity), subject, category, sa, a_by, sb, b_by) AS line FROM s"""


@query
def a9_category_counts(spark: SparkSession, root: str) -> DataFrame:
    return R.category_counts(table(spark, root, "specs"))


SQL["a9_category_counts"] = "SELECT category, count(*) AS n FROM specs GROUP BY 1"


@query
def a10_specs_per_person(spark: SparkSession, root: str) -> DataFrame:
    return R.specs_per_person(table(spark, root, "specs"))


SQL["a10_specs_per_person"] = "SELECT mentioned_by, count(*) AS n FROM specs WHERE length(mentioned_by) > 0 GROUP BY 1"


@query
def a5_values_by_category(spark: SparkSession, root: str) -> DataFrame:
    return R.values_by_category(table(spark, root, "specs"))


_LABEL = f"(CASE WHEN length(subject) > 0 THEN subject || ': ' ELSE '' END || {s_strip("concat_ws(' ', coalesce(value, ''), coalesce(unit, ''))")})"
SQL["a5_values_by_category"] = f"SELECT thread_id, category, string_agg(label, ' · ' ORDER BY id) AS \"values\", count(*) AS n FROM (SELECT thread_id, category, arg_min(label, spec_id) AS label, min(spec_id) AS id FROM (SELECT *, {_LABEL} AS label FROM specs) GROUP BY thread_id, category, lower(label)) GROUP BY 1, 2"


@query
def a8_counters(spark: SparkSession, root: str) -> DataFrame:
    return R.counters(mails(spark, root), *_records(spark, root))


SQL["a8_counters"] = "SELECT * FROM (SELECT count(*) AS n_mails, count(DISTINCT thread_id) AS n_threads FROM messages), (SELECT count(*) AS n_specs, count(DISTINCT category) AS n_categories FROM specs), (SELECT count(*) AS n_tagged, count(*) FILTER (WHERE is_unresolved) AS n_open FROM tagged_sentences)"


@query
def a15_filter_values(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "specs")
    return s.select(F.lit("category").alias("field"), F.col("category").alias("choice")).unionByName(s.select(F.lit("person").alias("field"), F.col("mentioned_by").alias("choice"))).where(F.length("choice") > 0).distinct().orderBy("field", "choice")


SQL["a15_filter_values"] = "SELECT DISTINCT * FROM (SELECT 'category' AS field, category AS choice FROM specs UNION ALL SELECT 'person', mentioned_by FROM specs) WHERE length(choice) > 0 ORDER BY 1, 2"


@query
def f5_numeric_specs(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "specs").withColumn("num", F.coalesce(R.number_of(F.col("value")), F.lit(0.0)))
    return s.where("num > 0").select("spec_id", "num").orderBy("num", "spec_id")


SQL["f5_numeric_specs"] = "SELECT spec_id, num FROM (SELECT spec_id, coalesce(try_cast(replace(value, ',', '') AS DOUBLE), 0) AS num FROM specs) WHERE num > 0 ORDER BY 2, 1"


@query
def f14_filter_specs(spark: SparkSession, root: str) -> DataFrame:
    return R.filter_specs(table(spark, root, "specs"), category="Torque", search="bolt").select("spec_id", "raw_match", "mentioned_by")


SQL["f14_filter_specs"] = "SELECT spec_id, raw_match, mentioned_by FROM specs WHERE category = 'Torque' AND (contains(lower(coalesce(value, '')), 'bolt') OR contains(lower(coalesce(subject, '')), 'bolt') OR contains(lower(category), 'bolt'))"


@query
def o6_top_open_items(spark: SparkSession, root: str) -> DataFrame:
    return R.top_open_items(table(spark, root, "tagged_sentences"))


SQL["o6_top_open_items"] = "SELECT mentioned_by, row_number() OVER w AS n, CASE WHEN length(sentence) > 150 THEN left(sentence, 150) || '...' ELSE sentence END AS sentence FROM tagged_sentences WHERE is_unresolved AND mentioned_by IS NOT NULL WINDOW w AS (PARTITION BY mentioned_by ORDER BY sentence_id) QUALIFY row_number() OVER w <= 5"


@query
def j1_mails_with_specs(spark: SparkSession, root: str) -> DataFrame:
    """Messages with the number of their recorded specifications, by message identifier; all of them stay."""
    from mailweave.operators.delivery_dedup import normal_id

    m = table(spark, root, "messages").select("delivery_id", normal_id(F.col("message_id")).alias("k"))
    s = table(spark, root, "specs").select(normal_id(F.col("message_id")).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n_specs"))
    return m.join(s, "k", "left").select("delivery_id", F.coalesce("n_specs", F.lit(0)).alias("n_specs"))


_K = r"nullif(lower(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g')), '')"
SQL["j1_mails_with_specs"] = f"WITH s AS (SELECT {_K} AS k, count(*) AS n FROM specs GROUP BY 1) SELECT delivery_id, coalesce(n, 0) AS n_specs FROM (SELECT delivery_id, {_K} AS k FROM messages) m LEFT JOIN s ON m.k = s.k"


@query
def o1_mail_order(spark: SparkSession, root: str) -> DataFrame:
    """Mails by thread and date, those without date first, ties by delivery: a range-partitioned sort, so a long thread is many tasks."""
    m = table(spark, root, "messages").select("delivery_id", "thread_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("day_time"), "date")
    return m.orderBy("thread_id", F.col("date").asc_nulls_first(), "delivery_id").drop("date")


SQL["o1_mail_order"] = "SELECT delivery_id, thread_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS day_time FROM messages ORDER BY thread_id, date ASC NULLS FIRST, delivery_id"


# ---- ranking and summaries


def thread_of(spark: SparkSession, root: str) -> DataFrame:
    """(k, thread_id): the thread of each message identifier, the first by name if there are several."""
    from mailweave.operators.delivery_dedup import normal_id

    return table(spark, root, "messages").select(normal_id(F.col("message_id")).alias("k"), "thread_id").where("k IS NOT NULL").groupBy("k").agg(F.min("thread_id").alias("thread_id"))


def _in_threads(spark: SparkSession, root: str) -> DataFrame:
    """tagged_sentences with thread_id; one whose message isn't known is a thread of its own."""
    from mailweave.operators.delivery_dedup import normal_id

    t = table(spark, root, "tagged_sentences").withColumn("k", normal_id(F.col("message_id")))
    return t.join(thread_of(spark, root), "k", "left").drop("k").withColumn("thread_id", F.coalesce("thread_id", F.concat(F.lit("#"), F.col("sentence_id").cast("string"))))


def _ranked(spark: SparkSession, root: str) -> DataFrame:
    return _in_threads(spark, root).where("sentence IS NOT NULL").select("thread_id", F.col("sentence_id").alias("sent_id"), "sentence")


_THREADS = f"mth AS (SELECT {_K} AS k, min(thread_id) AS thread_id FROM messages WHERE {_K} IS NOT NULL GROUP BY 1), ts AS (SELECT s.*, coalesce(mth.thread_id, '#' || sentence_id) AS thread_id FROM (SELECT *, {_K} AS k FROM tagged_sentences) s LEFT JOIN mth USING (k))"
_SENT = f"{_THREADS}, t AS (SELECT thread_id, sentence_id AS sent_id, sentence FROM ts WHERE sentence IS NOT NULL)"
_STOPS = ", ".join(lit(w) for w in STOP_WORDS)
TFIDF = f"""{_SENT}, w AS (SELECT thread_id, sent_id, list_filter({_TOKENS}, lambda x: x NOT IN ({_STOPS}) AND length(x) > 1) AS k FROM t),
    tf AS (SELECT thread_id, sent_id, term, count(*)::DOUBLE / max(n) AS tf FROM (SELECT thread_id, sent_id, len(k) AS n, unnest(k) AS term FROM w) GROUP BY 1, 2, 3),
    df AS (SELECT thread_id, term, count(*) AS df FROM tf GROUP BY 1, 2), nn AS (SELECT thread_id, count(*) AS n FROM t GROUP BY 1),
    v AS (SELECT tf.thread_id, sent_id, tf.term, tf * (ln(n::DOUBLE / df) + 1) AS w FROM tf JOIN df USING (thread_id, term) JOIN nn USING (thread_id))"""


@query
def r1_tfidf(spark: SparkSession, root: str) -> DataFrame:
    return Ra.tfidf(_ranked(spark, root)).select("sent_id", "term", F.round("w", 6).alias("weight"))


SQL["r1_tfidf"] = f"WITH {TFIDF} SELECT sent_id, term, round(w, 6) AS weight FROM v"


@query
def j7_cosine_edges(spark: SparkSession, root: str) -> DataFrame:
    return Ra.cosine_edges(Ra.tfidf(_ranked(spark, root)), 0.3).select("i", "j", F.round("sim", 5).alias("sim"))


SQL["j7_cosine_edges"] = f"WITH {TFIDF}, z AS (SELECT thread_id, sent_id, sqrt(sum(w * w)) AS z FROM v GROUP BY 1, 2), u AS (SELECT v.*, w / z AS u FROM v JOIN z USING (thread_id, sent_id)) SELECT a.sent_id AS i, b.sent_id AS j, round(sum(a.u * b.u), 5) AS sim FROM u a JOIN u b ON a.thread_id = b.thread_id AND a.term = b.term AND a.sent_id < b.sent_id GROUP BY a.thread_id, 1, 2 HAVING sum(a.u * b.u) > 0.3"


@query
def r2_textrank(spark: SparkSession, root: str) -> DataFrame:
    return Ra.rank_sentences(_ranked(spark, root)).select("thread_id", "sent_id", F.round("score", 5).alias("score"))


UNITS = f"{TFIDF}, z AS (SELECT thread_id, sent_id, sqrt(sum(w * w)) AS z FROM v GROUP BY 1, 2 HAVING sqrt(sum(w * w)) > 0), u AS (SELECT v.*, w / z AS u FROM v JOIN z USING (thread_id, sent_id))"
SIMILAR = f"{UNITS}, sm AS (SELECT a.thread_id, a.sent_id AS i, b.sent_id AS j, sum(a.u * b.u) AS sim FROM u a JOIN u b ON a.thread_id = b.thread_id AND a.term = b.term AND a.sent_id <> b.sent_id GROUP BY 1, 2, 3)"
# power iteration, a round a step; each thread ends on its own; a node's row of weight 0 to itself carries its old score along
RANKED = f"""{SIMILAR}, ow AS (SELECT i, sum(sim) AS o FROM sm GROUP BY 1), ed AS (SELECT thread_id, i, j, sim / o AS w FROM sm JOIN ow USING (i) UNION ALL SELECT thread_id, sent_id, sent_id, 0.0 FROM t),
    pr AS (SELECT t.thread_id, sent_id, n, 1.0::DOUBLE / n AS score, 0 AS it, false AS done FROM t JOIN nn USING (thread_id) UNION ALL
        SELECT thread_id, sent_id, n, new, it + 1, max(abs(new - old)) OVER (PARTITION BY thread_id) < 1e-4 FROM (
            SELECT ed.thread_id, ed.j AS sent_id, pr.n, pr.it, 0.15::DOUBLE / pr.n + 0.85::DOUBLE * sum(ed.w * pr.score) AS new, max(CASE WHEN ed.i = ed.j THEN pr.score END) AS old FROM pr JOIN ed ON ed.thread_id = pr.thread_id AND ed.i = pr.sent_id WHERE NOT pr.done AND pr.it < 100 GROUP BY ed.thread_id, ed.j, pr.n, pr.it)),
    rk AS (SELECT thread_id, sent_id, CASE WHEN any_value(n) = 1 THEN 1.0 ELSE arg_max(score, it) END AS score FROM pr GROUP BY 1, 2)"""
SQL["r2_textrank"] = f"WITH RECURSIVE {RANKED} SELECT thread_id, sent_id, round(score, 5) AS score FROM rk"


def _diverse(top: int) -> str:
    """The greedy choice, one sentence of each thread's ranking a step."""
    return f"""{RANKED}, od AS (SELECT rk.thread_id, rk.sent_id, coalesce(h.near, []) AS near, row_number() OVER (PARTITION BY rk.thread_id ORDER BY round(score, 9) DESC, rk.sent_id) AS pos FROM rk LEFT JOIN (SELECT i, list(j) AS near FROM sm WHERE sim > 0.7 GROUP BY 1) h ON h.i = rk.sent_id),
    ch AS (SELECT DISTINCT thread_id, 0::BIGINT AS pos, []::BIGINT[] AS chosen FROM od UNION ALL
        SELECT od.thread_id, od.pos, CASE WHEN len(ch.chosen) < {top} AND NOT list_has_any(ch.chosen, od.near) THEN list_append(ch.chosen, od.sent_id) ELSE ch.chosen END FROM ch JOIN od ON od.thread_id = ch.thread_id AND od.pos = ch.pos + 1),
    dv AS (SELECT thread_id, unnest(chosen) AS sent_id FROM (SELECT thread_id, arg_max(chosen, pos) AS chosen FROM ch GROUP BY 1))"""


@query
def r3_diverse_top(spark: SparkSession, root: str) -> DataFrame:
    s = _ranked(spark, root)
    return Ra.diverse_top(s, Ra.rank_sentences(s))


SQL["r3_diverse_top"] = f"WITH RECURSIVE {_diverse(8)} SELECT thread_id, sent_id, sentence FROM dv JOIN t USING (thread_id, sent_id)"


def _counted_people(spark: SparkSession, root: str, m: DataFrame) -> DataFrame:
    """People with the number of recorded specifications of their mails."""
    from mailweave.operators.delivery_dedup import normal_id

    ids = table(spark, root, "messages").select(F.col("delivery_id").alias("mail_id"), normal_id(F.col("message_id")).alias("k"))
    recorded = table(spark, root, "specs").select(normal_id(F.col("message_id")).alias("k")).where("k IS NOT NULL")
    return Pe.people_table(m, ids.join(recorded, "k").select("mail_id"))


@query
def r4_thread_summary(spark: SparkSession, root: str) -> DataFrame:
    m = mails(spark, root)
    return Su.thread_summary(m, table(spark, root, "specs"), _in_threads(spark, root).withColumn("ord", F.col("sentence_id")), _counted_people(spark, root, m))


PEOPLE = f"""{MENTIONS}, pf AS (SELECT *, count(*) FILTER (WHERE is_sender) OVER (PARTITION BY thread_id, address) AS mails_sent, row_number() OVER (PARTITION BY thread_id, address ORDER BY mail_ord, mail_id, slot) AS n FROM mx),
    pg AS (SELECT pf.*, m.body FROM pf JOIN m USING (mail_id) WHERE n = 1), pk AS (SELECT delivery_id AS mail_id, n FROM (SELECT delivery_id, {_K} AS k FROM messages) JOIN (SELECT {_K} AS k, count(*) AS n FROM specs GROUP BY 1) USING (k)),
    pn AS (SELECT thread_id, address, sum(n)::BIGINT AS specs_mentioned FROM mx JOIN pk USING (mail_id) WHERE is_sender GROUP BY 1, 2),
    pp AS (SELECT pg.thread_id, pg.address, CASE WHEN is_sender AND length(sender_name) > 0 THEN sender_name ELSE {_NAME} END AS name, {_COMPANY} AS company, CASE WHEN is_sender THEN {_role_sql()} ELSE '' END AS role, mails_sent, coalesce(specs_mentioned, 0) AS specs_mentioned FROM pg LEFT JOIN pn USING (thread_id, address))"""
_SHORT = "CASE WHEN length(sentence) > 150 THEN left(sentence, 150) || '...' ELSE sentence END"
SQL["r4_thread_summary"] = f"""WITH {PEOPLE}, {_THREADS}, hd AS (SELECT thread_id, count(*) AS n_mails, count(DISTINCT nullif(subject, '')) AS n_subjects, min(nullif(subject, '')) AS subject FROM m GROUP BY 1),
    ns AS (SELECT thread_id, count(*) AS n_specs FROM specs GROUP BY 1), np AS (SELECT thread_id, count(*) AS n_persons FROM pp GROUP BY 1), og AS (SELECT thread_id, string_agg(DISTINCT company, ', ' ORDER BY company) AS orgs FROM pp WHERE length(company) > 0 GROUP BY 1),
    vc AS (SELECT thread_id, category, string_agg(label, ' · ' ORDER BY id) AS vals FROM (SELECT thread_id, category, arg_min(label, spec_id) AS label, min(spec_id) AS id FROM (SELECT *, {_LABEL} AS label FROM specs) GROUP BY thread_id, category, lower(label)) GROUP BY 1, 2),
    ca AS (SELECT thread_id, string_agg('- **' || category || ':** ' || vals, chr(10) ORDER BY category) AS cats FROM vc GROUP BY 1),
    wh AS (SELECT thread_id, string_agg('- **' || coalesce(name, 'Unknown') || '**' || CASE WHEN length(company) > 0 THEN ' (' || company || ')' ELSE '' END || CASE WHEN length(role) > 0 THEN ' — ' || role ELSE '' END || ' — ' || mails_sent || ' mail(s)' || CASE WHEN specs_mentioned > 0 THEN ', mentioned ' || specs_mentioned || ' spec(s)' ELSE '' END, chr(10) ORDER BY mails_sent DESC, address) AS people FROM pp WHERE mails_sent > 0 GROUP BY 1),
    oi AS (SELECT thread_id, sentence_id, '- ' || {_SHORT} || ' (' || coalesce(mentioned_by, '') || ')' || coalesce(' — flags: ' || nullif(array_to_string(trigger_keywords, ', '), ''), '') AS line, row_number() OVER (PARTITION BY thread_id ORDER BY sentence_id) AS r, count(*) OVER (PARTITION BY thread_id) AS n_open FROM ts WHERE is_unresolved),
    op AS (SELECT thread_id, string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r <= 5) AS items, any_value(n_open) AS n_open FROM oi GROUP BY 1),
    dt AS (SELECT thread_id, min(date_str) AS first, max(date_str) AS last, count(*) AS n_events FROM (SELECT thread_id, date_str FROM specs WHERE length(date_str) > 0 UNION ALL SELECT thread_id, date_str FROM ts WHERE length(date_str) > 0 AND is_unresolved) GROUP BY 1)
    SELECT thread_id, concat_ws(chr(10), '## Executive Summary', '**Thread:** ' || CASE WHEN n_subjects = 1 THEN subject ELSE n_subjects || ' topics' END || ' | **Mails:** ' || n_mails || ' | **Participants:** ' || coalesce(n_persons, 0) || ' | **Specs:** ' || coalesce(n_specs, 0) || ' | **Open:** ' || coalesce(n_open, 0),
        '**Organizations:** ' || orgs, '### Key Specifications' || chr(10) || cats, '### Participants' || chr(10) || people,
        CASE WHEN items IS NOT NULL THEN '### Action Items (' || n_open || ')' || chr(10) || items || CASE WHEN n_open > 5 THEN chr(10) || '... and ' || (n_open - 5) || ' more' ELSE '' END ELSE '### No Open Items' || chr(10) || 'All items appear resolved.' END,
        '### Timeline (' || n_events || ' events)' || chr(10) || first || ' to ' || last) AS summary
    FROM hd LEFT JOIN ns USING (thread_id) LEFT JOIN np USING (thread_id) LEFT JOIN og USING (thread_id) LEFT JOIN ca USING (thread_id) LEFT JOIN wh USING (thread_id) LEFT JOIN op USING (thread_id) LEFT JOIN dt USING (thread_id)"""


@query
def r5_decisions(spark: SparkSession, root: str) -> DataFrame:
    s = _ranked(spark, root)
    return Su.decisions(Ra.diverse_top(s, Ra.rank_sentences(s), top=10))


_KIND = SQL["g6_sentence_category"].split("SELECT sentence_id, ", 1)[1].rsplit(" AS kind FROM", 1)[0]
_CUT = f"CASE WHEN length(bare) > 200 THEN left(bare, 200) || '...' ELSE bare END"
_DECIDED = f"{_diverse(10)}, dc AS (SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY sent_id) AS ord, {_CUT} AS sentence FROM (SELECT thread_id, sent_id, regexp_replace(sentence, '^[>\\s]+', '') AS bare, {_KIND} AS kind FROM dv JOIN t USING (thread_id, sent_id)) WHERE kind = 'decision' QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_id) <= 2)"
SQL["r5_decisions"] = f"WITH RECURSIVE {_DECIDED} SELECT * FROM dc"


@query
def r5_extractive_summary(spark: SparkSession, root: str) -> DataFrame:
    s, m = _ranked(spark, root), mails(spark, root)
    chosen = Ra.diverse_top(s, Ra.rank_sentences(s), top=10)
    return Su.extractive_summary(m, table(spark, root, "specs"), _in_threads(spark, root).withColumn("ord", F.col("sentence_id")), _counted_people(spark, root, m), chosen)


@query
def a6_value_sets(spark: SparkSession, root: str) -> DataFrame:
    return R.value_sets(table(spark, root, "specs")).withColumn("ord", F.col("ord").cast("long"))


_VAL6 = s_strip("(coalesce(value, '') || ' ' || coalesce(unit, ''))")
VALUE_SETS = f"""vs AS (SELECT thread_id, category, CASE WHEN length(value) > 0 THEN {_VAL6} END AS val, min(spec_id) AS id FROM specs GROUP BY 1, 2, 3), vg AS (SELECT thread_id, category, min(id) AS id, string_agg(val, ' | ' ORDER BY val) AS line FROM vs GROUP BY 1, 2),
    vl AS (SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY id, category) AS ord, category, line FROM vg)"""
SQL["a6_value_sets"] = f"WITH {VALUE_SETS} SELECT * FROM vl WHERE ord <= 6 AND length(line) > 0"
SQL["r5_extractive_summary"] = f"""WITH RECURSIVE {PEOPLE}, {_DECIDED}, {VALUE_SETS}, hd AS (SELECT thread_id, count(*) AS n_mails FROM m GROUP BY 1), np AS (SELECT thread_id, count(*) AS n_people FROM pp GROUP BY 1),
    og AS (SELECT thread_id, ' across ' || len(o) || ' organization(s) (' || array_to_string(o[1:3], ', ') || ')' AS orgs FROM (SELECT thread_id, list(DISTINCT company ORDER BY company) AS o FROM pp WHERE length(company) > 0 AND company <> 'Unknown' GROUP BY 1)),
    ca AS (SELECT thread_id, string_agg('- **' || category || ':** ' || line, chr(10) ORDER BY ord) AS cats FROM vl WHERE ord <= 6 AND length(line) > 0 GROUP BY 1),
    be AS (SELECT thread_id, string_agg('- "' || sentence || '"', chr(10) ORDER BY ord) AS best FROM dc GROUP BY 1),
    oi AS (SELECT thread_id, '- ' || regexp_replace(sentence, '^[>\\s]+', '') || ' *(Asked by ' || coalesce(nullif(mentioned_by, ''), 'Unknown') || ')*' AS line, row_number() OVER (PARTITION BY thread_id ORDER BY sentence_id) AS r, count(*) OVER (PARTITION BY thread_id) AS n_open FROM ts WHERE is_unresolved),
    op AS (SELECT thread_id, string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r <= 3) AS items, any_value(n_open) AS n_open FROM oi GROUP BY 1), sp AS (SELECT DISTINCT thread_id, true AS has_specs FROM specs)
    SELECT thread_id, concat_ws(chr(10), '### Executive Engineering Summary', 'This thread contains **' || n_mails || ' mails** with **' || coalesce(n_people, 0) || ' participants**' || coalesce(orgs, '') || '.', '**Finalized / Proposed Specifications:**' || chr(10) || cats,
        '**Key Agreements & Statements:**' || chr(10) || best, '**Pending Action Items & Questions:**' || chr(10) || items || CASE WHEN n_open > 3 THEN chr(10) || '- *...and ' || (n_open - 3) || ' more unresolved item(s).*' ELSE '' END,
        CASE WHEN has_specs IS NULL AND items IS NULL AND best IS NULL THEN '*No specific engineering parameters or action items were identified in this thread.*' END) AS summary
    FROM hd LEFT JOIN np USING (thread_id) LEFT JOIN og USING (thread_id) LEFT JOIN ca USING (thread_id) LEFT JOIN be USING (thread_id) LEFT JOIN op USING (thread_id) LEFT JOIN sp USING (thread_id)"""


@query
def a7_subjects_and_companies(spark: SparkSession, root: str) -> DataFrame:
    """The distinct subjects and companies of each thread."""
    m = mails(spark, root)
    a = m.where("length(subject) > 0").select("thread_id", F.lit("subject").alias("kind"), F.col("subject").alias("name"))
    b = Pe.people_table(m).where("length(company) > 0").select("thread_id", F.lit("company").alias("kind"), F.col("company").alias("name"))
    return a.unionByName(b).distinct()


SQL["a7_subjects_and_companies"] = f"WITH {PEOPLE} SELECT DISTINCT thread_id, 'subject' AS kind, subject AS name FROM m WHERE length(subject) > 0 UNION ALL SELECT DISTINCT thread_id, 'company', company FROM pp WHERE length(company) > 0"


@query
def a12_timeline_span(spark: SparkSession, root: str) -> DataFrame:
    return R.timeline_span(table(spark, root, "specs"), _in_threads(spark, root))


SQL["a12_timeline_span"] = f"WITH {_THREADS} SELECT thread_id, min(date_str) AS first, max(date_str) AS last, count(*) AS n_events FROM (SELECT thread_id, date_str FROM specs WHERE length(date_str) > 0 UNION ALL SELECT thread_id, date_str FROM ts WHERE length(date_str) > 0 AND is_unresolved) GROUP BY 1"


@query
def o4_participants(spark: SparkSession, root: str) -> DataFrame:
    """Who sent mails in a thread, by number of mails."""
    p = Pe.people_table(mails(spark, root)).where("mails_sent > 0").select("thread_id", (-F.col("mails_sent")).alias("less"), "address", "mails_sent")
    return R.numbered(p, ["thread_id"], ["less", "address"]).select("thread_id", "n", "address", "mails_sent")


SQL["o4_participants"] = f"WITH {MENTIONS} SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY count(*) DESC, address) AS n, address, count(*) AS mails_sent FROM mx WHERE is_sender GROUP BY thread_id, address"


@query
def f9_thinking(spark: SparkSession, root: str) -> DataFrame:
    """Subjects as a model's thinking before bodies as its answer, split again."""
    thinking, answer = Su.split_thinking(F.concat(F.lit("<think>"), "subject", F.lit("</think>"), "body"))
    return mails(spark, root).select("mail_id", thinking.alias("thinking"), F.md5(answer).alias("answer_md5"))


SQL["f9_thinking"] = f"WITH {MAILS} SELECT mail_id, subject AS thinking, md5(trim(body)) AS answer_md5 FROM m"


@query
def r6_prompts(spark: SparkSession, root: str) -> DataFrame:
    return Su.prompts(mails(spark, root))


SQL["r6_prompts"] = f"WITH {MAILS}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY mail_ord, mail_id) AS r FROM m) SELECT thread_id, string_agg('From: ' || coalesce(sender_name, 'Unknown') || chr(10) || 'Subject: ' || subject || chr(10) || 'Body:' || chr(10) || left(body, 1500) || '...', chr(10) || '---' || chr(10) ORDER BY r) AS prompt FROM r WHERE r <= 15 GROUP BY 1"


# ---- sinks and windows


@query
def k3_html_rows(spark: SparkSession, root: str) -> DataFrame:
    return html_rows(table(spark, root, "specs"), ["category", "value", "unit", "subject", "raw_match", "mentioned_by"])


SQL["k3_html_rows"] = "SELECT '<tr>' || " + " || ".join(f"'<td>' || {_escaped(f'coalesce({c}, {lit(chr(0))[:1]}{chr(39)})')} || '</td>'" for c in ("category", "value", "unit", "subject", "raw_match", "mentioned_by")) + " || '</tr>' AS row FROM specs"


@query
def k4_json_lines(spark: SparkSession, root: str) -> DataFrame:
    specs, tagged = _records(spark, root)
    return json_lines({"specs": specs, "tagged_sentences": tagged})


_SPEC_JSON = ", ".join(f"'{c}': {c}" for c in "spec_id thread_id message_id category raw_match value unit subject context mentioned_by mentioned_address date_str source_file".split())
_TAGGED_JSON = ", ".join(f"'{c}': {c}" for c in "sentence_id message_id sentence context trigger_keywords is_unresolved confidence mentioned_by mentioned_address date_str source_file".split())
SQL["k4_json_lines"] = f"SELECT 'specs' AS section, to_json({{{_SPEC_JSON}}})::VARCHAR AS json FROM specs UNION ALL SELECT 'tagged_sentences', to_json({{{_TAGGED_JSON}}})::VARCHAR FROM tagged_sentences"


@query
def w5_rate_limit(spark: SparkSession, root: str) -> DataFrame:
    """Events accepted under a limit of two an hour and user."""
    e = table(spark, root, "events").select("event_id", "user_id", "ts")
    return R.rate_limited(e, "user_id", "ts", limit=2, seconds=3600).select("event_id", "accepted")


SQL["w5_rate_limit"] = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS accepted, []::TIMESTAMP[] AS q FROM (SELECT DISTINCT user_id FROM events) UNION ALL
        SELECT user_id, i, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END FROM (SELECT o.*, list_filter(g.q, lambda t: o.ts - t < INTERVAL 3600 SECOND) AS live FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1))
    SELECT event_id, accepted FROM g WHERE i > 0"""


@query
def win_window_counts(spark: SparkSession, root: str) -> DataFrame:
    x = window_counts(table(spark, root, "events"), window="1 day")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


SQL["win_window_counts"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query
def win_session_counts(spark: SparkSession, root: str) -> DataFrame:
    x = session_counts(table(spark, root, "events"), gap="6 hours")
    return x.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


SQL["win_session_counts"] = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1"
