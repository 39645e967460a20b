"""Row-wise cleaning of mail bodies; every function maps a Column to a Column, so a chain stays one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions.text import WS, Steps, any_contains, bound, quote, replace_all, replace_guarded, rstrip, strip
from mailweave.words import DISCLAIMER_PHRASES, SIGNATURE_MARKERS, SIGNATURE_ROLES

# What each step deletes.
FORWARDED: Steps = [
    (r"(?i)-{3,}\s*Forwarded message\s*-{3,}", ""),
    (r"(?i)-{3,}\s*Original Message\s*-{3,}", ""),
    (r"(?m)^From:\s+[^\n]*\nSent:\s+[^\n]*\nTo:\s+[^\n]*\nSubject:\s+", ""),
    (r"(?m)^On\s+[^\n]*wrote:\s*$", ""),
    (r"(?m)^_{10,}$", ""),
    (r"(?m)^-{10,}$", ""),
    (r"(?m)^={10,}$", ""),
    (r"\n{3,}", "\n\n"),
]
CRM_REFS: Steps = [
    (r"(?i)ref:_[a-z0-9]+\._[a-z0-9]+:ref", ""),
    (r"(?i)\[\s*ref:\s*[a-z0-9_.\-]+\s*\]", ""),
    (r"(?i)(?:Case|Ref|Reference|Ticket|Opp|Opportunity)\s*[#:.\-]\s*\d{5,}", ""),
    (r"(?im)^\s*SF-(?:Case|Opp)-[^\n]*$", ""),
]
CALENDAR: Steps = [(r"(?im)^(?:When|Where|Organizer|Required|Optional):\s+[^\n]*$", ""), (r"(?m)^─{5,}$", "")]
AUTO_REPLY: Steps = [
    (r"(?i)This is an automatic(?:ally generated)? (?:reply|message|response)", ""),
    (r"(?i)I (?:am|will be) (?:currently )?(?:out of (?:the )?office|on leave|unavailable)", ""),
    (r"(?im)^Sent from (?:my )?\w+", ""),
]
#: What a text must hold for each step to find something.
_FORWARDED_NEEDS = [("forwarded message",), ("original message",), ("Sent:",), ("wrote:",), ("_" * 10,), ("-" * 10,), ("=" * 10,), ("\n\n\n",)]
_CRM_NEEDS, _CALENDAR_NEEDS = [("ref:_",), ("ref:",), (r"^\d{5}",), ("sf-",)], [("when:", "where:", "organizer:", "required:", "optional:"), ("─" * 5,)]
_AUTO_NEEDS = [("this is an automatic",), ("i am ", "i will be "), ("sent from ",)]
CONTROLS: Steps = [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")]
HTML_TAGS: Steps = [
    (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)</p>", "\n"), (r"(?i)</div>", "\n"), (r"(?i)</tr>", "\n"), (r"<[^>]+>", ""),
]
# Entities in the order in which they are replaced (so &amp;lt; is decoded twice).
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8211;", "-"), ("&#8212;", "—"),
    ("&ldquo;", '"'), ("&rdquo;", '"'), ("&lsquo;", "'"), ("&rsquo;", "'"), ("&mdash;", "—"), ("&ndash;", "-"), ("&hellip;", "..."), ("&bull;", "•"), ("&middot;", "·"),
]
PHONE = r"(?i)^\s*(?:Tel|Phone|Mobile|Cell|Mob|Fax|Ph|T|M|F)\s*[:.]\s*[+\d()\-\s]{7,}"
BARE_PHONE = r"^\s*[+]?\d[\d\s\-()]{8,}\s*$"
ADDRESS_ONLY = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)(?:https?://|www\.)\S+|linkedin\.com\S*|twitter\.com\S*|facebook\.com\S*"
STREET = r"(?i)\b(?:street|road|rd|avenue|ave|sector|plot|lane|block|floor|suite|building|bldg|pin|zip)\b|\b\d{5,6}\b"
ROLE = r"\b(?:" + "|".join(SIGNATURE_ROLES) + r")\b"
QUOTE_INTRO = r"(?i)^On\s+[^\n]*wrote:\s*$"
PARAGRAPH_BREAK = rf"\n{WS}*\n"


def strip_forwarded(body: Column) -> Column:
    """Forwarding marks, header blocks up to the subject and rulers deleted; forwarded content stays."""
    return strip(replace_guarded(body, FORWARDED, _FORWARDED_NEEDS))


def strip_crm_refs(body: Column) -> Column:
    return replace_guarded(body, CRM_REFS, _CRM_NEEDS)


def strip_calendar(body: Column) -> Column:
    return replace_guarded(body, CALENDAR, _CALENDAR_NEEDS)


def strip_auto_reply(body: Column) -> Column:
    return replace_guarded(body, AUTO_REPLY, _AUTO_NEEDS)


def sanitise(text: Column) -> Column:
    """Control characters but tab, line feed and carriage return deleted."""
    return replace_all(text, CONTROLS)


def strip_disclaimer(body: Column, phrases: list[str] = DISCLAIMER_PHRASES) -> Column:
    """Paragraphs with one of the phrases deleted; without phrases the body stays as it is."""
    if not phrases:
        return body
    paragraphs = F.filter(F.split(body, PARAGRAPH_BREAK, -1), lambda p: ~any_contains(F.lower(p), [x.lower() for x in phrases]))
    return F.array_join(paragraphs, "\n\n")


def line_signal(line: Column) -> Column:
    """What a line has of a signature: phone, mail, url, address or role; "" if nothing."""

    def kind(x: Column) -> Column:
        line, bare, low = x["line"], x["bare"], x["low"]
        n = F.length(bare)
        return (
            F.when(n == 0, "").when(line.rlike(PHONE) | line.rlike(BARE_PHONE), "phone").when(bare.contains("@") & bare.rlike(ADDRESS_ONLY), "mail")
            .when((low.contains("http") | low.contains("www.") | low.contains(".com")) & bare.rlike(URL), "url").when((n < 120) & bare.rlike(STREET), "address").when((n < 80) & low.rlike(ROLE), "role").otherwise("")
        )

    return bound(F.struct(line.alias("line"), strip(line).alias("bare"), F.lower(strip(line)).alias("low")), kind)


def marker_pattern(markers: list[str] = SIGNATURE_MARKERS) -> str:
    return r"(?i)^\s*(?:" + "|".join(quote(m) for m in markers) + ")"


def strip_signature(body: Column, markers: list[str] = SIGNATURE_MARKERS) -> Column:
    """Three cuts: at the first marker line of the second half (else at its last labelled phone line); at the first of
    three or more signature signals of two or more kinds in the last 15 lines; short lines at the end of a long body."""

    def first(lines: Column) -> Column:
        half = F.size(lines) / 2
        marked = F.filter(F.transform(lines, lambda l, i: F.when((i >= F.floor(half)) & l.rlike(marker_pattern(markers)), i)), lambda i: i.isNotNull())
        phones = F.filter(F.transform(lines, lambda l, i: F.when((i > F.floor(half)) & l.rlike(PHONE), i)), lambda i: i.isNotNull())
        return F.slice(lines, F.lit(1), F.coalesce(F.array_min(marked), F.array_max(phones), F.size(lines)))

    def second(x: Column) -> Column:
        start = F.greatest(F.lit(0), F.size(x) - 15)
        signals = F.filter(F.transform(x, lambda l, i: F.struct(i.alias("i"), F.when(i >= start, line_signal(l)).otherwise("").alias("s"))), lambda s: s["s"] != "")
        enough = (F.size(signals) >= 3) & (F.size(F.array_distinct(F.transform(signals, lambda s: s["s"]))) >= 2)
        return F.when(enough, F.slice(x, F.lit(1), F.get(signals, F.lit(0))["i"])).otherwise(x)

    def third(x: Column) -> Column:
        tail = F.reverse(F.slice(x, F.greatest(F.lit(1), F.size(x) - 9), 10))
        long_at = F.array_position(F.transform(tail, lambda l: F.length(strip(l)) >= 5), True)
        short = F.when(long_at == 0, F.size(tail)).otherwise((long_at - 1).cast("int"))
        return F.when((F.size(x) > 10) & (short >= 5), F.slice(x, F.lit(1), F.size(x) - short)).otherwise(x)

    # each pass refers to the one before several times: bound once as an array of one element
    out = F.array(F.split(body, "\n", -1))
    for step in (first, second, third, lambda x: rstrip(F.array_join(x, "\n"))):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def clean_body(body: Column, markers: list[str] = SIGNATURE_MARKERS, phrases: list[str] = DISCLAIMER_PHRASES) -> Column:
    """All cleaning steps in order; NULL and empty bodies give ""."""
    x = strip_signature(strip_disclaimer(strip_auto_reply(strip_calendar(strip_crm_refs(strip_forwarded(body)))), phrases), markers)
    x = replace_all(x, [(r"\n{3,}", "\n\n")])
    return F.coalesce(strip(F.array_join(F.transform(F.split(x, "\n", -1), rstrip), "\n")), F.lit(""))


def drop_quoted_lines(body: Column) -> Column:
    """Lines that start with > and lines that introduce a quotation deleted."""
    lines = F.filter(F.split(body, "\n", -1), lambda l: ~(strip(l).startswith(">") | strip(l).rlike(QUOTE_INTRO)))
    return F.array_join(lines, "\n")


def _code_points(c: Column, pattern: str, base: int) -> Column:
    """Numeric references decoded, each distinct one by a replacement; beyond the code range they stay."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))

    def decode(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, pattern, 1)
        code = F.conv(digits, base, 10).cast("bigint")
        big = F.concat(F.lpad(F.conv(code, 10, 16), 8, "0"))
        return F.when((code > 0) & (code < 1114112) & ~code.between(0xD800, 0xDFFF), F.replace(acc, ref, F.decode(F.unhex(big), "UTF-32"))).otherwise(acc)

    return F.aggregate(refs, c, decode)


def html_to_text(source: Column) -> Column:
    """Tags deleted with line breaks kept, entities and numeric references decoded, white space collapsed."""
    c = replace_all(source, HTML_TAGS)
    for entity, text in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(text))
    c = _code_points(_code_points(c, r"&#(\d{1,7});", 10), r"&#x([0-9a-fA-F]{1,6});", 16)
    return strip(replace_all(c, [(r"[ \t]{3,}", "  "), (r"\n{3,}", "\n\n")]))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def preview(body: Column, length: int = 500) -> Column:
    """Body for display: escape sequences of characters decoded (what is none deleted), HTML escaped, cut with an ellipsis; "(empty)" for nothing."""
    c = _code_points(F.coalesce(body, F.lit("")), r"\\u([0-9a-fA-F]{4})", 16)
    c = escape_html(F.regexp_replace(c, r"\\u[0-9a-fA-F]{4}", ""))
    c = F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length)), F.lit("..."))).otherwise(c)
    return F.when(F.length(strip(F.coalesce(body, F.lit("")))) == 0, "(empty)").otherwise(c)
