"""Quantities and designations in mail texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map
from mailweave.functions.text import WS, capitalise, find, replace_all, strip
from mailweave.words import MATERIALS, REFERENCE_WORDS, SUBJECTS

_N = r"\d+(?:\.\d+)?"
# Category, pattern (value, unit), in order; regardless of case.
PATTERNS: list[tuple[str, str]] = [
    ("Dimensions", rf'({_N}(?:\s*/\s*{_N})?)\s*(mm|cm|m|inch|inches|in|ft|feet|")'),
    ("Torque", rf"({_N})\s*(Nm|N\.m|kNm|lb[\-\s]?ft|lbf\.ft|oz[\-\s]?in)"),
    ("Speed/RPM", rf"({_N})\s*(RPM|r/min|rad/s|rev/min)"),
    ("Power", rf"({_N})\s*(kW|MW|HP|bhp|W(?![a-zA-Z]))"),
    ("Pressure", rf"({_N})\s*(bar|psi|Pa|kPa|MPa|atm)"),
    ("Temperature", rf"(-?{_N})\s*(°C|°F|degC|degF|deg\s*C|deg\s*F|\bK\b)"),
    ("Voltage", rf"({_N})\s*(kV|mV|VAC|VDC|V(?![a-zA-Z]))"),
    ("Current", rf"({_N})\s*(mA|kA|Amps?|A(?![a-zA-Z]))"),
    ("Weight/Mass", rf"({_N})\s*(kg|g(?!a)|lbs?|ton(?:ne)?s?)"),
    ("Tolerance", rf"([±]\s*{_N}|[+]\s*/\s*[-]\s*{_N})\s*(mm|%|µm|micron)"),
    ("Thread/Bolt", rf"(M\d+(?:\s*[×x]\s*{_N})?)"),
    ("Standards", r"(IS\s*\d+|ISO\s*\d+|ASTM\s*[A-Z]\d+|IP\s*\d+|NEMA\s*\d+|IEC\s*\d+|DIN\s*\d+|BS\s*\d+|EN\s*\d+)"),
    ("IP Rating", r"(IP\s*\d{2}(?:[A-Z])?)"),
    ("Efficiency Class", r"(IE[1-4]|EFF[1-3])"),
    ("Coupling Style", r"\b((?:RMS|RZS|RM|RZ|MP|MS)\s*\d{2,4}(?:\s*[A-Z]{0,3})?)\b"),
    ("Surface Finish", rf"({_N})\s*(Ra|Rz|µm|RMS|micro[\s\-]?inch)"),
    ("Fit/Interference", r"([HhKkMmNnPpRrSsTtUu]\d{1,2}\s*/\s*[a-z]\d{1,2}|(?:H7|H6|H8|k6|m6|n6|p6|js6|g6|f7|e8)\b)"),
    ("Hub Bore", rf"(?:hub|bore|coupling)\s*(?:bore|diameter|dia|size)?\s*(?:[:=]|is|of)?\s*({_N})\s*(mm|inch|in)?"),
]
def portable(pattern: str) -> str:
    """The pattern with white space of all scripts spelt out, for engines whose own class knows ASCII only."""
    return WS.join(part.replace(r"[\-\s]", "[\\-" + WS[1:]) if r"[\-\s]" in part else part for part in _outside(pattern))


def _flags(pattern: str) -> str:
    """Case is ignored for letters of all scripts only where the pattern has such letters; it costs time otherwise."""
    return "(?i)" if pattern.isascii() else "(?iu)"


def _outside(pattern: str) -> list[str]:
    """Pieces of pattern between white-space escapes that stand outside brackets."""
    return re.split(r"(?<!\\-)\\s", pattern)


#: Categories whose pattern has no unit group.
UNITLESS = {"Thread/Bolt", "Standards", "IP Rating", "Efficiency Class", "Coupling Style", "Fit/Interference"}
# What is deleted before extraction, and what looks like a quantity but isn't one.
SKIP_REFS = [(r"(?i)ref:_[a-z0-9]+\._[a-z0-9]+:ref|\[\s*ref:\s*[a-z0-9_.\-]+\s*\]|(?:Case|Ref|Reference|Ticket|Opp)\s*[#:.\-]\s*\d{5,}|SF-(?:Case|Opp)-\S+", "")]
PHONE_LINE = r"^[+\d()\-\s]{7,}$"
SKIP_PHONE = r"(?:Tel|Phone|Mobile|Cell|Mob|Fax|Ph|T|M|F)\s*[:.]\s*[+\d()\-\s]{7,}|[+]?\d[\d\s\-()]{8,}"
SKIP_PIN = r"(?:pin|zip|postal)\s*[:.\-]?\s*\d{5,6}|\b\d{6}\b(?=\s*(?:india|us|uk|$))"
NEAR = 50


def prefilter(text: Column) -> Column:
    """Text without references of the CRM and without lines that are only a phone number."""
    lines = F.filter(F.split(replace_all(text, SKIP_REFS), "\n", -1), lambda l: ~strip(l).rlike(PHONE_LINE))
    return F.array_join(lines, "\n")


def category_matches(mails: DataFrame, categories: list[str] | None = None, text: str = "body") -> DataFrame:
    """(mail_id, category, category_ord, raw_match, value, unit): distinct matches of a mail, first spelling first.

    One pass over each text in Arrow batches: 18 scans by the JVM's functions take longer. NULL texts match nothing.
    """
    place = {c: n for n, (c, _) in enumerate(PATTERNS) if not categories or c in categories}

    def make() -> object:
        return lambda mail, body: [(mail, c, place[c], raw, value, unit) for _, c, raw, value, unit, _ in matches_of(body, []) if c in place]

    kind = mails.schema["mail_id"].dataType.simpleString()
    return flat_map(mails.where(f"length({text}) > 0").select("mail_id", text), make, f"mail_id {kind}, category string, category_ord int, raw_match string, value string, unit string")


def subject_of(context: Column, value: Column) -> Column:
    """The subject word nearest to value in context (the first in the list among equals), capitalised; "" if there is none."""
    low = F.lower(context)

    def nearest(b: Column) -> Column:
        hits = F.filter(F.transform(F.array(*[F.lit(k) for k in SUBJECTS]), lambda k, i: F.struct(find(b["low"], k).alias("p"), i.alias("i"), k.alias("k"))), lambda s: s["p"] >= 0)
        there = b["at"] >= 0
        return F.array_min(F.transform(hits, lambda s: F.struct(F.when(there, F.abs(s["p"] - b["at"])).otherwise(s["p"]).alias("d"), F.when(there, s["i"]).otherwise(0).alias("i"), s["k"].alias("k"))))["k"]

    # the text in lower case and the value's place are bound once
    return F.coalesce(capitalise(F.get(F.transform(F.array(F.struct(low.alias("low"), find(low, F.lower(value)).alias("at"))), nearest), F.lit(0))), F.lit(""))


def false_positive(category: Column, raw: Column, value: Column, unit: Column, context: Column, whole_words: bool = False) -> Column:
    """Whether a match is a reference, a long bare number, a phone number or a postal code.

    Reference words count as parts of words ("po" in "power"), as the rule was meant to be read literally; whole_words asks for words.
    """
    low, v = F.lower(context), F.lower(strip(value))
    if whole_words:
        near = F.lit(False)
        for w in REFERENCE_WORDS:
            at = F.regexp_instr(low, F.lit(r"\b" + re.escape(w) + (r"\b" if w[-1].isalnum() else ""))) - 1
            near = near | ((at >= 0) & (find(low, v) >= 0) & (F.abs(at - find(low, v)) < NEAR))
    else:

        def by_word(b: Column) -> Column:
            return (b["at"] >= 0) & F.exists(F.transform(F.array(*[F.lit(w) for w in REFERENCE_WORDS]), lambda w: find(b["low"], w)), lambda p: (p >= 0) & (F.abs(p - b["at"]) < NEAR))

        near = F.get(F.transform(F.array(F.struct(low.alias("low"), find(low, v).alias("at"))), by_word), F.lit(0))
    digits = v.rlike(r"^\d+$")
    return near | ((unit == "") & digits & (F.length(v) >= 5)) | raw.rlike("(?i)" + SKIP_PHONE) | (context.rlike("(?i)" + SKIP_PIN) & digits & F.length(v).between(5, 6))


def _contexts(text: str) -> tuple[list[int], list[str]]:
    """Start offsets of the sentences of text, and the sentences; ends of sentences are . ! ? or a line feed before white space."""
    starts, parts, at = [], [], 0
    for m in _SENTENCE.finditer(text):
        starts.append(at)
        parts.append(text[at : m.start()])
        at = m.end()
    return [*starts, at], [*parts, text[at:]]


_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
_COMPILED = [(c, re.compile(p, re.I)) for c, p in PATTERNS]
_REFS, _PHONE_LINE = re.compile(SKIP_REFS[0][0]), re.compile(PHONE_LINE)


def context_at(text: str, start: int, end: int, index: tuple[list[int], list[str]]) -> str:
    """The sentence that holds an offset, or 100 characters around it."""
    starts, parts = index
    k = bisect_right(starts, start) - 1
    if 0 <= k and start < starts[k] + len(parts[k]):
        return parts[k].strip()
    return text[max(0, start - 100) : end + 100].strip()


#: Categories whose matches begin with a number, by the first letters that their units can have.
NUMBER_FIRST = {
    "Dimensions": 'mcif"', "Torque": "nklo", "Speed/RPM": "r", "Power": "kmhbw", "Pressure": "bpkma", "Temperature": "°dk", "Voltage": "kmv", "Current": "mka", "Weight/Mass": "kglt", "Surface Finish": "rµμm",
}
#: What stands before the number in matches of the other categories (in lower case); standards may also be ASTM with a letter.
_BEFORE = {
    "Standards": ("is", "iso", "ip", "nema", "iec", "din", "bs", "en"), "IP Rating": ("ip",), "Efficiency Class": ("ie", "eff"), "Coupling Style": ("rms", "rzs", "rm", "rz", "mp", "ms"),
}
_NUMBERS, _DIGIT, _LETTER_NUMBER, _FIVE = re.compile(r"\d[\d.\s/]*"), re.compile(r"\d"), re.compile(r"[^\W\d_]\s*\d"), re.compile(r"\d{5}")
#: Letters that match others regardless of case, beyond what lower case tells.
_ODD = re.compile("[İıſ\u212a]")
_BY_LETTER: dict[str, list[int]] = {}
for _n, (_c, _) in enumerate(PATTERNS):
    for _letter in NUMBER_FIRST.get(_c, ""):
        _BY_LETTER.setdefault(_letter, []).append(_n)


def _found(text: str) -> dict[int, list[re.Match]]:
    """For each pattern its matches in text, as a scan for each of them would find them.

    Numbers are looked for once; only the patterns whose unit can begin with what follows the number are tried, from each of its
    digits on. The other patterns scan texts that hold what they need.
    """
    out: dict[int, list[re.Match]] = {}
    if not _DIGIT.search(text):
        return out
    low = text.lower()
    for m in _NUMBERS.finditer(text):
        for n in _BY_LETTER.get(text[m.end() : m.end() + 1].lower(), ()):
            pattern, at, to = _COMPILED[n][1], m.start(), m.end()
            while at < to:
                hit = None
                if text[at].isdecimal():
                    signed = PATTERNS[n][0] == "Temperature" and at and text[at - 1] == "-" and at - 1 >= (out[n][-1].end() if n in out else 0)
                    hit = pattern.match(text, at - 1 if signed else at)
                if hit:
                    out.setdefault(n, []).append(hit)
                    at = hit.end()
                else:
                    at += 1
    odd = _ODD.search(text) is not None
    tails = [low[max(0, m.start() - 3) : m.start() + 1] for m in _LETTER_NUMBER.finditer(low)]
    for n, (category, pattern) in enumerate(_COMPILED):
        if category in NUMBER_FIRST:
            continue
        if category in _BEFORE:
            may = any(t.endswith(_BEFORE[category]) for t in tails) or (category == "Standards" and "astm" in low)
        elif category == "Hub Bore":
            may = "hub" in low or "bore" in low or "coupling" in low
        elif category == "Tolerance":
            may = "±" in low or "+" in low
        else:
            may = bool(tails)
        if (may or odd) and (hits := _letter_first(text, pattern) if category == "Fit/Interference" else list(pattern.finditer(text))):
            out[n] = hits
    return out


_LETTER_DIGIT = re.compile(r"[^\W\d_](?=\d)")


def _letter_first(text: str, pattern: re.Pattern) -> list[re.Match]:
    """finditer for a pattern whose matches begin with one or two letters before a digit."""
    out: list[re.Match] = []
    end = 0
    for m in _LETTER_DIGIT.finditer(text):
        for at in (m.start() - 1, m.start()):
            if at >= end and (hit := pattern.match(text, at)):
                out.append(hit)
                end = hit.end()
                break
    return out


def matches_of(body: str, materials: list[str] = MATERIALS) -> list[tuple]:
    """(match_ord, category, raw_match, value, unit, context) of one text: distinct matches in order of patterns and offsets, then materials."""
    low, whole = body.lower(), None
    if "ref:" in low or "sf-" in low or _FIVE.search(body) or _ODD.search(body):  # without these there is no reference
        filtered = _REFS.sub("", body)
    else:
        filtered = body
    filtered = "\n".join(l for l in filtered.split("\n") if not ((t := l.strip()) and (t[0] in "+()-" or t[0].isdecimal()) and _PHONE_LINE.match(t)))
    found, index, out = _found(filtered), None, []
    for n in sorted(found):
        category, seen = _COMPILED[n][0], set()
        for m in found[n]:
            raw = m[0].strip()
            if raw.lower() in seen:
                continue
            seen.add(raw.lower())
            value = raw if category == "Thread/Bolt" else m[1]
            unit = "" if category in UNITLESS else m[2] or ""
            index = index or _contexts(filtered)
            out.append((len(out), category, raw, value, unit, context_at(filtered, m.start(), m.end(), index)))
    for k, name in _by_key(tuple(materials)):
        at = low.find(k)
        if at >= 0:
            whole = whole or _contexts(body)
            out.append((len(out), "Material", name, name, "", context_at(body, at, at + len(k), whole)))
    return out


@lru_cache(maxsize=8)
def _by_key(materials: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """(name in lower case, name) of each material once, in the list's order."""
    first = {m.lower(): m for m in reversed(materials)}
    return tuple((k, first[k]) for k in dict.fromkeys(m.lower() for m in materials))


def extract_matches(mails: DataFrame, text: str = "body", materials: list[str] = MATERIALS) -> DataFrame:
    """(mail_id, match_ord, category, raw_match, value, unit, context): distinct matches per mail in order of patterns and
    offsets, then materials, each with its sentence. One pass in Python, as the JVM's functions don't give match offsets;
    subjects and the test for false positives are columns.
    """

    def make() -> object:
        return lambda mail, body: [(mail, *r) for r in matches_of(body, materials)]

    kind = mails.schema["mail_id"].dataType.simpleString()
    return flat_map(mails.where(f"length({text}) > 0").select("mail_id", text), make, f"mail_id {kind}, match_ord int, category string, raw_match string, value string, unit string, context string")


def extract_specs(mails: DataFrame, text: str = "body", materials: list[str] = MATERIALS, whole_words: bool = False) -> DataFrame:
    """extract_matches with subject, without false positives; materials are never false."""
    x = extract_matches(mails, text, materials).withColumn("subject", subject_of(F.col("context"), F.col("value")))
    wrong = (F.col("category") != "Material") & false_positive(F.col("category"), F.col("raw_match"), F.col("value"), F.col("unit"), F.col("context"), whole_words)
    return x.where(~wrong)


def material_mentions(mails: DataFrame, text: str = "body", materials: list[str] = MATERIALS) -> DataFrame:
    """(mail_id, material, position): materials named in a mail, with the offset of the first mention; in the JVM."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.struct(F.lit(m).alias("material"), find(low, F.lit(m.lower())).alias("position")) for m in materials]), lambda s: s["position"] >= 0)
    return mails.where(F.col(text).isNotNull()).select("mail_id", F.explode(hits).alias("h")).select("mail_id", "h.material", "h.position")


# Token in lower case -> category and unit; the connecting words that may stand between number and unit.
UNIT_TOKENS = {
    t.lower(): (c, t)
    for c, line in {
        "Dimensions": "mm cm m inch inches in ft feet", "Torque": "Nm kNm", "Speed/RPM": "RPM rev/min", "Power": "kW MW HP bhp W", "Pressure": "bar psi Pa kPa MPa atm", "Temperature": "°C °F degC degF",
        "Voltage": "kV mV V VAC VDC", "Current": "A mA kA Amps", "Weight/Mass": "kg g lbs lb tonnes tons", "Tolerance": "µm micron", "Surface Finish": "Ra Rz",
    }.items()
    for t in line.split()
}
CONNECTORS = ["of", "is", "are", "at", "to", "be", "approximately", "approx", "about", "around", "roughly"]


#: Tokens: numbers, words with signs (units too), sentence marks, and what may stand between the ends of a range.
TOKEN = r"-?\d+(?:\.\d+)?|[°µ]?[A-Za-z]+(?:/[a-z]+)?|[.!?;–/]"
#: Before that, a dash between digits is made the sign of a range, and a degree sign is joined with its letter.
TOKEN_STEPS = [(r"(\d) *[-–] *(\d)", "\\1 – \\2"), (r"° +([CFcf])\b", "°\\1")]
RANGE_SIGNS = ["–", "to", "/"]


def token_window_matches(mails: DataFrame, text: str = "body", window: int = 5) -> DataFrame:
    """(mail_id, token_ord, category, raw_match, value, unit): numbers with a unit among the next `window` tokens, past connecting words only.

    Works without a language model. A search ends at a sentence mark or, beyond the second token, at any other word. A number
    that a range sign and another number follow gives the range (the other number gives itself). Repetitions of a category
    and raw match (regardless of case) within a mail count once, the first stays. The array functions see one mail at a time.
    """
    c = F.col(text)
    for pattern, to in TOKEN_STEPS:
        c = F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", to))
    table = F.create_map(*[F.lit(x) for t, (g, u) in UNIT_TOKENS.items() for x in (t, f"{g}|{u}")])
    unit_at = lambda t: F.try_element_at(table, F.lower(t))

    def rows(k: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            ahead = F.slice(k, i + 2, window)
            kinds = F.transform(ahead, lambda t, j: F.struct(j.alias("j"), unit_at(t).alias("u"), (t.isin(".", "!", "?", ";") | ((j >= 2) & ~t.isin(*RANGE_SIGNS) & ~F.lower(t).isin(CONNECTORS) & unit_at(t).isNull())).alias("stop")))
            hit = F.array_min(F.filter(kinds, lambda s: s["u"].isNotNull()))
            stop = F.array_min(F.transform(F.filter(kinds, lambda s: s["stop"]), lambda s: s["j"]))
            span = F.lower(F.get(k, i + 1)).isin(*RANGE_SIGNS) & F.get(k, i + 2).rlike(r"^\d")
            return F.when(value.rlike(r"^-?\d"), F.struct(i.alias("token_ord"), F.when(span, F.concat(value, F.lit("-"), F.get(k, i + 2))).otherwise(value).alias("value"), F.when(span, F.concat(value, F.get(k, i + 1), F.get(k, i + 2))).otherwise(value).alias("shown"), hit.alias("hit"), stop.alias("stop")))

        return F.filter(F.transform(k, one), lambda s: s["hit"].isNotNull() & (s["stop"].isNull() | (s["stop"] > s["hit"]["j"])))

    found = F.get(F.transform(F.array(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))), rows), F.lit(0))
    x = mails.where(F.col(text).isNotNull()).select("mail_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL").select("mail_id", "x.*")
    x = x.select("mail_id", "token_ord", F.split_part("hit.u", F.lit("|"), F.lit(1)).alias("category"), F.concat_ws(" ", "shown", F.split_part("hit.u", F.lit("|"), F.lit(2))).alias("raw_match"), "value", F.split_part("hit.u", F.lit("|"), F.lit(2)).alias("unit"))
    first = x.groupBy("mail_id", "category", F.lower("raw_match").alias("_k")).agg(F.min(F.struct("token_ord", "raw_match", "value", "unit")).alias("f"))
    return first.select("mail_id", "f.token_ord", "category", "f.raw_match", "f.value", "f.unit")


def highlighted(context: Column, raw: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The context with each occurrence of the raw match marked; without raw match, unchanged."""
    return F.when(F.length(raw) > 0, F.replace(context, raw, F.concat(F.lit(before), raw, F.lit(after)))).otherwise(context)


def model_matches(mails: DataFrame, text: str = "body", model: str = "en_core_web_sm") -> DataFrame:
    """token_window_matches with `subject`: the noun that a number depends on by a language model where spaCy and the model are
    installed on the executors (loaded once per worker), else "" so that the nearest subject word of the context is taken."""

    def make() -> object:
        nlp = load_model(model)

        def one(mail: object, body: str, numbers: list[str]) -> list[tuple]:
            if nlp is None:
                return [(mail, v, "") for v in dict.fromkeys(numbers)]
            heads: dict[str, str] = {}
            for chunk in range(0, len(body), nlp.max_length):
                for tok in nlp(body[chunk : chunk + nlp.max_length]):
                    if tok.text in numbers and tok.text not in heads:
                        nouns = [tok.head, *[c for c in tok.head.children if c.i != tok.i], *[tok.doc[j] for j in range(tok.i - 1, max(0, tok.i - 6), -1)]]
                        heads[tok.text] = next((n.text.capitalize() for n in nouns if n.pos_ in ("NOUN", "PROPN")), "")
            return [(mail, v, heads.get(v, "")) for v in dict.fromkeys(numbers)]

        return one

    found = token_window_matches(mails, text)
    kind = mails.schema["mail_id"].dataType.simpleString()
    asked = found.groupBy("mail_id").agg(F.collect_list("value").alias("numbers")).join(mails.select("mail_id", text), "mail_id").select("mail_id", text, "numbers")  # one mail's numbers
    subjects = flat_map(asked, make, f"mail_id {kind}, value string, subject string")
    return found.join(subjects, ["mail_id", "value"], "left").select(*found.columns, F.coalesce("subject", F.lit("")).alias("subject"))


@lru_cache(maxsize=1)
def load_model(name: str) -> object | None:
    """The language model, or None where the library or the model isn't installed."""
    try:
        import spacy

        return spacy.load(name)
    except (ImportError, OSError):
        return None


def hybrid(regex: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("mail_id", "category", "value", "unit"), extra: list[str] | None = None) -> DataFrame:
    """regex and those rows of other whose key (regardless of case) regex doesn't have; other's own repetitions count once.

    The columns are those that both have, and `extra` of other, NULL for regex."""
    k = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_k{i}") for i, c in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    more = extra or []
    cols = [c for c in regex.columns if c in other.columns and c not in more]
    w = Window.partitionBy(*names).orderBy(*[F.col(c) for c in cols])
    rest = other.select(*cols, *more, *k).withColumn("_n", F.row_number().over(w)).where("_n = 1").join(regex.select(*k).distinct(), names, "left_anti").select(*cols, *more)
    return regex.select(*cols, F.lit("regex").alias("origin")).unionByName(rest.withColumn("origin", F.lit("tokens")), allowMissingColumns=True)
