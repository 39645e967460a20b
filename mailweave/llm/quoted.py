"""Newly written text of mails (problem 7): quoted history, signatures and notices are removed.

All lines of all bodies are normalised (quote marks, tags, case and white space off) and judged by three kinds of evidence:

1. first authorship: the messages of a thread are ranked by date; a line belongs to the first message that has it, and
   is quoted in later ones, alone where it is marked; where it isn't, in a run of lines of one source that stands before
   it in the thread too, as dates may be wrong;
2. recurrence: short closing lines that one sender repeats under several messages are signature;
3. structure of one body (`line_kinds`): quote prefixes, introductions, header blocks, signature dividers, closing
   phrases, bare names, notices. It decides what the first two leave open: lines that nobody in the table wrote before.

Copies of one message count as one author, so a repeated delivery isn't taken for a quotation.
"""

from __future__ import annotations

import html
import re
import struct
from difflib import SequenceMatcher

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map
from mailweave.operators.delivery_dedup import normal_id
from mailweave.operators.timestamps import normalise_timestamps
from mailweave.session import cut_lineage

NEW, QUOTED, SIGNATURE, NOTICE = 0, 1, 2, 3

# How companies' and systems' notices begin; digits and non-ASCII letters don't count.
NOTICE_STARTS = [
    "This e-mail and any files", "This email and any", "This message and any", "The information in this", "NOTICE: the content may be", "NOTICE:", "DISCLAIMER", "CONFIDENTIALITY",
    "Opinions in this mail are", "Diese Nachricht ist vertraulich", "Diese E-Mail", "Ce message est confidentiel", "Este mensaje es confidencial", "Registered office:",
    "You receive this because", "Unsubscribe at", "To unsubscribe", "Think of the trees", "Please consider the environment", "Scanned by", "Virus checked", "[EXTERNAL]", "[EXT]", "CAUTION:",
    "*** Gateway notice", "*** ", "WARNING: external",
    "Sent from my", "Sent from a mobile", "Von unterwegs gesendet", "Von meinem", "Get the FastMail app", "Get Outlook", "Gesendet von", "Envoy de mon",
]
# Closing phrases that stand alone on a line.
CLOSINGS = {
    "best regards", "kind regards", "regards", "thanks & regards", "thanks and regards", "warm regards", "with best wishes", "best wishes", "many thanks", "thanks", "thx", "cheers",
    "br", "rgds", "yours sincerely", "yours faithfully", "sincerely", "best", "mit freundlichen gren", "freundliche gre", "viele gre", "mfg", "cordialement", "bien cordialement",
    "salutations", "saludos cordiales", "saludos", "atentamente", "cordiali saluti", "the team", "your team",
}

_TAG = re.compile(r"<(?!/?blockquote)[^<>@]*>", re.I)
_ASCII = re.compile(r"[^\x20-\x7e]+")
_NOTICE = re.compile("|".join(re.escape(x) for x in NOTICE_STARTS))
_NOTICE_KEYS = {x[:3] for x in NOTICE_STARTS}
_LOW = frozenset("abcdefghijklmnopqrstuvwxyz& ")
_PROSE_END = re.compile(r"[a-z)]{4}\.$")
_NAME_START = re.compile(r"(?:[-–—] ?)?['\"“]?[^\W_]")
_GREETING = re.compile(r"(?:Dear|Hi|Hello|Hallo|Guten|Good|Bonjour|Hola|Sehr|Lieber?|Buenos)\b")
_LONE = re.compile(r"[-–—] ?[A-Z][\w'’.-]*(?: [A-Z][\w'’.-]*)?$|[A-Z][\w'’-]{1,24}$")
_PREFIX = re.compile(r"\s*(?:>|[A-Z]{1,3}> ?|: (?=\S)|:$|(?:&gt;))")
_PIPE = re.compile(r"\|(?: |$)(?!.*\|\s*$)")
_INTRO = re.compile(r"(?:\bwrote|\bschrieb\b.*|\bcrit|\bescribi|\bwrites|\bsaid on\b.*\d|\bhat am\b.*geschrieben|\bscrisse|\bha scritto|\bschreef\b.*|\bskrev\b.*)\s*:\s*$")
_INTRO_HEAD = re.compile(r"(?:On|Am|Le|El|Il|Op)\b.*\d|.*\bsaid(?: on\b.*)?$|.*@[\w.-]+\)")
_INTRO_TAIL = re.compile(r"(?:said on\b.*\d|on \d.*\d|\(?[\w.+-]+@[\w.-]+\)? writes|writes|a crit|escribi|wrote)\s*:$")
_FORWARD = re.compile(r"-{2,}\s*(?:Original Message|Forwarded message|Message d'origine|Message transfr|Mensaje original|Mensaje reenviado|Ursprngliche Nachricht|Weitergeleitete Nachricht|Messaggio originale)\s*-{2,}$|Begin forwarded message:$|FWD >>>$|Fwd:$", re.I)
_HEADER = re.compile(r"(?:From|Von|De|Date|Gesendet|Sent|Envoy|Enviado|To|An|Para|Cc|CC|Kopie|Subject|Betreff|Objet|Asunto|Datum|Fecha)\s*:\s")
_FROM = re.compile(r"(?:From|Von|De)\s*:\s*\S")
_RULER = re.compile(r"[_=\-*]{8,}$")
_BYLINE = re.compile(r".{2,60},\s*\d{1,2}\.? ?[A-Za-z0-9.]{2,9}\.? ?\d{4}$")
_DIVIDER = re.compile(r"(?:--|__|\*\*\*|---|-- |—|–)\s*$")
_CONTACT = re.compile(r"(?:T|M|Mob\.?|Tel\.?:?|Tel:|Phone:?|Fax:?|Mobile:?)\s*:?\s*\+?\d[\d ()/-]{5,}$|www\.\S+$|[\w.+-]+@[\w.-]+$")
_WORDS = re.compile(r"[^\W\d_]+", re.U)


def _plain(line: str) -> str:
    if "<" in line:
        line = _TAG.sub("", line)
    if "&" in line:
        line = html.unescape(html.unescape(line))
    return line.strip()


def _bare(text: str) -> str:
    """Text without anything but printable ASCII: wrong encodings don't hide a known phrase."""
    return text if text.isascii() else _ASCII.sub("", text)


def _names(sender: str | None, address: str | None) -> list[str]:
    words = _WORDS.findall((sender or "").lower())
    local = (address or "").split("@")[0].lower()
    return [w for w in words + _WORDS.findall(local) if len(w) > 2]


def _close(word: str, name: str) -> bool:
    """Equal, same beginning, or one typing error away (counted by differing letters, not by alignment)."""
    if word == name or (len(word) > 3 and name.startswith(word[:4])):
        return True
    return abs(len(word) - len(name)) <= 2 and len(word) > 3 and SequenceMatcher(None, word, name).quick_ratio() >= 0.75 and SequenceMatcher(None, word, name).ratio() >= 0.75


def _is_name(text: str, names: list[str]) -> bool:
    """A short line that names the sender: each of its longer words is close to a word of the sender's name."""
    text = re.sub(r"^[-–—*_'\"\s]+|['\"*_\s]+$", "", text)
    words = _WORDS.findall(text)
    if not words or len(text) > 70 or len(words) > 7 or re.search(r"[!?:;\\={}#|]|[a-z]{4}\.$", text):
        return False
    known = 0
    for w in words:
        if len(w) > 2 and any(_close(w.lower(), n) for n in names):
            known += 1
    return known > 0 and known * 2 >= len([w for w in words if len(w) > 2 and w[0].isupper()] or words)


def line_kinds(body: str, sender: str | None = None, address: str | None = None) -> list[int]:
    """NEW, QUOTED, SIGNATURE or NOTICE for each line of body (split at line feeds); blank lines are NEW.

    Linear in the body: the lines between two decisions are looked at once, and costly patterns run only on
    lines whose first or last character or length allows a match.
    """
    raw = body.replace("\r", "").split("\n")
    n = len(raw)
    lines = [_plain(x) if "<" in x or "&" in x else x.strip() for x in raw]
    kinds = [NEW] * n
    names: list[str] | None = None
    i, table = 0, False

    def next_text(k: int) -> int:
        while k < n and not lines[k]:
            k += 1
        return k

    def signature_like(k: int) -> bool:
        """A contact line follows within the block of short lines that starts at k."""
        for x in range(k, min(k + 5, n)):
            if not lines[x] or len(lines[x]) > 80:
                return False
            if _CONTACT.match(lines[x]):
                return True
        return False

    def quoted_at(k: int) -> bool:
        return bool(_PREFIX.match(raw[k]) or _PIPE.match(lines[k]) or "<blockquote" in raw[k].lower())

    def block(i: int, kind: int) -> int:
        while i < n and lines[i]:
            kinds[i] = kind
            i += 1
        return i

    while i < n:
        t = lines[i]
        if not t and not raw[i].strip():
            i += 1
            continue
        r, first = raw[i], t[:1]
        if "lockquote" in r.lower() and ("<blockquote" in r.lower() or "&lt;blockquote" in r.lower()):
            while i < n:
                if raw[i].strip():
                    kinds[i] = QUOTED
                if "/blockquote" in raw[i].lower():
                    break
                i += 1
            i += 1
            continue
        if not t:
            i += 1
            continue
        if first == "{" and t.startswith("{|"):
            table = True
        elif first == "|" and t.startswith("|}"):
            table = False
        if (r.lstrip()[:1] in ">:&" or t[1:4].find(">") >= 0 or ">" in t[:4]) and _PREFIX.match(r) or (first == "|" and not table and _PIPE.match(t) and not t.startswith(("|-", "|}"))):
            # a lone mark at the start of a line within a paragraph is a wrapped comparison or column, not a quote
            if not (i and lines[i - 1] and kinds[i - 1] == NEW and not (i + 1 < n and lines[i + 1] and quoted_at(i + 1)) and not re.search(r"[.!?:>]$", lines[i - 1])):
                kinds[i] = QUOTED
                i += 1
                continue
        b = t if t.isascii() else _bare(t)
        start = b[:1]
        if (start in "-BF" and _FORWARD.match(b)) or (start in "_=-*" and len(b) >= 8 and _RULER.match(b) and (k := next_text(i + 1)) < n and (_FROM.match(_bare(lines[k])) or _BYLINE.match(_bare(lines[k])))):
            _mark(kinds, raw, i, n, QUOTED)
            break
        if start in "FVD" and _FROM.match(b) and i + 1 < n and _HEADER.match(_bare(lines[i + 1])) and not _PROSE_END.search(lines[i + 1]):
            _mark(kinds, raw, i, n, QUOTED)
            break
        if b[:3] in _NOTICE_KEYS and _NOTICE.match(b):
            i = block(i, NOTICE)
            continue
        end = -1
        if len(b) < 160:
            if b[-1:] == ":" and _INTRO.search(b):
                end = i
            elif i + 1 < n and lines[i + 1].endswith(":") and _INTRO_TAIL.match(_bare(lines[i + 1])):
                end = i + 1
            elif i + 1 < n and lines[i + 1].endswith(":") and _INTRO_HEAD.match(b) and _INTRO.search(b + " " + _bare(lines[i + 1])) and len(b) + len(lines[i + 1]) < 160:
                end = i + 1
        if end >= 0:
            k = next_text(end + 1)
            for x in range(i, end + 1):
                kinds[x] = QUOTED
            if k < n and raw[k].startswith(("    ", "\t")):
                while k < n and (not lines[k] or raw[k].startswith(("    ", "\t"))):
                    kinds[k] = QUOTED if lines[k] else NEW
                    k += 1
                i = k
            elif k < n and not quoted_at(k):
                _mark(kinds, raw, i, n, QUOTED)
                break
            else:
                i = end + 1
            continue
        if len(t) < 75:
            low = "".join(c for c in b.lower() if c in _LOW).strip() if len(b) < 30 else ""
            opens = i == 0 or not lines[i - 1]
            signed = False
            if low in CLOSINGS:
                signed = opens or (k := next_text(i + 1)) == i + 1 or k >= n
            elif first in "-_*—–" and _DIVIDER.match(t):
                k = i + 1
                if k < n and lines[k] and len(lines[k]) < 70:
                    names = _names(sender, address) if names is None else names
                    signed = _is_name(lines[k], names) or signature_like(k) or not re.search(r"[.!?:]$", lines[k])
            elif opens and i > 0 and _NAME_START.match(t) and "<h" not in r.lower() and not _GREETING.match(t):
                names = _names(sender, address) if names is None else names
                final = (k := next_text(i + 1)) >= n or (k > i + 1 and (quoted_at(k) or _NOTICE.match(_bare(lines[k])) or _RULER.match(lines[k]) or _FORWARD.match(_bare(lines[k]))))
                signed = (not t.endswith((",", ":")) and _is_name(t, names)) or (not re.search(r"[.!?:;,]$", t) and final and _LONE.match(t) is not None) or (len(t.split()) <= 6 and not re.search(r"[a-z][!?:;]$", t) and signature_like(i + 1))
            if signed:
                i = block(i, SIGNATURE)
                continue
        i += 1
    return kinds


def _mark(kinds: list[int], raw: list[str], i: int, n: int, kind: int) -> None:
    for x in range(i, n):
        if raw[x].strip():
            kinds[x] = kind


#: Lines that nothing marks are quoted if so many of them in a row, with so many characters, come from one earlier message of somebody else.
RUN_LINES, RUN_CHARS = 2, 120
#: A closing line is a sender's signature if the sender wrote it at least so many times.
RECURS = 3
_CLOSING_LINE = re.compile(r"[A-Z+][^=(){}|<>\\\\#*;:]{1,58}[^=(){}|<>\\\\#*;:.!?,]$")
_MARKS = re.compile(r"(?:\s|[>|]|[A-Z]{1,3}>|: (?=\S))+")
_AUTHOR_BITS, _SIZE_BITS, _POS_BITS = 24, 20, 20


def normalised_line(raw: str) -> str:
    """A line without quote marks and tags, in lower case, white space collapsed."""
    text = _plain(raw) if "<" in raw or "&" in raw else raw
    m = _MARKS.match(text)
    return " ".join(text[m.end() if m else 0 :].lower().split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def message_key(ident: str, author: str) -> int:
    """Author and message in one number: messages of one author agree in the upper bits."""
    return ((xxhash.xxh64_intdigest(author) >> (64 - _AUTHOR_BITS)) << (64 - _AUTHOR_BITS) | xxhash.xxh64_intdigest(ident) >> _AUTHOR_BITS) - 2**63


def _fingerprints() -> object:
    """Per message: every non-blank line as (hash with its thread, number with place, size and kind packed), and its closing lines."""

    def one(delivery: int, sender: str | None, address: str | None, body: str, thread: str | None, ident: str, author: str, instant: int | None, place: int | None) -> list[tuple]:
        kinds = line_kinds(body, sender, address)
        raw = body.split("\n")
        hashes, packed, end_no, end_hash = [], [], [], []
        scope = f"{thread}\0" if thread is not None else None
        pos = last = 0
        for j, k in enumerate(kinds):
            if not (text := raw[j].strip()):
                continue
            pos += 1
            bare = normalised_line(raw[j])
            hashes.append(_hash(scope + bare) if scope is not None and bare else None)
            packed.append((((j + 1) << _POS_BITS | min(pos, 2**_POS_BITS - 1)) << _SIZE_BITS | min(len(bare), 2**_SIZE_BITS - 1)) << 2 | k)
            if k == NEW:
                last = j
            elif k == SIGNATURE and author and len(text) <= 60:
                end_no.append(-(j + 1))
                end_hash.append(_hash(f"{author}\0{_DIGIT.sub('9', text)}"))
        j, new_no, new_hash = last, [], []
        while author and j > 0 and kinds[j] == NEW and (text := raw[j].strip()):
            if len(text) > 60:
                new_no, new_hash = [], []
                break
            if _CLOSING_LINE.match(text) and not _GREETING.match(text):
                new_no.append(j + 1)
                new_hash.append(_hash(f"{author}\0{_DIGIT.sub('9', text)}"))
            j -= 1
        key = message_key(ident, author)
        place = min(max(place, 0), 2**31 - 1) if place is not None else 2**31 - 1
        when = min(max(instant, 0), 2**32 - 2) if instant is not None else 2**32 - 1
        rank = struct.pack(">IIq", when, place, key)
        return [(delivery, key, rank, place, hashes, packed, end_no + new_no, end_hash + new_hash)] if packed else []

    return one


_DIGIT = re.compile(r"\d")


def judged_lines(messages: DataFrame, mailboxes: DataFrame | None = None) -> DataFrame:
    """(delivery_id, line_no, evidence): non-blank lines of body that the sender didn't newly write; lines count from 1.

    evidence: first_author, recurrent, or structure where neither tells. With mailboxes the messages of a thread are ranked
    by the instant of date_str, else and where there is none by the stored date, the time of receipt, the place in the
    thread. A NULL or empty body has no lines. A message without identifier is an author of its own; one without thread is
    compared with nothing. Nothing is compared across all pairs: hashes of lines are reduced to their first author by a
    grouped minimum that combines before the shuffle, so a line that a third of all messages hold is one row of it, and the
    join back is on the hash, which AQE splits if skewed. Windows see one message each.
    """
    date = F.coalesce(F.col("date").cast("timestamp_ntz"), F.col("received_at").cast("timestamp_ntz"))
    x = messages.where("length(body) > 0")
    if mailboxes is not None:
        x = normalise_timestamps(x, mailboxes)
        date = F.coalesce("instant_utc", date)
    x = x.select(
        "delivery_id", "sender_name", "sender_address", "body", F.col("thread_id").alias("thread"), F.coalesce(normal_id(F.col("message_id")), F.concat(F.lit("#"), F.col("delivery_id").cast("string"))).alias("ident"),
        F.lower(F.coalesce("sender_address", "sender_name", F.lit(""))).alias("author"), F.unix_seconds(date.cast("timestamp")).alias("instant"), F.col("message_ord").cast("long").alias("place"),
    )
    schema = "delivery_id long, key long, rank binary, place int, hash array<long>, packed array<long>, end_no array<int>, end_hash array<long>"
    prints = cut_lineage(flat_map(x, _fingerprints, schema))  # four readers; the bodies are parsed once
    lines = prints.select("delivery_id", "key", "rank", "place", F.explode(F.arrays_zip("hash", "packed")).alias("x")).select("delivery_id", "key", "rank", "place", F.col("x.hash").alias("hash"), F.col("x.packed").alias("packed"))

    firsts = lines.where("hash IS NOT NULL").groupBy("hash").agg(F.min("rank").alias("rank"))
    number = lambda at, n: F.conv(F.hex(F.substring("rank", at, n)), 16, -10).cast("bigint")
    firsts = firsts.select("hash", number(9, 8).alias("source"), number(5, 4).cast("int").alias("source_place"))
    known = lines.drop("rank").join(firsts, "hash", "left")
    kind, size = F.col("packed").bitwiseAND(F.lit(3)), F.shiftright("packed", 2).bitwiseAND(F.lit(2**_SIZE_BITS - 1))
    pos, line_no = F.shiftright("packed", 2 + _SIZE_BITS).bitwiseAND(F.lit(2**_POS_BITS - 1)), F.shiftright("packed", 2 + _SIZE_BITS + _POS_BITS)
    before = F.coalesce(F.col("source") != F.col("key"), F.lit(False))
    marked = known.where(kind != NEW).select("delivery_id", line_no.alias("line_no"), kind.alias("kind"), before.alias("before"))

    somebody_else = F.shiftright("source", 64 - _AUTHOR_BITS) != F.shiftright("key", 64 - _AUTHOR_BITS)
    later = known.where((kind == NEW) & before & somebody_else & (F.col("source_place") < F.col("place"))).select("delivery_id", line_no.alias("line_no"), pos.alias("pos"), size.alias("size"), "source")
    w = Window.partitionBy("delivery_id").orderBy("pos")
    starts = ~((F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("source").over(w) == F.col("source")))
    runs = later.withColumn("run", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("run", F.sum("run").over(w))
    all_of = Window.partitionBy("delivery_id", "run")
    quoted = runs.withColumns({"lines": F.count("*").over(all_of), "chars": F.sum("size").over(all_of)}).where((F.col("lines") >= RUN_LINES) & (F.col("chars") >= RUN_CHARS))

    ends = prints.where("size(end_no) > 0").select("delivery_id", "key", F.explode(F.arrays_zip("end_no", "end_hash")).alias("x")).select("delivery_id", "key", F.col("x.end_no").alias("end_no"), F.col("x.end_hash").alias("end_hash"))
    again = ends.groupBy("end_hash").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("top")).where((F.col("n") >= RECURS) & (F.col("low") != F.col("top"))).select("end_hash")
    closing = ends.join(again, "end_hash", "left_semi").select("delivery_id", F.abs("end_no").cast("long").alias("line_no"), (F.col("end_no") < 0).alias("marked"))

    signed = marked.where(F.col("kind") == SIGNATURE).join(closing.where("marked").select("delivery_id", "line_no", F.lit(True).alias("again")), ["delivery_id", "line_no"], "left")
    evidence = F.when(F.col("before"), "first_author").otherwise("structure")
    out = marked.where(F.col("kind") != SIGNATURE).select("delivery_id", "line_no", evidence.alias("evidence"))
    out = out.unionByName(signed.select("delivery_id", "line_no", F.when(F.col("again"), "recurrent").otherwise(evidence).alias("evidence")))
    new = quoted.select("delivery_id", "line_no", F.lit("first_author").alias("evidence")).unionByName(closing.where("NOT marked").select("delivery_id", "line_no", F.lit("recurrent").alias("evidence")))
    return out.unionByName(new.groupBy("delivery_id", "line_no").agg(F.min("evidence").alias("evidence")))  # a line may be both


def not_new_lines(messages: DataFrame, mailboxes: DataFrame | None = None) -> DataFrame:
    """(delivery_id, line_no) of judged_lines."""
    return judged_lines(messages, mailboxes).select("delivery_id", "line_no")


def newly_written(messages: DataFrame, mailboxes: DataFrame | None = None) -> DataFrame:
    """(delivery_id, new_text): body without the lines of not_new_lines, blank runs collapsed; NULL body gives NULL."""
    gone = not_new_lines(messages, mailboxes).groupBy("delivery_id").agg(F.collect_list(F.col("line_no").cast("int")).alias("gone"))  # bounded by one body's lines
    x = messages.select("delivery_id", "body").join(gone, "delivery_id", "left")

    def make() -> object:
        def one(delivery: int, body: str | None, gone: list[int] | None) -> list[tuple]:
            if body is None:
                return [(delivery, None)]
            without = set(gone or ())
            text = "\n".join(l for n, l in enumerate(body.replace("\r", "").split("\n"), 1) if n not in without)
            return [(delivery, _BLANK_RUN.sub("\n\n", text).strip())]

        return one

    return flat_map(x, make, f"delivery_id {messages.schema['delivery_id'].dataType.simpleString()}, new_text string")


_BLANK_RUN = re.compile(r"\n\s*\n")
