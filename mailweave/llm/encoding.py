"""Text decoded with a wrong character set (problem 2).

Characters are mapped back to the bytes of a legacy character set, a byte-structure automaton finds the maximal
well-formed multibyte UTF-8 spans among those bytes, and only these spans are decoded; what lies between them is
left alone. Text that went wrong repeatedly is treated repeatedly. Two further kinds of damage have no multibyte
structure and get tests of their own: single-byte text read in another single-byte set (foreign letters or symbols
inside a Latin word) and replacement characters, which are reported but can't be undone.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map

# Legacy character sets whose bytes are tried, in this order.
LEGACY = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp866", "cp1253", "cp1254", "iso8859_15"]
# Pairs (set in which the text was wrongly read, set in which it had been written).
SINGLE = [("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("cp1253", "cp1252"), ("cp1252", "cp1251"), ("latin-1", "cp1252")]
_TOKEN = re.compile(r"(?<![^ \t\r\n\v\f])[^ \t\r\n\v\f]*[^\x00-\x7f][^ \t\r\n\v\f]*")  # tried at the starts of tokens only, so linear
_RUN = re.compile(r"[^\x00-\x7f]+")
_LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
_FOREIGN = re.compile(
    rf"[A-Za-z][Ͱ-ϿЀ-ӿ](?![Ͱ-ϿЀ-ӿ]*$(?<=μ|Ω))|[Ѐ-ӿ][A-Za-z]"  # letters of two scripts side by side
    rf"|[{_LATIN}][─-◿⌠⌡∙√≈≤≥∫∂∆∏∑π∞ⁿ◊ﬁﬂˆ-˝‡†‰¢¤-¦¨-¬®¯´¶¸º-¿×÷ƒ€™‚„‹›\u0080-\u009f][{_LATIN}]"
    rf"|[{_LATIN}][²³¹¡£§©±¿][a-zß-öø-ÿ]"
    rf"|[Α-ΜΞ-ΩΘα-λν-ω][A-Za-z]|[A-Za-z][ˆ-˝ﬁﬂ]{{1,3}}[a-z]|∞[CF]\\b"
    rf"|[a-zß-öø-ÿ][À-ÖØ-Þ]"  # a capital with accent after a small letter
    r"|[─-╿▀-▟]{1,2}[A-Za-z]|[A-Za-z][═-╬▀-▟]"
    r"|[À-ÖØ-öø-ÿ]{4}|[\u0080-\u009f]"  # a word of accents only; control characters
)


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte set; bytes it leaves undefined stand for themselves, as readers do."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@lru_cache(maxsize=10_000)
def _script(c: str) -> str | None:
    """The script of an assigned letter or mark, by the first word of its name; None for other characters."""
    return unicodedata.name(c, "").split(" ")[0] or None if unicodedata.category(c)[0] in "LM" else None


def _plausible(text: str) -> bool:
    """Characters that are likely in mail, or two or more letters of one script: a single rare letter is more likely a chance
    match of accents and signs than damage."""
    scripts: dict[str, int] = {}
    for c in text:
        o = ord(c)
        if not (0x1E00 <= o <= 0x1EFF or o in (0x1A0, 0x1A1, 0x1AF, 0x1B0) or 0xA0 <= o <= 0x17F or 0x218 <= o <= 0x21B or 0x386 <= o <= 0x3CE or 0x401 <= o <= 0x45F or 0x2010 <= o <= 0x2044 or 0x2070 <= o <= 0x209C or 0x20A0 <= o <= 0x22FF or 0x2500 <= o <= 0x25FF or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xFB00 <= o <= 0xFB04 or 0xFF00 <= o <= 0xFFEF or o == 0xFFFD or 0x2C6 <= o <= 0x2DD or o >= 0x1F000 or 0x80 <= o <= 0x9F):
            script = _script(c)
            if script is None:
                return False
            scripts[script] = scripts.get(script, 0) + 1
    return not scripts or (len(scripts) == 1 and min(scripts.values()) > 1)


def spans(data: list[int]) -> list[tuple[int, int]]:
    """Maximal well-formed multibyte spans [start, end) of bytes, by the UTF-8 automaton (no overlong forms, no surrogates). -1 stands for no byte."""
    out, i, n = [], 0, len(data)
    while i < n:
        start = i
        while i < n:
            b = data[i]
            if 0xC2 <= b <= 0xDF:
                need, low, high = 1, 0x80, 0xBF
            elif 0xE0 <= b <= 0xEF:
                need, low, high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                need, low, high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                break
            if i + need >= n or not low <= data[i + 1] <= high or not all(0x80 <= x <= 0xBF for x in data[i + 2 : i + need + 1]):
                break
            i += need + 1
        if i > start:
            out.append((start, i))
        else:
            i += 1
    return out


@lru_cache(maxsize=200_000)
def _run(run: str) -> str | None:
    """The repaired run of non-ASCII characters, or None if nothing in it is wrong."""
    best, gain = None, 0
    for codec in LEGACY:
        table = _bytes_of(codec)
        data = [table.get(c, -1) for c in run]
        pieces, at, won = [], 0, 0
        for a, b in spans(data):
            text = bytes(data[a:b]).decode("utf-8")
            if not _plausible(text):
                continue
            if len(text) == 1 and codec not in ("cp1252", "latin-1") and (0x400 <= ord(text) <= 0x45F or 0x386 <= ord(text) <= 0x3CE):
                continue  # one letter of another script is a chance match of quotation marks and accents
            pieces.append(run[at:a] + text)
            at, won = b, won + b - a
        if won > gain:
            best, gain = "".join(pieces) + run[at:], won
    return best


def _mixed(token: str) -> bool:
    return _FOREIGN.search(token) is not None


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[bool, str]:
    """(damaged, repaired) of one token without white space."""
    bad, text = "�" in token, token
    while (fixed := _RUN.sub(lambda m: _run(m[0]) or m[0], text)) != text:  # each round leaves fewer characters
        bad, text = True, fixed
    if not bad and _mixed(text):
        bad = True
        for wrong, right in SINGLE:
            try:
                other = text.encode(wrong).decode(right)
            except UnicodeError:
                continue
            if not _mixed(other) and all(c.isalpha() or ord(c) < 128 or c in "–—‘’“”…° " for c in other):
                text = other
                break
    return bad, text


def repair(text: str | None) -> tuple[bool, str | None]:
    """(damaged, text with what could be restored). Text of ASCII only is never looked at twice."""
    if not text or text.isascii():
        return False, text
    bad = False

    def fix(m: re.Match) -> str:
        nonlocal bad
        wrong, out = _token(m[0])
        bad |= wrong
        return out

    out = _TOKEN.sub(fix, text)
    return bad, out


def repaired_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, repaired): one row per damaged field, with the restored text as far as possible.

    NULL and empty texts are not damaged. Only rows with a non-ASCII character leave the JVM; repeated tokens are
    judged once per worker. Rows are independent: no shuffle, no state between rows.
    """

    def make() -> object:
        def one(k: object, *texts: str | None) -> list[tuple]:
            out = []
            for name, text in zip(fields, texts):
                bad, fixed = repair(text)
                if bad:
                    out.append((k, name, fixed))
            return out

        return one

    some = F.lit(False)
    for f in fields:
        some = some | F.coalesce(F.length(f) < F.octet_length(f), F.lit(False))
    kind = df.schema[key].dataType.simpleString()
    return flat_map(df.where(some).select(key, *fields), make, f"{key} {kind}, field string, repaired string")
