"""String helpers with the same meaning on every engine: white space is Unicode's, `.` and `$` know line feeds only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script as one character class that Java and RE2 both read.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

Steps = list[tuple[str, str]]


def replace_all(c: Column, steps: Steps) -> Column:
    """Regex replacements in order; patterns use (?i), (?m) and explicit [^\\n], so line ends mean line feeds."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern.replace("(?im)", "(?imd)").replace("(?m)", "(?md)"), to.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def replace_guarded(c: Column, steps: Steps, needs: list[tuple[str, ...]]) -> Column:
    """replace_all for texts of which few have anything to replace: each step runs only on texts that hold one of its literals.

    Literals in lower case are looked for regardless of case; one that begins with ^ is a short pattern.
    """

    def guarded(step: tuple[str, str], some: tuple[str, ...]) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            has = F.lit(False)
            for s in some:
                has = has | (x.rlike(s[1:]) if s.startswith("^") else F.lower(x).contains(s) if s.islower() else x.contains(s))
            return F.when(has, replace_all(x, [step])).otherwise(x)

        return run

    for step, some in zip(steps, needs, strict=True):
        c = bound(c, guarded(step, some))
    return c


#: The characters of that class.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """c without white space at both ends (all white space, not only blanks); looks at the ends only, unlike a pattern."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower; not word by word."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def find(text: Column, part: Column | str) -> Column:
    """Position of part in text from 0, -1 if it isn't there."""
    return F.position(F.lit(part) if isinstance(part, str) else part, text) - 1


def any_contains(c: Column, parts: list[str]) -> Column:
    """c contains one of parts, which are literals."""
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def quote(word: str) -> str:
    """A literal as a regex that Java and RE2 read alike."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-/#&" else ch for ch in word)


def word_pattern(word: str) -> str:
    """The word as a whole word, regardless of case."""
    return rf"(?i)\b{quote(word)}\b"
