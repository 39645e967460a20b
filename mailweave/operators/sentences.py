"""Sentences: splitting, engineering tags, open items, categories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import WS, any_contains, quote, strip, word_pattern
from mailweave.words import ABBREVIATIONS, BOOST_WORDS, DECISION_WORDS, ENGINEERING_KEYWORDS, GREETINGS, UNRESOLVED_MARKERS

# A number with a unit; any number.
WITH_UNIT = r"(?i)\d+(?:\.\d+)?\s*(?:mm|cm|m|kg|g|Nm|kW|HP|RPM|bar|psi|Pa|°|V|A|Hz)\b"
ANY_NUMBER = r"\b\d+(?:\.\d+)?\b"
GREETING = r"(?i)^\s*(?:" + "|".join(g.replace("'", ".") for g in GREETINGS) + ")"
#: Engineering words of the test for open questions when the caller has none.
QUESTION_KEYWORDS = "torque rpm speed load pressure bore shaft diameter dimension material tolerance coupling temperature voltage current power weight delivery drawing specification approval".split()


#: Abbreviations that end in a full stop, as one pattern; the mark that stands for that stop meanwhile.
_SHORTENED = "(" + "|".join(re.escape(a[:-1]) for a in sorted(ABBREVIATIONS, key=len, reverse=True) if a.endswith(".")) + r")\."
_STOP = "\x01\x02"


def split_sentences(text: Column) -> Column:
    """Sentences of text: after . ! ? before white space, and at line feeds; abbreviations end none. Trimmed, without empty ones."""
    marked = F.regexp_replace(text, _SHORTENED, f"$1{_STOP}")
    parts = F.split(F.regexp_replace(marked, rf"([.!?]){WS}+", "$1\n"), "\n+", -1)
    return F.filter(F.transform(parts, lambda s: strip(F.replace(s, F.lit(_STOP), F.lit(".")))), lambda s: F.length(s) > 0)


def summary_sentences(text: Column) -> Column:
    """Sentences of more than 15 characters; no abbreviations are known."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, rf"([.!?]){WS}+", "$1\n"), "\n+", -1), strip), lambda s: F.length(s) > 15)


def sentences(mails: DataFrame, text: str = "body") -> DataFrame:
    """(mail_id, sent_ord, sentence, context): context is the sentence with its neighbours.

    Both are put together inside the mail's own array, which is then exploded once: no window, no shuffle, and no copy of the
    mail in each sentence's row.
    """

    def rows(all_: Column) -> Column:
        return F.transform(all_, lambda s, i: F.struct(i.alias("sent_ord"), s.alias("sentence"), F.concat_ws(" ", F.when(i > 0, F.get(all_, i - 1)), s, F.get(all_, i + 1)).alias("context")))

    bound = F.get(F.transform(F.array(split_sentences(F.col(text))), rows), F.lit(0))  # the sentences are split once
    return mails.where(F.length(text) > 0).select("mail_id", F.inline(bound))


def found_words(sentence: Column, words: list[str]) -> Column:
    """Those of words that occur as whole words, in the list's order. Single words are looked up among the sentence's words by
    one intersection, phrases by their patterns, and only where one of them occurs at all."""
    single = {w.lower(): w for w in reversed(words) if not re.search(r"\W", w)}
    phrases = [w for w in words if re.search(r"\W", w)]
    tokens = F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def pick(tokens: Column) -> Column:
        hits = [F.when(sentence.rlike(word_pattern(w)) if w in phrases else F.array_contains(tokens, w.lower()), F.lit(w)) for w in words]
        return F.filter(F.array(*hits), lambda w: w.isNotNull())

    slow = F.get(F.transform(F.array(tokens), pick), F.lit(0))  # the words are bound once
    if len(single) + len(phrases) < len(words) or not single:
        return slow
    spelt = F.create_map(*[F.lit(x) for kv in single.items() for x in kv])
    fast = F.transform(F.array_intersect(F.array(*[F.lit(w.lower()) for w in words if w not in phrases]), tokens), lambda w: F.element_at(spelt, w))
    return F.when(sentence.rlike(any_pattern(phrases)), slow).otherwise(fast) if phrases else fast


def any_pattern(words: list[str]) -> str:
    """One pattern for any of words as a whole word."""
    return r"(?i)\b(?:" + "|".join(quote(w) for w in words) + r")\b"


def confidence(sentence: Column, found: Column) -> Column:
    """0 to 1: keywords, a number with unit or any number, a keyword of several words; short sentences count half."""
    score = F.least(F.size(found) * 0.2, F.lit(0.4)) + F.when(sentence.rlike(WITH_UNIT), 0.35).when(sentence.rlike(ANY_NUMBER), 0.15).otherwise(0.0)
    score = score + F.when(F.exists(found, lambda w: w.contains(" ")), 0.1).otherwise(0.0)
    n = F.size(F.filter(F.split(sentence, rf"{WS}+"), lambda w: F.length(w) > 0))
    return F.least(F.lit(1.0), F.when(n < 4, score * 0.5).when(n > 5, score + 0.05).otherwise(score))


def first_marker(sentence: Column, markers: list[str] = UNRESOLVED_MARKERS, keywords: list[str] = QUESTION_KEYWORDS) -> Column:
    """The first marker that the sentence has; a question mark counts in questions about engineering that aren't greetings."""
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        hit = (sentence.contains("?") & ~sentence.rlike(GREETING) & sentence.rlike(any_pattern(keywords))) if m == "?" else sentence.rlike(word_pattern(m))
        out = F.when(hit, m).otherwise(out)
    return out


def tag_sentences(mails: DataFrame, text: str = "body", keywords: list[str] = ENGINEERING_KEYWORDS, markers: list[str] = UNRESOLVED_MARKERS) -> DataFrame:
    """(mail_id, sent_ord, sentence, context, trigger_keywords, is_unresolved, confidence): sentences with an engineering keyword."""
    # filtered by one pattern, not by the list: a filter on the list would compute it twice
    x = sentences(mails, text).where(F.col("sentence").rlike(any_pattern(keywords))).withColumn("trigger_keywords", found_words(F.col("sentence"), keywords))
    # a sentence that got here has a keyword, so its question mark needs only not to be a greeting
    open_ = F.lit(False)
    if "?" in markers:
        open_ = open_ | (F.col("sentence").contains("?") & ~F.col("sentence").rlike(GREETING))
    if others := [m for m in markers if m != "?"]:
        open_ = open_ | F.col("sentence").rlike(any_pattern(others))
    return x.withColumn("is_unresolved", open_).withColumn("confidence", confidence(F.col("sentence"), F.col("trigger_keywords")))


def open_items(mails: DataFrame, text: str = "body", markers: list[str] = UNRESOLVED_MARKERS, keywords: list[str] = QUESTION_KEYWORDS) -> DataFrame:
    """(mail_id, sent_ord, sentence, context, marker): sentences with a marker of something unresolved."""
    x = sentences(mails, text).where(F.col("sentence").contains("?") | F.col("sentence").rlike(any_pattern([m for m in markers if m != "?"] or ["?"])))
    return x.withColumn("marker", first_marker(F.col("sentence"), markers, keywords)).where("marker IS NOT NULL")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[a-z0-9]+)*"), F.lit(0))


def sentence_category(sentence: Column) -> Column:
    """decision, spec, open_item, engineering or general, in this order of precedence."""
    low = F.lower(sentence)
    boosted = F.size(F.filter(word_tokens(sentence), lambda w: w.isin(BOOST_WORDS)))
    return (
        F.when(any_contains(low, DECISION_WORDS), "decision").when(sentence.rlike(WITH_UNIT), "spec").when(sentence.contains("?") | any_contains(low, ["tbd", "pending"]), "open_item")
        .when(boosted >= 2, "engineering").otherwise("general")
    )
