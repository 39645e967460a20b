"""Texts that lost their end (problem 10).

The vocabulary of the corpus, with how often each word ends a line or sentence, is a trie: a final word that the corpus
doesn't know but that is a proper prefix of known words was cut, and so was a text whose last word never ends a line
elsewhere. Length is evidence too: sources that cut at a fixed length have many more texts of exactly that length than of
the lengths around it. Both are weighed together with the shape of the last line (prose without full stop, list item,
signature, reference), of which punctuation is one feature; the sum decides, and the strongest evidence is the reason.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map, flat_map_batches
from mailweave.session import cut_lineage

#: A word that occurs at least so often is known; one that ends fewer than 1 % of its lines isn't an ending.
KNOWN, ENDING = 3, 0.01
#: A length is a limit of its source if at least so many texts have it, so many times as many as the mean of the lengths that
#: occur within SPREAD, more than chance gives (so many standard deviations of a Poisson count), and SHARP times as many as the two
#: lengths on either side, as systems that cut at word ends pile up many lengths. The longest length of all needs the first two only.
LIMIT_TEXTS, LIMIT_EXCESS, SPREAD, DEVIATIONS, SHARP = 5, 4.0, 100, 6.0, 2.0
#: Words after the last full stop from which on its absence says little: such texts have none anyway.
UNPUNCTUATED = 40
#: Evidence for a cut (log odds): half a character, a broken word, a word that never ends a line, the source's limit; by the shape
#: of the last line; and for a name that signs several texts. A text is cut if the sum is above CUT.
EVIDENCE = {"lost_end": 9.0, "broken_word": 4.0, "no_ending": 3.0, "at_limit": 3.0}
SHAPE = {"end": -20.0, "prose": 2.0, "loose": -1.5, "item": -1.0, "dots": -1.0, "short": -2.0, "signed": -2.0, "lost": 0.0}
SIGNS_SEVERAL, CUT = -2.0, 1.5

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_END = re.compile(r"[.!?…。！？।][\"”’»)\]]*$")
_CLOSED = re.compile(
    r"(?:Ref\.? ?:? ?[A-Z]{2}-?\d{3,6}|(?:File|Attachment|Anlage):? \S+\.[a-z]{2,4}|https?://\S+/\d{3,}|https?://[\w.-]+\.[a-z]{3,}/\S+\.\w{2,4}|Page \d+ of \d+|Seite \d+ von \d+|- ?\d+ ?-"
    r"|End of (?:report|memo|document|text)|see attachments?|siehe Anhang|cc: .+|\S+@\S+\.\w{2,}|www\.\S+\.\w{2,}|\+?\d[\d /()-]{6,}|[-=_*]{2,}|\[[^\]]*\]|EOF|-+ ?end ?-+)$",
    re.I,
)
_ITEM = re.compile(r"(?:[-*•–]|\d{1,3}[.)])\s+\S")
_ENDS = ".!?…:,;\x01"
_UNFINISHED = re.compile(r"(?:,\s*\d*|\b[A-Z]{2}-\d{0,3}|[-:])$")  # no list item ends like this
_SENTENCE = re.compile(r"[.!?…。][\"”’»)]*\s+")
CLOSING = re.compile(r"^(?:best|kind|warm|many|with|yours|thanks|thx|cheers|br|regards|mit|viele|freundliche|cordialement|bien|saludos|atentamente|sincerely|mfg|rgds)\b", re.I)

END, PROSE, LOOSE, ITEM, SIGNED, SHORT, LOST, DOTS = "end", "prose", "loose", "item", "signed", "short", "lost", "dots"


def ending(text: str) -> tuple[str, str, bool]:
    """(kind of the last line, its last word or "", whether a word cut is possible) of a text.

    end: closed by a full stop or a known closing form. lost: closed by half a character. dots: three dots, which a system may have put in place of what it cut.
    prose: words without full stop; loose: so many of them that there never was one. item, signed, short: lines that end without one anyway.
    """
    bare = text.rstrip()
    cut = bare.rfind("\n")
    last = bare[cut + 1 :].strip()
    if not last:
        return END, "", False
    if last[-1] == "\ufffd":
        return LOST, "", True
    if last.endswith("..."):
        words = _WORD.findall(last)
        return DOTS, words[-1] if words else "", True
    if _END.search(last) or _CLOSED.match(last):
        return END, "", False
    words = _WORD.findall(last)
    word = words[-1] if words and last.endswith(words[-1]) else ""
    before = bare[:cut].rstrip() if cut > 0 else ""
    previous = before[before.rfind("\n") + 1 :].strip()
    if _ITEM.match(last):
        if _UNFINISHED.search(last):
            return PROSE, word, True
        return ITEM, word, text[-1:] not in ("\n",)
    if CLOSING.match(previous) and len(previous.split()) <= 4 and len(last.split()) <= 3 and not re.search(r"[a-z]{3}[.]", last):
        return SIGNED, word, True
    if CLOSING.match(last) and len(last.split()) <= 4:
        return SIGNED, word, True
    tail = _SENTENCE.split(last)[-1]
    if len(tail.split()) > UNPUNCTUATED:
        return LOOSE, word, True
    if len(last.split()) <= 3 and len(tail) == len(last) and (cut < 0 or re.match(r"[A-Z]", last)) and not before.endswith((",", "-")):
        return SHORT, word, True
    return PROSE, word, True


def _without_last(text: str) -> str:
    """Text without its last token."""
    bare = text.rstrip()
    return bare[: max(bare.rfind(c) for c in " \n\t\r\xa0\u3000") + 1]


def _count_words() -> object:
    """Batch -> (word, n, n_end): raw tokens are counted first, so each distinct one is taken apart once; the map-side combine."""

    def batch(texts: list[str]) -> Iterable[tuple]:
        raw: Counter = Counter()
        for t in texts:
            whole = _without_last(t)
            raw.update(whole.replace("\n", "\x01 ").split())  # \x01 marks the end of a line
        n, ends = Counter(), Counter()
        for token, k in raw.items():
            words = _WORD.findall(token)
            for w in words:
                n[w] += k
            if words and token[-1] in _ENDS and _WORD.search(token.rstrip(_ENDS)[-1:]):
                ends[words[-1]] += k
        return ((w, k, ends[w]) for w, k in n.items())

    return batch


def _features() -> object:
    def one(doc: object, source: str | None, text: str) -> list[tuple]:
        kind, word, open_ = ending(text)
        return [(doc, source, kind, word, len(text), len(text.encode("utf-8", "ignore")))]

    return one


def vocabulary(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, n_end) over all documents; a text's last token isn't counted, so cut words don't enter."""
    return flat_map_batches(documents.where(f"length({text}) > 0").select(text), _count_words, "word string, n long, n_end long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def trie(vocab: DataFrame) -> DataFrame:
    """(word, n, n_end, prefix): the words of vocab and the inner nodes of its trie in one table, made in one pass; prefix tells
    that a known word goes on from here."""
    none = F.lit(0).cast("long")
    leaf = F.struct("word", "n", "n_end", F.lit(False).alias("prefix"))
    inner = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.left("word", i).alias("word"), none.alias("n"), none.alias("n_end"), F.lit(True).alias("prefix")))
    nodes = F.when((F.col("n") >= KNOWN) & (F.length("word") > 1), F.concat(F.array(leaf), inner)).otherwise(F.array(leaf))
    return vocab.select(F.explode(nodes).alias("x")).select("x.*").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"), F.max("prefix").alias("prefix"))


def limits(feats: DataFrame, unit: str) -> DataFrame:
    """(source, limits): the lengths at which each source cuts, in characters or bytes. NULL is a source of its own.

    Texts are counted by length before anything else; a source has as many rows as different lengths, and a few limits.
    """
    w = Window.partitionBy("source").orderBy("length").rangeBetween(-SPREAD, SPREAD)
    n = feats.groupBy("source", F.col(unit).alias("length")).agg(F.count("*").alias("n")).withColumns({"around": F.sum("n").over(w), "others": F.count("*").over(w) - 1, "longer": F.lead("n").over(Window.partitionBy("source").orderBy("length"))})
    mean = (F.col("around") - F.col("n")) / F.greatest("others", F.lit(1))
    by = Window.partitionBy("source").orderBy("length")
    beside = F.greatest(F.coalesce(F.max("n").over(by.rangeBetween(-2, -1)), F.lit(0)), F.coalesce(F.max("n").over(by.rangeBetween(1, 2)), F.lit(0)))
    n = n.withColumn("beside", beside)
    chance = F.col("longer").isNotNull() & ((F.col("n") <= mean + DEVIATIONS * F.sqrt(mean + 1)) | (F.col("n") < SHARP * F.col("beside")))
    return n.where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_EXCESS * mean) & ~chance).groupBy(F.col("source").alias(f"{unit}_source")).agg(F.collect_set("length").alias(f"{unit}_limits"))


def cut_documents(documents: DataFrame, salt: int = 16) -> DataFrame:
    """(doc_id, source, cut, reason) for every document, NULL and empty texts included (never cut).

    The final words are looked up by a shuffle join with the vocabulary and its prefixes, distinct words first; documents
    get their verdict back by a salted join, as one word may end a third of all texts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    feats = flat_map(documents.where("length(text) > 0").select("doc_id", "source", "text"), _features, f"doc_id {kind}, source string, kind string, word string, chars int, bytes int")
    feats = cut_lineage(feats)  # four readers; the texts are looked at once
    spikes = {unit: limits(feats, unit) for unit in ("chars", "bytes")}
    final = feats.where("word <> ''").groupBy("word").agg(F.count("*").alias("n_final"))
    words = final.join(trie(vocabulary(documents)), "word", "left").select(
        "word", "n_final", (F.coalesce("n", F.lit(0)) < KNOWN).alias("unknown"), F.coalesce("prefix", F.lit(False)).alias("prefix"), (F.coalesce("n_end", F.lit(0)) < F.coalesce("n", F.lit(0)) * ENDING).alias("never_ends")
    )
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    x = feats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int")).join(salted, ["word", "salt"], "left")
    for unit, s in spikes.items():
        x = x.join(s, x["source"].eqNullSafe(s[f"{unit}_source"]), "left")
    # half a character that was taken off makes a text one byte shorter than its limit
    at_limit = F.coalesce(F.array_contains("chars_limits", F.col("chars")) | F.array_contains("bytes_limits", F.col("bytes")) | F.array_contains("bytes_limits", F.col("bytes") + 1), F.lit(False))
    broken = F.coalesce(F.col("unknown") & F.col("prefix"), F.lit(False))
    never = F.coalesce(F.col("never_ends") & ~F.col("unknown"), F.lit(False))
    there = {"lost_end": F.col("kind") == LOST, "broken_word": broken, "no_ending": never, "at_limit": at_limit}
    shape = F.try_element_at(F.create_map(*[F.lit(v) for kv in SHAPE.items() for v in kv]), F.col("kind"))
    total = sum((F.when(c, EVIDENCE[k]).otherwise(0.0) for k, c in there.items()), shape) + F.when((F.col("kind") == SIGNED) & (F.coalesce("n_final", F.lit(0)) >= KNOWN), SIGNS_SEVERAL).otherwise(0.0)
    strongest = F.coalesce(*[F.when(c, k) for k, c in there.items()], F.lit("no_full_stop"))
    reason = F.when(total > CUT, strongest)
    judged = x.select("doc_id", "source", reason.alias("reason"))
    empty = documents.where("text IS NULL OR length(text) = 0").select("doc_id", "source", F.lit(None).cast("string").alias("reason"))
    return judged.unionByName(empty).select("doc_id", "source", F.col("reason").isNotNull().alias("cut"), "reason")


def cut_share(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, share_cut) per source; NULL is a source of its own."""
    return cut_documents(documents).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("cut").alias("n_cut")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_docs"), 6))
