"""Paragraphs of a thread and what repeats among them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweave.functions.arrow import flat_map
from mailweave.functions.text import WS, strip
from mailweave.operators.cleaning import PARAGRAPH_BREAK, drop_quoted_lines
from mailweave.session import cut_lineage

#: Jaccard similarity from which a paragraph repeats another, and the distinct words below which it isn't compared.
FUZZY, FEW_WORDS = 0.85, 5
#: Normalised paragraphs shorter than this are always kept.
SHORT = 10
#: What orders the paragraphs of a thread.
KEY = ("mail_ord", "mail_id", "para_ord")
ROW = ("thread_id", *KEY)


def normalised(paragraph: Column) -> Column:
    return F.regexp_replace(F.lower(strip(paragraph)), rf"{WS}+", " ")


def paragraph_hash(paragraph: Column) -> Column:
    """MD5 of the normalised paragraph; NULL if it is too short to count as repeated."""
    n = normalised(paragraph)
    return F.when(F.length(n) >= SHORT, F.md5(n))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def paragraphs(mails: DataFrame, body: str = "body") -> DataFrame:
    """(thread_id, mail_ord, mail_id, para_ord, paragraph): non-blank paragraphs without quoted lines, ordinals from 0.

    mails needs thread_id, mail_ord and mail_id; NULL and empty bodies have no paragraphs.
    """
    x = mails.select("thread_id", "mail_ord", "mail_id", F.posexplode_outer(F.split(drop_quoted_lines(F.col(body)), PARAGRAPH_BREAK, -1)).alias("para_ord", "paragraph"))  # outer: the inner one cleans bodies twice
    return x.where(F.length(strip(F.col("paragraph"))) > 0)


def first_occurrences(paras: DataFrame) -> DataFrame:
    """paras without exact repetitions within a thread: the first by (mail_ord, mail_id, para_ord) stays.

    Firsts are found by a grouped minimum, so a paragraph that a third of all mails repeat is combined before the
    shuffle; rows come back by their own unique key, not by the paragraph.
    """
    x = paras.withColumn("h", paragraph_hash(F.col("paragraph")))
    key = ["mail_ord", "mail_id", "para_ord"]
    firsts = x.where("h IS NOT NULL").groupBy("thread_id", "h").agg(F.min(F.struct(*key)).alias("k")).select("k.*", F.lit(True).alias("_mw_first"))
    same = [x[k].eqNullSafe(firsts[k]) for k in key]
    return x.join(firsts, same, "left").where("h IS NULL OR _mw_first").select(*[x[c] for c in paras.columns])


def fuzzy_within_mail(paras: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """paras without those similar to an earlier kept paragraph of the same mail (greedy, in order).

    A fold over the mail's paragraphs in the JVM; the group is one mail, so it is bounded by one body.
    """
    x = paras.withColumns({"w": word_set(F.col("paragraph")), "short": F.length(normalised(F.col("paragraph"))) < SHORT})
    mail = x.groupBy("thread_id", "mail_ord", "mail_id").agg(F.array_sort(F.collect_list(F.struct("para_ord", "paragraph", "w", "short"))).alias("p"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("seen"), F.array().cast("array<struct<para_ord:int,paragraph:string>>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        repeated = ~p["short"] & (F.size(p["w"]) >= FEW_WORDS) & F.exists(acc["seen"], lambda s: jaccard(p["w"], s) >= threshold)
        seen = F.when(repeated | p["short"], acc["seen"]).otherwise(F.concat(acc["seen"], F.array(p["w"])))
        kept = F.when(repeated, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(p["para_ord"].alias("para_ord"), p["paragraph"].alias("paragraph")))))
        return F.struct(seen.alias("seen"), kept.alias("kept"))

    return mail.select("thread_id", "mail_ord", "mail_id", F.explode(F.aggregate("p", zero, step)["kept"]).alias("k")).select("thread_id", "mail_ord", "mail_id", "k.para_ord", "k.paragraph")


def _words(paragraph: str) -> frozenset[str] | None:
    """The word set as it is compared; None for a paragraph that is always kept."""
    if len(" ".join(paragraph.lower().split())) < SHORT:
        return None
    w = frozenset(re.findall("[a-z0-9]+", paragraph.lower()))
    return w if len(w) >= FEW_WORDS else None


def _alike(a: frozenset[str], b: frozenset[str], threshold: float) -> bool:
    both = len(a & b)
    return both / (len(a) + len(b) - both) >= threshold


class SetKeys:
    """Keys of word sets of which every two sets with Jaccard similarity >= threshold share one.

    Sizes fall into classes l..l/threshold, so of a similar pair the larger set is of the smaller one's class or the next:
    a set has keys of its own class and of the one before. A pair of a class differs in at most d words. Words are dealt by
    hash into d + 2 parts, of which two are equal then; a key is two parts, so few other sets share it. From nine parts
    on there are d + 1, and a key is one part.
    """

    def __init__(self, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("a bound above 0 and up to 1 is needed")
        self.threshold = threshold
        self.ends: list[int] = []  # largest size of each class
        self.hashes: dict[str, int] = {}

    def _class(self, n: int) -> int:
        while not self.ends or self.ends[-1] < n:
            self.ends.append(int(((self.ends[-1] if self.ends else FEW_WORDS - 1) + 1) / self.threshold + 1e-9))
        return bisect_left(self.ends, n)

    def _hash(self, word: str) -> int:
        h = self.hashes.get(word)
        if h is None:
            if len(self.hashes) > 200_000:
                self.hashes.clear()
            h = self.hashes[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1
        return h

    def __call__(self, w: frozenset[str]) -> list[int]:
        own, t, out = self._class(len(w)), self.threshold, []
        hashes = [self._hash(x) for x in w]
        for k in range(max(own - 1, 0), own + 1):
            d = int((1 - t) / (1 + t) * (self.ends[k] + int(self.ends[k] / t + 1e-9)) + 1e-9)
            parts = d + 2 if d <= 6 else d + 1
            sums = [0] * parts
            for h in hashes:
                sums[h % parts] += h
            # hashes of integers are the same in every process
            out += [hash((k, i, j, sums[i], sums[j])) for i in range(parts) for j in range(i)] if d <= 6 else [hash((k, i, x)) for i, x in enumerate(sums)]
        return out


def _sorted_groups(paras: DataFrame, by: list[str], make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]], schema: T.StructType) -> DataFrame:
    """Rows of each group in order of (mail_ord, mail_id, para_ord), given to make() as an iterator, one group at a time."""
    n = len(by)

    def stream() -> Callable[..., Iterator[tuple]]:
        group, last = make(), [None, None]

        def row(*values: Any) -> Iterator[tuple]:
            if last[1] is None or values[:n] != last[0]:
                last[0], last[1] = values[:n], group()
            return last[1](values)

        return row

    return flat_map(paras.repartition(*by).sortWithinPartitions(*by, *KEY), stream, schema)


def _scan(paras: DataFrame, threshold: float) -> DataFrame:
    """The greedy scan itself, a thread in one task's memory: its rows without exact and similar repetitions."""
    cols = [*ROW, "paragraph"]

    def make() -> Callable[[], Callable[[tuple], Iterator[tuple]]]:
        keys = SetKeys(threshold)

        def thread() -> Callable[[tuple], Iterator[tuple]]:
            seen: set[str] = set()
            few: list[frozenset[str]] = []
            index: dict[int, list[frozenset[str]]] = {}

            def similar(w: frozenset[str]) -> bool:
                if len(few) <= 64:
                    lo, hi = len(w) * threshold - 1e-9, len(w) / threshold + 1e-9
                    if any(lo <= len(s) <= hi and _alike(w, s, threshold) for s in few):
                        return True
                    few.append(w)
                    if len(few) == 65:  # from here on kept sets are found by their keys
                        for s in few:
                            for k in keys(s):
                                index.setdefault(k, []).append(s)
                    return False
                ks = keys(w)
                if any(_alike(w, s, threshold) for k in ks for s in index.get(k, ())):
                    return True
                for k in ks:
                    index.setdefault(k, []).append(w)
                return False

            def row(values: tuple) -> Iterator[tuple]:
                n = " ".join(values[4].lower().split())
                if len(n) >= SHORT:
                    if n in seen:
                        return
                    seen.add(n)
                    w = _words(values[4])
                    if w is not None and values[0] is not None and similar(w):
                        return
                yield values

            return row

        return thread

    x = paras.select(*cols, *[c for c in paras.columns if c not in cols])
    return _sorted_groups(x, ["thread_id"], make, x.schema).select(*paras.columns)


def _repeats(members: DataFrame, threshold: float, of: str = "true") -> DataFrame:
    """Distinct ROW columns of members that are similar to an earlier one of their bucket for which `of` holds."""
    x = members.select("thread_id", "bucket", *KEY, F.expr(of).alias("of"), "paragraph")

    def make() -> Callable[[], Callable[[tuple], Iterator[tuple]]]:
        def bucket() -> Callable[[tuple], Iterator[tuple]]:
            seen: list[frozenset[str]] = []

            def row(values: tuple) -> Iterator[tuple]:
                w = _words(values[-1])
                if any(_alike(w, s, threshold) for s in seen):
                    yield values[0], *values[2:5]
                if values[5]:
                    seen.append(w)

            return row

        return bucket

    out = T.StructType([x.schema[c] for c in ROW])
    return _sorted_groups(x, ["thread_id", "bucket"], make, out).distinct()


def _without_similar(exact: DataFrame, threshold: float, in_memory: int) -> DataFrame:
    """exact, rows of threads too long for one task, without similar repetitions.

    Similar paragraphs share a bucket of SetKeys; who shares none stays. In rounds, those with no earlier similar one are
    kept and those similar to them go, without listing a pair; what is undecided in a thread is scanned as soon as it fits.
    """
    schema = T.StructType([*[exact.schema[c] for c in ROW], T.StructField("bucket", T.LongType())])

    def make() -> Callable[..., Iterator[tuple]]:
        keys = SetKeys(threshold)

        def row(*values: Any) -> Iterator[tuple]:
            w = _words(values[-1])
            for k in keys(w) if w is not None else ():
                yield *values[:-1], k

        return row

    texts = exact.where("thread_id IS NOT NULL").select(*ROW, "paragraph")
    keyed = cut_lineage(flat_map(texts, make, schema))
    shared = _matched(keyed, keyed.groupBy("thread_id", "bucket").agg(F.count("*").alias("n")).where("n > 1"), ("thread_id", "bucket"), "left_semi")
    members = cut_lineage(_matched(shared, texts, ROW, "inner"))
    gone = None
    while not members.select(*ROW).distinct().groupBy("thread_id").count().where(F.col("count") > in_memory).isEmpty():
        later = cut_lineage(_repeats(members, threshold).withColumn("later", F.lit(True)))
        marked = cut_lineage(_matched(members, later, ROW, "left").withColumn("later", F.col("later").isNotNull()))
        drop = cut_lineage(_repeats(marked, threshold, "NOT later"))
        gone = drop if gone is None else gone.unionByName(drop)
        members = cut_lineage(_matched(marked.where("later").drop("later"), drop, ROW, "left_anti"))
    rest = members.select(*ROW, "paragraph").distinct()
    drop = _matched(rest.select(*ROW), _scan(rest, threshold), ROW, "left_anti")
    return _matched(exact, drop if gone is None else gone.unionByName(drop), ROW, "left_anti")


def _matched(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """a joined with b on equal columns, where NULL equals NULL; columns that both have are a's."""
    b = b.select(*[F.col(c).alias(f"_mw_{c}") for c in on], *[c for c in b.columns if c not in a.columns])
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_mw_{c}")) for c in on], how).drop(*[f"_mw_{c}" for c in on])


def fuzzy_within_thread(paras: DataFrame, threshold: float = FUZZY, in_memory: int = 20_000) -> DataFrame:
    """paras without exact repetitions and without those similar to an earlier kept paragraph of the thread, greedily in order.

    Threads of up to in_memory paragraphs are scanned in one task each; longer ones are resolved distributed, with the
    same result. The ids of long threads come to the driver: at most one for each in_memory paragraphs.
    """
    long = [r[0] for r in paras.groupBy("thread_id").count().where(F.col("count") > in_memory).select("thread_id").collect()]
    if not long:
        return _scan(paras, threshold)
    is_long = F.coalesce(F.col("thread_id").isin([x for x in long if x is not None]), F.lit(None in long))
    exact = cut_lineage(first_occurrences(paras.where(is_long)))
    return _scan(paras.where(~is_long), threshold).unionByName(_without_similar(exact, threshold, in_memory))


def rebuilt_bodies(mails: DataFrame, paras: DataFrame) -> DataFrame:
    """(mail_id, body): kept paragraphs joined by blank lines in order; "" for mails that keep none."""
    kept = paras.groupBy("mail_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_ord", "paragraph"))), lambda s: s["paragraph"]), "\n\n").alias("body"))
    return mails.select("mail_id").join(kept, "mail_id", "left").na.fill("", ["body"])
