"""Sentence vectors, similarity and TextRank per thread."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.operators.sentences import word_tokens
from mailweave.session import cut_lineage
from mailweave.words import STOP_WORDS


def rank_tokens(text: Column) -> Column:
    return F.filter(word_tokens(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))


def tfidf(sentences: DataFrame) -> DataFrame:
    """(thread_id, sent_id, term, w): tf * (ln(N/df) + 1) with N sentences in the thread; sentences needs thread_id, sent_id, sentence."""
    toks = sentences.select("thread_id", "sent_id", rank_tokens(F.col("sentence")).alias("t"))
    total = sentences.groupBy("thread_id").agg(F.count("*").alias("n"))
    tf = toks.select("thread_id", "sent_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("thread_id", "sent_id", "term").agg((F.count("*") / F.max("len")).alias("tf"))
    df = tf.groupBy("thread_id", "term").agg(F.count("*").alias("df"))
    return tf.join(df, ["thread_id", "term"]).join(total, "thread_id").select("thread_id", "sent_id", "term", (F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1)).alias("w"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(thread_id, sent_id, term, u, df): vectors of length 1; df is the number of the thread's sentences with the term."""
    norm = vectors.groupBy("thread_id", "sent_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    df = vectors.groupBy("thread_id", "term").agg(F.count("*").alias("df"))
    return vectors.join(norm, ["thread_id", "sent_id"]).join(df, ["thread_id", "term"]).select("thread_id", "sent_id", "term", (F.col("w") / F.col("norm")).alias("u"), "df")


def cosine_edges(vectors: DataFrame, min_similarity: float) -> DataFrame:
    """(thread_id, i, j, sim), i < j: sentences of a thread whose cosine is above min_similarity (which must be positive).

    Exact prefix filtering: with terms in order of rarity, sentences that are so similar share a term before the point
    where the rest of a vector is too short to reach the bound, so common terms are never joined.
    """
    if min_similarity <= 0:
        raise ValueError("a bound above 0 is needed; all pairs are never listed")
    sent = unit_vectors(vectors).groupBy("thread_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "u"))).alias("v"))  # one sentence's terms
    rest = F.aggregate("v", F.struct(F.lit(1.0 + 1e-9).alias("left"), F.array().cast("array<string>").alias("p")), lambda a, x: F.when(a["left"] < min_similarity**2, a).otherwise(F.struct((a["left"] - x["u"] * x["u"]).alias("left"), F.concat(a["p"], F.array(x["term"])).alias("p"))))
    sent = sent.select("thread_id", "sent_id", "v", rest["p"].alias("p"))
    prefix = sent.select("thread_id", "sent_id", F.explode("p").alias("term"))
    a, b = prefix.alias("a"), prefix.alias("b")
    same = (F.col("a.thread_id") == F.col("b.thread_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.sent_id") < F.col("b.sent_id"))
    cand = a.join(b, same).select(F.col("a.thread_id").alias("thread_id"), F.col("a.sent_id").alias("i"), F.col("b.sent_id").alias("j")).distinct()
    weights = F.map_from_arrays(F.transform("v", lambda x: x["term"]), F.transform("v", lambda x: x["u"]))
    full = sent.select("thread_id", "sent_id", weights.alias("m"))
    both = cand.join(full.select("thread_id", F.col("sent_id").alias("i"), F.col("m").alias("mi")), ["thread_id", "i"]).join(full.select("thread_id", F.col("sent_id").alias("j"), F.col("m").alias("mj")), ["thread_id", "j"])
    dot = F.aggregate(F.map_keys("mi"), F.lit(0.0), lambda s, t: s + F.try_element_at("mi", t) * F.coalesce(F.try_element_at("mj", t), F.lit(0.0)))
    return both.select("thread_id", "i", "j", dot.alias("sim")).where(F.col("sim") > min_similarity)


def textrank(units: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, epsilon: float = 1e-4) -> DataFrame:
    """(thread_id, sent_id, score) by power iteration, distributed, without listing the graph's edges.

    The similarity is the product of the sentence-term matrix with itself, so a step is two sums over its entries: per term
    over the sentences, then per sentence over the terms, less the sentence's similarity to itself. The work of a step is
    linear in the words, however long a thread is. Nodes without edges keep (1-d)/n. Lineage is cut every round; the largest
    change is the only value that comes to the driver.
    """
    n = nodes.groupBy("thread_id").agg(F.count("*").alias("n"))
    x = cut_lineage(units.select("thread_id", "sent_id", "term", "u"))

    def product(q: DataFrame) -> DataFrame:
        """(thread_id, sent_id, g): for each sentence the sum of similarity times q over the others."""
        terms = x.join(q, ["thread_id", "sent_id"]).groupBy("thread_id", "term").agg(F.sum(F.col("u") * F.col("q")).alias("t"))
        sums = x.join(terms, ["thread_id", "term"]).groupBy("thread_id", "sent_id").agg(F.sum(F.col("u") * F.col("t")).alias("s"))
        return sums.join(q, ["thread_id", "sent_id"]).select("thread_id", "sent_id", (F.col("s") - F.col("q")).alias("g"))

    out = product(nodes.select("thread_id", "sent_id", F.lit(1.0).alias("q"))).select("thread_id", "sent_id", F.when(F.col("g") > 1e-9, F.col("g")).alias("out"))
    score = cut_lineage(nodes.select("thread_id", "sent_id").join(n, "thread_id").join(out, ["thread_id", "sent_id"], "left").withColumn("score", 1.0 / F.col("n")))
    for _ in range(rounds):
        gain = product(score.select("thread_id", "sent_id", F.coalesce(F.col("score") / F.col("out"), F.lit(0.0)).alias("q")))
        new = score.join(gain, ["thread_id", "sent_id"], "left").select("thread_id", "sent_id", "n", "out", F.col("score").alias("old"), ((1 - damping) / F.col("n") + damping * F.when(F.col("out").isNotNull(), F.coalesce("g", F.lit(0.0))).otherwise(0.0)).alias("score"))
        new = cut_lineage(new)
        change = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        score = new.drop("old")
        if change < epsilon:
            break
    return score.select("thread_id", "sent_id", F.when(F.col("n") == 1, 1.0).otherwise(F.col("score")).alias("score"))


_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_STOP = frozenset(STOP_WORDS)


def vectors_of(texts: list[str]) -> list[dict[str, float]]:
    """The vectors of `tfidf` for sentences in memory."""
    counts = [Counter(w for w in _WORD.findall(t.lower()) if w not in _STOP and len(w) > 1) for t in texts]
    df = Counter(w for c in counts for w in c)
    return [{w: k / max(sum(c.values()), 1) * (math.log(len(texts) / df[w]) + 1) for w, k in c.items()} for c in counts]


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    common = a.keys() & b.keys()
    size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
    return sum(a[w] * b[w] for w in common) / size if common and size else 0.0


def textrank_in_memory(texts: list[str], damping: float = 0.85, rounds: int = 100, epsilon: float = 1e-4) -> list[float]:
    """The scores of `textrank` for the sentences of one thread."""
    n = len(texts)
    if n < 2:
        return [1.0] * n
    terms: dict[str, int] = {}
    rows, cols, vals = [], [], []
    for i, v in enumerate(vectors_of(texts)):
        size = math.sqrt(sum(k * k for k in v.values()))
        for w, k in v.items() if size else ():
            rows.append(i)
            cols.append(terms.setdefault(w, len(terms)))
            vals.append(k / size)
    row, col, u = np.array(rows, int), np.array(cols, int), np.array(vals, float)
    own = np.bincount(row, u * u, n)  # the similarity of a sentence to itself

    def product(q: np.ndarray) -> np.ndarray:
        """For each sentence the sum of similarity times q over the others; linear in the words, as no similarity is listed."""
        return np.bincount(row, u * np.bincount(col, u * q[row], len(terms))[col], n) - own * q

    out = product(np.ones(n))
    linked = out > 1e-9
    score = np.full(n, 1.0 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * np.where(linked, product(np.divide(score, out, out=np.zeros(n), where=linked)), 0.0)
        change = np.abs(new - score).max()
        score = new
        if change < epsilon:
            break
    return score.tolist()


#: Threads of at most so many sentences are ranked in one task each (some 100 MB); larger ones by the distributed iteration.
IN_MEMORY = 50_000


def rank_sentences(sentences: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """(thread_id, sent_id, score) for all sentences: small threads grouped, large ones by the distributed iteration.

    NULL sentences count as empty. A thread with one sentence scores 1. Both ways give the same scores.
    """
    s = sentences.select("thread_id", "sent_id", F.coalesce("sentence", F.lit("")).alias("sentence"))
    sizes = s.groupBy("thread_id").agg(F.count("*").alias("n"))
    kind = s.schema["sent_id"].dataType.simpleString()

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sent_id")
        return pd.DataFrame({"thread_id": pdf["thread_id"], "sent_id": pdf["sent_id"], "score": textrank_in_memory(pdf["sentence"].tolist())})

    small = s.join(sizes.where(F.col("n") <= in_memory).select("thread_id"), "thread_id", "left_semi").groupBy("thread_id").applyInPandas(rank, f"thread_id string, sent_id {kind}, score double")
    large_ids = sizes.where(F.col("n") > in_memory).select("thread_id")
    if large_ids.isEmpty():
        return small
    large = cut_lineage(s.join(large_ids, "thread_id", "left_semi"))
    return small.unionByName(textrank(unit_vectors(tfidf(large)), large.select("thread_id", "sent_id")))


def diverse_top(sentences: DataFrame, scores: DataFrame, top: int = 8, diversity: float = 0.7, in_memory: int = IN_MEMORY) -> DataFrame:
    """(thread_id, sent_id, sentence): the best sentences of a thread, none similar to a better one, in order of the text.

    Scores that agree in nine digits are equal, and the first in the text goes first. The greedy choice goes down the whole ranking of a thread, with the vectors of the whole thread, until `top` are chosen
    or none is left: small threads grouped, large ones in at most `top` distributed rounds. Both ways choose the same.
    """
    sizes = sentences.groupBy("thread_id").agg(F.count("*").alias("n"))
    schema = f"thread_id string, sent_id {sentences.schema['sent_id'].dataType.simpleString()}, sentence string"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=pdf["score"].round(9)).sort_values(["score", "sent_id"], ascending=[False, True])
        vec = vectors_of(pdf["sentence"].fillna("").tolist())
        kept: list[int] = []
        for i in range(len(vec)):
            if len(kept) == top:
                break
            if all(cosine(vec[i], vec[k]) <= diversity for k in kept):
                kept.append(i)
        return pdf.iloc[kept].sort_values("sent_id")[["thread_id", "sent_id", "sentence"]]

    ranked = sentences.select("thread_id", "sent_id", "sentence").join(scores, ["thread_id", "sent_id"])
    small = ranked.join(sizes.where(F.col("n") <= in_memory).select("thread_id"), "thread_id", "left_semi").groupBy("thread_id").applyInPandas(choose, schema)
    large_ids = sizes.where(F.col("n") > in_memory).select("thread_id")
    if large_ids.isEmpty():
        return small
    return small.unionByName(_diverse_in_rounds(ranked.join(large_ids, "thread_id", "left_semi"), top, diversity))


def _diverse_in_rounds(ranked: DataFrame, top: int, diversity: float) -> DataFrame:
    """`diverse_top` without a thread in one task: a round takes each thread's best sentence that is similar to none taken before."""
    vectors = unit_vectors(tfidf(ranked)).groupBy("thread_id", "sent_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "u"))).alias("m"))  # one sentence's terms
    left = cut_lineage(ranked.join(vectors, ["thread_id", "sent_id"], "left"))
    taken: DataFrame | None = None
    for _ in range(top):
        x = left
        if taken is not None:
            dot = lambda p: F.coalesce(F.aggregate(F.map_keys("m"), F.lit(0.0), lambda s, t: s + F.try_element_at("m", t) * F.coalesce(F.try_element_at(p["m"], t), F.lit(0.0))), F.lit(0.0))
            before = taken.groupBy("thread_id").agg(F.collect_list("p").alias("before"))  # at most `top`
            x = left.join(before, "thread_id").where(F.forall("before", lambda p: (p["sent_id"] != F.col("sent_id")) & (dot(p) <= diversity)))
        new = cut_lineage(x.groupBy("thread_id").agg(F.min_by(F.struct("sent_id", "sentence", "m"), F.struct(-F.round("score", 9), "sent_id")).alias("p")))
        if new.isEmpty():
            break
        taken = new if taken is None else taken.unionByName(new)
    return taken.select("thread_id", "p.sent_id", "p.sentence")
