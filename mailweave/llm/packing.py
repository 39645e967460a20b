"""Containers of fixed capacity filled with documents (problem 8).

Sizes are tokens of a public byte-level BPE. A document is cut only if it exceeds the capacity: whole capacities of it
fill containers of their own, the rest is an item. Items are spread over groups of bounded size; a group is packed by
best fit, then by swap-based local search: one-for-one and two-for-one exchanges and moves between underfull bins that
increase the sum of squared fills, until bins empty out or nothing improves.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_left, insort
from collections import defaultdict, deque

from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map_batches

#: Vocabulary file of the public tokenizer; a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before byte-pair merging in that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a group on average. A group is one task's work, whatever the size of the table.
GROUP_ITEMS = 4000
#: Each document is packed once for each kind of container, so their number is a matter of configuration; more are refused.
MOST_KINDS = 1000


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Tokens of texts. A single blank before a word starts a new piece, so texts are counted word by word from a bounded cache."""

    def __init__(self, path: str = TOKENIZER) -> None:
        self.encode = encoder(path).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if "  " in text or text[:1] == " " or text[-1:] == " " or _ODD_BLANK.search(text):
            return len(self.encode(text))
        known = self.known
        total = 0
        parts = text.split(" ")
        for i, w in enumerate(parts):
            w = " " + w if i else w
            n = known.get(w)
            if n is None:
                if len(known) > 500_000:
                    known.clear()
                n = known[w] = len(self.encode(w))
            total += n
        return total


#: White space next to a blank merges with it, so such texts are encoded whole.
_ODD_BLANK = re.compile(r" [^\S ]|[^\S ] ")


class _Underfull:
    """The underfull bins' items and pairs of items by size: what may be given for a gap is looked up, not searched."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int) -> None:
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.by_size: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # size -> items of one bin of that size -> the bin

    def groups(self, b: int) -> list[tuple[int, ...]]:
        """Single items of a bin and pairs, one of each combination of sizes."""
        some: dict[tuple[int, ...], tuple[int, ...]] = {}
        items = sorted(self.bins[b], key=lambda i: (self.size[i], i))
        seen: dict[int, list[int]] = defaultdict(list)
        for i in items:
            if self.size[i] and len(seen[self.size[i]]) < 2:  # more of the same size give the same pairs
                seen[self.size[i]].append(i)
        few = [i for s in seen.values() for i in s]
        for n, i in enumerate(few):
            some.setdefault((self.size[i],), (i,))
            for j in few[n + 1 :]:
                some.setdefault((self.size[i], self.size[j]), (i, j))
        return list(some.values())

    def enter(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            for g in self.groups(b):
                self.by_size[sum(self.size[i] for i in g)][g] = b

    def leave(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            for g in self.groups(b):
                del self.by_size[sum(self.size[i] for i in g)][g]

    def best_for(self, b: int) -> tuple[tuple[int, ...], tuple[int, ...], int] | None:
        """(items of b, items of another bin, that bin) whose exchange fills b most while it raises the sum of squared fills."""
        gap = self.capacity - self.fill[b]
        mine = [((), 0)] + [(g, sum(self.size[i] for i in g)) for g in self.groups(b)]
        for d in range(gap, 0, -1):
            for out, n in mine:
                for into, a in self.by_size.get(n + d, {}).items():
                    # moves, one for one, two for one and one for two
                    if a != b and len(out) + len(into) < 4 and d > self.fill[a] - self.fill[b]:
                        return out, into, a
        return None

    def exchange(self, b: int, out: tuple[int, ...], into: tuple[int, ...], a: int) -> None:
        self.leave(a)
        self.leave(b)
        d = sum(self.size[i] for i in into) - sum(self.size[i] for i in out)
        self.bins[a] = [i for i in self.bins[a] if i not in into] + list(out)
        self.bins[b] = [i for i in self.bins[b] if i not in out] + list(into)
        self.fill[a] -= d
        self.fill[b] += d
        self.enter(a)
        self.enter(b)


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Improve a packing (bins of item numbers) by swaps and moves between underfull bins that raise the sum of squared fills.

    Raising it makes full bins fuller and empty ones emptier; bins that empty are dropped, items of size 0 going elsewhere.
    It ends when no move, no exchange of one for one and none of two for one between any two bins raises the sum: each
    exchange raises a sum of whole numbers that has a bound.
    """
    state = _Underfull([list(b) for b in bins], size, capacity)
    for b in range(len(bins)):
        state.enter(b)
    todo = deque(sorted((b for b in range(len(bins)) if state.fill[b] < capacity), key=lambda b: (-state.fill[b], b)))
    waiting = set(todo)
    settled = 0  # bins seen in a row without an exchange
    while todo and settled <= len(todo):
        b = todo.popleft()
        waiting.discard(b)
        found = state.best_for(b) if 0 < state.fill[b] < capacity else None
        if found is None:
            if 0 < state.fill[b] < capacity:
                todo.append(b)
                waiting.add(b)
                settled += 1
            continue
        state.exchange(b, *found)
        settled = 0
        for x in (b, found[2]):
            if x not in waiting and 0 < state.fill[x] < capacity:
                todo.append(x)
                waiting.add(x)
    out = [x for x, f in zip(state.bins, state.fill) if f]
    empty = [i for x, f in zip(state.bins, state.fill) if not f for i in x]
    if empty and not out:
        return [empty]
    if empty:
        out[-1] = out[-1] + empty
    return out


def pack(size: list[int], capacity: int, search: bool = True) -> list[list[int]]:
    """Bins of item numbers: best fit in order of falling size, then local search. Sizes must not exceed the capacity; items of size 0 go along."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(size)), key=lambda i: (-size[i], i)):
        k = bisect_left(room, (size[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > size[i]:
            insort(room, (left - size[i], b))
    return local_search(bins, size, capacity) if search else bins


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens); NULL texts count as empty. The vocabulary file is sent along to executors that don't have it."""
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)

    def make() -> object:
        counter = TokenCounter(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        return lambda ids, texts: ((d, counter.count(t) if t else 0) for d, t in zip(ids, texts))

    return flat_map_batches(documents.select("doc_id", "text"), make, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens int")


def packed(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, container_id, doc_id, first_token, n_tokens): which tokens of which documents each container holds.

    A document that fits is whole in one container (first_token 0). Empty and NULL texts take part with no tokens. The
    containers table is small by meaning (kinds); the packing of a kind is cut into groups by a hash of the document, so
    no task holds more than a few times group_items, and each group leaves at most a few underfull containers.
    """
    sizes = token_counts(documents, path).withColumn("_mw_h", F.xxhash64("doc_id"))
    groups = max(1, documents.count() // group_items)
    given = containers.select("container_kind", "capacity_tokens").where("capacity_tokens > 0")
    if given.limit(MOST_KINDS + 1).count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")  # never some of them only
    kinds = sorted((r[0], int(r[1])) for r in given.collect())
    key = documents.schema["doc_id"].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values("doc_id")
        ids, counts = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()
        out = []
        for kind, capacity in kinds:
            n = 0
            rest, start, owner = [], [], []
            for d, c in zip(ids, counts):
                whole = c // capacity if c > capacity else 0
                for w in range(whole):
                    if (w + 1) * capacity < c or c % capacity == 0:
                        out.append((kind, f"{kind}-{g:06d}-{n:07d}", d, w * capacity, capacity))
                        n += 1
                left = c - whole * capacity
                if left or not whole:
                    rest.append(left)
                    start.append(whole * capacity)
                    owner.append(d)
            for b in pack(rest, capacity):
                out.extend((kind, f"{kind}-{g:06d}-{n:07d}", owner[i], start[i], rest[i]) for i in b)
                n += 1
        return pd.DataFrame(out, columns=["container_kind", "container_id", "doc_id", "first_token", "n_tokens"])

    # packing is work without bytes, so the number of tasks is given: adaptive execution would join such small partitions into one
    tasks = min(groups, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_group = sizes.select(F.pmod("_mw_h", F.lit(groups)).cast("int").alias("grp"), "doc_id", "n_tokens").repartition(tasks, "grp")
    return by_group.groupBy("grp").applyInPandas(group, f"container_kind string, container_id string, doc_id {key}, first_token int, n_tokens int")
