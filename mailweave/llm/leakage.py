"""Passages of held-out test items inside corpus documents (problem 9).

Winnowing: of the k-gram hashes in every window of w neighbours the smallest is kept, on both sides alike, so every
shared run of at least w+k-1 words leaves a common fingerprint. Items' fingerprints are joined with the documents',
hits are extended along their diagonals, and a hit counts if it follows enough running words of the item with few
words changed.

The defaults guarantee 5-word runs: a passage of 15 words with two of them changed can't avoid one. A longer passage
with one change in seven words has a part of 15 to 29 words of which that holds too (cut it into such parts: one has no
more than its share of the changes), with at most four changes, so it leaves its diagonal by at most four words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.arrow import flat_map_batches

K, WINDOW = 4, 2
#: Running words of an item that make a passage, and the words per change that are allowed.
MIN_WORDS, PER_EDIT = 15, 7
#: Words of the items in one index (some 40 bytes each). More items are searched for in blocks, each in a pass of its own.
BLOCK_WORDS = 2_000_000
#: A passage of MIN_WORDS words in which MIN_WORDS // PER_EDIT are changed keeps at least so many k-grams (runs of 5, 4 and 4 words).
MIN_GRAMS = (MIN_WORDS - MIN_WORDS // PER_EDIT) - (MIN_WORDS // PER_EDIT + 1) * (K - 1)
_LABEL = re.compile(r"^[ \t>]*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|(?:[Qq]|[Aa]|[Ff]rage|[Aa]ntwort|[Qq]uestion|[Aa]nswer|[Ii]tem|[Tt]ask)(?: ?\d{1,4})?:)[ \t]+", re.M)
_JOINED = re.compile(r"[­​-‍⁠﻿]|(?<=[a-z])-\n(?=[a-z])")
_MARKS = re.compile("[\u0300-\u036f]+")
_OTHER = re.compile(r"[^\w\s]|_")
_WEIGHTS = np.random.RandomState(11).randint(1, 2**62, size=96).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
_IS_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
#: Characters that are hashed at once.
CHUNK = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Text in lower case without line labels, soft hyphens, accents and typographic variants (compatibility forms)."""
    if not text.isascii() or "-\n" in text:
        text = _JOINED.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
        text = _OTHER.sub(" ", _MARKS.sub("", text))
    if "\n" in text or _LABEL.match(text):
        text = _LABEL.sub("", text)
    return text.lower()


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numeric, ends) of the words of all texts in a row: 64-bit hashes, whether the word has a digit, and the end of each text's words.

    Words are runs of letters and digits. The bytes of all texts are hashed at once: a word's hash is the sum of its
    bytes times fixed random weights of their places.
    """
    parts = [plain(t).encode("utf-8", "ignore") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.nonzero(begins)[0]
    ends = np.searchsorted(first, np.cumsum([len(p) for p in parts]))
    if not len(first):
        return np.array([], np.uint64), np.array([], bool), ends
    at = np.nonzero(inside)[0]
    word = np.cumsum(begins)[at] - 1
    place = np.minimum(at - first[word], len(_WEIGHTS) - 1)
    cuts = np.searchsorted(at, first)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_WEIGHTS[place] * (data[at].astype(np.uint64) + np.uint64(1)), cuts)
        h = (h ^ (h >> np.uint64(32))) * _MIX
    return h, np.logical_or.reduceat(_IS_DIGIT[data[at]], cuts), ends


def kgrams(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes."""
    if len(h) < k:
        return h[:0]
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * _MIX + h[j : len(h) - k + 1 + j]
        return out ^ (out >> np.uint64(31))


def winnow(g: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the kept fingerprints: the smallest (the last of equals) of every window of w k-grams; all if fewer than w."""
    n = len(g)
    if n <= w or w == 1:
        return np.arange(n)
    best = np.arange(n - w + 1)
    value = g[: n - w + 1].copy()
    for j in range(1, w):
        other = g[j : n - w + 1 + j]
        less = other <= value
        best[less] = np.nonzero(less)[0] + j
        value = np.where(less, other, value)
    return np.unique(best)


def has_free_stretch(numeric: np.ndarray) -> bool:
    """Whether MIN_WORDS words in a row have no figure."""
    at = np.concatenate(([-1], np.nonzero(numeric)[0], [len(numeric)]))
    return bool((np.diff(at) > MIN_WORDS).any())


def follows(doc: np.ndarray, item: np.ndarray, numeric: np.ndarray, shift: int, band: int = 16, free: bool | None = None) -> bool:
    """Whether doc follows MIN_WORDS or more running words of item near the diagonal doc = item + shift, with at most one change in PER_EDIT.

    Words are compared on the diagonals of a band; a step to another diagonal costs the words inserted. The band is the 16
    diagonals that a hit's bucket and the next one hold, with 8 more on either side, twice what changes can shift. A stretch whose
    figures mostly differ from the item's is another question of the same pattern, not a passage. free: has_free_stretch(numeric), if known.
    """
    n, m = len(item), len(doc)
    need = MIN_WORDS - MIN_WORDS // PER_EDIT
    if n < MIN_WORDS:
        return False
    # the document's words on the diagonals shift - band to shift + band, 0 (no word's hash) beyond its ends
    first, last = shift - band, shift + band + n
    part = doc[max(first, 0) : max(min(last, m), 0)]
    part = np.concatenate((np.zeros(min(max(-first, 0), last - first), np.uint64), part, np.zeros(min(max(last - m, 0), last - first), np.uint64)))[: last - first]
    same = np.ndarray((2 * band + 1, n), np.uint64, np.ascontiguousarray(part), strides=(8, 8)) == item  # a view: row d is the diagonal shift - band + d
    hit = same.any(axis=0)
    if np.count_nonzero(hit) < need or not ((hit & numeric).any() or (has_free_stretch(numeric) if free is None else free)):
        return False
    # before the alignment, its own test with every word that occurs in the band taken as met: nothing is lost
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    between = lambda x: x[None, MIN_WORDS:] - x[: n - MIN_WORDS + 1, None]
    length = between(np.arange(n + 1))
    may = (length >= MIN_WORDS) & (between(sums(~hit)) * PER_EDIT <= length)
    if not may.any() or not (may & ((between(sums(np.where(numeric, np.where(hit, 1, -1), 0))) > 0) | (between(sums(numeric)) == 0))).any():
        return False
    # Viterbi over diagonals: an unmet word costs 1, a step up costs the words inserted; a step down drops the item's word
    d = 2 * band + 1
    step = np.arange(d)[:, None] - np.arange(d)[None, :]  # to row from column
    step = np.where(step >= 0, step, 10**6).astype(float)
    miss = np.where(same, -1e-6, 1.0)  # of ways that cost the same, the one that meets more words
    cost = miss[:, 0]
    back = np.zeros((n, d), int)
    lanes = np.arange(d)
    for j in range(1, n):
        total = cost[None, :] + step
        best = total.argmin(axis=1)
        new = total[lanes, best] + miss[:, j]
        drop = np.append(cost[1:], 10**6) + 1
        fell = drop < new
        back[j] = np.where(fell, lanes + 1, best)
        cost = np.where(fell, drop, new)
    path = np.zeros(n, int)
    path[-1] = int(cost.argmin())
    for j in range(n - 1, 0, -1):
        path[j - 1] = back[j, path[j]]
    met = same[path, np.arange(n)] & np.concatenate(([True], np.diff(path) >= 0))
    inserted = np.concatenate(([0], np.maximum(0, np.diff(path))))
    edits = np.concatenate(([0], np.cumsum(~met + inserted)))
    extra = np.concatenate((inserted, [0]))
    figures = np.concatenate(([0], np.cumsum(np.where(numeric, np.where(met, 1, -1), 0))))
    wrong = np.concatenate(([0], np.cumsum(numeric & ~met)))
    for a in range(n - MIN_WORDS + 1):
        if not met[a]:
            continue
        ends = np.arange(a + MIN_WORDS, n + 1)
        e = edits[ends] - edits[a] - extra[a]
        if ((e * PER_EDIT <= ends - a) & met[ends - 1] & ((figures[ends] - figures[a] > 0) | (wrong[ends] == wrong[a]))).any():
            return True
    return False


class Index:
    """Fingerprints of the items, and all their k-grams by hash for the extension of hits (arrays, so that it broadcasts small)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items: list[tuple[np.ndarray, np.ndarray, bool]] = []
        kept, grams, owner, place = [], [], [], []
        for n, (_, text) in enumerate(items):
            h, numeric, _ = hashed_words([text or ""])
            self.items.append((h, numeric, has_free_stretch(numeric)))
            g = kgrams(h)
            kept.append(g[winnow(g)])
            grams.append(g)
            owner.append(np.full(len(g), n))
            place.append(np.arange(len(g)))
        none = np.array([], dtype=np.uint64)
        self.prints = np.unique(np.concatenate([none, *kept]))
        g = np.concatenate([none, *grams])
        order = np.argsort(g, kind="stable")
        self.grams, self.starts = np.unique(g[order], return_index=True)
        self.starts = np.append(self.starts, len(g))
        self.owner = np.concatenate([np.array([], int), *owner])[order]
        self.place = np.concatenate([np.array([], int), *place])[order]

    def search(self, texts: list[str]) -> list[list[int]]:
        """For each text the items of which it holds a passage."""
        out: list[list[int]] = []
        chunk: list[str] = []
        size = 0
        for t in texts:
            chunk.append(t)
            size += len(t)
            if size >= CHUNK:
                out += self._search(chunk)
                chunk, size = [], 0
        return out + self._search(chunk) if chunk else out

    def _search(self, texts: list[str]) -> list[list[int]]:
        h, _, ends = hashed_words(texts)
        g = kgrams(h)
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.prints) or not len(g):
            return out
        at = np.searchsorted(self.prints, g)
        at[at == len(self.prints)] = 0
        hits = np.nonzero(self.prints[at] == g)[0]
        for n in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
            a, b = (int(ends[n - 1]) if n else 0), int(ends[n])
            out[n] = self.matches(h[a:b])
        return out

    def matches(self, h: np.ndarray) -> list[int]:
        """Items of which the word hashes of one text hold a passage."""
        if len(h) < MIN_WORDS - MIN_WORDS // PER_EDIT or not len(self.prints):
            return []
        g = kgrams(h)
        at = np.searchsorted(self.prints, g)
        at[at == len(self.prints)] = 0
        pos = np.nonzero(self.prints[at] == g)[0]
        if not len(pos) or not np.isin(pos, winnow(g), assume_unique=True).any():
            return []
        # extend: all k-grams that a document with a common fingerprint shares with items, counted by item and diagonal
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        pos = np.nonzero(self.grams[at] == g)[0]
        at = at[pos]
        n = self.starts[at + 1] - self.starts[at]
        flat = np.repeat(self.starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = self.owner[flat] * 2**32 + ((np.repeat(pos, n) - self.place[flat]) >> 3) + 2**20
        keys, counts = np.unique(where, return_counts=True)
        if len(keys) > 1:  # a passage may lie across two buckets of diagonals
            pair = np.concatenate((np.diff(keys) == 1, [False]))
            counts = counts + np.where(pair, np.roll(counts, -1), 0)
        found = set()
        for key in keys[counts >= MIN_GRAMS].tolist():
            n = key >> 32
            if n in found:
                continue
            item, numeric, free = self.items[n]
            shift = (((key & (2**32 - 1)) - 2**20) << 3) + 8
            if follows(h, item, numeric, shift, free=free):
                found.add(n)
        return sorted(self.ids[n] for n in found)


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """The items in lists of at most BLOCK_WORDS words (or one longer item), one after the other."""
    block: list[tuple] = []
    size = 0
    for i, text in items.select(item_id, item_text).where(f"{item_id} IS NOT NULL AND length({item_text}) > 0").toLocalIterator():
        n = len(text.split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += n
    yield block


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold a passage of an item.

    NULL and empty texts on either side hold nothing; items shorter than MIN_WORDS can't leak. The items are a stated query
    set against all documents: each block of at most BLOCK_WORDS of their words is sent as an index, and documents are
    read whole, in one pass without shuffle per block. A gram that a third of the documents hold pairs nothing by itself.
    """
    schema = f"{id_col} {documents.schema[id_col].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    texts = documents.where(f"length({text_col}) > 0").select(id_col, text_col)
    out = None
    for block in _blocks(items, item_id, item_text):
        index = documents.sparkSession.sparkContext.broadcast(Index(block))

        def make(index: object = index) -> object:
            idx = index.value
            return lambda docs, batch: ((d, i) for d, found in zip(docs, idx.search(batch)) for i in found)

        x = flat_map_batches(texts, make, schema)
        out = x if out is None else out.unionByName(x)
    return out.distinct()
