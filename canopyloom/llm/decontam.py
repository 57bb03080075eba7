"""Benchmark decontamination by SimHash windows, a multi-index Hamming search and exact verification.

Words are runs without ASCII white space, in lower case, ASCII
punctuation deleted. An item of n words has max(1, n - k + 1) shingles of k words
(k = 5, or n if fewer). Windows of a document have as many shingles as the item;
a document with fewer is one window as a whole, verified without a fingerprint search.

1. A window that shares no shingle with an item has similarity 0 to it. So only
   windows that cover a shingle of an item, and have that item's size, are
   fingerprinted: a lossless gate.
2. Such windows get a 64-bit SimHash, by running sums over the shingles' bits.
3. The items' fingerprints are indexed in ``radius`` + 1 blocks of bits (8 of 8 bits
   by default, of which a random fingerprint shares one with 3 in 100 items). Two
   fingerprints within the radius agree in a block at least, so looking up every
   block finds all of them.
4. Similar windows may lie beyond the radius (at a similarity of 0.8 most do: 10 of 64
   bits differ on average). No radius with selective blocks reaches them, so windows
   that hold as many shingles of an item as the threshold needs are taken as well,
   whatever their distance; the radius doesn't decide what is found.
5. What is found is verified exactly: shingles weighted by how often they occur,
   sum of minima over sum of maxima, at least ``threshold``.

The best window of each pair of document and item is returned (highest
similarity, then the earliest). A null or empty text and an item without words
match nothing. Repeated rows and null ids are searched like others. Empty tables
give an empty table. Documents aren't shuffled. The items are checked against
``block_bytes`` and searched for in blocks of that size, one pass over the
documents for each.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyloom.llm.neardup import mix

BITS = 64
#: Windows fingerprinted at a time.
STEP = 4096
SCHEMA = "doc_id long, item_id long, start_word long, n_words int, hamming int, similarity double"
PUNCTUATION = string.punctuation.encode()


def hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out + words[i : n + i])
    return out


def signs(s: np.ndarray) -> np.ndarray:
    """-1 or 1 for each bit of each shingle."""
    return (np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) << 1) - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1).view(np.uint64).reshape(-1)


class Items:
    """The items of one block, ready for search."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int, radius: int):
        self.radius = radius
        #: How many (window, item) pairs each step left: all of an item's size, sharing a block, within the radius, similar.
        self.left = dict.fromkeys(("windows", "blocks", "radius", "similar", "beyond"), 0)
        self.ids, self.k, self.own, self.prints = [], [], [], []
        places: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # of k: shingle: items
        for item_id, text in rows:
            words = hashes(text)
            if not len(words):
                continue
            size = min(k, len(words))
            s, i = shingles(words, size), len(self.ids)
            self.ids.append(item_id)
            self.k.append(size)
            self.own.append(Counter(s.tolist()))
            self.prints.append(int(fingerprint(signs(s).sum(0, np.int32)[None])[0]))
            for x in s.tolist():
                places[size][x].add(i)
        self.total = [c.total() for c in self.own]
        self.places = {size: (np.sort(np.fromiter(d, np.uint64, len(d))), {x: sorted(v) for x, v in d.items()}) for size, d in places.items()}
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(np.uint64(int(a)), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        #: By (k, window size): the items, their fingerprints, and for each block which items have a value.
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list[dict[int, np.ndarray]]]] = {}
        groups = defaultdict(list)
        for i, (size, n) in enumerate(zip(self.k, self.total, strict=True)):
            groups[size, n].append(i)
        for key, own in groups.items():
            prints = np.array([self.prints[i] for i in own], np.uint64)
            tables = []
            for shift, mask in self.blocks:
                table = defaultdict(list)
                for j, v in enumerate((prints >> shift & mask).tolist()):
                    table[v].append(j)
                tables.append({v: np.array(x) for v, x in table.items()})
            self.index[key] = (np.array(own), prints, tables)

    def near(self, key: tuple[int, int], prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all pairs within the radius."""
        own, known, tables = self.index[key]
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for (shift, mask), table in zip(self.blocks, tables, strict=True):
            for w, v in enumerate((prints >> shift & mask).tolist()):
                if v in table:
                    found[w].append(table[v])
        self.left["windows"] += len(prints) * len(known)
        for w, lists in found.items():
            cand = np.unique(np.concatenate(lists))
            distance = np.bitwise_count(known[cand] ^ prints[w])
            near = np.flatnonzero(distance <= self.radius)
            self.left["blocks"] += len(cand)
            self.left["radius"] += len(near)
            for j in near:
                yield w, int(own[cand[j]]), int(distance[j])

    def reach(self, i: int, at: list[int], s: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(start, shared shingles) of the windows of item i's size that reach the threshold; at: where its shingles stand in s."""
        own, size = self.own[i], self.total[i]
        if len(at) < size and len(at) / (2 * size - len(at)) < threshold:
            return
        names, window, both, lo, hi = s[at].tolist(), Counter(), 0, 0, 0
        # the shared shingles change only where one of them enters or leaves the window
        steps = sorted({x for p in at for x in (p - size + 1, p + 1) if 0 <= x <= len(s) - size} | {0})
        for w in steps:
            while hi < len(at) and at[hi] < w + size:
                window[names[hi]] += 1
                both += window[names[hi]] <= own[names[hi]]
                hi += 1
            while lo < hi and at[lo] < w:
                both -= window[names[lo]] <= own[names[lo]]
                window[names[lo]] -= 1
                lo += 1
            if both / (2 * size - both) >= threshold:
                yield w, both

    def search(self, text: str | None, threshold: float) -> list[tuple]:
        """(item id, start word, words, distance, similarity) of the best window of each item found."""
        words = hashes(text)
        best: dict[int, tuple] = {}
        for k, (known, places) in self.places.items():
            s = shingles(words, k)
            if not len(s):
                continue
            at = np.searchsorted(known, s)
            at[at == len(known)] = 0
            hits = np.flatnonzero(known[at] == s)
            if not len(hits):
                continue
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of window size: starts to look at
            longer = {i for p in hits.tolist() for i in places[int(s[p])] if len(s) < self.total[i] and len(s) / self.total[i] >= threshold}
            if longer:
                whole, own_print = Counter(s.tolist()), int(fingerprint(signs(s).sum(0, np.int32)[None])[0])
                for i in longer:
                    both = (self.own[i] & whole).total()
                    similarity = both / (self.total[i] + len(s) - both)
                    if similarity >= threshold:
                        best[i] = (self.ids[i], 0, len(words), (self.prints[i] ^ own_print).bit_count(), similarity)
            for p in hits.tolist():
                for size in {self.total[i] for i in places[int(s[p])]}:
                    lo, hi = max(0, p - size + 1), min(p, len(s) - size)
                    if lo <= hi:
                        if spans[size] and lo <= spans[size][-1][1] + 1:
                            spans[size][-1] = (spans[size][-1][0], max(hi, spans[size][-1][1]))
                        else:
                            spans[size].append((lo, hi))
            places_of: dict[int, list[int]] = defaultdict(list)  # of item: where its shingles stand
            for p in hits.tolist():
                for i in places[int(s[p])]:
                    places_of[i].append(p)
            for i, own_at in places_of.items():
                size = self.total[i]
                for w, both in self.reach(i, own_at, s, threshold) if size <= len(s) else ():
                    similarity = both / (2 * size - both)
                    self.left["beyond"] += 1
                    if i not in best or (-similarity, w) < (-best[i][4], best[i][1]):
                        distance = (int(fingerprint(signs(s[w : w + size]).sum(0, np.int32)[None])[0]) ^ self.prints[i]).bit_count()
                        best[i] = (self.ids[i], w, size + k - 1, distance, similarity)
            for size, runs in spans.items():
                for lo, hi in ((x, min(hi, x + STEP - 1)) for lo, hi in runs for x in range(lo, hi + 1, STEP)):
                    part = s[lo : hi + size]
                    sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(part), 0, np.int32)])
                    prints = fingerprint(sums[size:] - sums[:-size])
                    for w, i, distance in self.near((k, size), prints):
                        own, window = self.own[i], Counter(part[w : w + size].tolist())
                        both = sum(min(n, window[x]) for x, n in own.items() if x in window)
                        similarity = both / (2 * size - both)
                        self.left["similar"] += similarity >= threshold
                        if similarity >= threshold and (i not in best or (-similarity, lo + w) < (-best[i][4], best[i][1])):
                            best[i] = (self.ids[i], lo + w, size + k - 1, distance, similarity)
        return list(best.values())


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 5,
    radius: int = 7,
    threshold: float = 0.8,
    block_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row of SCHEMA for each pair of a document and an item found in it."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    out = None
    for rows in item_blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(rows)

        def task(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            known = Items(held.value, k, radius)
            for b in batches:
                rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"], strict=True) for x in known.search(t, threshold)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = docs.mapInPandas(task, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The rows (id, text) in blocks of about ``block_bytes``; one block if they fit."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    parts = 1 + size // block_bytes
    for part in range(parts):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()]


def clean_udf(held, k: int, radius: int, threshold: float):
    """A column function: whether a text holds none of the broadcast items."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Items(held.value, k, radius)
        for b in batches:
            yield pd.Series([not known.search(t, threshold) for t in b], dtype=bool)

    return clean


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = 5,
    radius: int = 7,
    threshold: float = 0.8,
    block_bytes: int = 16 << 20,
    text_col: str = "text",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs``, all columns, without the rows in which an item is found; nothing is shuffled."""
    items = benchmark.select(F.lit(0).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    for rows in item_blocks(items, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(rows)
        docs = docs.filter(clean_udf(held, k, radius, threshold)(F.col(f"`{text_col}`")))
    return docs
