"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, so the sizes within a partition differ by a factor
of at most sqrt(2). For each partition documents are read in overlapping blocks a little over
twice the partition's largest item: an item's passage lies whole in some block, and its containment of 0.8
becomes a Jaccard similarity of 0.21 or more, whatever the document's length. A block is a
candidate for an item when any of 64 minimum hashes agree (a miss has probability below 1e-6); this is how every item that lies in some block is found. What
no block can show is counted by an index of the items' shingles, and only that: items that repeat themselves, so that their places exceed
their partition's distinct shingles, and items of which the document has enough, but scattered so that no block has it. Candidates
are verified by exact containment of word shingles in the whole document.

Documents are read once and nothing is shuffled. Items go to all tasks in blocks of bounded size;
a larger benchmark takes several passes.

Cases: null or empty texts and items have no shingles and match nothing. A text or item of fewer
words than a shingle is one shingle, so such an item matches texts of the same words. Repeated documents or
items each give their pairs. An empty table on either side gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import cuts, mix64, shingles, starts_of, texts, word_hashes

WORDS = 5
HASHES = 64
SLICE = 2 << 20  # bytes of text whose arrays a task holds
SLACK = 1.25  # a passage may be longer than its item by so much
_SALT = mix64(np.arange(HASHES, dtype=np.uint64), 21)
_ODD = mix64(np.arange(HASHES, dtype=np.uint64), 22) | np.uint64(1)
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def exact_shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    w = _TOKEN.findall(text.lower())
    if not w:
        return set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))) if len(w) >= words else {b" ".join(w)}


def shingle_hashes(raw: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles in order, and how many each text has."""
    return shingles(*word_hashes(raw, lower=True, plain=True), words)


def minima(h: np.ndarray, begins: np.ndarray, k: int) -> np.ndarray:
    """The least value of hash function k in each stretch."""
    with np.errstate(over="ignore"):
        return np.minimum.reduceat((h ^ _SALT[k]) * _ODD[k], begins)


class Items:
    """Signatures of the benchmark's items, partitioned by size."""

    def __init__(self, ids: list, raw: list[bytes]):
        keep = [k for k, x in enumerate(raw) if exact_shingles(x)]
        self.ids, self.raw = [ids[k] for k in keep], [raw[k] for k in keep]
        self.sets = [exact_shingles(x) for x in self.raw]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        h, count = shingle_hashes(self.raw)
        begins = np.cumsum(count) - count
        level = np.ceil(2 * np.log2(np.maximum(sizes, 1)) - 1e-9).astype(np.int64)
        # the passage of an item has as many places as the item, repeats included
        repeats = np.ceil(2 * np.log2(np.maximum(count, 1)) - 1e-9).astype(np.int64) > level
        self._index(h, begins, count, np.arange(len(self.ids)))
        self.repeats = repeats
        self.parts = []
        for p in np.unique(level[~repeats]):
            own = np.flatnonzero((level == p) & ~repeats)
            self.parts.append((int(np.ceil(SLACK * count[own].max())), own))
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.parts]
        for k in range(HASHES if len(h) else 0):
            low = minima(h, begins, k)
            for t, (_, own) in zip(self.tables, self.parts, strict=True):
                order = own[np.argsort(low[own], kind="stable")]
                seen = np.zeros(1 << 16, bool)
                seen[(low[own] >> np.uint64(48)).astype(np.int64)] = True
                t.append((low[order], order, seen))

    def _index(self, h: np.ndarray, begins: np.ndarray, count: np.ndarray, own: np.ndarray) -> None:
        """Sorted distinct shingle hashes of the items ``own`` with their items, and how many each item has."""
        hashes = [np.unique(h[begins[i] : begins[i] + count[i]]) for i in own]
        self.index_items = np.repeat(own, [len(x) for x in hashes])
        self.index = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(self.index, kind="stable")
        self.index, self.index_items = self.index[order], self.index_items[order]
        self.needs = np.bincount(self.index_items, minlength=len(self.ids))
        self.indexed = np.zeros(1 << 22, bool)
        self.indexed[(self.index >> np.uint64(42)).astype(np.int64)] = True

    def counted(self, h: np.ndarray, count: np.ndarray, least: float) -> set[tuple[int, int]]:
        """(text, item) pairs that blocks cannot show: the text holds ``least`` of an item that repeats itself, or of one whose shingles no block holds enough of."""
        at = np.flatnonzero(self.indexed[(h >> np.uint64(42)).astype(np.int64)]) if len(self.index) else np.zeros(0, np.int64)
        block = np.zeros(len(self.ids), np.int64)
        for size, own in self.parts:
            block[own] = size
        a, b = np.searchsorted(self.index, h[at], "left"), np.searchsorted(self.index, h[at], "right")
        at, a, b = at[b > a], a[b > a], b[b > a]
        found: set[tuple[int, int]] = set()
        ends = np.cumsum(count)
        doc = np.searchsorted(ends, at, "right")
        run = starts_of(doc)
        for x, y in zip(run.tolist(), np.append(run[1:], len(doc)).tolist(), strict=True) if len(run) else ():
            d = int(doc[x])
            _, first = np.unique(a[x:y], return_index=True)
            begin, n = a[x:y][first], (b - a)[x:y][first]
            hits = np.bincount(self.index_items[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(self.ids))
            for i in np.flatnonzero((hits > 0) & (hits >= least * self.needs - 1e-6) & (count[d] > block)):
                places = at[x:y] - (ends[d] - count[d])
                if self.repeats[i] or self._scattered(int(i), places, a[x:y], b[x:y], int(block[i]), least):
                    found.add((d, int(i)))
        return found

    def _scattered(self, item: int, places: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, least: float) -> bool:
        """Whether no block (two neighbouring stretches of ``size`` places) holds ``least`` of the item's shingles."""
        held: dict[int, set[int]] = {}
        for place, lo, hi in zip(places.tolist(), a.tolist(), b.tolist(), strict=True):
            if item in self.index_items[lo:hi]:
                held.setdefault(place // size, set()).add(lo)
        return all(len(own | held.get(s + 1, set())) < least * self.needs[item] - 1e-6 for s, own in held.items())

    def candidates(self, h: np.ndarray, count: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs in which some block and the item agree on a minimum."""
        found: set[tuple[int, int]] = set()
        has = np.flatnonzero(count)
        if not len(h) or not self.ids:
            return found
        ends = np.cumsum(count)
        cuts = []
        for size, _ in self.parts:
            n = -(-count[has] // size)
            doc = np.repeat(has, n)
            begins = (ends - count)[doc] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * size
            cuts.append((begins, doc, np.concatenate((doc[1:] == doc[:-1], [False]))))
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                g = (h ^ _SALT[k]) * _ODD[k]
                for (begins, doc, follows), table in zip(cuts, self.tables, strict=True):
                    values, order, seen = table[k]
                    low = np.minimum.reduceat(g, begins)
                    # a block is two neighbouring stretches of a text; its minimum is one of theirs
                    near = np.flatnonzero(seen[(low >> np.uint64(48)).astype(np.int64)])
                    if not len(near):
                        continue
                    near = np.unique(np.concatenate((near, near[near > 0] - 1)))
                    block = np.where(follows[near], np.minimum(low[near], low[np.minimum(near + 1, len(low) - 1)]), low[near])
                    a, b = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
                    for x in np.flatnonzero(b > a):
                        found.update((int(doc[near[x]]), int(i)) for i in order[a[x] : b[x]])
        return found

    def matches(self, raw: list[bytes], least: float) -> list[tuple[int, int, int, float]]:
        """(text, item, shingles of the item, share of them in the text), verified exactly."""
        h, count = shingle_hashes(raw)
        out, at, own = [], -1, set()
        for doc, item in sorted(self.candidates(h, count) | self.counted(h, count, least)):
            if doc != at:
                at, own = doc, exact_shingles(raw[doc])
            need = self.sets[item]
            share = len(need & own) / len(need)
            if share >= least:
                out.append((doc, item, len(need), share))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in got], [(r["text"] or "").encode() for r in got])


def find_items(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, n_shingles, containment) of items of which ``least`` or more lies in a document."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in cuts(b, 1 << 20, SLICE):
                    raw = texts(part)
                    rows = held.value.matches(raw, least)
                    if rows:
                        doc, item, n, share = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array([held.value.ids[i] for i in item], pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "n_shingles", "containment"])

        found = source.mapInArrow(run, "doc_id long, item_id long, n_shingles long, containment double")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass a block of items."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in cuts(b, 1 << 20, SLICE):
                    raw = texts(part)
                    bad = {x[0] for x in held.value.matches(raw, least)}
                    yield part.filter(pa.array([k not in bad for k in range(len(raw))])) if bad else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs
