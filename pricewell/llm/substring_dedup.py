"""Repeated word windows found by recompression.

Recompression names runs of equal words, then in rounds pairs of neighbouring symbols: a global
hash of its name puts each symbol left or right, and a left one merges with a right one that follows. Names
are functions of what they name, so equal substrings have equal symbols in their
interior in whatever document or task they lie, without exchanging a dictionary. With
each symbol goes its support, the words on which its forming depends: a symbol whose support lies
in a window appears in every copy of that window.

Round one of Spark work counts the names of high symbols over the corpus; a symbol that occurs once rules out every
window around its support. Round two sends the windows that are left as 96-bit hashes, and the
first of equals (doc_id, then start) stays; the others' words go. A false survivor of round one
costs a row and changes nothing.

Cases: null or empty text has no words. Texts shorter than a window lose nothing. Rows that repeat a
doc_id and text are one document and share its result; a null doc_id is the smallest. An empty table gives an empty result; other
columns, of clashing names too, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, mix64, partitions, per_bytes, texts, word_hashes
from pricewell.llm.repeats import ANSWER, PACK, SENT, Entries, by_doc, exchange, join_found, keyed, keys_of, packs, positions, repeated_marks

ROUNDS = 4
TESTED = (3, 4)  # rounds whose new symbols are counted
LEAST = 3  # words of a counted symbol at least


def symbols(names: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, support start and support end of the symbols that are counted, ordered by text.

    Supports are in word positions of the slice. What depends on a text's edge reaches
    beyond it and so lies in no window.
    """
    doc = np.repeat(np.arange(len(count)), count)
    n = len(names)
    empty = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), empty, empty
    run = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))))
    size = np.diff(np.append(run, n))
    name = np.where(size > 1, mix64(names[run] ^ mix64(size.astype(np.uint64), 7), 8), names[run])
    doc, start, end = doc[run], run.astype(np.int64), (run + size).astype(np.int64)
    low, high = start - 1, end + 1
    ends = np.cumsum(count)
    begins = ends - count
    found = []
    for r in range(1, ROUNDS + 1):
        m = len(name)
        right = (mix64(name, 100 + r) >> np.uint64(63)).astype(bool)
        next_same = np.concatenate((doc[1:] == doc[:-1], [False]))
        pair = np.zeros(m, bool)
        pair[:-1] = next_same[:-1] & ~right[:-1] & right[1:]
        second = np.concatenate(([False], pair[:-1]))
        prev_same = np.concatenate(([False], next_same[:-1]))
        after = np.concatenate((high[1:], [0]))
        before = np.concatenate(([0], low[:-1]))
        alone = ~pair & ~second
        new_high = np.where(alone & ~right, np.where(next_same, np.maximum(high, after), np.maximum(high, end + 1)), high)
        new_low = np.where(alone & right, np.where(prev_same, np.minimum(low, before), np.minimum(low, start - 1)), low)
        at = np.flatnonzero(pair)
        name, new_name = name.copy(), mix64(mix64(name[at], 50 + r) ^ name[at + 1], 60 + r)
        name[at] = new_name
        new_high[at] = np.maximum(high[at], high[at + 1])
        new_low[at] = np.minimum(low[at], low[at + 1])
        end = end.copy()
        end[at] = end[at + 1]
        if r in TESTED:
            fit = (end[at] - start[at] >= LEAST) & (new_high[at] - new_low[at] <= width)
            own = at[fit & (new_low[at] >= begins[doc[at]]) & (new_high[at] <= ends[doc[at]])]
            found.append((doc[own], name[own], new_low[own], new_high[own]))
        stay = ~second
        name, doc, start, end, low, high = name[stay], doc[stay], start[stay], end[stay], new_low[stay], new_high[stay]
    doc, name, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(doc, kind="stable")
    return name[order], low[order], high[order]


def _marks(width: int):
    def marks(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        names, count = word_hashes(raw)
        name, low, _ = symbols(names, count, width)
        return name, np.bincount(np.searchsorted(np.cumsum(count), low, side="right"), minlength=len(raw)).astype(np.int64)

    return marks


def open_windows(count: np.ndarray, low: np.ndarray, high: np.ndarray, once: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows (in the slice) that hold no support of a symbol that occurs once."""
    n = int(count.sum())
    edge = np.zeros(n + 2, np.int64)
    a, b = np.maximum(high[once] - width, 0), low[once] + 1
    np.add.at(edge, a, 1)
    np.add.at(edge, np.maximum(b, a), -1)
    clear = np.cumsum(edge[:n]) == 0
    ends = np.repeat(np.cumsum(count), count)
    return np.flatnonzero(clear & (np.arange(n) + width <= ends))


def window_hashes(names: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes of the windows that start at the given words."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            v = names[at + k]
            a = (a ^ v) * np.uint64(0x9FB21C651E98DF25)
            a ^= a >> np.uint64(29)
            b = (b + v) * np.uint64(0xD6E8FEB86659FD93)
            b ^= b >> np.uint64(31)
    return mix64(a, 1), mix64(b, 2) >> np.uint64(32)


def _first_of_equals(a, b, d, h, pos):
    """Order by hash, doc_id, start; which entries begin a hash, and which differ from their first."""
    order = np.lexsort((h, pos, d, b, a))
    a, b, d, h, pos = a[order], b[order], d[order], h[order], pos[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    at = np.flatnonzero(first)
    lead = np.repeat(at, np.diff(np.append(at, len(a))))
    later = (d != d[lead]) | (pos != pos[lead]) | (h != h[lead])
    return order, first, later


def repeated_windows(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(_d, _h, found): starts of the windows whose words also start earlier."""
    marked = repeated_marks(docs, _marks(width), scratch, "symbols")
    parts = partitions(docs.sparkSession)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, count = word_hashes(texts(batch))
        name, low, high = symbols(names, count, width)
        base = np.cumsum(count) - count
        own = np.bincount(np.searchsorted(np.cumsum(count), low, side="right"), minlength=len(count))
        shift = np.cumsum(own) - own
        once = np.ones(len(name), bool)
        for k, blob in enumerate(batch.column("found").to_pylist()):
            once[positions(blob) + shift[k]] = False
        at = open_windows(count, low, high, once, width)
        if not len(at):
            return
        a, b = window_hashes(names, at, width)
        doc = np.searchsorted(np.cumsum(count), at, side="right")
        key, pos = keys_of(batch), at - base[doc]
        order, first, later = _first_of_equals(a, b, key[0][doc], key[1][doc], pos)
        first, later = np.sort(order[first]), np.sort(order[later])
        yield from packs((a[first] % np.uint64(parts)).astype(np.int32), SENT, doc[first], *key, [pos[first]], plain=[a[first], b[first].astype(np.uint32)])
        yield from packs(by_doc(*key, parts)[doc[later]], ANSWER, doc[later], *key, [pos[later]])

    def answer(e: Entries) -> Iterator[tuple[np.ndarray]]:
        order, _, later = _first_of_equals(*e.plain, e.d[e.doc], e.h[e.doc], e.pos)
        yield (order[later],)

    layout = {"plain": [np.uint64, np.uint32]}
    found = exchange(per_bytes(join_found(docs, marked), send, PACK), layout, answer, scratch, "windows")
    scratch.drop("symbols")
    return found


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def drop_repeated_windows(docs: DataFrame, width: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by a space (``text``, or ``kept_sha256``).

    A word goes when a window of ``width`` words over it also starts earlier: in a smaller
    doc_id, or before it in the same document. Windows are judged on the input.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    source = keyed(docs)
    found = repeated_windows(source, width, scratch)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total, gone, out = [], [], []
        for text, blob in zip(texts(batch), batch.column("found").to_pylist(), strict=True):
            words = text.split()
            hit = covered(positions(blob), width, len(words))
            kept = b" ".join([w for w, x in zip(words, hit.tolist(), strict=True) if not x] if hit.any() else words)
            total.append(len(words))
            gone.append(int(hit.sum()))
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "text"
    return per_bytes(join_found(source, found).select("doc_id", "text", F.col("found")), run, f"doc_id long, n_words long, n_removed long, {last} string")
