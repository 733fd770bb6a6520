"""Repeated byte strings found by two-stage suffix sorting.

A text is cut by content: each string of ``width`` bytes has an anchor, the k-gram in it with the
smallest hash, so equal strings have the same anchor at the same offset wherever they stand.
Round one counts anchors over the corpus; strings whose anchor occurs once repeat nowhere. Round
two sends each remaining anchor with the stretch of text its strings cover to the shard of the anchor's
hash, so all copies of a string meet in one shard. There the stretches are sorted in two
stages: suffixes smaller than their successors directly, all others by one scan over the
first-byte buckets. Common prefixes of neighbours give the classes of equal strings, and a class's smallest doc_id
keeps its bytes. Equal stretches are told by a 128-bit digest, travel and are sorted once however often they occur; the sort decides between
stretches that differ.

Cases: null or empty text has no bytes. Texts shorter than ``width`` lose nothing. Strings never cross
documents, and those within one document do not count. Rows that share a doc_id are not
smaller than one another; a null doc_id is the smallest. An empty table gives an empty result; other columns, of clashing names too, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, mix64, partitions, per_bytes, starts_of, texts
from pricewell.llm.repeats import ANSWER, PACK, SENT, Entries, by_doc, exchange, join_found, keyed, keys_of, packs, positions, repeated_marks, stretches

GRAM = 16  # bytes of an anchor
SLICE = 8 << 20  # bytes of texts that are cut at once
SORTED = 1 << 20  # bytes of stretches that are sorted at once, or all of one anchor
BLOCK, PLACE = 1 << 16, np.uint64(17)  # a block with its overlap has fewer than 2 ** 17 places
_BYTES = mix64(np.arange(256, dtype=np.uint64), 11)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of the bytes, by doubling."""
    h, size = _BYTES[data], 1
    with np.errstate(over="ignore"):
        while size < k:
            step = min(size, k - size)
            m = len(h) - step
            if m <= 0:
                return np.zeros(0, np.uint64)
            h = h[:m] * np.uint64(0xD1342543DE82EF95) + (h[step:] ^ np.uint64(size * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            size += step
    return mix64(h)


def anchors(raw: list[bytes], width: int, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, base; and for each anchor its name, its first string and how many strings are its.

    Strings are named by where they begin in ``data``, the texts one after another; ``base``
    has the texts' beginnings.
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    base = np.cumsum(size) - size
    none = np.zeros(0, np.int64)
    n = len(data) - width + 1
    if n <= 0:
        return data, base, np.zeros(0, np.uint64), none, none
    whole = np.ones(n, bool)  # strings that lie in one text
    for b, s in zip(base.tolist(), size.tolist(), strict=True):
        whole[max(b, b + s - width + 1) : b + s] = False
    parts = []
    for a in range(0, n, BLOCK):  # small enough for the processor's cache
        at = np.flatnonzero(whole[a : a + BLOCK])
        if not len(at):
            continue
        h = gram_hashes(data[a : a + BLOCK + width - 1], k)
        key = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=np.uint64)  # leftmost of equals
        span, best = width - k + 1, 1
        while best < span:
            step = min(best, span - best)
            key = np.minimum(key[: len(key) - step], key[step:])
            best += step
        chosen = (key[at] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        first = starts_of(chosen)
        parts.append((chosen[first] + a, h[chosen[first]], at[first] + a, np.diff(np.append(first, len(chosen)))))
    if not parts:
        return data, base, np.zeros(0, np.uint64), none, none
    chosen, name, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = starts_of(chosen)  # an anchor's strings may go on in the next block
    return data, base, name[first], start[first], np.add.reduceat(count, first)


def _owner(base: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(base, at, side="right") - 1


def _marks(width: int):
    def marks(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, base, name, start, _ = anchors(raw, width)
        return name, np.bincount(_owner(base, start), minlength=len(raw)).astype(np.int64)

    return marks


def _words(text: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as a number that sorts like them."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """All places of the text, ordered by the ``depth`` bytes that follow at least.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets
    in order and puts the predecessor of each suffix met, where larger, behind those that
    its own bucket has.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = np.concatenate((_words(text), np.zeros(depth + 8, np.uint64)))
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    turn = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # where a run of equal bytes ends
    smaller = step[turn] > 0

    direct = np.flatnonzero(smaller)
    key = words[direct]
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    group = np.zeros(len(direct), np.int64)
    open_ = np.arange(len(direct))
    for at in range(8, depth, 8):
        # ties alone go on to the next eight bytes
        same = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tie = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(key) else np.zeros(0, bool)
        if not tie.any():
            break
        group = np.cumsum(np.concatenate(([True], ~same)))[tie]
        open_ = open_[tie]
        own = direct[open_]
        key = words[own + at]
        order = np.lexsort((key, group))
        direct[open_], key = own[order], key[order]

    first = text[direct]
    begin = np.searchsorted(first, np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[text[n - 1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        byte = text[before]
        same = before[(byte == c) & ~smaller[before]]
        up = byte > c
        before, byte = before[up], byte[up]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cut = starts_of(byte)
            for a, e in zip(cut.tolist(), np.append(cut[1:], len(byte)).tolist(), strict=True):
                heads[byte[a]].append(before[a:e])
        return same

    for c in range(256):
        todo = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        while len(todo):
            out.append(todo)
            todo = induce(todo, c)
        own = direct[begin[c] : begin[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place in ``order`` shares with the place before it, ``depth`` at most; 0 for the first."""
    words = np.concatenate((_words(text), np.zeros(depth + 8, np.uint64)))
    out, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for at in range(0, depth, 8):
        x = words[order[open_] + at] ^ words[order[open_ - 1] + at]
        # without the bit below the highest no rounding reaches the next power of two
        same = 8 - (np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64) + 7) // 8
        out[open_] += same
        open_ = open_[same == 8]
    return np.minimum(out, depth)


def least_of_classes(text: np.ndarray, at: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``at``, the least owner among the places with the same ``depth`` bytes."""
    number = np.full(len(text), -1, np.int64)
    number[at] = np.arange(len(at))
    order = sort_suffixes(text, depth)
    order = order[number[order] >= 0]
    new = starts_of(np.cumsum(common_prefixes(text, order, depth) < depth))
    least = np.minimum.reduceat(owner[number[order]], new) if len(new) else np.zeros(0, owner.dtype)
    out = np.empty(len(at), owner.dtype)
    out[number[order]] = np.repeat(least, np.diff(np.append(new, len(order))))
    return out


def _stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after another."""
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return data[np.arange(int(size.sum())) + shift]


def _digests(data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit hashes of the stretches."""
    cut = map(data.__getitem__, map(slice, begin.tolist(), (begin + size).tolist()))
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cut)), "<u8").reshape(-1, 2)


def _parts_that_go(data: np.ndarray, begin: np.ndarray, count: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that a stretch of a smaller owner also has: stretch, first string in it, and how many follow."""
    size = count + width - 1
    text = _stretches(data, begin, size)
    skip = np.cumsum(count) - count
    at = np.repeat(np.cumsum(size) - size - skip, count) + np.arange(int(count.sum()))
    owner = np.repeat(owner, count)
    gone = least_of_classes(text, at, owner, width) < owner
    # cut where a stretch ends
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    head[skip] = gone[skip]
    first = np.flatnonzero(head)
    length = np.diff(np.append(np.cumsum(gone)[first] - 1, np.count_nonzero(gone)))
    which = np.searchsorted(skip, first, side="right") - 1
    return which, first - skip[which], length


def repeated_strings(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(_d, _h, found): runs of places where strings of ``width`` bytes begin that a smaller doc_id also has."""
    marked = repeated_marks(docs, _marks(width), scratch, "anchors", SLICE)
    parts = partitions(docs.sparkSession)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = texts(batch)
        data, base, name, start, count = anchors(raw, width)
        own = np.bincount(_owner(base, start), minlength=len(raw))
        shift = np.cumsum(own) - own
        keep = np.zeros(len(name), bool)
        for k, blob in enumerate(batch.column("found").to_pylist()):
            keep[positions(blob) + shift[k]] = True
        name, start, count = name[keep], start[keep], count[keep]
        if not len(name):
            return
        doc = _owner(base, start)
        key = keys_of(batch)
        d = key[0][doc]
        pos = start - base[doc]
        mark = _digests(data.tobytes(), start, count + width - 1)
        order = np.lexsort((d, mark[:, 0]))
        mark = mark[order]
        new = np.concatenate(([True], (mark[1:] != mark[:-1]).any(axis=1)))
        lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))
        later, leader = np.empty(len(order), bool), np.empty(len(order), np.int64)
        later[order] = d[order] > d[order[lead]]  # a smaller document of this slice has all their strings
        leader[order] = order[lead]
        sent = np.flatnonzero(~later)
        used, which = np.unique(leader[sent], return_inverse=True)
        part, short = (x.astype(kind) for x, kind in zip(np.divmod(name[used], np.uint64(parts))[::-1], (np.int32, np.uint32), strict=True))
        order = np.argsort(part, kind="stable")
        used, short = used[order], short[order]
        at = starts_of(part[order])
        rows = np.diff(np.append(at, len(order)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(at, rows)
        size = count[used] + width - 1
        tables = [(rows, [count[used].astype(np.uint16)], [short]), (np.add.reduceat(size, at), [_stretches(data, start[used], size)], [])]
        yield from packs(part[which], SENT, doc[sent], *key, [pos[sent], place[which]], tables=tables)
        yield from packs(by_doc(*key, parts)[doc[later]], ANSWER, doc[later], *key, [pos[later]], [count[later].astype(np.uint32)])

    def answer(e: Entries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        (count, name), (data,) = e.tables
        count, which, d = count.astype(np.int64), e.steps[1] + e.first[0], e.d[e.doc]
        begin = np.cumsum(count + width - 1) - (count + width - 1)
        # equal stretches become one, with the smallest document that has it
        mark = _digests(data.tobytes(), begin, count + width - 1)
        order = np.argsort(mark[:, 0])
        new = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (mark[order][1:] != mark[order][:-1]).any(axis=1)))
        rep = order[new]
        by_name = np.argsort(name[rep], kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[by_name] = np.arange(len(rep))
        one = np.empty(len(order), np.int64)
        one[order] = rank[np.cumsum(new) - 1]
        rep, which = rep[by_name], one[which]
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, which, d)
        name, count, begin = name[rep], count[rep], begin[rep]
        all_gone = d > low[which]
        at = np.flatnonzero(all_gone)
        yield at, e.pos[at], count[which[at]]
        # only anchors with several stretches have anything to sort, some at a time
        run = starts_of(name)
        n = np.diff(np.append(run, len(name)))
        used = np.flatnonzero(np.repeat(n > 1, n))
        if not len(used):
            return
        run = starts_of(name[used])
        cut = run[starts_of(np.cumsum(count[used] + width - 1)[run] // SORTED)].tolist()
        found = []
        for a, z in zip(cut, [*cut[1:], len(used)], strict=True):
            own = used[a:z]
            stretch, first, length = _parts_that_go(data, begin[own], count[own], low[own], width)
            found.append((own[stretch], first, length))
        stretch, first, length = (np.concatenate(x) for x in zip(*found, strict=True))
        m = np.bincount(stretch, minlength=len(rep))
        lo = np.cumsum(m) - m
        rest = np.flatnonzero(~all_gone & (m[which] > 0))
        w = which[rest]
        k = np.repeat(lo[w] - (np.cumsum(m[w]) - m[w]), m[w]) + np.arange(int(m[w].sum()))
        rest = np.repeat(rest, m[w])
        yield rest, e.pos[rest] + first[k], length[k]

    layout = {"steps": 2, "tables": [([np.uint16], [np.uint32]), ([np.uint8], [])]}
    found = exchange(per_bytes(join_found(docs, marked), send, PACK, SLICE), layout, answer, scratch, "strings", runs=True)
    scratch.drop("anchors")
    return found


def drop_repeated_strings(docs: DataFrame, width: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is left (``kept_sha256``, or ``kept`` as binary with ``spans``).

    A byte goes when a string of ``width`` bytes over it also begins in a document with a
    smaller doc_id. Strings are judged on the input; ``spans`` lists the removed runs as [begin, end) in bytes.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    source = keyed(docs)
    found = repeated_strings(source, width, scratch)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, blob in zip(texts(batch), batch.column("found").to_pylist(), strict=True):
            starts, n = stretches(blob)
            kept, spans = text, np.zeros((0, 2), np.int64)
            if len(starts):
                step = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + n + width - 1, minlength=len(text) + 1)
                hit = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                spans = edge.reshape(-1, 2)
                kept = np.frombuffer(text, np.uint8)[~hit].tobytes()
            rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digest else kept, spans.tolist()))
        n, gone, runs, out, spans = zip(*rows, strict=True)
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(out, pa.string() if digest else pa.binary())]
        if not digest:
            columns.append(pa.array(spans, pa.list_(pa.list_(pa.int64()))))
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digest else ["kept", "spans"])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary, spans array<array<long>>")
    return per_bytes(join_found(source, found).select("doc_id", "text", F.col("found")), run, schema)
