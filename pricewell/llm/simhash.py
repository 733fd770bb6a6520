"""SimHash near-duplicates found with the general pigeonhole principle.

Every text gets a 64-bit fingerprint. Work on pairs is done on distinct fingerprints only, so
any number of copies is one node. Bits that correlate are grouped into partitions; a pair
that differs in at most r bits differs in at most t_i bits of some partition i whenever the
sum of (t_i + 1) is r + 1. Number of partitions and thresholds t_i (-1 leaves a partition out) come
from a dynamic program over estimated rows and candidates, whose inputs are bit and bit-pair
counts over all fingerprints. Fingerprints meet under partition keys with up to t_i set bits
cleared, are verified on all 64 bits, and each bucket passes on a spanning forest of its links,
never its pairs. Components of those links give each document its group.

Cases: null or empty text has fingerprint zero, which is linked like any other. Texts of fewer words than
a shingle are one shingle. Repeated rows share a fingerprint and so a component. An
empty table gives an empty result. Other columns, of clashing names too, do not matter. A row without a doc_id has a fingerprint and
a component like any other and lends no number to it.

``near_duplicates`` and ``drop_near_duplicates`` find groups by similarity of word shingles; ``near_groups`` by fingerprint alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, mix64, per_batch, per_bytes, shingles, starts_of, texts, word_hashes
from pricewell.llm.components import components

BITS = 64
ROW_COST, PAIR_COST = 100.0, 1.0  # a shuffled key against a verified pair
LARGE_BUCKET = 4096


def fingerprint(text: bytes, words: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """Majority of the bits of the shingles' XXH64, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = list(map(b" ".join, zip(*(w[n:] for n in range(words)), strict=False))) if len(w) >= words else [b" ".join(w)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), chunk):
        raw = b"".join(map(xxhash.xxh64_digest, shingles[at : at + chunk], repeat(seed)))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits that are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(x), 1 << 15):
                part = x[at : at + (1 << 15)]
                total += part.T @ part
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], ["i", "j", "c"])

    both = np.zeros((BITS, BITS), np.int64)
    for r in prints.select("fp").mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        both[r["i"], r["j"]] = r["c"]
    return prints.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits cut into ``parts`` groups, correlated bits together (greedy)."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: corr[b, own].sum()))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def _within(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t of these bits, t = 0..most.

    Bits disagree with probability 2p(1-p); correlation is allowed for by fewer, equal
    independent bits with the same mean and variance of the distance.
    """
    p = np.diag(both)[bits] / max(n, 1)
    q = 2 * p * (1 - p)
    cov = both[np.ix_(bits, bits)] / max(n, 1) - np.outer(p, p)
    off = cov - np.diag(np.diag(cov))
    mean, var = q.sum(), (q * (1 - q)).sum() + 4 * (off**2).sum() + 2 * np.abs(off * np.outer(1 - 2 * p, 1 - 2 * p)).sum()
    if mean <= 0:
        return [1.0] * (most + 1)
    k = max(1.0, mean * mean / max(var, 1e-9))  # a gamma-like number of independent changes
    out, total = [], 0.0
    for t in range(most + 1):
        total += math.exp(-k + t * math.log(k) - math.lgamma(t + 1))
        out.append(min(1.0, total))
    return out


def allocate(n: int, both: np.ndarray, radius: int, layouts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds with the least estimated cost, by dynamic programming."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in layouts:
        groups = group_bits(n, both, m)
        costs = []
        for bits in groups:
            share = _within(n, both, bits, radius)
            half = len(bits) // 2
            rows = [sum(math.comb(half, d) for d in range(t + 1)) for t in range(radius + 1)]
            costs.append([0.0, *(ROW_COST * n * rows[t] + PAIR_COST * n * n / 2 * share[t] for t in range(radius + 1))])
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, plan) in table.items():
                for u in range(radius + 2 - used):
                    if used + u not in step or c + cost[u] < step[used + u][0]:
                        step[used + u] = (c + cost[u], [*plan, u])
            table = step
        total, plan = table[radius + 1]
        if best is None or total < best[0]:
            best = (total, [(g, u - 1) for g, u in zip(groups, plan, strict=True) if u])
    return best[1]


def _mask(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def keyed(prints: DataFrame, plan: list[tuple[list[int], int]], *more: str) -> DataFrame:
    """(part, key, fp, *more): the partition's bits of each fingerprint, with up to t set bits cleared."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for part, (bits, t) in enumerate(plan):
            own = fp & np.uint64(_mask(bits))
            for d in range(t + 1):
                for gone in combinations(bits, d):
                    m = np.uint64(_mask(list(gone)))
                    hit = (own & m) == m
                    if hit.any():
                        k = (own[hit] & ~m).view(np.int64)
                        rest = [pa.array(batch.column(c).to_numpy()[hit]) for c in more]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(fp[hit].view(np.int64)), *rest], ["part", "key", "fp", *more])

    return per_batch(prints.select("fp", *more), run, "part int, key long, fp long" + "".join(f", {c} long" for c in more), rows=1 << 14)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        s = parent[r]
        if np.array_equal(s, r):
            return r
        r = s


def _merge(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    while len(x):
        x, y = _root(parent, x), _root(parent, y)
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def _link(fp: np.ndarray, at: np.ndarray, key: np.ndarray, parent: np.ndarray, radius: int) -> None:
    """Join in ``parent`` all fp[at] of equal key that differ in at most ``radius`` bits.

    Neighbours at distance 1, 2, ... in the sorted order are compared as arrays; pairs already in one
    tree are skipped, so a dense bucket costs comparisons but no memory.
    """
    run = starts_of(key)
    length = np.diff(np.append(run, len(key)))
    left = np.repeat(run + length, length) - np.arange(len(key))  # itself and what follows in its run
    who = np.arange(len(key))
    for d in range(1, int(length.max(initial=1))):
        who = who[left[who] > d]
        a, b = at[who], at[who + d]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if near.any():
            _merge(parent, a[near], b[near])


def forest(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that span the near pairs among equal keys; ``key`` is sorted."""
    parent = np.arange(len(fp))
    run = starts_of(key)
    length = np.diff(np.append(run, len(key)))
    large = np.repeat(length > LARGE_BUCKET, length)
    small = np.flatnonzero(~large)
    _link(fp, small, key[small], parent, radius)
    for a, n in zip(run[length > LARGE_BUCKET], length[length > LARGE_BUCKET], strict=True):
        # at most `radius` bits differ, so one of radius + 1 blocks of all bits is equal
        width = -(-BITS // (radius + 1))
        for k in range(radius + 1):
            block = (fp[a : a + n] >> np.uint64(min(k * width, BITS - 1))) & np.uint64((1 << width) - 1)
            order = np.argsort(block, kind="stable")
            _link(fp, a + order, block[order], parent, radius)
    roots = _root(parent, np.arange(len(fp)))
    moved = fp[roots] != fp
    return fp[moved], fp[roots[moved]]


def _buckets(radius: int, rows: int = 1 << 17):
    def flush(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = forest(fp, key, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        enough = rows
        for b in batches:
            # buckets of different partitions are kept apart by mixing the number in
            key = b.column("key").to_numpy() ^ (b.column("part").to_numpy().astype(np.int64) * np.int64(0x1F3D5B79A6C4E2))
            held.append((key, b.column("fp").to_numpy().view(np.uint64)))
            if sum(len(k) for k, _ in held) >= enough:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = starts_of(key)[-1]
                yield from flush(key[:last], fp[:last])
                held = [(key[last:], fp[last:])]
                enough = max(rows, 2 * (len(key) - last))  # a long bucket is copied few times
        if held:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from flush(key, fp)

    return run


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id
    reachable over links.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, words), "marked")
    prints = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    plan = allocate(*bit_counts(prints), radius)
    links = scratch.table(keyed(prints, plan).repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_buckets(radius), "a long, b long").distinct(), "links")
    joined = components(links, scratch)
    labelled = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    groups = scratch.table(groups, "groups")
    scratch.only("marked", "groups")
    return marked.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BANDS, LOWS = 25, 5  # a pair at similarity 0.8 shares no band of minima with probability (1 - 0.8 ** 5) ** 25 = 5e-5
ALL_BITS = 64  # bands choose by minima, not by bits: every pair of a band may be tried, the nearest first
_ODD = mix64(np.arange(BANDS * LOWS, dtype=np.uint64), 23) | np.uint64(1)
HELD = 16 << 20  # bytes of a table that all tasks may get
CELLS = 256


def sketches(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, number, bands and cells of the distinct word shingles of each text; texts without a word are alike.

    The cells count the shingles by a part of their hash: no two texts share more shingles than the sum of the smaller counts. Where a count
    is too large for a byte all are the greatest byte, which bounds nothing.
    """
    h, count = shingles(*word_hashes(raw, lower=True), words)
    doc = np.repeat(np.arange(len(raw)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
    h, size = h[new], np.bincount(doc[new], minlength=len(raw))
    fp, bands = np.zeros(len(raw), np.uint64), np.zeros((len(raw), BANDS), np.uint64)
    cells = np.bincount(doc[new] * CELLS + (h >> np.uint64(56)).astype(np.int64), minlength=len(raw) * CELLS).reshape(-1, CELLS)
    cells[(cells > 255).any(axis=1)] = 255
    cells = cells.astype(np.uint8)
    has = np.flatnonzero(size)
    if not len(has):
        return fp, size, bands, cells
    begins = (np.cumsum(size) - size)[has]
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    fp[has] = np.packbits(2 * ones > size[has, None], axis=1).view(">u8").ravel()
    with np.errstate(over="ignore"):
        for k in range(BANDS * LOWS):
            low = np.minimum.reduceat(h * _ODD[k], begins)
            bands[has, k // LOWS] = mix64(bands[has, k // LOWS] ^ low, 24)
    return fp, size, bands, cells


def close_pairs(fp: np.ndarray, key: np.ndarray, radius: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bits): all places of equal key within ``radius`` bits, for a few whole buckets (``most`` pairs) at a time."""
    if not len(key):
        return
    run = starts_of(key)
    length = np.diff(np.append(run, len(key)))
    left = np.repeat(run + length, length) - np.arange(len(key))
    first = starts_of(np.cumsum(length * (length - 1) // 2) // most)
    for begin, end in zip(run[first], np.append(run[first[1:]], len(key)), strict=True):
        at, found = np.arange(begin, end), []
        for d in range(1, int(left[begin:end].max())):
            at = at[left[at] > d]
            far = np.bitwise_count(fp[at] ^ fp[at + d])
            near = far <= radius[at]
            if near.any():
                found.append((at[near], at[near] + d, far[near]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def chosen(x: np.ndarray, y: np.ndarray, bits: np.ndarray, node: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of one of their two members; of equally near ones the smaller node counts."""
    u, v = np.concatenate((x, y)), np.concatenate((y, x))
    order = np.lexsort((node[v], np.concatenate((bits, bits)), u))
    run = starts_of(u[order])
    rank = np.arange(len(u)) - np.repeat(run, np.diff(np.append(run, len(u))))
    out = np.zeros(len(u), bool)
    out[order[rank < most]] = True
    return out[: len(x)] | out[len(x) :]


PAIR, MORE, LARGE = 0, 1, 2  # a pair to try; a node with pairs that were put off; part and key of a bucket to be split
ROW = ("part", "key", "cell", "side", "fp", "size", "node", "grp")


def _candidates(limits: list[int], masks: list[int], least: float, most: int, large: int, rows: int = 1 << 17):
    """(kind, a, b) of rows in order of part, key, cell and fp: pairs of different groups, the ``most`` nearest of a node, and nodes of the others.

    A pair counts within the ``limits`` (bits) of its part and where sizes and cells (if rows have any) allow the similarity ``least``. Two items meet
    under several keys of one of the first parts, which have ``masks``; the pair counts under the key that keeps all bits they have in common.
    Of a bucket of more than ``large`` rows that has no cells yet (cell -1), only neighbours in order are tried, in one pass
    that holds no bucket; it is split in the next round. In a cell, rows of side 1 meet those of side 0.
    """
    limit, mask = np.array(limits, np.int64), np.zeros(len(limits), np.uint64)
    mask[: len(masks)] = masks
    masked = np.arange(len(limits)) < len(masks)

    def changes(part: np.ndarray, key: np.ndarray, cell: np.ndarray, *_: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))[: len(part)]

    def alike(size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]) - 1e-9

    def possible(size: np.ndarray, cells: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs whose cells leave room for the similarity."""
        need = least / (1 + least) * (size[x] + size[y]) - 1e-9
        shared = [np.minimum(cells[x[a : a + 8192]], cells[y[a : a + 8192]]).sum(axis=1, dtype=np.int64) for a in range(0, len(x), 8192)]
        return np.concatenate([np.zeros(0, np.int64), *shared]) >= need

    def flush(goes_on: bool, part, key, cell, side, fp, size, node, group, cells) -> Iterator[pa.RecordBatch]:
        bucket = np.cumsum(changes(part, key, cell)) - 1
        if not len(bucket):
            return
        big = np.bincount(bucket) > large
        big[0] |= goes_on
        big = big[bucket] & (cell < 0)
        if big.any():
            x = np.flatnonzero(big[:-1] & (bucket[1:] == bucket[:-1]))
            x = x[(group[x] != group[x + 1]) & (np.bitwise_count(fp[x] ^ fp[x + 1]) <= limit[part[x]]) & alike(size, x, x + 1)]
            yield from tell(PAIR, np.minimum(node[x], node[x + 1]), np.maximum(node[x], node[x + 1]))
            own = np.unique(node[big])
            yield from tell(MORE, own, own)
            at = np.flatnonzero(big & changes(part, key, cell))
            yield from tell(LARGE, part[at].astype(np.int64), key[at])
            part, key, side, fp, size, node, group, cells, bucket = (v[~big] for v in (part, key, side, fp, size, node, group, cells, bucket))
        for x, y, bits in close_pairs(fp, bucket, limit[part]):
            fits = (group[x] != group[y]) & ((side[x] == 2) | (side[x] != side[y])) & alike(size, x, y)
            fits &= ~masked[part[x]] | ((fp[x] & fp[y] & mask[part[x]]) == key[x].view(np.uint64))
            x, y, bits = x[fits], y[fits], bits[fits]
            if cells.shape[1]:
                room = possible(size, cells, x, y)
                x, y, bits = x[room], y[room], bits[room]
            if not len(x):
                continue
            now = chosen(x, y, bits, node, most)
            pairs = np.unique(np.sort(np.stack((node[x[now]], node[y[now]]), axis=1), axis=1), axis=0)
            more = np.unique(node[np.concatenate((x[~now], y[~now]))])
            yield from tell(PAIR, pairs[:, 0], pairs[:, 1])
            yield from tell(MORE, more, more)

    def tell(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        enough, goes_on = rows, False
        for b in batches:
            cells = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint8).reshape(b.num_rows, -1) if "cells" in b.schema.names and b.num_rows else np.zeros((b.num_rows, 0), np.uint8)
            held.append((*(b.column(c).to_numpy().view(np.uint64) if c == "fp" else b.column(c).to_numpy() for c in ROW), cells))
            if sum(len(x[0]) for x in held) >= enough:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.flatnonzero(changes(*whole))[-1])  # where the bucket that may go on begins
                if len(whole[0]) - last > large and whole[2][-1] < 0:
                    yield from flush(goes_on, *whole)
                    held, goes_on = [tuple(x[-1:] for x in whole)], True
                else:
                    yield from flush(goes_on, *(x[:last] for x in whole))
                    held, goes_on = [tuple(x[last:] for x in whole)], goes_on and last == 0
                enough = max(rows, 2 * len(held[0][0]))
        if held:
            yield from flush(goes_on, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def split(rows: DataFrame, hot: DataFrame, scratch: Scratch, name: str, large: int) -> DataFrame:
    """``rows`` with cell and side; those of the buckets (part, key) of ``hot`` are dealt to cells of about ``large`` rows a side.

    A pair of different groups has a member outside the bucket's greatest group. Such rows are dealt to some blocks (side 1),
    all rows to others (side 0), and every two blocks are a cell: many tasks share a bucket and no pair is dropped.
    A bucket of one group has no cells.
    """
    sizes = rows.join(hot, ["part", "key"], "left_semi").groupBy("part", "key", "grp").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("part", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "grp")).alias("top"))
    blocks = lambda n: F.ceil(n / F.lit(large)).cast("int")
    whole = scratch.table(whole.select("part", "key", F.col("top.grp").alias("top"), blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("top.n")).alias("rest")), name)
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("all")).cast("int")
    place = lambda cell, side: F.struct(cell.cast("int").alias("cell"), F.lit(side).alias("side"))
    seen = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: place(k * F.col("all") + j, 0))
    sees = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda k: place(i * F.col("all") + k, 1))
    cells = F.when(F.col("top").isNull(), F.array(place(F.lit(-1), 2))).when(F.col("rest") > 0, F.when(F.col("grp") == F.col("top"), seen).otherwise(F.concat(seen, sees)))
    dealt = rows.join(whole, ["part", "key"], "left").select(*rows.columns, F.explode(cells).alias("_c"))
    return dealt.select("part", "key", F.col("_c.cell").alias("cell"), F.col("_c.side").alias("side"), *ROW[4:], *[c for c in rows.columns if c == "cells"])


def similarity(a: bytes, b: bytes, words: int) -> float:
    """Jaccard similarity of the texts' sets of word shingles."""
    x, y = (set(map(b" ".join, zip(*(w[n:] for n in range(words)), strict=False))) if len(w) >= words else {b" ".join(w)} for w in (a.lower().split(), b.lower().split()))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _side(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as the side of a join that is held: by all tasks if its counted rows are few, else dealt by key."""
    return F.broadcast(table) if table.count() * row_bytes <= HELD else table.hint("shuffle_hash")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and what tells rows apart: the id (null as the least) and 128 bits of the text's hash."""
    text, ident = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), text.alias("text"), F.coalesce(ident, F.lit(-(2**63))).alias("_d"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))


def _groups(docs: DataFrame, scratch: Scratch, words: int, least: float, radius: int, large: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id and text hash of each row, and (node, _h1, _h2, doc_id, copies, root) of each distinct text.

    Candidates come from two kinds of buckets: SimHash keys by the general pigeonhole principle, which hold all pairs within ``radius``
    bits, and bands of minimum hashes, which hold the pairs whose fingerprints lie further apart (at similarity 0.8 only one pair in
    sixty is within three bits). Pairs are tried in rounds: each node with the nearest of other groups in each of its buckets, first
    with one, then with eight times as many each round. Pairs whose counts by cells cannot reach the similarity are ruled out, the
    others verified on the whole texts and the groups contracted. Nodes whose pairs were all tried leave, and the rounds end when no untried pair of a bucket joins two groups. A bucket of
    more than ``large`` nodes is linked along its order in the first round and then split over many tasks.
    """
    source = _texts(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp, size, bands, cells = sketches(texts(batch), words)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int64)), lists, pa.array([c.tobytes() for c in cells], pa.binary())], [*names, "fp", "size", "bands", "cells"])

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = [similarity(x, y, words) >= least for x, y in zip(texts(batch, "x"), texts(batch, "y"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    names = ["doc_id", "_d", "_h1", "_h2"]
    marked = scratch.table(per_bytes(source, run, "doc_id long, _d long, _h1 long, _h2 long, fp long, size long, bands array<long>, cells binary"), "marked")
    one = marked.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "cells")])
    nodes = scratch.table(one.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    plan = allocate(*bit_counts(nodes), radius)
    masks, limits = [_mask(bits) for bits, _ in plan], [radius] * len(plan) + [ALL_BITS] * BANDS
    open_, stars, tried, hot, held = nodes.select("node", "fp", "size", "bands", F.col("node").alias("grp")), None, None, None, None
    for n in count():
        rows = keyed(open_, plan, "size", "node", "grp").unionByName(open_.select(F.posexplode("bands").alias("part", "key"), "fp", "size", "node", "grp").withColumn("part", F.col("part") + len(plan)))
        if n:  # few nodes are left, which may have many pairs: their cells rule out most before any text is read
            rows = rows.join(open_.select("node", "cells"), "node")
        if hot is None:
            rows = rows.repartition("part", "key").sortWithinPartitions("part", "key", "fp", "node").withColumns({"cell": F.lit(-1), "side": F.lit(2)})
        else:
            rows = split(rows, hot, scratch, f"cells-{n}", large).repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell", "fp", "node")
        met = scratch.table(rows.select(*ROW, *(["cells"] if n else [])).mapInArrow(_candidates(limits, masks, least, 8**n, large), "kind int, a long, b long"), f"met-{n}")
        pairs = met.filter(F.col("kind") == PAIR).select("a", "b").distinct()
        more = met.filter(F.col("kind") == MORE).select(F.col("a").alias("node")).distinct()
        if held is None:
            hot = scratch.table(met.filter(F.col("kind") == LARGE).select(F.col("a").cast("int").alias("part"), F.col("b").alias("key")).distinct(), "hot")
            hot = None if hot.isEmpty() else hot
            # the texts of nodes that have a pair; later rounds only see nodes of these
            used = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(more).distinct()
            used = scratch.table(nodes.join(used, "node", "left_semi").select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"), "_h1", "_h2"), "used")
            held = scratch.table(source.join(_side(used, 32), ["_d", "_h1", "_h2"]).select("node", "text").dropDuplicates(["node"]), "held")
        pairs = scratch.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{n}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        both = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
        links = scratch.table(per_batch(both, verify, "a long, b long", rows=500), f"links-{n}")
        if stars is None or not links.isEmpty():
            edges = links if stars is None else links.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
            stars = components(edges, scratch, f"cc{n}")
        open_ = scratch.table(nodes.join(more, "node", "left_semi").join(stars, "node", "left").select("node", "fp", "size", "bands", "cells", F.coalesce("root", "node").alias("grp")), f"open-{n}")
        scratch.drop(f"met-{n}")
        if open_.isEmpty():
            break
    scratch.drop("held")
    return marked.select(*names), nodes.drop("fp", "size", "bands", "cells").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, large: int = 2048) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``: groups of texts whose word shingles have similarity ``least`` or more.

    Equal texts are one node; two texts under one doc_id are two. component_id is the smallest doc_id of the group, null if it has none.
    Texts without a word are alike. An empty table gives an empty result; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows, nodes = _groups(docs, scratch, words, least, radius, large)
    nodes = scratch.table(nodes, "groups")
    named = nodes.join(nodes.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("_h1", "_h2", "component_id")
    named = scratch.table(named, "named")
    scratch.only("marked", "named")
    return rows.join(named, ["_h1", "_h2"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, large: int = 2048) -> DataFrame:
    """One row of each group of ``near_duplicates``, with all columns: that of the smallest doc_id, one row of it if it repeats.

    Rows without a doc_id come last in their group; of texts under one doc_id the one with the smaller hash stays.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    _, nodes = _groups(docs, scratch, words, least, radius, large)
    least_id = F.coalesce("doc_id", F.lit(-(2**63)))
    best = nodes.groupBy("root").agg(F.min_by(F.struct(least_id.alias("_d"), "_h1", "_h2", (F.col("copies") > 1).alias("_several")), F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2")).alias("r"))
    kept = scratch.table(best.select("r.*"), "kept")
    scratch.only("kept")
    text, ident = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    marked = docs.withColumns({"_d": F.coalesce(ident, F.lit(-(2**63))), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)})
    found = marked.join(_side(kept, 32), ["_d", "_h1", "_h2"])
    # a text that no other row has cannot repeat
    return found.filter(~F.col("_several")).unionByName(found.filter("_several").dropDuplicates(["_d", "_h1", "_h2"])).select(*docs.columns)
