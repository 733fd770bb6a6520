"""Line deduplication over a sharded minimal perfect hash.

Counting: every document row emits the 128-bit hashes of its distinct long line keys; they are
combined per Arrow batch, then by Spark's partial and final aggregation, so a line held by
a third of all documents is a handful of rows when it is shuffled.

Index: all distinct hashes are cut into shards by hash. Each shard is
a minimal perfect hash (levels of collision-free bits with ranks) into three compact arrays:
fingerprint, document count and largest doc_id.

Probe: documents send packed hashes (never lines) to the shards, which stream past the probes and look
counts up in their arrays; only lines to be dropped return. Keys of ``hot_docs`` documents or more (as many
as fit ``broadcast_bytes``, the most frequent first) are held by an index of their own that all tasks get, and documents probe it where they
lie: so no shard key is hot.

Cases: null or empty text is one empty line. Every row counts as a document, also when its
doc_id repeats; rows of the largest doc_id keep the line, however many they are; a null doc_id sorts below all others. An empty
table gives an empty result. Other columns are carried, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.common import Scratch, mix64, partitions, per_batch, starts_of, texts

KEY_BYTES = 24  # fingerprint, count, doc_id and the hash's own bits
NULL_ID = -(2**63)


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys; all steps are array operations."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate(([0], np.cumsum(bits))).astype(np.int64))
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels = []
        while len(keys):
            slots = mix64(keys, len(levels)) % np.uint64(max(1, int(gamma * len(keys))))
            held = np.bincount(slots.astype(np.int64), minlength=max(1, int(gamma * len(keys))))
            levels.append(held == 1)
            keys = keys[held[slots.astype(np.int64)] > 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of the keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for n, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mix64(keys[left], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


class LineIndex:
    """One shard: perfect hash, and arrays of fingerprints, counts and largest doc_ids."""

    def __init__(self, place: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.place, self.prints, self.counts, self.last = place, prints, counts, last

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        # h1 may repeat where h2 differs; the perfect hash takes a mixture of both halves
        place = PerfectHash.build(mix64(h1) ^ h2)
        at = place(mix64(h1) ^ h2)
        arrays = [np.empty(len(h1), d) for d in (np.uint64, np.uint32, np.int64)]
        for a, v in zip(arrays, (h2, np.minimum(counts, 2**32 - 1), last), strict=True):
            a[at] = v
        return cls(place, *arrays)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """found, count and largest doc_id for each hash."""
        if not len(self.prints) or not len(h1):
            z = np.zeros(len(h1), np.int64)
            return z.astype(bool), z, z
        at = self.place(mix64(h1) ^ h2)
        found = (at >= 0) & (self.prints[at] == h2)
        return found, np.where(found, self.counts[at], 0), np.where(found, self.last[at], 0)

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, prints=self.prints, counts=self.counts, last=self.last, **{f"l{n}": np.packbits(b) for n, b in enumerate(self.place.levels)}, sizes=np.array([len(b) for b in self.place.levels], np.int64))
        return f.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> LineIndex:
        with np.load(io.BytesIO(data)) as z:
            levels = [np.unpackbits(z[f"l{n}"], count=int(s)).astype(bool) for n, s in enumerate(z["sizes"])]
            return cls(PerfectHash(levels), z["prints"], z["counts"], z["last"])


def long_keys(text: bytes, min_chars: int) -> tuple[int, list[int], list[bytes]]:
    """Number of lines, and place and key of those of at least ``min_chars`` code points."""
    lines = text.split(b"\n")
    places, keys = [], []
    for n, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip().lower()  # ASCII white space and letters only, as bytes
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                places.append(n)
                keys.append(key)
    return len(lines), places, keys


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _count(min_chars: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        for doc, text in zip(_ids(batch).tolist(), texts(batch), strict=True):
            own = set(long_keys(text, min_chars)[2])
            keys += own
            docs += [doc] * len(own)
        if not keys:
            return
        h, d = _hashes(keys), np.array(docs, np.int64)
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, d = h[order], d[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(d)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[at, 0].view(np.int64), h[at, 1].view(np.int64), n.astype(np.int64), np.maximum.reduceat(d, at))], ["h1", "h2", "n", "last"])

    return run


def _build(table: pa.Table) -> pa.Table:
    cols = [table.column(c).to_numpy() for c in ("h1", "h2", "n", "last")]
    index = LineIndex.build(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3])
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "data": pa.array([index.dumps()], pa.binary())})


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, data) with one serialised ``LineIndex`` for each shard of the hash space."""
    return keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, "shard int, data binary")


def _send(min_chars: int, shards: int, heavy):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        for doc, row, text in zip(_ids(batch).tolist(), batch.column("_row").to_pylist(), texts(batch), strict=True):
            own = set(long_keys(text, min_chars)[2])
            keys += own
            docs += [(doc, row)] * len(own)
        if not keys:
            return
        h, d = _hashes(keys), np.array(docs, np.int64)
        left = ~_heavy(heavy).probe(h[:, 0], h[:, 1])[0]
        h, d = h[left], d[left]
        shard = np.mod(h[:, 0].view(np.int64), shards).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        shard, h, d = shard[order], h[order], d[order]
        at = starts_of(shard)
        end = np.append(at[1:], len(shard))
        pack = [[np.ascontiguousarray(x[a:b]).tobytes() for a, b in zip(at, end, strict=True)] for x in (h, d)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array([None] * len(at), pa.binary()), *(pa.array(x, pa.binary()) for x in pack)], ["shard", "data", "hashes", "docs"])

    return run


def _answer(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come before their probes; one shard and one batch are held at a time."""
        at, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["data"] is not None:
                    at, index = row["shard"], LineIndex.loads(row["data"])
                    continue
                if row["shard"] != at:
                    raise ValueError(f"line hashes met no index of shard {row['shard']}")
                h, d = np.frombuffer(row["hashes"], "<u8").reshape(-1, 2), np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
                found, count, last = index.probe(h[:, 0], h[:, 1])
                hit = found & (count >= min_docs) & (last != d[:, 0])
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(d[hit, 0]), pa.array(d[hit, 1]), pa.array([x.tobytes() for x in h[hit]], pa.binary())], ["_id", "_row", "hash"])

    return run


_CACHE: dict[int, LineIndex] = {}


def _heavy(broadcast) -> LineIndex:
    if broadcast.id not in _CACHE:
        _CACHE.clear()
        _CACHE[broadcast.id] = LineIndex.loads(broadcast.value)
    return _CACHE[broadcast.id]


class _Held:
    """A broadcast with a name that Python workers can cache its unpacked form under."""

    def __init__(self, spark, data: bytes, name: str):
        self.id, self._b = name, spark.sparkContext.broadcast(data)

    @property
    def value(self) -> bytes:
        return self._b.value


def _apply(min_chars: int, heavy, carry: list[str], digest: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, found, raw = _ids(batch), [], texts(batch)
        for text in raw:
            found.append(long_keys(text, min_chars))
        keys = [k for _, _, own in found for k in own]
        h = _hashes(keys) if keys else np.zeros((0, 2), np.uint64)
        hit, _, last = _heavy(heavy).probe(h[:, 0], h[:, 1])
        drop = hit & (last != np.repeat(ids, [len(own) for _, _, own in found]))
        if "hits" in batch.schema.names:
            for n, (hits, a) in enumerate(zip(batch.column("hits").to_pylist(), np.cumsum([0] + [len(own) for _, _, own in found[:-1]]).tolist(), strict=True)):
                if hits:
                    told = set(hits)
                    for k in range(a, a + len(found[n][2])):
                        drop[k] |= h[k].tobytes() in told
        out, dropped, at = [], [], 0
        for text, (_, places, own) in zip(raw, found, strict=True):
            gone = {p for p, x in zip(places, drop[at : at + len(own)], strict=True) if x}
            at += len(own)
            dropped.append(len(gone))
            kept = b"\n".join(x for n, x in enumerate(text.split(b"\n")) if n not in gone) if gone else text
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array([n for n, _, _ in found], pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], [*carry, "n_lines", "n_dropped", "kept_sha256" if digest else "text"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 32 << 20, shard_keys: int = 1 << 18, hot_docs: int = 1024, digest: bool = False) -> DataFrame:
    """Drop frequent lines from all documents but the one with the largest doc_id.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    ``min_chars`` code points or more in ``min_docs`` documents or more lose their lines
    everywhere but in the largest doc_id. Returns the columns of ``docs`` with the kept
    ``text`` (or, with ``digest``, doc_id and ``kept_sha256`` alone), ``n_lines`` and ``n_dropped``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = per_batch(small, _count(min_chars), "h1 long, h2 long, n long, last long")
    counts = scratch.table(counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "counts")
    # hot keys by power of two: at most 64 rows, from which the cut between hot keys and the others follows
    least = F.lit(max(hot_docs, min_docs))
    sizes = {r["p"]: r["c"] for r in counts.filter(F.col("n") >= least).groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("c")).collect()}
    room, cut = broadcast_bytes // KEY_BYTES, None
    for p in sorted(sizes, reverse=True):
        if sizes[p] > room:
            break
        room, cut = room - sizes[p], p
    is_hot = F.lit(False) if cut is None else (F.col("n") >= least) & (F.col("n") >= 2**cut)
    found = build_shards(counts.filter(is_hot), 1).select("data").collect()
    empty = LineIndex.build(*(np.zeros(0, d) for d in (np.uint64, np.uint64, np.int64, np.int64))).dumps()
    heavy = _Held(spark, bytes(found[0]["data"]) if found else empty, scratch.base)

    carry = ["doc_id"] if digest else [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "hits", "_id", "_row")]
    source = small if digest else docs.select(*carry, F.col("text").cast("string").alias("text"))
    n_shards = max(1, math.ceil(counts.count() / shard_keys))
    index = scratch.table(build_shards(counts.filter(~is_hot), n_shards), "shards")
    row = F.xxhash64("text").alias("_row")
    probes = per_batch(small.select("*", row), _send(min_chars, n_shards, heavy), "shard int, data binary, hashes binary, docs binary")
    met = index.select("shard", "data", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("docs")).unionByName(probes)
    hits = met.repartition(max(partitions(spark), n_shards), "shard").sortWithinPartitions("shard", F.col("data").isNull()).mapInArrow(_answer(min_docs), "_id long, _row long, hash binary")
    # one list for each text of an id, no longer than the text's own lines: rows without an id, or with one id, do not get one another's
    hits = scratch.table(hits.groupBy("_id", "_row").agg(F.collect_set("hash").alias("hits")), "hits")
    scratch.only("hits")
    n_hits = hits.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    side = F.broadcast(hits) if n_hits * 56 <= broadcast_bytes else hits.hint("shuffle_hash")
    source = source.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_row", row).join(side, ["_id", "_row"], "left").drop("_id", "_row")
    kinds = {f.name: f.dataType for f in source.schema}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in carry), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256" if digest else "text", T.StringType())])
    out = per_batch(source, _apply(min_chars, heavy, carry, digest), schema)
    return out if digest else out.select(*[c for c in docs.columns if c in out.columns], *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
