"""Exchange of positions in texts: marks that occur more than once, and answers gathered by document.

Positions travel packed: one row for each slice of documents and partition, with the positions'
names as fixed-width bytes. A name that a slice holds several times is sent once, and the slice
answers its other positions itself, so a name in a third of all texts costs a partition one entry
a slice. There are as many packs as slices times partitions, the square of the input: so a slice is
packed as a whole, a pack costs one compression, and a partition's packs are opened together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, mix64, partitions, per_bytes, starts_of, texts

NULL_ID = -(2**63)
PACK = "shard int, kind int, n binary, body binary, plain binary"
NAMES = [x.split()[0] for x in PACK.split(", ")]
SENT, ANSWER = 0, 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key under which answers return: doc_id (null as the least) and text hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), text.alias("text"), F.coalesce(ident, F.lit(NULL_ID)).alias("_d"), F.xxhash64(text).alias("_h"))


def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("_d").to_numpy(), batch.column("_h").to_numpy()


SMALL = 256  # bytes below which compressing costs more than it saves


def squeeze(raw: bytes) -> bytes:
    return raw if len(raw) < SMALL else pa.compress(raw, codec="zstd", asbytes=True)


def opened(data: bytes, size: int) -> bytes:
    """The ``size`` bytes that were squeezed; their number tells whether they are compressed."""
    return data if size < SMALL else pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _steps(x: np.ndarray, at: np.ndarray, kind) -> np.ndarray:
    """Differences to the value before; the first of each pack as it is."""
    out = np.diff(x, prepend=x[:1])
    out[at] = x[at]
    return out.astype(kind)


def _sums(step: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values whose ``_steps`` these are, in packs of ``n`` values."""
    total = np.cumsum(step, dtype=np.int64)
    at = np.cumsum(n) - n
    at = at[n > 0]
    return total - np.repeat(total[at] - step[at], n[n > 0])


def packs(shard: np.ndarray, kind: int, doc: np.ndarray, d: np.ndarray, h: np.ndarray, steps: Sequence[np.ndarray], columns: Sequence[np.ndarray] = (), plain: Sequence[np.ndarray] = (), tables: Sequence[tuple[np.ndarray, Sequence[np.ndarray], Sequence[np.ndarray]]] = ()) -> Iterator[pa.RecordBatch]:
    """One packed row for each shard.

    An entry has its document ``doc`` (with key ``d``, ``h``), whole numbers that mostly go
    up by little (``steps``, its position first), and values that compress (``columns``) or do not (``plain``).
    ``tables`` hold what entries refer to, ordered by shard: how many rows each shard has, and values of either kind. Entries that come document by document pack best; any order is right.
    """
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")
    shard, doc = shard[order], doc[order]
    at = starts_of(shard)
    n = np.diff(np.append(at, len(shard)))
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    new[at] = True
    own = np.flatnonzero(new)
    own_at = np.searchsorted(own, at)
    m = np.diff(np.append(own_at, len(own)))
    packed = [(m, _steps(d[doc[own]], own_at, np.int64)), (m, np.diff(np.append(own, len(doc))).astype(np.uint32))]
    packed += [(n, _steps(x[order], at, np.int32)) for x in steps] + [(n, x[order]) for x in columns]
    whole = [(m, h[doc[own]])] + [(n, x[order]) for x in plain]
    for rows, some, others in tables:
        packed += [(rows, x) for x in some]
        whole += [(rows, x) for x in others]

    def joined(fields: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        cut = []
        for rows, x in fields:
            view, end = memoryview(np.ascontiguousarray(x).view(np.uint8)), (np.cumsum(rows) * x.itemsize).tolist()
            cut.append([view[a:e] for a, e in zip([0, *end[:-1]], end, strict=True)])
        return [b"".join(x) for x in zip(*cut, strict=True)]

    counts = np.stack((n, m, *(t[0] for t in tables)), axis=1).astype(np.int64)
    values = (pa.array(shard[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), *(pa.array(x, pa.binary()) for x in ([x.tobytes() for x in counts], [squeeze(x) for x in joined(packed)], joined(whole))))
    yield pa.RecordBatch.from_arrays(list(values), NAMES)


class Entries(NamedTuple):
    """What packs hold: keys of documents; of each entry its document and its values; tables, and in which pack's part of them its entry may look."""

    d: np.ndarray
    h: np.ndarray
    doc: np.ndarray
    steps: list[np.ndarray]
    columns: list[np.ndarray]
    plain: list[np.ndarray]
    tables: list[list[np.ndarray]]
    first: list[np.ndarray]  # of each table, where the rows of an entry's pack begin

    @property
    def pos(self) -> np.ndarray:
        return self.steps[0]


def unpack(rows: list[dict], steps: int = 1, columns: Sequence = (), plain: Sequence = (), tables: Sequence[tuple[Sequence, Sequence]] = ()) -> Entries:
    """The packs' entries, one pack after another; ``columns``, ``plain`` and ``tables`` name the types that ``packs`` got."""
    counts = np.array([np.frombuffer(r["n"], np.int64) for r in rows])
    packed = [(1, np.int64), (1, np.uint32), *[(0, np.int32)] * steps, *((0, x) for x in columns)]
    whole = [(1, np.uint64), *((0, x) for x in plain)]
    for k, (some, others) in enumerate(tables):
        packed += [(2 + k, x) for x in some]
        whole += [(2 + k, x) for x in others]

    def parted(fields: list[tuple[int, type]], column: str) -> list[np.ndarray]:
        end = np.cumsum(np.stack([counts[:, k] * np.dtype(x).itemsize for k, x in fields], axis=1), axis=1)
        cut = [[] for _ in fields]
        for r, e in zip(rows, end.tolist(), strict=True):
            view, a = memoryview(opened(r[column], e[-1]) if column == "body" else r[column]), 0
            for own, b in zip(cut, e, strict=True):
                own.append(view[a:b])
                a = b
        return [np.frombuffer(b"".join(own), x) for own, (_, x) in zip(cut, fields, strict=True)]

    d, c, *packed = parted(packed, "body")
    h, *whole = parted(whole, "plain")
    n, m = counts[:, 0], counts[:, 1]
    k, p = steps + len(columns), len(plain)
    found, first = [], []
    for t, (some, others) in enumerate(tables):
        found.append([*packed[k : k + len(some)], *whole[p : p + len(others)]])
        k, p = k + len(some), p + len(others)
        first.append(np.repeat(np.cumsum(counts[:, 2 + t]) - counts[:, 2 + t], n))
    return Entries(_sums(d, m), h.view(np.int64), np.repeat(np.arange(len(c)), c), [_sums(x, n) for x in packed[:steps]], packed[steps : steps + len(columns)], whole[: len(plain)], found, first)


def by_doc(d: np.ndarray, h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(d.view(np.uint64) ^ mix64(h.view(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def exchange(sent: DataFrame, layout: dict, answer: Callable[[Entries], Iterator[tuple[np.ndarray, ...]]], scratch: Scratch, name: str, runs: bool = False) -> DataFrame:
    """(_d, _h, found): for each document the sorted positions that partitions and slices answered.

    ``answer`` gets a partition's entries (``layout``: how to ``unpack`` them) and yields the places of those whose
    position is an answer; packs of kind ANSWER were answered where they were made and pass through. With ``runs`` an answer
    stands for n positions from pos on: ``answer`` yields (place, pos, n), packs carry n as their column.
    """
    buckets = parts = partitions(scratch.spark)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[dict] = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            if (kind == ANSWER).any():
                yield b.filter(pa.array(kind == ANSWER))
            asked += b.filter(pa.array(kind == SENT)).to_pylist()
        if not asked:
            return
        e = unpack(asked, **layout)
        asked.clear()
        at, *more = (np.concatenate(x) for x in zip(*answer(e), strict=True))
        order = np.argsort(at, kind="stable")  # document by document
        at, more = at[order], [x[order] for x in more]
        yield from packs(by_doc(e.d, e.h, buckets)[e.doc[at]], ANSWER, e.doc[at], e.d, e.h, more[:1] or [e.pos[at]], [x.astype(np.uint32) for x in more[1:]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        e = unpack(rows, columns=[np.uint32] if runs else [])
        order = np.lexsort((e.h, e.d))
        new = np.concatenate(([True], (e.d[order][1:] != e.d[order][:-1]) | (e.h[order][1:] != e.h[order][:-1])))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        key = (number[e.doc] << 32) | e.pos
        if runs:
            order_of = np.argsort(key)
            key = key[order_of]
            values = np.stack(((key & 0xFFFFFFFF).astype(np.uint32), e.columns[0][order_of]), axis=1)
        else:
            key = np.unique(key)
            values = (key & 0xFFFFFFFF).astype(np.uint32)
        at = starts_of(key >> 32)
        blobs = [values[a:z].tobytes() for a, z in zip(at.tolist(), np.append(at[1:], len(key)).tolist(), strict=True)]
        one = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(e.d[one]), pa.array(e.h[one]), pa.array(blobs, pa.binary())], ["_d", "_h", "found"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, "shard")

    answered = dealt(dealt(sent).mapInArrow(reduce, PACK)).mapInArrow(gather, "_d long, _h long, found binary")
    return scratch.table(answered, name)


def join_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with their answered positions; only the positions are held in a hash table."""
    return docs.join(found.hint("shuffle_hash"), ["_d", "_h"], "left")


def positions(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value, np.uint32).astype(np.int64) if value else np.zeros(0, np.int64)


def stretches(value: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of positions begin and how many each has."""
    both = positions(value).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def repeated_marks(docs: DataFrame, marks: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], scratch: Scratch, name: str, most: int = 4 << 20) -> DataFrame:
    """(_d, _h, found): numbers of each document's marks whose name occurs twice or more anywhere; a few others too.

    ``marks`` gives, for a slice of texts (about ``most`` bytes), the marks' names (uint64, in text order) and the
    number of marks of each text. Of a name 32 bits travel, beside the partition: names that are taken for equal
    are one in some thousands.
    """
    parts = partitions(scratch.spark)

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, count = marks(texts(batch))
        if not len(names):
            return
        d, h = keys_of(batch)
        doc = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(names)) - (np.cumsum(count) - count)[doc]
        order = np.argsort(names)
        at = starts_of(names[order])
        n = np.diff(np.append(at, len(names)))
        twice = np.zeros(len(names), bool)
        twice[order] = np.repeat(n > 1, n)
        one = np.sort(order[at])  # one mark of each name, in text order again
        part, short = (x.astype(kind) for x, kind in zip(np.divmod(names[one], np.uint64(parts))[::-1], (np.int32, np.uint32), strict=True))
        yield from packs(part, SENT, doc[one], d, h, [pos[one]], [twice[one].astype(np.uint8)], [short])
        yield from packs(by_doc(d, h, parts)[doc[twice]], ANSWER, doc[twice], d, h, [pos[twice]])

    def answer(e: Entries) -> Iterator[tuple[np.ndarray]]:
        name = e.plain[0]
        order = np.argsort(name)
        at = starts_of(name[order])
        n = np.diff(np.append(at, len(name)))
        yield (order[np.repeat(n > 1, n) & (e.columns[0][order] == 0)],)  # flagged ones were answered by their slice

    return exchange(per_bytes(docs, send, PACK, most), {"columns": [np.uint8], "plain": [np.uint32]}, answer, scratch, name)
