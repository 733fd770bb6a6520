"""Shared pieces: the scratch folder all executors see, and byte-level text helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a new one of this machine where it is unset and all tasks run here, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pricewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables under the shared folder.

    ``table`` writes a frame as Parquet and reads it back: lineage ends there, a lost
    executor costs a task and not the chain, and the shuffle files behind it are freed as
    soon as it is written. ``drop`` frees a table that later steps no longer need; the rest
    goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self._remove, self.base)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            self._remove(self.path(n))
            self.names.discard(n)

    def only(self, *names: str) -> None:
        """Frees all tables but these."""
        self.drop(*(self.names - set(names)))


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Inside, each finished query deletes its shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cuts(batch: pa.RecordBatch, rows: int, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes of a column, one row at least."""
    if not batch.num_rows:
        return
    at = np.arange(batch.num_rows) // rows
    if column in batch.schema.names:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = at * (1 << 32) + np.cumsum(size, dtype=np.int64) // most
    begin = starts_of(at)
    for a, e in zip(begin.tolist(), np.append(begin[1:], len(at)).tolist(), strict=True):
        yield batch.slice(a, e - a)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema, rows: int = 2000, most: int = 4 << 20) -> DataFrame:
    """``fn`` over slices of Arrow batches; memory follows one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in cuts(b, rows, most):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_text(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the keys and the text: extra columns, also of clashing names, go no further."""
    return df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("text"))


def per_bytes(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema, most: int = 4 << 20) -> DataFrame:
    """``fn`` over slices that hold about ``most`` bytes of text: as large as the arrays made of it allow."""
    return per_batch(df, fn, schema, 1 << 20, most)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 64
with np.errstate(over="ignore"):
    _TABLE = mix64(np.arange(_PLACES * 256, dtype=np.uint64), 3)


_NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(raw: list[bytes], lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the number of words of each text.

    A word is a run of bytes other than ASCII white space, or with ``plain`` a run of letters, digits
    and bytes beyond ASCII. Its hash is the sum of a fixed random
    value for each byte and place in the word, so one pass over the bytes hashes all words.
    """
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    space = (_NOT_ALNUM if plain else _SPACE)[data]
    if lower:
        data = _LOWER[data]
    before = np.concatenate(([True], space[:-1]))
    first = before & ~space
    start = np.flatnonzero(first)
    size = np.array([len(x) + 1 for x in raw], np.int64)
    count = np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(size)))))
    if not len(start):
        return np.zeros(0, np.uint64), count
    at = np.flatnonzero(~space)
    word = np.cumsum(first[at]) - 1
    place = at - start[word]
    with np.errstate(over="ignore"):
        v = _TABLE[((place & (_PLACES - 1)) << 8) | data[at]]
        far = place >= _PLACES
        if far.any():
            v[far] = mix64(v[far] + (place[far] // _PLACES).astype(np.uint64), 4)
        total = np.add.reduceat(v, np.flatnonzero(first[at]))
    return mix64(total, 5), count


def shingles(v: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles from their words' hashes, in order, and how many each text has; fewer words are one shingle."""
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    base = np.cumsum(n) - n
    at = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    length = np.repeat(np.minimum(n, words), count)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            use = length > k
            if use.all():
                h = (h + v[at + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            else:
                h[use] = (h[use] + v[at[use] + k]) * np.uint64(0xD6E8FEB86659FD93)
                h[use] ^= h[use] >> np.uint64(32)
    return mix64(h, 9), count
