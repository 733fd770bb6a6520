"""Audit of how far the word use of sources differs, language by language.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps
the terms of at least ``min_docs`` of its documents. Each (language, source) group, and each language as a
whole, gives a kept term with ``count`` occurrences the share p = 1 + floor(scale * (count + 1) / (N + V)), where N
is the sum of its counts and V the number of kept terms. A term's divergence of p from q is floor((p - q)^2 / q).

Counting: each task counts its slice of documents by (language, source, term) and sends sums only,
so a frequent word or a large source is a row a task. Kept terms are dealt by hash to vocabulary chunks of about
``chunk_terms`` terms and numbered inside their chunk; a group's counts in a chunk are packed in two arrays.

Pairs: the groups of a language fall into blocks of about ``block`` groups. The packed counts of a group are
sent to all tiles (block by block, each unordered pair of blocks once) that its block takes part in; a tile is
cut along the vocabulary into spans of ``span`` chunks. A task has one tile and one span: it goes
through the chunks one after the other, holds two blocks' counts of one chunk as a dense matrix, and adds to
the tile's submatrix of divergences, in both directions. Spark sums the spans. No task
sees more than 2 * block groups times span * chunk_terms terms, however many sources or words there are.

All arithmetic is exact: counts are 64-bit integers, and shares are divided digit by digit (three
digits a step), which holds up to N + V of 9e15; beyond that the job ends with an error.

Cases: null text, lang and source are ''. A group without a term takes part (all its counts are
0), a language without kept terms has pairs of value 0 and no terms, one with a single source no pairs. Each
repeated row counts as a document. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, per_bytes, texts

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # in UTF-8, bytes from 0x80 on are the characters beyond ASCII
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MOST = (2**63 - 1) // 1000  # largest divisor whose remainder times 1000 is still a long


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of the slice; a row with a null term stands for the group itself."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch), strict=True):
        words = TERM.findall(text.translate(LOWER))
        counts.setdefault((lang, source), Counter()).update(words)
        docs.setdefault((lang, source), Counter()).update(set(words))
    for (lang, source), c in counts.items():
        d = docs[lang, source]
        terms = [None, *c]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *c.values()], pa.int64()),
                pa.array([0, *(d[t] for t in c)], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: np.ndarray, total: np.ndarray, scale_steps: int = 3) -> np.ndarray:
    """1 + floor(1000^scale_steps * (count + 1) / total), exact in 64 bits."""
    total = np.asarray(total, np.int64)
    if total.size and int(total.max()) > MOST:
        raise OverflowError("too many occurrences for exact 64-bit shares")
    rest, out = count.astype(np.int64) + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(scale_steps):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def share_column(count: str, total: str):
    """The same as an expression; a product beyond 64 bits is an error."""
    rest, parts = f"({count} + 1L)", []
    for _ in range(3):
        parts.append(f"(({rest} * 1000L) div {total})")
        rest = f"(({rest} * 1000L) % {total})"
    a, b, c = parts
    return F.expr(f"1L + {a} * 1000000L + {b} * 1000L + {c}")


def _tile(key, table):
    """One tile and span: the divergence sums of its pairs of groups."""
    groups: dict[str, tuple[int, int]] = {}  # source -> block, N + V
    chunks: dict[int, list] = {}
    sizes: dict[int, int] = {}
    columns = [table.column(c).to_pylist() for c in ("source", "block", "total", "chunk", "size")]
    at, n = table.column("at").combine_chunks(), table.column("n").combine_chunks()
    for row, (source, block, total, chunk, size) in enumerate(zip(*columns, strict=True)):
        groups[source] = (block, total)
        sizes[chunk] = size
        chunks.setdefault(chunk, []).append((source, row))
    names = sorted(groups)
    place = {s: k for k, s in enumerate(names)}
    blocks = np.array([groups[s][0] for s in names])
    totals = np.array([max(groups[s][1], 1) for s in names], np.int64)[:, None]
    sums = np.zeros((len(names), len(names)), np.int64)
    lo, hi = key[1].as_py(), key[2].as_py()
    for chunk in sorted(chunks):
        dense = np.zeros((len(names), sizes[chunk]), np.int64)
        for source, row in chunks[chunk]:
            if at[row].is_valid:
                dense[place[source], at[row].values.to_numpy()] = n[row].values.to_numpy()
        p = share(dense, totals)
        for i in range(len(names)):
            # the pairs of one tile: its two blocks with each other, or one block with itself
            other = np.flatnonzero(blocks == (hi if blocks[i] == lo else lo))
            for a in range(0, len(other), 8):
                q = p[other[a : a + 8]]
                d = p[i] - q
                sums[i, other[a : a + 8]] += (d * d // q).sum(axis=1)
    i, j = np.nonzero((blocks[:, None] == lo) & (blocks[None, :] == hi) | (blocks[:, None] == hi) & (blocks[None, :] == lo))
    i, j = i[i != j], j[i != j]
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(i), pa.string()),
        "source": pa.array([names[k] for k in i], pa.string()),
        "item": pa.array([names[k] for k in j], pa.string()),
        "value": pa.array(sums[i, j]),
    })


def audit_sources(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, block: int = 16, chunk_terms: int = 1 << 15, span: int = 4) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source of the language, part ``term`` for the terms a source uses more than its language, ``top_terms`` of them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = per_bytes(rows, _count, "lang string, source string, term string, n long, docs long", 16 << 20)
    counted = scratch.table(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")

    vocabulary = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = counted.filter("term IS NOT NULL").drop("docs").join(vocabulary, ["lang", "term"])
    kept = scratch.table(kept, "kept")
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = scratch.table(counted.select("lang").distinct().join(langs, "lang", "left").fillna(0, ["v", "lang_total"]), "langs")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang")
    groups = groups.select("lang", "source", (F.coalesce("total", F.lit(0)) + F.col("v")).alias("total"), "v", (F.col("lang_total") + F.col("v")).alias("lang_total"))
    groups = scratch.table(groups, "groups")
    scratch.drop("counted")
    return _pairs(kept, groups, scratch, block, chunk_terms, span).unionByName(_terms(kept, groups, top_terms))


def _ranked(df: DataFrame, part: str):
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Terms with a larger share in the group than in the language; the limit is applied before the shuffle, too."""
    met = kept.filter("n > 0").join(groups, ["lang", "source"])
    shares = met.select("lang", "source", F.col("term").alias("item"), share_column("n", "total").alias("p"), share_column("lang_n", "lang_total").alias("q")).filter("p > q")
    return _ranked(shares.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")), "term").filter(F.col("rank") <= most)


def _pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch, block: int, chunk_terms: int, span: int) -> DataFrame:
    """Divergence of each group from each other source of its language."""
    shape = groups.groupBy("lang").agg(F.first("v").alias("v"), F.ceil(F.count("*") / block).alias("blocks"))
    shape = scratch.table(shape.withColumn("chunks", F.greatest(F.ceil(F.col("v") / chunk_terms), F.lit(1))), "shape")
    terms = kept.select("lang", "term").distinct().join(shape.select("lang", "chunks"), "lang")
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks")).drop("chunks")
    # about chunk_terms terms meet in a partition of this window
    terms = terms.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    sizes = terms.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    packed = kept.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("v"))
    packed = packed.select("lang", "source", "chunk", F.col("v.at").alias("at"), F.col("v.n").alias("n"))
    # each group has a row for each chunk of its language, with or without counts there
    grid = groups.select("lang", "source", "total").join(shape, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    grid = grid.join(sizes, ["lang", "chunk"], "left").fillna(0, ["size"]).withColumn("block", F.pmod(F.xxhash64("source", F.lit(7)), "blocks"))
    vectors = grid.join(packed, ["lang", "source", "chunk"], "left")
    vectors = scratch.table(vectors.select("lang", "source", "total", "chunk", "size", "block", "blocks", "at", "n"), "vectors")
    tiles = vectors.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.expr(f"chunk div {span}").alias("span")).drop("other", "blocks")
    parts = tiles.groupBy("lang", "lo", "hi", "span").applyInArrow(_tile, "lang string, source string, item string, value long")
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
