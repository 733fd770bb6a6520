"""Small groups replayed in order, many of them in one stream of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def replay(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterable[dict]], schema: T.StructType) -> DataFrame:
    """``fn`` over the rows of each group as dictionaries, in order.

    Spark deals rows by key and sorts them; a task then reads its partition batch by batch and hands over a group when the key changes, so
    very many small groups cost no call into Python each. Memory holds one batch and one group.
    """
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at, types = None, None
        for batch in batches:
            types = types or {f.name: f.type for f in batch.schema}
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != at:
                    out += fn(held)
                    held = []
                at = key
                held.append(row)
            if out:
                yield _batch(out, names, types)
        if held:
            yield _batch(list(fn(held)), names, types)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)
