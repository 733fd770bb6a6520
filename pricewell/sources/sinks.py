"""Writing without MERGE: every change is a new frame, written beside the old table and swapped in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def toggle(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are there go, rows that are not come."""
    return old.exceptAll(rows).unionByName(rows.exceptAll(old))


def patch(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The named columns replaced where a key has a change (null clears); other columns stay."""
    c = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(x).alias(f"_{x}") for x in columns])
    met = old.join(c, keys, "left")
    return met.withColumns({x: F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).select(*old.columns)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(parent_gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Children without the rows of deleted parents."""
    return {name: df.join(parent_gone.select(F.col(key).alias(fk)).distinct(), fk, "left_anti") for name, (df, fk) in children.items()}


def replace_scope(old: DataFrame, new: DataFrame, scope: Column | None, key: Column) -> DataFrame:
    """Without a scope: nothing happens if the key already has rows. With one: rows in scope make way for the new."""
    if scope is None:
        there = old.filter(key).limit(1).select(F.lit(True).alias("_t"))
        return old.unionByName(new.join(F.broadcast(there), F.lit(True), "left_anti"))
    return old.filter(~(key & scope)).unionByName(new)


def lay_out(df: DataFrame, path: str, by: list[str]) -> None:
    """A table in a folder for each value of ``by``, so that readers of one value open no other folder; each value's rows are written by one task a value and hash."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """The folders of the values that ``df`` has, replaced by its rows; all others stay as they are.

    ``df`` must not read from ``path`` itself: write it elsewhere first where it does.
    """
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> str:
    """The folder of a table's current version: that with the highest number whose write was finished."""
    fs, p = _fs(spark, path)
    done = [f.getPath() for f in (fs.listStatus(p) if fs.exists(p) else []) if f.getPath().getName().startswith("v=") and fs.exists(p.suffix(f"/{f.getPath().getName()}/_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"{path} has no version")
    return max((int(d.getName()[2:]), d.toString()) for d in done)[1]


def swap(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Write the table's next version and make it the current one; returns its folder.

    A version is a folder of its own, and counts once Spark has marked its write as finished: readers of ``current`` see the old or the
    new table, a failed job leaves the old one. All but the ``keep`` newest versions go, so who reads an older one can finish.
    """
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in (fs.listStatus(p) if fs.exists(p) else [])]
    numbers = sorted(int(n[2:]) for n in names if n.startswith("v="))
    number = numbers[-1] + 1 if numbers else 0
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/v={number}")
    for old in numbers[: max(0, len(numbers) + 1 - keep)]:
        fs.delete(p.suffix(f"/v={old}"), True)
    return f"{path}/v={number}"


def wipe(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> None:
    """Every table (path, schema) gets an empty version."""
    for path, schema in tables.values():
        swap(spark, spark.createDataFrame([], schema), path)
