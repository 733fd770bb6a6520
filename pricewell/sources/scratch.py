"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def dealt(df: DataFrame, rounds: int = 4) -> DataFrame:
    """The rows dealt out over all cores, some tasks a core: for small rows with much work each, which else run in as few tasks as their files have parts."""
    return df.repartition(rounds * df.sparkSession.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a new one in local mode and an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pricewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str = "tables") -> str:
    """A name under the shared folder that nobody else has; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return path


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """A frame that several results need: worked out once, written, and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
