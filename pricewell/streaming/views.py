"""The same transforms over streams: files in, windows and latest prices out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pricewell.sources.sinks import _fs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 50) -> DataFrame:
    """New event files as they come, so many at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows a day and type; state older than the watermark is dropped."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> DataStreamWriter:
    """A table of the newest row of each key, as large as the number of keys, rewritten with every micro-batch.

    Each batch writes a numbered version, so a batch that is run again writes the same version again; two versions are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        if number > 0:
            old = spark.read.parquet(f"{path}/v={number - 1}")
            both = old.unionByName(newest).groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        else:
            both = newest
        both.write.mode("overwrite").parquet(f"{path}/v={number}")
        if number > 1:  # the version before is what a repeated batch reads
            fs, old = _fs(spark, f"{path}/v={number - 2}")
            fs.delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


