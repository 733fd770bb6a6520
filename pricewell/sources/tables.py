"""Reading tables: declared schemas, pruned columns, and the offers star seen through other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.semantics import half_up

SCHEMAS = {
    "supermarkets": "id string, name string, slug string, city string, state string, active boolean, timezone string, network_type string",
    "stores": "id string, supermarket_id string, name string, city string, state string, latitude double, longitude double, active boolean",
    "flyers": "id string, supermarket_id string, source_id string, store_ids array<string>, title string, original_url string, external_id string, file_hash string, valid_from timestamp, valid_until timestamp, expired_at timestamp, status string, created_at timestamp, updated_at timestamp",
    "flyer_pages": "id string, flyer_id string, page_number int",
    "brands": "id string, name string, slug string, aliases array<string>",
    "canonical_products": "id string, canonical_name string, slug string, brand_id string, quantity string, unit string, match_key string, created_at timestamp, updated_at timestamp",
    "price_history": "id string, canonical_product_id string, supermarket_id string, offer_id string, price double, original_price double, member_price double, requires_membership boolean, membership_name string, valid_from timestamp, valid_until timestamp, created_at timestamp",
    "scraper_flows": "id string, supermarket_id string, name string, start_url string, status string, version int, next_run_at timestamp, last_run_at timestamp, discovery_attempts int",
    "scraper_runs": "id string, flow_id string, status string, started_at timestamp, finished_at timestamp, error string, flyers_found int",
    "shopping_list_items": "id string, list_id string, query_text string, offer_id string, canonical_product_id string, quantity double",
}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def star_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table of the offers star with its declared schema: nothing is inferred, no footer is read twice."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{base}/{name}")


def raw_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of files of extracted text, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def binary_pages(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files with their content."""
    return spark.read.format("binaryFile").load(path)


def prices(spark: SparkSession, base: str) -> DataFrame:
    """Price facts: product, market, time, price, original price, whether members only, and validity of 30 days."""
    li = table(spark, base, "lineitem")
    original = half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return li.select(
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("market"),
        F.col("l_shipdate").alias("created_at"),
        original.alias("original"),
        half_up(original * (1 - F.col("l_discount")), 2).alias("price"),
        (F.col("l_returnflag") == "R").alias("club"),
        F.col("l_shipdate").alias("valid_from"),
        (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("valid_until"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMddHHmmss")).alias("offer_id"),
    )


#: The same frame in DuckDB, for oracles.
PRICES_SQL = """
prices0 AS (SELECT *, CAST(floor(l_extendedprice / l_quantity * 100.0 + 0.5) AS DOUBLE) / 100.0 AS original FROM lineitem),
prices AS (SELECT l_partkey AS product, l_suppkey AS market, l_shipdate AS created_at, original,
  CAST(floor(original * (1 - l_discount) * 100.0 + 0.5) AS DOUBLE) / 100.0 AS price, l_returnflag = 'R' AS club,
  l_shipdate AS valid_from, l_shipdate + INTERVAL 30 DAY AS valid_until,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d%H%M%S')) AS offer_id FROM prices0)"""
