"""The offers star seen through the tables at hand: each frame is one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pricewell.functions.text import UNIT_ALIASES, UNITS
from pricewell.sources.tables import table

FRAMES = {
    "offers": """SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS n, CAST(p_partkey % 40 + 1 AS STRING) AS flyer_id, p_partkey % 7 + 1 AS supermarket_id, p_name AS name, lower(p_name) AS normalized_name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE p_brand END AS brand,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1,5' WHEN 2 THEN '500' WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE CAST(p_size AS STRING) END AS quantity,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Kilos' WHEN 2 THEN 'lt.' WHEN 3 THEN 'UNID' WHEN 4 THEN 'dozen' WHEN 5 THEN 'ml' ELSE '' END AS unit,
  CASE p_partkey % 50 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) WHEN 2 THEN CAST(9000 AS DOUBLE) WHEN 3 THEN CAST(5000 AS DOUBLE) ELSE p_retailprice END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 WHEN p_partkey % 3 = 1 THEN p_retailprice / 2 END AS original_price,
  CASE WHEN p_partkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_partkey % 101 AS DOUBLE) / 100 END AS confidence,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ALL_CUSTOMERS' WHEN 2 THEN 'APP_ONLY' ELSE 'STORE_CARD' END AS eligibility,
  CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'validated' WHEN 2 THEN 'rejected' WHEN 3 THEN 'suspicious' ELSE 'pending' END AS validation_status,
  CASE WHEN p_partkey % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE p_partkey % 4 + 1 END AS page_number, CASE WHEN p_partkey % 8 = 2 THEN 'Clube X' END AS condition_name,
  CASE WHEN p_partkey % 13 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE CAST('2001-01-01' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * CAST(p_partkey % 400 AS INTEGER) END AS valid_from,
  CASE WHEN p_partkey % 17 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE CAST('2001-01-21' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * CAST(p_partkey % 400 AS INTEGER) END AS valid_until,
  CAST('2001-01-01' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * CAST(p_partkey % 365 AS INTEGER) AS created_at, CASE WHEN p_partkey % 3 > 0 THEN 'p' || CAST(p_partkey % 60 AS STRING) END AS canonical_product_id FROM {part}""",
    "flyers": """SELECT CAST(o_orderkey AS STRING) AS id, o_orderkey AS n, o_custkey % 50 + 1 AS supermarket_id, o_custkey % 9 AS source_id, o_orderpriority AS title, 'https://shop.example/' || CAST(o_orderkey AS STRING) AS original_url, CAST(o_custkey AS STRING) AS file_hash,
  CASE WHEN o_orderkey % 6 = 1 THEN 'x' || CAST(o_orderkey AS STRING) END AS external_id,
  CASE o_orderkey % 10 WHEN 0 THEN 'discovered' WHEN 1 THEN 'downloading' WHEN 2 THEN 'downloaded' WHEN 3 THEN 'processing' WHEN 4 THEN 'processed' WHEN 5 THEN 'partially_processed' WHEN 6 THEN 'expired' WHEN 7 THEN 'failed' WHEN 8 THEN 'duplicate' ELSE 'processed' END AS status,
  CASE WHEN o_orderkey % 11 = 3 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE o_orderdate END AS valid_from, CASE WHEN o_orderkey % 11 = 4 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE o_orderdate + INTERVAL '7' DAY END AS valid_until,
  o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 's' END AS storage_id FROM {orders}""",
    "runs": """SELECT event_id AS id, user_id AS flow_id, ts AS started_at, CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE ts + INTERVAL '1' HOUR END AS finished_at,
  CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'success' WHEN 'view' THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 'cancelled' WHEN event_id % 10 = 0 THEN 'duplicate' WHEN event_id % 11 = 0 THEN 'timeout' END AS error FROM {events}""",
    "flows": """SELECT user_id AS id, user_id % 50 + 1 AS supermarket_id, 'Fluxo São ' || CAST(user_id AS STRING) || '!' AS name, CASE user_id % 4 WHEN 1 THEN 'https://a.example/x.pdf?v=1' ELSE 'https://a.example/ofertas' END AS start_url,
  CASE user_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'testing' WHEN 2 THEN 'draft' WHEN 3 THEN 'disabled' ELSE 'active' END AS status, user_id % 5 AS version,
  CASE WHEN user_id % 4 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE CAST('2024-01-29' AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * CAST(user_id % 72 AS INTEGER) END AS next_run_at,
  CASE WHEN user_id % 5 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE CAST('2024-01-28' AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * CAST(user_id % 60 AS INTEGER) END AS last_run_at, CAST(user_id % 5 AS INTEGER) AS discovery_attempts
  FROM (SELECT DISTINCT user_id FROM {events})""",
}
_TABLE = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame in Spark."""
    sql = FRAMES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})


def cte(*names: str) -> str:
    """The same frames for DuckDB, as the beginning of a WITH."""
    return ", ".join(f"{n} AS ({_TABLE.sub(lambda m: m.group(1), FRAMES[n]).replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for n in names)


def half(x: str, places: int = 0) -> str:
    return f"CAST(floor(({x}) * {10**places}.0 + 0.5) AS DOUBLE) / {10**places}.0"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def unit(x: str) -> str:
    known = {**UNIT_ALIASES, **{u: u for u in UNITS}}
    return rf"CASE trim(regexp_replace(lower({x}), '\.$', '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + " END"


def number(x: str) -> str:
    return rf"TRY_CAST(regexp_replace({x}, '^([^,]*),', '\1.') AS DOUBLE)"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M')"
