"""The driver's ``events`` table seen as a store's event log, and a fixed grid of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2026-03-03 15:30:00 minus 14:00:00, the log's time zero, in microseconds.
AS_OF_US = 5_400_000_000

_COLUMNS = {
    "arrival_seq": "event_id",
    "event_id": "cast(event_id AS string)",
    "store_id": "concat('STORE_', cast(user_id % 3 AS string))",
    "camera_id": """CASE WHEN event_type IN ('signup', 'error') AND event_id % 5 <> 0
        THEN concat('CAM_ENTRY_', lpad(cast(1 + event_id % 3 AS string), 2, '0'))
        ELSE concat('CAM_FLOOR_', lpad(cast(1 + event_id % 9 AS string), 2, '0')) END""",
    "visitor_id": "concat('VIS_', cast(user_id AS string))",
    "event_type": """CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'REENTRY' ELSE 'ENTRY' END
        WHEN 'error' THEN 'EXIT'
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'ZONE_ENTER' ELSE 'ZONE_DWELL' END
        WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'ZONE_EXIT' ELSE 'ZONE_ENTER' END
        ELSE CASE WHEN event_id % 4 < 3 THEN 'BILLING_QUEUE_JOIN' ELSE 'BILLING_QUEUE_ABANDON' END END""",
    "ts_us": "(unix_micros(cast(ts AS timestamp)) - 1704067200000000) div 1000",
    "zone_id": """CASE WHEN event_type IN ('view', 'click') THEN
          CASE WHEN event_id % 7 = 6 THEN 'ZONE_BILLING_QUEUE' ELSE concat('ZONE_', cast(event_id % 7 AS string)) END
        WHEN event_type = 'purchase' THEN 'ZONE_BILLING_QUEUE' END""",
    "dwell_ms": "CASE WHEN event_type IN ('view', 'click') THEN cast(floor(value) AS bigint) * 100 ELSE 0L END",
    "is_staff": "user_id % 10 = 0 OR (user_id % 3 = 2 AND user_id % 5 < 3)",
    "confidence": "cast((event_id * 37) % 101 AS double) / 100D",
    "queue_depth": "CASE WHEN event_type = 'purchase' AND event_id % 4 < 3 THEN event_id % 11 - 1 END",
    "wait_ms": "cast(NULL AS bigint)",
    "reid_score": "CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN cast((event_id * 53) % 97 AS double) / 97D END",
}

_TO_DUCKDB = (
    ("cast(event_id AS string)", "event_id::VARCHAR"), (" AS string)", " AS VARCHAR)"),
    ("(unix_micros(cast(ts AS timestamp)) - 1704067200000000) div 1000", "(epoch_us(ts) - 1704067200000000) // 1000"),
    ("0L", "0"), ("100D", "100::DOUBLE"), ("97D", "97::DOUBLE"),
)


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event in the shape of ``schema.EVENT``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(e).alias(n) for n, e in _COLUMNS.items()])


def pos_transactions(spark: SparkSession) -> DataFrame:
    """Six rounds of one transaction in each of three stores."""
    grid = spark.range(18).select((F.col("id") % 3).alias("s"), F.expr("id div 3").alias("k"))
    return grid.select(
        F.concat(F.lit("STORE_"), F.col("s").cast("string")).alias("store_id"),
        F.concat(F.lit("T"), (F.col("k") * 3 + F.col("s")).cast("string")).alias("transaction_id"),
        ((480 * F.col("k") + 100 * F.col("s")) * 1_000_000).alias("ts_us"),
        (100 + F.col("k")).cast("double").alias("basket_value"),
    )


def _duckdb(expression: str) -> str:
    for a, b in _TO_DUCKDB:
        expression = expression.replace(a, b)
    return expression


#: The same two tables as DuckDB common table expressions.
EVENTS_SQL = "ev AS (SELECT " + ", ".join(f"{_duckdb(e)} AS {n}" for n, e in _COLUMNS.items()) + " FROM events)"
POS_SQL = """pos AS (SELECT 'STORE_' || s AS store_id, 'T' || (k * 3 + s) AS transaction_id, (480 * k + 100 * s)::BIGINT * 1000000 AS ts_us, (100 + k)::DOUBLE AS basket_value
  FROM range(6) a(k), range(3) b(s))"""
