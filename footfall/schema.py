"""Types, event names and thresholds shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY, EXIT, REENTRY = "ENTRY", "EXIT", "REENTRY"
ZONE_ENTER, ZONE_EXIT, ZONE_DWELL = "ZONE_ENTER", "ZONE_EXIT", "ZONE_DWELL"
QUEUE_JOIN, QUEUE_ABANDON = "BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON"
EVENT_TYPES = (ENTRY, EXIT, REENTRY, ZONE_ENTER, ZONE_EXIT, ZONE_DWELL, QUEUE_JOIN, QUEUE_ABANDON)
ZONE_EVENTS = (ZONE_ENTER, ZONE_EXIT, ZONE_DWELL)
BILLING_ZONE = "ZONE_BILLING_QUEUE"

# Prefixes of billing zones and of entry cameras, upper case.
BILLING_PREFIXES = ("ZONE_BILLING", "ZONE_CASH", "BILLING", "ZONE_CHECKOUT")
ENTRY_CAMERA_PREFIXES = ("CAM_ENTRY", "CAM_DOOR", "CAM_THRESHOLD")

SECOND = 1_000_000
MINUTE = 60 * SECOND

# Fixed thresholds.
CORRELATION_WINDOW_US = 300 * SECOND
QUEUE_SPIKE_WARN, QUEUE_SPIKE_CRITICAL = 5, 8
DEAD_ZONE_US = 30 * MINUTE
STALE_FEED_US = 600 * SECOND
CONVERSION_DROP_RATIO = 0.7
MIN_CONFIDENT_SESSIONS = 20
CONFIDENCE_CLIFF = 0.40
MAX_HOPS_PER_SECOND = 1.5
MIN_REENTRY_GAP_US = 10 * SECOND
STAFF_WINDOW_US = 300 * SECOND
STAFF_MIN_EVENTS = 10
STAFF_SHARE = 0.50
MAX_WARNINGS, API_WARNINGS = 1000, 100
MAX_BATCH = 500
FUTURE_SLACK_US = 60 * SECOND

METADATA = T.StructType(
    [
        T.StructField("queue_depth", T.LongType()),
        T.StructField("sku_zone", T.StringType()),
        T.StructField("session_seq", T.LongType()),
        T.StructField("reid_score", T.DoubleType()),
        T.StructField("reentry_count", T.LongType()),
        T.StructField("session_duration_ms", T.LongType()),
        T.StructField("wait_duration_ms", T.LongType()),
        T.StructField("behavior_state", T.StringType()),
        T.StructField("det_conf", T.DoubleType()),
        T.StructField("track_conf", T.DoubleType()),
        T.StructField("reid_conf", T.DoubleType()),
        T.StructField("zone_conf", T.DoubleType()),
        T.StructField("confidence_lineage", T.StringType()),
    ]
)

#: The log that all operators read: one row per accepted event, in order of ``arrival_seq``; ts_us counts microseconds.
EVENT = T.StructType(
    [
        T.StructField("arrival_seq", T.LongType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("store_id", T.StringType(), False),
        T.StructField("camera_id", T.StringType(), False),
        T.StructField("visitor_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("zone_id", T.StringType()),
        T.StructField("dwell_ms", T.LongType(), False),
        T.StructField("is_staff", T.BooleanType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("queue_depth", T.LongType()),
        T.StructField("wait_ms", T.LongType()),
        T.StructField("reid_score", T.DoubleType()),
    ]
)

POS = T.StructType(
    [
        T.StructField("store_id", T.StringType(), False),
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("basket_value", T.DoubleType()),
    ]
)
