"""Audit records of each visitor: what happened, in order, with a reason in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text_number
from ..schema import ENTRY, EXIT, QUEUE_ABANDON, QUEUE_JOIN, REENTRY, SECOND, ZONE_ENTER, ZONE_EVENTS, ZONE_EXIT
from .sessions import number_sessions
from .verifier import warnings as event_warnings

RECORD = ("category", "event_type", "confidence", "source", "reason", "session_no")
# The wording of audit reasons, which clients of the service read.
DETECTED_TEXT = " detected on "
CONFIDENCE_TEXT = " with confidence "
OPENED_TEXT = "Session opened for "
CLOSED_TEXT = "Session closed for "
LASTED_TEXT = ". Duration: "
AGAIN_TEXT = "reentry #"
LIKENESS_TEXT = "appearance similarity "
ENTERED_TEXT = "Entered zone "
LEFT_TEXT = "Left zone "
DWELLED_TEXT = "Dwelled in zone "
CHECKPOINT_TEXT = " (periodic checkpoint)"
JOINED_TEXT = "Joined billing queue (depth="
CANDIDATE_TEXT = "). Marked as purchase_candidate."
ABANDONED_TEXT = "Abandoned billing queue after waiting "
UNKNOWN_TEXT = "unknown"


def _record(category: str, event: Column, reason: Column, source: str = "Sessionizer") -> Column:
    return F.struct(F.lit(category).alias("category"), event.alias("event_type"), F.col("confidence"), F.lit(source).alias("source"), reason.alias("reason"), F.col("session_no"))


def _seconds(ms: Column) -> Column:
    return F.concat(text_number(ms / 1000, 1), F.lit("s"))


def event_records(events: DataFrame) -> DataFrame:
    """(visitor_id, arrival_seq, sub_seq, record columns) of the log's events, without verifier rows.

    An entry gives a detection and a session record; implicit openings and orphans give none.
    """
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    last_exit = F.last(F.when(F.col("event_type") == EXIT, F.col("ts_us")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = number_sessions(events).withColumn("last_exit_us", last_exit)
    numbered = numbered.withColumn("opened_us", F.first("ts_us").over(Window.partitionBy("visitor_id", "session_no").orderBy("arrival_seq")))
    kind, visitor, zone = F.col("event_type"), F.col("visitor_id"), F.nullif(F.col("zone_id"), F.lit(""))
    wait = F.coalesce(F.nullif(F.col("wait_ms"), F.lit(0)), F.nullif(F.col("dwell_ms"), F.lit(0)))
    detection = F.concat(kind, F.lit(DETECTED_TEXT), F.col("camera_id"), F.lit(CONFIDENCE_TEXT), text_number(F.col("confidence"), 2))
    opening = F.concat(F.lit(OPENED_TEXT), visitor, F.lit(" at "), F.col("store_id"), F.when(F.col("is_staff"), " [STAFF]").otherwise(""))
    closing = F.concat(F.lit(CLOSED_TEXT), visitor, F.lit(LASTED_TEXT), _seconds(F.expr("(ts_us - opened_us) div 1000")))
    parts = F.array(
        F.concat(F.lit(AGAIN_TEXT), F.col("reentries").cast("string"), F.lit(" for "), visitor),
        F.when(F.col("reid_score").isNotNull(), F.concat(F.lit(LIKENESS_TEXT), text_number(F.col("reid_score"), 2))),
        F.concat(F.lit("camera="), F.col("camera_id")),
        F.when(F.col("last_exit_us").isNotNull(), F.concat(F.lit("time gap "), text_number((F.col("ts_us") - F.col("last_exit_us")) / SECOND, 1), F.lit(" sec"))),
    )
    moved = (
        F.when(kind == ZONE_ENTER, F.concat(F.lit(ENTERED_TEXT), zone))
        .when(kind == ZONE_EXIT, F.concat(F.lit(LEFT_TEXT), zone, F.lit(" after "), _seconds(F.col("dwell_ms"))))
        .otherwise(F.concat(F.lit(DWELLED_TEXT), zone, F.lit(" for "), _seconds(F.col("dwell_ms")), F.lit(CHECKPOINT_TEXT)))
    )
    queued = F.when(kind == QUEUE_JOIN, F.concat(F.lit(JOINED_TEXT), F.coalesce(F.col("queue_depth").cast("string"), F.lit("None")), F.lit(CANDIDATE_TEXT))).otherwise(
        F.concat(F.lit(ABANDONED_TEXT), F.coalesce(_seconds(wait), F.lit(UNKNOWN_TEXT)))
    )
    records = F.array(
        F.when(kind == ENTRY, _record("DETECTION", kind, detection, "IngestionPipeline")),
        F.when(kind == ENTRY, _record("SESSION", kind, opening)),
        F.when(kind == EXIT, _record("EXIT", kind, closing)),
        F.when(kind == REENTRY, _record("REENTRY", kind, F.array_join(parts, "; "))),
        F.when(kind.isin(*ZONE_EVENTS) & zone.isNotNull(), _record("ZONE", kind, moved)),
        F.when(kind.isin(QUEUE_JOIN, QUEUE_ABANDON), _record("QUEUE", kind, queued)),
    )
    kept = F.filter(records, lambda r: r.isNotNull())
    rows = numbered.select("visitor_id", "store_id", "arrival_seq", "ts_us", F.posexplode(kept).alias("sub_seq", "r"))
    return rows.select("visitor_id", "store_id", "arrival_seq", "sub_seq", "ts_us", *[f"r.{c}" for c in RECORD])


def warning_records(events: DataFrame) -> DataFrame:
    """Verifier warnings that name a visitor, as records after the event's own."""
    found = event_warnings(events).filter("visitor_id is not null")
    return found.select(
        "visitor_id", "store_id", F.expr("seq div 10").alias("arrival_seq"), (10 + F.col("seq") % 10).cast("int").alias("sub_seq"), F.lit("TRACKING").alias("category"),
        F.col("code").alias("event_type"), F.lit(0.0).alias("confidence"), F.lit("VerifierEngine").alias("source"), F.col("suggested_action").alias("reason"),
    )


def identity_records(decisions: DataFrame) -> DataFrame:
    """``decisions(visitor_id, store_id, arrival_seq, decision, confidence, explanation, source)`` as records of the timeline, after an event's own.

    decision is a word such as REUSED, NEW or STAFF_CLASSIFIED; a null source is the sessionizer.
    """
    return decisions.select(
        "visitor_id", "store_id", F.col("arrival_seq").cast("long").alias("arrival_seq"), F.lit(20).alias("sub_seq"), F.lit("IDENTITY").alias("category"), F.col("decision").alias("event_type"),
        F.col("confidence").cast("double").alias("confidence"), F.coalesce("source", F.lit("Sessionizer")).alias("source"), F.col("explanation").alias("reason"),
    )


def audit_timeline(events: DataFrame) -> DataFrame:
    """All records by (visitor, event, place in the event)."""
    return event_records(events).drop("ts_us", "session_no").unionByName(warning_records(events))


def explain(timeline: DataFrame) -> DataFrame:
    """One text per visitor: a numbered line per record, in order. For looking up single visitors."""
    lines = F.array_sort(F.collect_list(F.struct("arrival_seq", "sub_seq", F.concat_ws(" ", F.concat(F.lit("["), F.col("category"), F.lit("]")), "event_type", "reason").alias("line"))))
    return timeline.groupBy("visitor_id").agg(F.array_join(F.transform(lines, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["line"])), "\n").alias("explanation"))


def audit_summary(timeline: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per store and visitor with a session there: number of records and their categories."""
    counted = timeline.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("records"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return sessions.select("store_id", "visitor_id").distinct().join(counted, "visitor_id")
