"""Visitor sessions by window functions: one shuffle on the visitor, no user code.

A session opens at an ENTRY, at a visitor's first event and after an EXIT; any other event joins the open
one. That is the state machine's whole rule, as after any event but EXIT a session is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BILLING_ZONE, ENTRY, EXIT, QUEUE_ABANDON, QUEUE_JOIN, REENTRY, ZONE_DWELL, ZONE_ENTER, ZONE_EVENTS, ZONE_EXIT


def number_sessions(events: DataFrame) -> DataFrame:
    """The events with ``session_no`` (from 1 for each visitor), ``counted``, ``visit_zone`` and ``reentries`` so far."""
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    kind, zone = F.col("event_type"), F.nullif(F.col("zone_id"), F.lit(""))
    starts = (kind == ENTRY) | F.col("before").isNull() | (F.col("before") == EXIT)
    visited = F.when(kind == ZONE_ENTER, zone).when(kind == QUEUE_JOIN, F.coalesce(zone, F.lit(BILLING_ZONE)))
    return (
        events.withColumn("before", F.lag("event_type").over(order))
        .withColumn("session_no", F.sum(starts.cast("int")).over(order))
        .withColumn("counted", ~(kind.isin(*ZONE_EVENTS) & zone.isNull()))
        .withColumn("visit_zone", visited)
        .withColumn("reentries", F.sum((kind == REENTRY).cast("int")).over(order))
        .drop("before")
    )


def sessions(numbered: DataFrame) -> DataFrame:
    """One row per session. Store, start and staff mark are the opener's; an orphan ends where the next one starts.

    ``session_id`` is derived from visitor and opener, so that a rerun gives the same ids.
    """
    seq, kind = F.col("arrival_seq"), F.col("event_type")
    wait = F.coalesce(F.nullif(F.col("wait_ms"), F.lit(0)), F.nullif(F.col("dwell_ms"), F.lit(0)))
    queue = F.struct(
        seq.alias("seq"), kind.alias("event_type"), F.col("ts_us"), F.when(kind == QUEUE_JOIN, F.col("queue_depth")).alias("queue_depth"),
        F.when(kind == QUEUE_ABANDON, wait).alias("wait_ms"),
    )
    folded = numbered.groupBy("visitor_id", "session_no").agg(
        F.min_by("store_id", seq).alias("store_id"),
        F.min_by("event_id", seq).alias("opener_event_id"),
        F.min_by("event_type", seq).alias("opener"),
        F.min_by("confidence", seq).alias("opener_confidence"),
        F.min_by("ts_us", seq).alias("start_us"),
        F.min_by("is_staff", seq).alias("is_staff"),
        F.max_by("event_type", seq).alias("closer"),
        F.max_by("ts_us", seq).alias("last_us"),
        F.sum(F.col("counted").cast("long")).alias("n_counted"),
        F.avg(F.when(F.col("counted"), F.col("confidence"))).alias("mean_confidence"),
        F.coalesce(F.max(F.when(kind == REENTRY, F.col("reentries"))), F.lit(0)).cast("long").alias("reentry_count"),
        F.max(F.when(kind == QUEUE_JOIN, F.col("ts_us"))).alias("last_join_us"),
        F.array_sort(F.collect_list(F.when(kind.isin(QUEUE_JOIN, QUEUE_ABANDON), queue))).alias("queue_events"),
        F.collect_list(F.when(F.col("visit_zone").isNotNull(), F.struct(seq.alias("seq"), F.col("visit_zone").alias("zone")))).alias("visits"),
        F.bool_or(kind == QUEUE_JOIN).alias("purchase_candidate"),
    )
    following = F.lead("start_us").over(Window.partitionBy("visitor_id").orderBy("session_no"))
    end = F.when(F.col("closer") == EXIT, F.col("last_us")).otherwise(following)
    zones = F.array_distinct(F.transform(F.array_sort("visits"), lambda v: v["zone"]))
    return folded.select(
        F.sha2(F.concat_ws("|", "visitor_id", "opener_event_id").cast("binary"), 256).alias("session_id"),
        "visitor_id",
        "session_no",
        "store_id",
        "start_us",
        end.alias("end_us"),
        "is_staff",
        (F.col("n_counted") + F.when(F.col("opener") == EXIT, 1).otherwise(0)).alias("event_count"),
        F.coalesce("mean_confidence", "opener_confidence").alias("avg_confidence"),
        "reentry_count",
        "last_join_us",
        "purchase_candidate",
        zones.alias("zones_visited"),
        "queue_events",
    ).withColumn("duration_ms", F.expr("(end_us - start_us) div 1000")).withColumn("is_active", F.col("end_us").isNull())


def session_zones(numbered: DataFrame) -> DataFrame:
    """(visitor_id, session_no, zone_id, position): zones in order of their first visit."""
    first = numbered.filter("visit_zone is not null").groupBy("visitor_id", "session_no", F.col("visit_zone").alias("zone_id")).agg(F.min("arrival_seq").alias("first_seq"))
    order = Window.partitionBy("visitor_id", "session_no").orderBy("first_seq")
    return first.select("visitor_id", "session_no", "zone_id", F.row_number().over(order).alias("position"))


def session_dwell(numbered: DataFrame) -> DataFrame:
    """(visitor_id, session_no, zone_id, dwell_ms): dwell of zone exits and checkpoints, a key also if it is 0."""
    kept = numbered.filter(F.col("event_type").isin(ZONE_EXIT, ZONE_DWELL) & (F.coalesce("zone_id", F.lit("")) != ""))
    return kept.groupBy("visitor_id", "session_no", "zone_id").agg(F.sum("dwell_ms").alias("dwell_ms"))


def session_dwell_exit_only(numbered: DataFrame) -> DataFrame:
    """As ``session_dwell`` without the checkpoints, which repeat what the exit totals."""
    return session_dwell(numbered.filter(F.col("event_type") != ZONE_DWELL))


def dwell_map(dwell: DataFrame) -> DataFrame:
    """One map per session out of ``session_dwell``."""
    return dwell.groupBy("visitor_id", "session_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone_id", "dwell_ms")))).alias("dwell_per_zone"))
