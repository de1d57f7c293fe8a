"""Sessions matched to transactions: one join on the store and a bin of five minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_billing_zone
from ..schema import CORRELATION_WINDOW_US


def last_billing_presence(sessions: DataFrame) -> DataFrame:
    """Adds ``billing_us``: the last queue join, else the end (or start) of a session that visited a billing zone."""
    visited = F.exists("zones_visited", is_billing_zone)
    return sessions.withColumn("billing_us", F.coalesce("last_join_us", F.when(visited, F.coalesce("end_us", "start_us"))))


def _bins(pos: DataFrame, window_us: int) -> DataFrame:
    """(store, bin, latest, following): the last transaction in each bin of one window, and the first in the bin after it."""
    at = F.expr(f"floor(ts_us / {window_us})")
    sides = F.array(F.struct(at.alias("bin"), F.col("ts_us").alias("own"), F.lit(None).cast("long").alias("after")), F.struct((at - 1).alias("bin"), F.lit(None).cast("long").alias("own"), F.col("ts_us").alias("after")))
    told = pos.select("store_id", F.explode(sides).alias("s"))
    return told.groupBy(F.col("store_id").alias("_store"), F.col("s.bin").alias("_bin")).agg(F.max("s.own").alias("_latest"), F.min("s.after").alias("_following"))


def with_match(sessions: DataFrame, pos: DataFrame, window_us: int = CORRELATION_WINDOW_US) -> DataFrame:
    """Adds ``pos_converted``: a guest's session with a transaction of its store from the last billing presence to ``window_us`` after.

    Times are cut into bins of one window. A transaction in the session's own bin is never too late and one in the next is
    never too early, so the last of the one and the first of the other decide: one join on (store, bin) with at most one match.
    Sessions that ask for nothing carry keys of their own, so that they neither match nor meet in one task.
    """
    asks = ~F.col("is_staff") & F.col("_billing").isNotNull()
    asked = last_billing_presence(sessions).withColumnRenamed("billing_us", "_billing")
    asked = asked.withColumns({"_store": F.when(asks, F.col("store_id")), "_bin": F.when(asks, F.expr(f"floor(_billing / {window_us})")).otherwise(F.xxhash64("session_id"))})
    found = asked.join(_bins(pos, window_us), ["_store", "_bin"], "left")
    near = (F.col("_latest") >= F.col("_billing")) | (F.col("_following") <= F.col("_billing") + window_us)
    return found.withColumn("pos_converted", F.coalesce(near, F.lit(False))).select(*sessions.columns, "pos_converted")


def correlate(sessions: DataFrame, pos: DataFrame, window_us: int = CORRELATION_WINDOW_US) -> DataFrame:
    """(session_id) of the sessions that ``with_match`` finds a transaction for."""
    return with_match(sessions, pos, window_us).filter("pos_converted").select("session_id")


def with_conversion(sessions: DataFrame, pos: DataFrame) -> DataFrame:
    """Adds ``pos_converted`` and raises ``purchase_candidate`` where it holds."""
    return with_match(sessions, pos).withColumn("purchase_candidate", F.col("purchase_candidate") | F.col("pos_converted"))
