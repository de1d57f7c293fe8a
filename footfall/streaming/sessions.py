"""The same log as a stream: strict ingest, dedup, sessions per visitor, feed health, projections per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest
from ..schema import ENTRY, EXIT, QUEUE_JOIN, REENTRY, ZONE_EVENTS


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the JSONL files that arrive in a folder."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).filter(F.trim("value") != "")


def valid_events(lines: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Valid events of a stream of lines. The order within a visitor is that of the timestamp, as a folder has no line order.

    What lies ahead is measured against the time of each batch, unless a clock is given to repeat an old run.
    """
    checked = ingest.validate(lines.withColumn("arrival_seq", F.lit(0).cast("long")), ingest.clock() if as_of_us is None else as_of_us)
    return checked.filter(F.size("errors") == 0).drop("errors", "raw", "meta", "arrival_seq").withColumn("arrival_seq", F.col("ts_us"))


def first_arrivals(events: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Each event id once within ``delay`` of event time, which bounds the state; with None over all time, whose state grows for ever."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


#: Processing time after which a silent visitor's state goes.
FORGET_MS = 7 * 86_400_000
OUTPUT = "visitor_id string, session_no long, store_id string, start_us long, end_us long, is_staff boolean, event_count long, reentry_count long, purchase_candidate boolean"
STATE = "session_no long, open boolean, store_id string, start_us long, is_staff boolean, event_count long, reentry_count long, reentries long, purchase_candidate boolean, last_us long"
_KEYS = ("session_no", "open", "store_id", "start_us", "is_staff", "event_count", "reentry_count", "reentries", "purchase_candidate", "last_us")


def fold(state: dict, rows: Iterator) -> Iterator[dict]:
    """Feeds a visitor's events, in order of arrival, to the session state; yields each session that changed, as it then is."""
    changed: dict[int, dict] = {}

    def tell(end_us):
        changed[state["session_no"]] = {**{k: state[k] for k in ("session_no", "store_id", "start_us", "is_staff", "event_count", "reentry_count", "purchase_candidate")}, "end_us": end_us}

    for e in rows:
        kind = e.event_type
        if state["open"] and kind == ENTRY:
            tell(e.ts_us)
            state["open"] = False
        if not state["open"]:
            state.update(session_no=state["session_no"] + 1, open=True, store_id=e.store_id, start_us=e.ts_us, is_staff=bool(e.is_staff), event_count=int(kind == EXIT), reentry_count=0, purchase_candidate=False)
        state["event_count"] += not (kind in ZONE_EVENTS and not e.zone_id)
        if kind == REENTRY:
            state["reentries"] += 1
            state["reentry_count"] = state["reentries"]
        state["purchase_candidate"] |= kind == QUEUE_JOIN
        state["last_us"] = e.ts_us
        if kind == EXIT:
            tell(e.ts_us)
            state["open"] = False
        else:
            tell(None)
    yield from changed.values()


def _start() -> dict:
    return dict(session_no=0, open=False, store_id="", start_us=0, is_staff=False, event_count=0, reentry_count=0, reentries=0, purchase_candidate=False, last_us=0)


def session_updates(events: DataFrame, idle_ms: int | None = None, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """A row for each session that a micro-batch changed, to be taken as the session's newest version.

    ``idle_ms`` closes sessions without events for so long of processing time (off by default: a session
    has no time-out). A visitor without events for ``forget_ms``, seven days unless said otherwise, is forgotten with its
    state, an open session being left as it was last told; its sessions are then numbered from 1 again and told apart by their start.
    """
    waits = [ms for ms in (idle_ms, forget_ms) if ms is not None]

    def work(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(_KEYS, held.get)) if held.exists else _start()
        if held.hasTimedOut:
            made = []
            if idle_ms is not None and state["open"]:
                state["open"] = False
                made = [{**{k: state[k] for k in ("session_no", "store_id", "start_us", "is_staff", "event_count", "reentry_count", "purchase_candidate")}, "end_us": state["last_us"]}]
            # after a session was closed for idleness the visitor is kept for the rest of the time
            wait = None if forget_ms is None else max(0, forget_ms - idle_ms) if made else 0
        else:
            batch = pd.concat(list(frames), ignore_index=True).sort_values("arrival_seq", kind="stable")
            made = list(fold(state, batch.itertuples(index=False)))
            wait = idle_ms if idle_ms is not None and state["open"] else forget_ms
        if wait == 0:
            held.remove()
        else:
            held.update(tuple(state[k] for k in _KEYS))
            if wait is not None:
                held.setTimeoutDuration(wait)
        if made:
            frame = pd.DataFrame(made).assign(visitor_id=key[0])
            frame["end_us"] = frame["end_us"].astype("Int64")
            yield frame[["visitor_id", "session_no", "store_id", "start_us", "end_us", "is_staff", "event_count", "reentry_count", "purchase_candidate"]]

    narrow = events.select("visitor_id", "arrival_seq", "store_id", "event_type", "ts_us", "zone_id", "is_staff")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if waits else GroupStateTimeout.NoTimeout
    return narrow.groupBy("visitor_id").applyInPandasWithState(work, OUTPUT, STATE, "update", timeout)


def latest_sessions(updates: DataFrame, version: str) -> DataFrame:
    """The newest version of each session out of stored updates."""
    keys = ("visitor_id", "session_no", "start_us")
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), version).alias("s"))
    return newest.select(*keys, "s.*")


def feed_state(events: DataFrame) -> DataFrame:
    """Newest event time and count of each store, kept up to date; the reader compares it with the clock."""
    return events.groupBy("store_id").agg(F.max("ts_us").alias("last_event_us"), F.count(F.lit(1)).alias("events"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and staff events of each store by window of event time; late ones are taken until ``delay`` has passed."""
    timed = events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    return timed.groupBy("store_id", F.window("event_time", width)).agg(F.count(F.lit(1)).alias("events"), F.count_if("is_staff").alias("staff"))


def project_each_batch(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that appends through ``work(batch, number)``; the checkpoint makes a rerun pick up where it ended."""
    return events.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
