"""Data-quality checks over the event log, as window expressions on the visitor or the store."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import camera_number, half_even, is_entry_camera
from ..functions.lineage import cut
from ..schema import API_WARNINGS, CONFIDENCE_CLIFF, ENTRY, EXIT, MAX_HOPS_PER_SECOND, MAX_WARNINGS, MIN_REENTRY_GAP_US, REENTRY, SECOND, STAFF_MIN_EVENTS, STAFF_SHARE, STAFF_WINDOW_US
from .ranks import sum_before

#: code -> severity and place among the warnings of one event
CODES = {
    "QUEUE_DEPTH_NEGATIVE": ("CRITICAL", 0),
    "CONFIDENCE_CLIFF": ("WARN", 1),
    "IMPOSSIBLE_CAMERA_TRANSITION": ("WARN", 2),
    "ENTRY_WITHOUT_DOORWAY": ("WARN", 3),
    "REENTRY_TOO_FAST": ("CRITICAL", 4),
    "STAFF_COUNT_EXPLOSION": ("WARN", 5),
    "DUPLICATE_ACTIVE_SESSION": ("CRITICAL", 6),
}
ACTIONS = {
    "QUEUE_DEPTH_NEGATIVE": "reset the queue counter",
    "CONFIDENCE_CLIFF": "look for a split track",
    "IMPOSSIBLE_CAMERA_TRANSITION": "look for swapped identities",
    "ENTRY_WITHOUT_DOORWAY": "review the camera's zones",
    "REENTRY_TOO_FAST": "look for a doubled track",
    "STAFF_COUNT_EXPLOSION": "review the staff threshold",
    "DUPLICATE_ACTIVE_SESSION": "review session handling",
}


def with_previous(events: DataFrame) -> DataFrame:
    """Adds the visitor's previous camera, time and confidence, and last exit before each event."""
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    exits = F.last(F.when(F.col("event_type") == EXIT, F.col("ts_us")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumns({"prev_camera": F.lag("camera_id").over(order), "prev_us": F.lag("ts_us").over(order), "prev_confidence": F.lag("confidence").over(order), "last_exit_us": exits})


def _drop() -> Column:
    return F.col("prev_confidence") - F.col("confidence")


def _hops() -> Column:
    a, b = F.nullif(camera_number(F.col("prev_camera")), F.lit(0)), F.nullif(camera_number(F.col("camera_id")), F.lit(0))
    return F.coalesce(F.abs(b - a), F.lit(1))


def _elapsed() -> Column:
    return (F.col("ts_us") - F.col("prev_us")) / SECOND


def _exit_gap() -> Column:
    return F.col("ts_us") - F.col("last_exit_us")


def _event_rules() -> dict[str, Column]:
    """When an event with its predecessors breaks each rule that looks at single events."""
    moved = (F.col("prev_camera") != F.col("camera_id")) & (_elapsed() > 0)
    return {
        "QUEUE_DEPTH_NEGATIVE": F.col("queue_depth") < 0,
        "CONFIDENCE_CLIFF": _drop() > CONFIDENCE_CLIFF,
        "IMPOSSIBLE_CAMERA_TRANSITION": moved & (_hops() > F.greatest(_elapsed() * MAX_HOPS_PER_SECOND, F.lit(1.0))),
        "ENTRY_WITHOUT_DOORWAY": (F.col("event_type") == ENTRY) & ~is_entry_camera(F.col("camera_id")),
        "REENTRY_TOO_FAST": (F.col("event_type") == REENTRY) & (_exit_gap() > 0) & (_exit_gap() < MIN_REENTRY_GAP_US),
    }


def negative_queues(events: DataFrame) -> DataFrame:
    return events.filter(_event_rules()["QUEUE_DEPTH_NEGATIVE"]).select("arrival_seq", "store_id", "visitor_id", "camera_id", "queue_depth")


def confidence_cliffs(traced: DataFrame) -> DataFrame:
    return traced.filter(_event_rules()["CONFIDENCE_CLIFF"]).select("arrival_seq", "store_id", "visitor_id", "prev_confidence", "confidence", half_even(_drop(), 3).alias("drop"))


def camera_jumps(traced: DataFrame) -> DataFrame:
    """Camera changes over more hops (by camera number; 1 if either has none or 0) than the time allows."""
    far = traced.filter(_event_rules()["IMPOSSIBLE_CAMERA_TRANSITION"])
    return far.select("arrival_seq", "store_id", "visitor_id", "prev_camera", "camera_id", _hops().alias("hops"), half_even(_elapsed(), 2).alias("elapsed_sec"))


def entries_off_door(events: DataFrame) -> DataFrame:
    return events.filter(_event_rules()["ENTRY_WITHOUT_DOORWAY"]).select("arrival_seq", "store_id", "visitor_id", "camera_id")


def fast_reentries(traced: DataFrame) -> DataFrame:
    return traced.filter(_event_rules()["REENTRY_TOO_FAST"]).select("arrival_seq", "store_id", "visitor_id", half_even(_exit_gap() / SECOND, 2).alias("gap_sec"))


def staff_explosions(events: DataFrame, span_us: int = STAFF_WINDOW_US) -> DataFrame:
    """Events at which the store's last five minutes hold ten events or more, over half of them by staff.

    Exact for a log that arrives in order of time. Rows are dealt by store and span of time, each with the
    span before it, so that one store's log is no single window.
    """
    slot = F.expr(f"floor(ts_us / {span_us})")
    named = events.select("arrival_seq", "store_id", "ts_us", F.col("is_staff").cast("long").alias("staff"), slot.alias("slot"))
    # an event counts from its time on and is taken off again a span later, before what arrives just then;
    # so running sums give the sliding counts, and each row is added up once
    steps = F.array(
        *[
            F.struct((F.col("slot") + later).alias("slot"), (F.col("ts_us") + shift).alias("at"), F.lit(step).alias("step"), F.lit(own).alias("own"))
            for later, shift, step, own in ((0, 0, 1, True), (1, 0, 1, False), (1, span_us, -1, False))
        ]
    )
    dealt = named.select("arrival_seq", "store_id", "staff", F.explode(steps).alias("e")).select("arrival_seq", "store_id", "staff", "e.*")
    order = Window.partitionBy("store_id", "slot").orderBy("at", "step", "arrival_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumns({"n": F.sum("step").over(order), "s": F.sum(F.col("step") * F.col("staff")).over(order)})
    share = F.col("s") / F.col("n")
    return seen.filter("own").filter((F.col("n") >= STAFF_MIN_EVENTS) & (share > STAFF_SHARE)).select("arrival_seq", "store_id", "n", half_even(share, 3).alias("staff_fraction"))


#: Arrivals of a store that one task takes in order; see ``staff_explosions_as_arrived``.
ARRIVALS = 65_536
_TRAIL = "store_id string, arrival_seq long, n long, s long"


def staff_explosions_as_arrived(events: DataFrame, span_us: int = STAFF_WINDOW_US, arrivals: int = ARRIVALS) -> DataFrame:
    """``staff_explosions`` for a log in any order of time: at each arrival the store's trailing window holds what arrived so far and was not yet put out.

    An event is put out, for good, by the first arrival at or after it whose time is a window's length or more ahead of its own; one that arrives
    late counts from then on like any other. A store's arrivals are cut into runs, each a task of its own. What a run leaves in the window goes to
    the one run that puts it out, the first whose latest time is far enough; in the runs between it only counts. So an event is carried once, however dense the log is.
    """
    named = events.select("store_id", "arrival_seq", "ts_us", F.col("is_staff").cast("int").alias("staff"))
    placed = sum_before(named, ["store_id"], ["arrival_seq"], F.lit(1), "nth").withColumn("run", F.expr(f"nth div {arrivals}"))
    placed = cut(placed.select("store_id", "run", "arrival_seq", "ts_us", "staff"))
    after = Window.partitionBy("store_id", "run").orderBy("arrival_seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = placed.withColumn("put_out", F.max("ts_us").over(after) >= F.col("ts_us") + span_us).filter("not put_out")
    latest = placed.groupBy("store_id", F.col("run").alias("at")).agg(F.max("ts_us").alias("m0"))
    held = cut(_first_run(held.select("store_id", "run", "ts_us", "staff", (F.col("run") + 1).alias("at")), cut(latest), span_us))
    # between its own run and the one that puts it out, an event is one of the window
    step = lambda c, sign: held.select("store_id", F.col(c).alias("run"), F.lit(sign).alias("n"), (F.col("staff") * sign).alias("s"))
    moves = step("run", 1).withColumn("run", F.col("run") + 1).unionByName(step("at", -1)).unionByName(placed.select("store_id", "run", F.lit(0).alias("n"), F.lit(0).alias("s")).distinct())
    so_far = Window.partitionBy("store_id").orderBy("run")
    standing = moves.groupBy("store_id", "run").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("store_id", "run", F.sum("n").over(so_far).alias("n0"), F.sum("s").over(so_far).alias("s0"))
    entered = held.select("store_id", F.col("at").alias("run"), F.lit(-1).cast("long").alias("arrival_seq"), "ts_us", "staff")
    rows = placed.unionByName(entered).join(F.broadcast(standing), ["store_id", "run"])

    def trail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, n, s = None, [], 0, 0
        for frame in frames:
            made = []
            for store, run, seq, ts, staff, n0, s0 in zip(*(frame[c].tolist() for c in ("store_id", "run", "arrival_seq", "ts_us", "staff", "n0", "s0"))):
                if (store, run) != now:
                    now, held, n, s = (store, run), [], n0, s0
                heapq.heappush(held, (ts, staff))
                n, s = n + 1, s + staff
                if seq < 0:
                    continue
                while held[0][0] <= ts - span_us:
                    n, s = n - 1, s - heapq.heappop(held)[1]
                if n >= STAFF_MIN_EVENTS and s > STAFF_SHARE * n:
                    made.append((store, seq, n, s))
            yield pd.DataFrame(made, columns=["store_id", "arrival_seq", "n", "s"])

    dealt = rows.repartition("store_id", "run").sortWithinPartitions("store_id", "run", "arrival_seq")
    told = dealt.select("store_id", "run", "arrival_seq", "ts_us", "staff", "n0", "s0").mapInPandas(trail, _TRAIL)
    return told.select("arrival_seq", "store_id", "n", half_even(F.col("s") / F.col("n"), 3).alias("staff_fraction"))


def _first_run(waiting: DataFrame, latest: DataFrame, span_us: int) -> DataFrame:
    """``waiting(store_id, ts_us, at, ...)`` with ``at`` moved on to the first run from there whose latest time is ``span_us`` ahead, or past the last one.

    ``latest(store_id, at, m0)`` has a row a run. Runs are passed over in steps of powers of two, the greatest first, by the latest time of so many runs.
    """
    steps = max(1, (latest.agg(F.max("at")).first()[0] or 0).bit_length() + 1)
    order = Window.partitionBy("store_id").orderBy("at")
    for k in range(1, steps):
        latest = latest.withColumn(f"m{k}", F.greatest(f"m{k - 1}", F.lead(f"m{k - 1}", 1 << (k - 1)).over(order)))
    latest = cut(latest)
    for k in reversed(range(steps)):
        waiting = waiting.join(F.broadcast(latest.select("store_id", "at", F.col(f"m{k}").alias("most"))), ["store_id", "at"], "left")
        waiting = waiting.withColumn("at", F.when(F.col("most") < F.col("ts_us") + span_us, F.col("at") + (1 << k)).otherwise(F.col("at"))).drop("most")
    return waiting


def exits_without_entry(events: DataFrame) -> DataFrame:
    """Exits of visitors whose history, since their last exit, holds no entry or re-entry: (arrival_seq, store_id, visitor_id, ts_us)."""
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    before = F.last(F.when(F.col("event_type").isin(ENTRY, REENTRY, EXIT), F.col("event_type")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = events.withColumn("before", before).filter((F.col("event_type") == EXIT) & (F.coalesce("before", F.lit(EXIT)) == EXIT))
    return found.select("arrival_seq", "store_id", "visitor_id", "ts_us")


def presence(events: DataFrame, hold_us: int) -> DataFrame:
    """Stays at cameras: (store_id, visitor_id, camera_id, start_us, end_us), sightings at most ``hold_us`` apart as one, ended ``hold_us`` after the last."""
    order = Window.partitionBy("visitor_id", "camera_id").orderBy("ts_us", "arrival_seq")
    opens = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(order) > hold_us, F.lit(True))
    runs = events.withColumn("opens", opens.cast("int")).withColumn("stay", F.sum("opens").over(order))
    return runs.groupBy("visitor_id", "camera_id", "stay").agg(F.min_by("store_id", "arrival_seq").alias("store_id"), F.min("ts_us").alias("start_us"), (F.max("ts_us") + hold_us).alias("end_us")).drop("stay")


def simultaneous_cameras(stays: DataFrame) -> DataFrame:
    """Pairs of ``presence`` rows of one visitor that overlap in time: (store_id, visitor_id, camera_a, camera_b, since_us, until_us), the first camera's name the smaller.

    A sweep by start cuts a visitor's stays where none is open any more, by the running maximum of ends; only stays of one such island meet.
    """
    order = Window.partitionBy("visitor_id").orderBy("start_us", "camera_id").rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max("end_us").over(order)
    island = Window.partitionBy("visitor_id").orderBy("start_us", "camera_id")
    swept = stays.withColumn("alone", F.coalesce(longest <= F.col("start_us"), F.lit(True)).cast("int")).withColumn("island", F.sum("alone").over(island))
    a, b = (swept.select("visitor_id", "island", "store_id", *[F.col(c).alias(f"{c}_{x}") for c in ("camera_id", "start_us", "end_us")]) for x in "ab")
    pairs = a.join(b.drop("store_id"), ["visitor_id", "island"]).filter("camera_id_a < camera_id_b and start_us_a < end_us_b and start_us_b < end_us_a")
    return pairs.select("store_id", "visitor_id", F.col("camera_id_a").alias("camera_a"), F.col("camera_id_b").alias("camera_b"), F.greatest("start_us_a", "start_us_b").alias("since_us"), F.least("end_us_a", "end_us_b").alias("until_us"))


def visitor_teleports(events: DataFrame, hops: DataFrame, least: int = 2, second_us: int = SECOND) -> DataFrame:
    """Moves between zones that are ``least`` or more steps of ``hops(zone_from, zone_to, hops)`` apart within fewer seconds than steps: (arrival_seq, store_id, visitor_id, zone_from, zone_to, hops).

    Zones that ``hops`` does not join are as far as no visitor can walk.
    """
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    zoned = events.filter(F.coalesce("zone_id", F.lit("")) != "")
    moved = zoned.withColumns({"zone_from": F.lag("zone_id").over(order), "from_us": F.lag("ts_us").over(order)}).filter("zone_from <> zone_id")
    met = moved.withColumnRenamed("zone_id", "zone_to").join(hops, ["zone_from", "zone_to"], "left")
    fast = (F.col("ts_us") - F.col("from_us")) < F.col("hops") * second_us
    return met.filter(F.col("hops").isNull() | ((F.col("hops") >= least) & fast)).select("arrival_seq", "store_id", "visitor_id", "zone_from", "zone_to", "hops")


def duplicate_active(sessions: DataFrame) -> DataFrame:
    """Visitors of a store with more than one open session."""
    open_ = sessions.filter("end_us is null").groupBy("store_id", "visitor_id").agg(F.count(F.lit(1)).alias("active_sessions"))
    return open_.filter("active_sessions > 1")


def warnings(events: DataFrame) -> DataFrame:
    """All per-event warnings: (seq, store_id, visitor_id, code, severity), one place per event and code.

    The rules on single events share one pass over the log by visitor; only the staff share needs another, by store.
    """
    told = lambda code: F.struct(F.lit(CODES[code][1]).alias("place"), F.lit(code).alias("code"), F.lit(CODES[code][0]).alias("severity"), F.lit(ACTIONS[code]).alias("suggested_action"))
    broken = F.filter(F.array(*[F.when(rule, told(code)) for code, rule in _event_rules().items()]), lambda w: w.isNotNull())
    single = with_previous(events).select("arrival_seq", "store_id", "visitor_id", F.explode(broken).alias("w"))
    staff = staff_explosions(events).select("arrival_seq", "store_id", F.lit(None).cast("string").alias("visitor_id"), told("STAFF_COUNT_EXPLOSION").alias("w"))
    return single.unionByName(staff).select((F.col("arrival_seq") * 10 + F.col("w.place")).alias("seq"), "store_id", "visitor_id", "w.code", "w.severity", "w.suggested_action")


def newest(found: DataFrame, limit: int = MAX_WARNINGS) -> DataFrame:
    """The newest ``limit`` warnings, as the engine keeps them."""
    return found.orderBy(F.desc("seq")).limit(limit)


def newest_by_store(found: DataFrame, limit: int = API_WARNINGS, severity: str | None = None) -> DataFrame:
    """Each store's newest warnings in order, of one severity if named."""
    kept = found if severity is None else found.filter(F.col("severity") == severity.upper())
    rank = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("seq")))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")
