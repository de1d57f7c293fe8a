"""Folds over what a visitor or track does: behaviour states, zone intervals, line crossings, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import ENTRY, EXIT, QUEUE_ABANDON, QUEUE_JOIN, REENTRY, SECOND, ZONE_DWELL, ZONE_ENTER, ZONE_EXIT
from .ranks import sum_before

BROWSE_DWELL_MS = 10_000
CHECKPOINT_US = 30 * SECOND
CROSS_FRAMES = 3
MIN_QUEUE_US = 5 * SECOND
ABANDON_US = 45 * SECOND
SPAN_SLACK = 0.05


def behaviour_states(events: DataFrame, dwelling_ms: int = BROWSE_DWELL_MS) -> DataFrame:
    """(visitor_id, arrival_seq, event_type, state) after each event of the seven-state machine, from UNKNOWN.

    Entries and exits fix the state whatever it was before, so each stretch from one of them to the next is
    folded by itself: the array that is gathered is as long as one visit, not as the visitor's log.
    """
    kind = F.col("event_type")
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    acts = F.struct(F.col("arrival_seq").alias("seq"), kind.alias("kind"), F.col("dwell_ms").alias("dwell"), F.col("zone_id").alias("zone"))
    fixed = kind.isin(ENTRY, REENTRY, EXIT)
    cut = events.withColumn("stretch", F.sum(fixed.cast("int")).over(order))
    lists = cut.groupBy("visitor_id", "stretch").agg(F.array_sort(F.collect_list(acts)).alias("acts"))

    def step(state: Column, a: Column) -> Column:
        k = a["kind"]
        return (
            F.when(k.isin(ENTRY, REENTRY), "ENTERED")
            .when(k == EXIT, "EXITED")
            .when((k == ZONE_ENTER) & state.isin("UNKNOWN", "ENTERED"), "BROWSING")
            .when((k == ZONE_EXIT) & (state == "DWELLING"), "BROWSING")
            .when((k == ZONE_DWELL) & (state == "BROWSING") & (a["dwell"] >= dwelling_ms), "DWELLING")
            .when((k == QUEUE_JOIN) & (state != "EXITED"), "QUEUEING")
            .when((k == QUEUE_ABANDON) & (state == "QUEUEING"), "BROWSING")
            .otherwise(state)
        )

    empty = F.struct(F.lit("UNKNOWN").alias("state"), F.array().cast("array<struct<seq:bigint,kind:string,state:string>>").alias("trail"))

    def fold(acc: Column, a: Column) -> Column:
        now = step(acc["state"], a)
        return F.struct(now.alias("state"), F.concat(acc["trail"], F.array(F.struct(a["seq"].alias("seq"), a["kind"].alias("kind"), now.alias("state")))).alias("trail"))

    rows = lists.select("visitor_id", F.explode(F.aggregate("acts", empty, fold)["trail"]).alias("t"))
    return rows.select("visitor_id", F.col("t.seq").alias("arrival_seq"), F.col("t.kind").alias("event_type"), F.col("t.state").alias("state"))


def time_ticks(states: DataFrame, until_us: Column, entered_us: int = 5 * SECOND, queued_us: int = 10 * SECOND) -> DataFrame:
    """What time alone makes of a last ``state`` reached at ``ts_us``: entered visitors browse after 5 s, queued ones may buy after 10 s."""
    stayed = until_us - F.col("ts_us")
    later = F.when((F.col("state") == "ENTERED") & (stayed >= entered_us), "BROWSING").when((F.col("state") == "QUEUEING") & (stayed >= queued_us), "PURCHASE_CANDIDATE")
    return states.withColumn("state", F.coalesce(later, F.col("state")))


def zone_changes(sightings: DataFrame) -> DataFrame:
    """Enter and exit events of ``sightings(visitor_id, ts_us, seq, zone_id)``: one per change of zone, open zones left at the last sighting.

    (visitor_id, zone_id, enter_us, exit_us, dwell_ms, flushed).
    """
    order = Window.partitionBy("visitor_id").orderBy("seq")
    zone = F.coalesce("zone_id", F.lit(""))
    changed = F.coalesce(F.lag(zone).over(order) != zone, F.lit(True))
    marked = sightings.withColumn("run", F.sum(changed.cast("int")).over(order))
    runs = marked.groupBy("visitor_id", "run").agg(F.first(zone).alias("zone_id"), F.min_by("ts_us", "seq").alias("enter_us"), F.max_by("ts_us", "seq").alias("last_us"))
    after = F.lead("enter_us").over(Window.partitionBy("visitor_id").orderBy("run"))
    out = runs.withColumn("after", after).withColumn("exit_us", F.coalesce("after", "last_us"))
    return out.filter("zone_id <> ''").select("visitor_id", "zone_id", "enter_us", "exit_us", F.expr("(exit_us - enter_us) div 1000").alias("dwell_ms"), F.col("after").isNull().alias("flushed"))


def dwell_checkpoints(intervals: DataFrame, every_us: int = CHECKPOINT_US) -> DataFrame:
    """Checkpoints every 30 s of a stay, each with the time since the zone was entered."""
    n = F.expr(f"(exit_us - enter_us) div {every_us}")
    ticks = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    rows = intervals.select("visitor_id", "zone_id", "enter_us", F.explode(ticks).alias("k"))
    return rows.select("visitor_id", "zone_id", (F.col("enter_us") + F.col("k") * every_us).alias("ts_us"), F.expr(f"k * {every_us} div 1000").alias("dwell_ms"))


def line_side(x: Column, y: Column, line: tuple[float, float, float, float], inside_below: bool = True) -> Column:
    """inside, outside, or null beside the line's span (5 % of slack at both ends)."""
    x1, y1, x2, y2 = line
    dx, dy = x2 - x1, y2 - y1
    if dx == 0 and dy == 0:
        return F.lit(None).cast("string")
    t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)
    d = dx * (y - y1) - dy * (x - x1)
    inside = d > 0 if inside_below else d < 0
    return F.when((t >= -SPAN_SLACK) & (t <= 1 + SPAN_SLACK), F.when(inside, "inside").otherwise("outside"))


def line_crossings(sides: DataFrame, frames: int = CROSS_FRAMES) -> DataFrame:
    """ENTRY and EXIT out of ``sides(track_id, seq, side)``: a side counts once it held for three frames running.

    Frames without a side are skipped and do not break a run. The first side seen counts at once.
    """
    order = Window.partitionBy("track_id").orderBy("seq")
    seen = sides.filter("side is not null")
    turned = F.coalesce(F.lag("side").over(order) != F.col("side"), F.lit(True))
    seen = seen.withColumn("run", F.sum(turned.cast("int")).over(order))
    seen = seen.withColumn("nth", F.row_number().over(Window.partitionBy("track_id", "run").orderBy("seq")))
    sure = seen.filter((F.col("nth") == frames) & (F.col("run") > 1) | (F.col("nth") == 1) & (F.col("run") == 1))
    moved = sure.withColumn("prior", F.lag("side").over(order)).filter("prior <> side")
    return moved.select("track_id", "seq", F.when(F.col("side") == "inside", ENTRY).otherwise(EXIT).alias("event_type"))


def entry_or_reentry(crossings: DataFrame) -> DataFrame:
    """Inward crossings after an exit of the same track become re-entries; ``exits`` counts those before."""
    before = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    exits = F.coalesce(F.sum((F.col("event_type") == EXIT).cast("int")).over(before), F.lit(0))
    named = crossings.withColumn("exits", exits)
    return named.withColumn("event_type", F.when((F.col("event_type") == ENTRY) & (F.col("exits") > 0), REENTRY).otherwise(F.col("event_type")))


def queue_stays(presence: DataFrame) -> DataFrame:
    """Stays in the queue area out of ``presence(camera_id, frame, ord, visitor_id, is_staff)``, one row per visitor and frame.

    A stay runs over frames of the camera's own frame list without a gap: (camera_id, visitor_id, is_staff,
    enter, ord, leave), leave being the first frame without the visitor (null at the end of the list).
    """
    frames = presence.select("camera_id", "frame").distinct()
    frames = sum_before(frames, ["camera_id"], ["frame"], F.lit(1), "nth")
    named = presence.join(frames, ["camera_id", "frame"])
    order = Window.partitionBy("camera_id", "visitor_id").orderBy("nth")
    named = named.withColumn("island", F.col("nth") - F.row_number().over(order))
    stays = named.groupBy("camera_id", "visitor_id", "island").agg(F.min("frame").alias("enter"), F.min_by("ord", "frame").alias("ord"), F.min_by("is_staff", "frame").alias("is_staff"), F.max("nth").alias("last"))
    following = frames.select("camera_id", (F.col("nth") - 1).alias("last"), F.col("frame").alias("leave"))
    return stays.join(following, ["camera_id", "last"], "left").drop("last", "island")


def queue_joins(stays: DataFrame) -> DataFrame:
    """One join per non-staff stay, with the guests already there: those that arrived before, less those gone in an earlier frame."""
    guests = stays.filter("not is_staff")
    come = guests.select("camera_id", F.col("enter").alias("at"), F.lit(1).alias("place"), "ord", F.lit(1).alias("step"), "visitor_id")
    go = guests.filter("leave is not null").select("camera_id", F.col("leave").alias("at"), F.lit(2).alias("place"), F.lit(0).alias("ord"), F.lit(-1).alias("step"), "visitor_id")
    run = sum_before(come.unionByName(go), ["camera_id"], ["at", "place", "ord"], F.col("step"), "queue_depth")
    return run.filter("step = 1").select("camera_id", "visitor_id", F.col("at").alias("frame"), "queue_depth")


def queue_abandons(stays: DataFrame, pos: DataFrame, clock: Column, window_us: int = ABANDON_US, least_us: int = MIN_QUEUE_US) -> DataFrame:
    """Guests that stayed 5 s or more, left, and did not buy within 45 s: (camera_id, visitor_id, leave_us, dwell_ms, abandoned_us).

    ``clock`` maps the column ``frame`` to microseconds; ``pos(visitor_id, ts_us)`` lists purchases.
    """
    gone = stays.filter("not is_staff and leave is not null")
    timed = gone.withColumn("frame", F.col("enter")).withColumn("enter_us", clock).withColumn("frame", F.col("leave")).withColumn("leave_us", clock)
    stayed = timed.filter(F.col("leave_us") - F.col("enter_us") >= least_us)
    bought = pos.select(F.col("visitor_id").alias("v"), F.col("ts_us").alias("t"))
    left = stayed.join(bought, (F.col("visitor_id") == F.col("v")) & (F.col("t") >= F.col("enter_us")) & (F.col("t") <= F.col("leave_us") + window_us), "left_anti")
    return left.select("camera_id", "visitor_id", "leave_us", F.expr("(leave_us - enter_us) div 1000").alias("dwell_ms"), (F.col("leave_us") + window_us).alias("abandoned_us"))


def session_seq(events: DataFrame) -> DataFrame:
    """Per visitor a running number that entries, exits and zone changes raise, checkpoints and queue events not."""
    raises = F.col("event_type").isin(ENTRY, REENTRY, EXIT, ZONE_ENTER, ZONE_EXIT).cast("int")
    order = Window.partitionBy("visitor_id").orderBy("arrival_seq")
    return events.select("visitor_id", "arrival_seq", "event_type", F.sum(raises).over(order).alias("session_seq"))
