"""Live visitor passports: seen, lost and expired in event time, with what each visitor did in the zones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.behavior import CHECKPOINT_US
from ..schema import SECOND

ACTIVE, SUSPENDED, EXPIRED, DWELL = "ACTIVE", "SUSPENDED", "EXPIRED", "DWELL"
#: A passport's state goes so long after it expired.
FORGET_US = 86_400 * SECOND
OUTPUT = "visitor_id string, at_us long, what string, last_us long, expirations long, zone_id string, dwell_ms long, zones int"
PASSPORT = "state string, last_us long, retain_us long, expirations long, zone_id string, enter_us long, told long, timer_ms long, zones map<string, long>"
_FIELDS = [f.split()[0] for f in PASSPORT.split(", ")[:9]]
_TOLD = Row(*[f.split()[0] for f in OUTPUT.split(", ")])
#: The state store that timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def due_us(p: dict, active_us: int, forget_us: int) -> int:
    """When a passport changes next if nobody sees its visitor: it is active up to ``active_us`` after the last sighting, then suspended up to its retention."""
    if p["state"] == ACTIVE:
        return p["last_us"] + active_us + 1
    return p["last_us"] + max(p["retain_us"], active_us) + 1 + (forget_us if p["state"] == EXPIRED else 0)


def elapse(p: dict, now_us: int, active_us: int) -> Iterator[tuple[int, str]]:
    """The changes of a passport up to a time, as (time, state)."""
    while p["state"] != EXPIRED:
        at = due_us(p, active_us, 0)
        if at > now_us:
            return
        p["state"] = EXPIRED if p["state"] == SUSPENDED or p["retain_us"] <= active_us else SUSPENDED
        yield at, p["state"]


def sight(p: dict | None, ts_us: int, retain_us: int, zone: str, active_us: int) -> tuple[dict, list[tuple[int, str, str, int, int]], tuple[str, int] | None]:
    """(passport, changes, (zone that was left, its dwell in microseconds)) after a sighting in ``zone`` ('' for none).

    Changes are (time, what, zone, dwell in ms, expirations so far): lifecycle states, and a DWELL for every 30 s in a zone.
    """
    if p is None:
        fresh = dict(zip(_FIELDS, (ACTIVE, ts_us, retain_us, 0, zone, ts_us, 0, 0, {})))
        return fresh, [(ts_us, ACTIVE, zone, 0, 0)], None
    made = [(at, what, p["zone_id"], 0, p["expirations"]) for at, what in elapse(p, ts_us, active_us)]
    if p["state"] != ACTIVE:
        p["expirations"] += p["state"] == EXPIRED
        p["state"] = ACTIVE
        made.append((ts_us, ACTIVE, zone, 0, p["expirations"]))
    left = None
    if p["zone_id"]:
        told = (ts_us - p["enter_us"]) // CHECKPOINT_US
        made += [(p["enter_us"] + k * CHECKPOINT_US, DWELL, p["zone_id"], k * CHECKPOINT_US // 1000, p["expirations"]) for k in range(p["told"] + 1, told + 1)]
        p["told"] = max(p["told"], told)
    if zone != p["zone_id"]:
        left = (p["zone_id"], ts_us - p["enter_us"]) if p["zone_id"] else None
        p.update(zone_id=zone, enter_us=ts_us, told=0)
    p.update(last_us=ts_us, retain_us=retain_us)
    return p, made, left


class Passports(StatefulProcessor):
    """A passport a visitor as value state, with its time in each zone it left, and one event-time timer for its next change.

    Each call to the state is a round trip to the JVM and costs more than a sighting, so a visitor's state is read once and written once a batch.
    """

    def __init__(self, active_us: int, forget_us: int):
        self.active_us, self.forget_us = active_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passport = handle.getValueState("passport", PASSPORT)

    def _keep(self, p: dict) -> None:
        timer = -(-due_us(p, self.active_us, self.forget_us) // 1000)
        if timer != p["timer_ms"]:
            if p["timer_ms"]:
                self.handle.deleteTimer(p["timer_ms"])
            self.handle.registerTimer(timer)
            p["timer_ms"] = timer
        self.passport.update(tuple(p[f] for f in _FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.passport.get()
        p = dict(zip(_FIELDS, kept)) if kept else None
        out = []
        for ts, _, retain, zone in sorted((r.ts_us, r.seq, r.retain_us, r.zone_id) for r in rows):
            p, made, left = sight(p, ts, retain, zone, self.active_us)
            if left:
                p["zones"][left[0]] = p["zones"].get(left[0], 0) + left[1]
            out += [(*m, p["last_us"]) for m in made]
        self._keep(p)
        for at, what, zone, dwell, n, last in out:
            yield _TOLD(key[0], at, what, last, n, zone or None, dwell, len(p["zones"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.passport.get()
        p = dict(zip(_FIELDS, kept)) if kept else None
        if p is None or expiredTimerInfo.getExpiryTimeInMs() != p["timer_ms"]:
            return
        p["timer_ms"] = 0
        if p["state"] == EXPIRED:
            self.passport.clear()
            return
        # all that is due by the watermark at once: no later sighting can be older
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        made = list(elapse(p, now * 1000, self.active_us))
        self._keep(p)
        for at, what in made:
            yield _TOLD(key[0], at, what, p["last_us"], p["expirations"], p["zone_id"] or None, 0, len(p["zones"]))

    def close(self) -> None:
        pass


def passport_changes(sightings: DataFrame, active_us: int = 0, delay: str = "10 minutes", forget_us: int = FORGET_US) -> DataFrame:
    """(visitor_id, at_us, what, last_us, expirations, zone_id, dwell_ms, zones) of a stream of ``sightings(visitor_id, ts_us, seq, retain_sec, zone_id)``.

    A row for each change of a passport between ACTIVE, SUSPENDED and EXPIRED, at the time it took effect, and for each DWELL of 30 s;
    ``zones`` counts the zones it has left. Losses are told once the watermark, ``delay`` behind the newest sighting, has passed them;
    sightings older than that are dropped. Needs the state store named by ``PROVIDER``.
    """
    timed = sightings.select(
        "visitor_id", F.timestamp_micros("ts_us").alias("event_time"), "ts_us", "seq", F.coalesce(F.col("retain_sec") * SECOND, F.lit(0)).cast("long").alias("retain_us"), F.coalesce("zone_id", F.lit("")).alias("zone_id")
    ).withWatermark("event_time", delay)
    return timed.groupBy("visitor_id").transformWithState(Passports(active_us, forget_us), OUTPUT, "Update", "EventTime")


def states_at(changes: DataFrame, as_of_us: int) -> DataFrame:
    """(visitor_id, state, expirations): each passport as the told changes leave it at a time."""
    kept = changes.filter((F.col("what") != DWELL) & (F.col("at_us") <= as_of_us))
    # a visitor may come back the moment it expires
    order = F.struct("at_us", F.col("what") == ACTIVE)
    return kept.groupBy("visitor_id").agg(F.max_by(F.struct(F.col("what").alias("state"), "expirations"), order).alias("s")).select("visitor_id", "s.*")
