import random

import pytest
from pyspark.sql import functions as F

from footfall.operators import correlation, projections, sessions
from footfall.schema import EVENT_TYPES, POS
from footfall.sources.fixtures import pos_transactions

from .helpers import AS_OF_US, BASE_US, log


def made(spark, *events, store="STORE_1"):
    return sessions.sessions(sessions.number_sessions(log(spark, *events, store=store)))


def fold(events):
    """An independent walk through the log: sessions as dictionaries."""
    open_, out, reentries = {}, [], {}
    for e in events:
        v, kind = e.visitor_id, e.event_type
        if kind == "ENTRY" and v in open_:
            open_.pop(v)["end"] = e.ts_us
        s = open_.get(v)
        if s is None:
            s = open_[v] = {"visitor": v, "store": e.store_id, "start": e.ts_us, "end": None, "staff": e.is_staff, "n": int(kind == "EXIT"), "conf": [], "first": e.confidence, "zones": [], "dwell": {}, "queue": [], "re": 0, "buy": False}
            out.append(s)
        if kind.startswith("ZONE"):
            if not e.zone_id:
                continue
            if kind == "ZONE_ENTER":
                s["zones"] += [e.zone_id] if e.zone_id not in s["zones"] else []
            else:
                s["dwell"][e.zone_id] = s["dwell"].get(e.zone_id, 0) + e.dwell_ms
        if kind == "REENTRY":
            reentries[v] = s["re"] = reentries.get(v, 0) + 1
        if kind == "BILLING_QUEUE_JOIN":
            z = e.zone_id or "ZONE_BILLING_QUEUE"
            s["zones"] += [z] if z not in s["zones"] else []
            s["queue"].append((kind, e.queue_depth, None))
            s["buy"] = True
        if kind == "BILLING_QUEUE_ABANDON":
            s["queue"].append((kind, None, e.wait_ms or e.dwell_ms or None))
        s["n"] += 1
        s["conf"].append(e.confidence)
        if kind == "EXIT":
            open_.pop(v)["end"] = e.ts_us
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    events, t = [], 0
    for _ in range(600):
        t += rng.random() * 4
        extra = {"zone_id": rng.choice([None, "", "ZONE_1", "ZONE_2", "ZONE_BILLING_9"]), "dwell_ms": rng.choice([0, 500, 7000]), "is_staff": rng.random() < 0.2, "confidence": rng.randrange(100) / 100, "queue_depth": rng.randrange(-1, 9), "wait_ms": rng.choice([None, 0, 900]), "store_id": f"STORE_{rng.randrange(2)}"}
        events.append((f"V{rng.randrange(25)}", rng.choice(EVENT_TYPES), t, extra))
    table = log(spark, *events)
    numbered = sessions.number_sessions(table)
    rows = sessions.sessions(numbered).collect()
    dwell = {(r.visitor_id, r.session_no): r.dwell_per_zone for r in sessions.dwell_map(sessions.session_dwell(numbered)).collect()}
    got = {(r.visitor_id, r.start_us, r.event_count): r for r in rows}
    want = fold(table.orderBy("arrival_seq").collect())
    assert len(rows) == len(want) and sum(r.is_active for r in rows) == len({s["visitor"] for s in want if s["end"] is None})
    for s in want:
        r = got[s["visitor"], s["start"], s["n"]]
        mean = sum(s["conf"]) / len(s["conf"]) if s["conf"] else s["first"]
        assert (r.store_id, r.end_us, r.is_staff, r.zones_visited, r.reentry_count, r.purchase_candidate) == (s["store"], s["end"], s["staff"], s["zones"], s["re"], s["buy"])
        assert [(q.event_type, q.queue_depth, q.wait_ms) for q in r.queue_events] == s["queue"]
        assert abs(r.avg_confidence - mean) < 1e-9 and dwell.get((r.visitor_id, r.session_no), {}) == s["dwell"]


def test_case_catalogue(spark):
    happy = made(spark, ("V", "ENTRY", 0), ("V", "ZONE_ENTER", 20, {"zone_id": "Z"}), ("V", "EXIT", 40)).collect()
    assert [(s.duration_ms, s.event_count, s.is_active) for s in happy] == [(40_000, 3, False)]
    orphan = made(spark, ("V", "ENTRY", 0), ("V", "ENTRY", 9)).orderBy("session_no").collect()
    assert [s.end_us for s in orphan] == [BASE_US + 9_000_000, None]
    stub = made(spark, ("V", "EXIT", 5)).collect()
    assert [(s.start_us, s.event_count) for s in stub] == [(stub[0].end_us, 2)]
    implicit = made(spark, ("V", "ZONE_ENTER", 3, {"zone_id": "Z"})).collect()
    assert implicit[0].is_active and implicit[0].zones_visited == ["Z"]
    again = made(spark, ("V", "ENTRY", 0), ("V", "EXIT", 5), ("V", "REENTRY", 30)).orderBy("session_no").collect()
    assert [s.reentry_count for s in again] == [0, 1] and len({s.session_id for s in again}) == 2
    same = made(spark, ("V", "ENTRY", 0), ("V", "EXIT", 5)).collect()[0]
    assert same.session_id == again[0].session_id


def pos(spark, *seconds, store="STORE_1"):
    return spark.createDataFrame([(store, f"T{k}", BASE_US + int(s * 1_000_000), 10.0) for k, s in enumerate(seconds)], POS)


@pytest.mark.parametrize("second, hit", [(180, True), (360, False), (0, True), (300, True), (300.000001, False), (-1, False)])
def test_transaction_window(spark, second, hit):
    s = made(spark, ("V", "ENTRY", 0), ("V", "BILLING_QUEUE_JOIN", 0))
    assert correlation.correlate(s, pos(spark, second)).count() == int(hit)
    assert correlation.correlate(s, pos(spark, second, store="STORE_2")).count() == 0


def test_presence_falls_back_and_staff_never_converts(spark):
    s = made(spark, ("V", "ENTRY", 0), ("V", "ZONE_ENTER", 5, {"zone_id": "zone_cash_1"}), ("V", "EXIT", 50), ("W", "ENTRY", 0, {"is_staff": True}), ("W", "BILLING_QUEUE_JOIN", 1), ("X", "ENTRY", 0), ("X", "ZONE_ENTER", 2, {"zone_id": "QUEUE_AREA"}))
    held = {r.visitor_id: r.billing_us for r in correlation.last_billing_presence(s).collect()}
    assert held == {"V": BASE_US + 50_000_000, "W": BASE_US + 1_000_000, "X": None}
    found = correlation.with_conversion(s, pos(spark, 60, 2, 3)).filter("pos_converted").collect()
    assert [r.visitor_id for r in found] == ["V"] and found[0].purchase_candidate


def test_projections_of_small_stores(spark):
    events = [("A", "ENTRY", 0), ("A", "EXIT", 5), ("A", "REENTRY", 30), ("A", "BILLING_QUEUE_JOIN", 31, {"queue_depth": 9}), ("A", "BILLING_QUEUE_ABANDON", 35), ("A", "EXIT", 40), ("S", "ENTRY", 0, {"is_staff": True})]
    s = correlation.with_conversion(made(spark, *events), pos(spark))
    stores = spark.createDataFrame([("STORE_1",), ("POS_ONLY",)], "store_id string")
    m = {r.store_id: r for r in projections.metrics(s, stores).collect()}
    a = m["STORE_1"]
    assert (a.unique_visitors, a.converted_count, a.conversion_rate, a.abandonment_rate, a.max_queue_depth, a.total_sessions) == (1, 1, 1.0, 1.0, 9, 2)
    assert (m["POS_ONLY"].unique_visitors, m["POS_ONLY"].conversion_rate, m["POS_ONLY"].total_sessions) == (0, 0.0, 0)
    f = {(r.store_id, r.stage): (r.visitors, r.pct_of_top, r.drop_off_pct) for r in projections.funnel(s, stores).collect()}
    assert f["STORE_1", "PURCHASE"] == (1, 100.0, 0.0) and f["POS_ONLY", "ENTRY"] == (0, 100.0, 0.0) and f["POS_ONLY", "PURCHASE"] == (0, 0.0, 0.0) and len(f) == 8
    assert {r.stage: r.visitors for r in projections.funnel(s, pos_only=True).collect()}["PURCHASE"] == 0
    assert projections.queue_spikes(s).collect()[0].severity == "CRITICAL"
    assert projections.as_json(projections.metrics(s)).count() == 1


def test_dwell_and_confidence(spark):
    events = [e for v, d in (("A", 6000), ("B", 2000)) for e in ((v, "ENTRY", 0), (v, "ZONE_EXIT", 5, {"zone_id": "Z", "dwell_ms": d}))]
    numbered = sessions.number_sessions(log(spark, *events))
    s, d = sessions.sessions(numbered).withColumn("pos_converted", F.lit(False)), sessions.session_dwell(numbered)
    assert [r.avg_dwell_ms for r in projections.avg_dwell_per_zone(s, d).collect()] == [4000]
    heat = projections.heatmap(s, d).collect()
    assert [(r.zone_id, r.visits, r.dwell_score, r.data_confidence) for r in heat] == [("Z", 0, 100, False)]


def test_dead_zone_and_health(spark):
    events = log(spark, ("A", "ENTRY", 0), ("A", "ZONE_ENTER", 1, {"zone_id": "Z"}), ("A", "EXIT", 2700), ("B", "ENTRY", 100))
    s = sessions.sessions(sessions.number_sessions(events))
    dead = projections.dead_zones(s, AS_OF_US).collect()
    assert [(r.zone_id, r.minutes_idle) for r in dead] == [("Z", 45.0)]
    assert projections.dead_zones(s, BASE_US + 2_800_000_000).count() == 0
    h = projections.health(events, s, BASE_US + 700_000_000).collect()[0]
    assert (h.last_event_us, h.lag_seconds, h.stale_feed, h.status) == (BASE_US + 100_000_000, 600.0, False, "OK")
    assert projections.system_status(projections.health(events, s, AS_OF_US)).collect()[0].status == "DEGRADED"


def test_grid_of_transactions(spark):
    assert pos_transactions(spark).count() == 18
