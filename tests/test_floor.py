import math
import random

import pytest
from pyspark.sql import functions as F

from footfall.operators import behavior, floor, geometry, graph, identity, ranks

from .helpers import log


def test_behaviour_fold(spark):
    rng = random.Random(7)
    kinds = ("ENTRY", "EXIT", "REENTRY", "ZONE_ENTER", "ZONE_EXIT", "ZONE_DWELL", "BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON")
    events = [(f"V{rng.randrange(6)}", rng.choice(kinds), k, {"dwell_ms": rng.choice([100, 20_000]), "zone_id": "Z"}) for k in range(400)]
    want, state = {}, {}
    for k, (v, kind, _, extra) in enumerate(events):
        s = state.get(v, "UNKNOWN")
        if kind in ("ENTRY", "REENTRY"):
            s = "ENTERED"
        elif kind == "EXIT":
            s = "EXITED"
        elif kind == "ZONE_ENTER" and s in ("UNKNOWN", "ENTERED") or kind == "ZONE_EXIT" and s == "DWELLING" or kind == "BILLING_QUEUE_ABANDON" and s == "QUEUEING":
            s = "BROWSING"
        elif kind == "ZONE_DWELL" and s == "BROWSING" and extra["dwell_ms"] >= 10_000:
            s = "DWELLING"
        elif kind == "BILLING_QUEUE_JOIN" and s != "EXITED":
            s = "QUEUEING"
        state[v] = want[k] = s
    assert {r.arrival_seq: r.state for r in behavior.behaviour_states(log(spark, *events)).collect()} == want
    last = spark.createDataFrame([("ENTERED", 0), ("ENTERED", 9_000_000), ("QUEUEING", 0)], "state string, ts_us long")
    assert sorted(r.state for r in behavior.time_ticks(last, F.lit(10_000_000)).collect()) == ["BROWSING", "ENTERED", "PURCHASE_CANDIDATE"]


def test_line_crossing_debounce(spark):
    def walk(sides):
        rows = spark.createDataFrame([("t", k, s) for k, s in enumerate(sides)], "track_id string, seq long, side string")
        return [(r.seq, r.event_type) for r in behavior.line_crossings(rows).orderBy("seq").collect()]

    o, i, n = "outside", "inside", None
    assert walk([o, i, i, i, i, o, o, o]) == [(3, "ENTRY"), (7, "EXIT")]
    assert walk([o, i, i, o, i, i, n, i]) == [(7, "ENTRY")] and walk([i, o, o]) == [] and walk([n, o, i, n, i, n, i]) == [(6, "ENTRY")]
    side = spark.range(1).select(*[behavior.line_side(F.lit(x), F.lit(y), (0.0, 0.5, 1.0, 0.5), below).alias(f"c{k}") for k, (x, y, below) in enumerate([(0.5, 0.6, True), (0.5, 0.4, True), (0.5, 0.4, False), (1.04, 0.6, True), (1.06, 0.6, True)])]).collect()[0]
    assert tuple(side) == (i, o, i, i, None)


def test_zone_intervals_and_checkpoints(spark):
    rows = spark.createDataFrame([("v", k, k, t * 1_000_000, z) for k, (t, z) in enumerate([(0, "A"), (40, "A"), (65, "B"), (70, None), (80, "B"), (81, "B")])], "visitor_id string, seq long, arrival_seq long, ts_us long, zone_id string")
    made = behavior.zone_changes(rows)
    assert sorted((r.zone_id, r.dwell_ms, r.flushed) for r in made.collect()) == [("A", 65_000, False), ("B", 1_000, True), ("B", 5_000, False)]
    assert sorted(r.dwell_ms for r in behavior.dwell_checkpoints(made).collect()) == [30_000, 60_000]


def test_queue_depth_and_abandon(spark):
    here = [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (1, "s"), (2, "b"), (2, "c"), (3, "c"), (3, "a")]
    present = spark.createDataFrame([("C", f, k, v, v == "s") for k, (f, v) in enumerate(here)], "camera_id string, frame long, ord long, visitor_id string, is_staff boolean")
    stays = behavior.queue_stays(present)
    assert {(r.visitor_id, r.frame): r.queue_depth for r in behavior.queue_joins(stays).collect()} == {("a", 0): 0, ("b", 0): 1, ("c", 2): 2, ("a", 3): 2}
    bought = spark.createDataFrame([("b", 20_000_000)], "visitor_id string, ts_us long")
    gone = behavior.queue_abandons(stays, bought, F.col("frame") * 10_000_000).collect()
    assert [(r.visitor_id, r.dwell_ms, r.abandoned_us) for r in gone] == [("a", 20_000, 65_000_000)]


def test_points_in_polygons(spark):
    rng = random.Random(3)
    poly = [(0.1, 0.1), (0.6, 0.2), (0.5, 0.55), (0.35, 0.3), (0.15, 0.6)]
    zones = spark.createDataFrame([("C", "Z", 0, [{"x": x, "y": y} for x, y in poly]), ("C", "ALL", 1, [{"x": x, "y": y} for x, y in [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])], "camera_id string, zone_id string, ord int, points array<struct<x:double,y:double>>")
    pix = [(math.floor(x * 960), math.floor(y * 540)) for x, y in poly]

    def inside(px, py):
        hit = False
        for (x1, y1), (x2, y2) in zip(pix, pix[1:] + pix[:1]):
            if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return True
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    spots = [(rng.randrange(960), rng.randrange(540)) for _ in range(500)] + pix + [(960, 540), (2000, 5)]
    points = spark.createDataFrame([(k, "C", float(x), float(y)) for k, (x, y) in enumerate(spots)], "point_id int, camera_id string, px double, py double")
    made = {r.point_id: r.zone_id for r in geometry.locate(points, zones, 960, 540).collect()}
    for k, (x, y) in enumerate(spots):
        assert made[k] == ("Z" if inside(x, y) else "ALL" if 0 <= x <= 960 and 0 <= y <= 540 else None), (x, y)


def test_shapes_and_clips():
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    assert geometry.shoelace(box(0, 0, 2, 1)) == 2 and geometry.shoelace([(0, 0), (1, 1)]) == 0
    assert abs(geometry.clip_area(box(0, 0, 2, 2), box(1, 1, 3, 3), exact=True) - 1) < 1e-9
    assert geometry.clip_area(box(0, 0, 1, 1), box(0, 0, 2, 2)) == 1 and geometry.clip_area(box(0, 0, 1, 1), box(2, 2, 3, 3), exact=True) == 0
    assert geometry.crosses_itself([(0, 0), (1, 1), (1, 0), (0, 1)]) and not geometry.crosses_itself(box(0, 0, 1, 1))


@pytest.mark.parametrize("exact", [False, True])
def test_clips_as_expressions(spark, exact):
    rng = random.Random(4)
    ring = lambda n, x, y, r: [(x + r * math.cos(2 * math.pi * k / n + 0.3), y + r * math.sin(2 * math.pi * k / n + 0.3)) for k in range(n)]
    rows = [(k, ring(rng.randrange(3, 8), rng.random(), rng.random(), 0.1 + rng.random()), ring(rng.randrange(3, 7), rng.random(), rng.random(), 0.1 + rng.random())) for k in range(60)]
    rows.append((60, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]))
    table = spark.createDataFrame(rows, "k int, p array<struct<x:double,y:double>>, w array<struct<x:double,y:double>>")
    made = table.select("k", geometry.clipped(F.col("p"), F.col("w"), exact).alias("c")).collect()
    for r in made:
        _, p, w = rows[r.k]
        assert abs(geometry.shoelace([(v.x, v.y) for v in r.c]) - geometry.clip_area(p, w, exact)) < 1e-9


def test_calibration_codes(spark):
    from footfall.plans.floor_queries import _shapes

    found = {(r.camera_id, r.code) for r in geometry.calibration_issues(_shapes(spark)).collect()}
    entry, billing, second = "CAM_ENTRY_01", "CAM_BILLING_01", "CAM_02"
    assert found == {
        (entry, "MISSING_ENTRY_LINE"), (entry, "DUPLICATE_LABEL"), (entry, "MISSING_SHAPE_ID"), (entry, "MISSING_LABEL"), (billing, "MISSING_BILLING_COUNTER"), (billing, "DUPLICATE_ROLE"), (billing, "SELF_INTERSECT"),
        (billing, "DEGENERATE_POLYGON"), (second, "DUPLICATE_ROLE"), (second, "LINE_TOO_SHORT"), (second, "MISSING_INSIDE_IS"), (second, "INVALID_LINE"), (second, "POINT_OUT_OF_BOUNDS"), (second, "INVALID_POINT"),
        (second, "MISSING_ROLE"), (second, "EMPTY_POINTS"), (second, "TOO_FEW_POINTS"), *((entry, c) for _, c in found if c.startswith("POLYGON_OVERLAP")),
    }


SIGNALS = {"reid": 0.9, "fingerprint": 0.5, "trajectory": 0.8, "temporal": 0.9, "camera_transition": 0.8, "zone_plausibility": 0.9, "detection": 0.9, "track_health": 0.5, "group_continuity": 0.0, "staff_reputation": 0.0, "visitor_dna": 0.5}


def cases(spark, *changes):
    rows = [("L", f"c{k}", *{**SIGNALS, **c}.values()) for k, c in enumerate(changes)]
    return spark.createDataFrame(rows, "lost string, cand string, " + ", ".join(f"{k} double" for k in SIGNALS))


def test_vote_and_decision(spark):
    voted = identity.vote(cases(spark, {}, {"reid": 0.39}, {"reid": 0.85}, {"reid": 0.4, "trajectory": 0.0, "temporal": 0.0, "camera_transition": 0.0, "zone_plausibility": 0.0})).orderBy("cand").collect()
    want = sum(round(w * SIGNALS[k], 5) for k, w in identity.WEIGHTS.items())
    assert abs(voted[0].identity_score - round(want, 4)) < 1e-9 and voted[0].should_associate and voted[0].dominant == "reid"
    assert (voted[1].band, voted[1].identity_score, voted[1].should_associate) == ("REJECT", 0.39, False) and voted[3].band == "REJECT"
    best = identity.decide(identity.vote(cases(spark, {}, {"reid": 0.85})), "lost", "cand").collect()
    assert [(r.cand, r.second, r.competing, r.band) for r in best] == [("c0", "c1", True, "LOW")]
    heard = identity.courtroom(identity.vote(cases(spark, {"reid": 0.45, "trajectory": 0.75, "temporal": 0.3, "visitor_dna": 0.8}))).collect()[0]
    assert heard.verdict in ("veto", None) and (heard.verdict is None or heard.final_score == heard.identity_score * 0.5)
    spec = identity.courtroom(identity.vote(cases(spark, {"reid": 0.45, "trajectory": 0.75, "temporal": 0.3, "visitor_dna": 0.8})), "camera_transition").collect()[0]
    assert spec.verdict == "match" and spec.should_match
    assert identity.evidence(identity.vote(cases(spark, {}, {})), "lost", "cand", keep=1).count() == 11


def test_folds(spark):
    steps = spark.createDataFrame([("v", k, kind, 10.0) for k, kind in enumerate(["frame"] * 4 + ["reassociated"] * 6 + ["teleport", "suspended"])], "visitor_id string, seq long, kind string, seconds double")
    assert identity.track_health(steps).collect()[0].health == 100 - 15 - 3
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, None)], "k int, o int, v array<double>")
    x, y = identity.embedding_ewma(vectors, "k", "o", "v").collect()[0].embedding
    assert abs(x - 0.7 / math.hypot(0.7, 0.3)) < 1e-9 and abs(x * x + y * y - 1) < 1e-9
    print_ = "struct<embedding:array<double>,embedding_std:double,colours:array<double>,aspect:double,height:double,motion:array<double>>"
    one = ([1.0, 0.0], 0.0, [1.0, 1.0], 0.5, 0.5, None)
    same = spark.createDataFrame([(one, one)], f"a {print_}, b {print_}").select(identity.fingerprint_similarity("a", "b").alias("s")).collect()[0].s
    assert same == 1.0
    decay = spark.range(1).select(identity.occlusion_decay(F.lit("SHELF_OCCLUSION"), F.lit(10.0), F.lit(20.0)).alias("d")).collect()[0].d
    assert decay == 0.75


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "camera_id string, neighbour_id string")
    hops = {(r.cam_from, r.cam_to): r.hops for r in graph.hops(spark, links).collect()}
    assert hops[("a", "c")] == 2 and hops[("c", "c")] == 0 and ("a", "x") not in hops
    moves = spark.createDataFrame([("ZONE_EB", "ZONE_TFS"), ("ZONE_TFS", "ZONE_EB"), ("ZONE_EB", "ZONE_EB"), ("ZONE_EB", "ZONE_Q"), (None, "ZONE_EB")], "zone_from string, zone_to string")
    made = {(r.zone_from, r.zone_to): round(r.zone_probability, 6) for r in graph.zone_probability(moves, graph.zone_edges(spark)).collect()}
    assert list(made.values()).count(0.5) == 1 and made["ZONE_EB", "ZONE_TFS"] == 0.9 and made["ZONE_TFS", "ZONE_EB"] == 0.72 and made["ZONE_EB", "ZONE_EB"] == 1.0 and made["ZONE_EB", "ZONE_Q"] == 0.1
    edges = graph.camera_edges(spark, links, spark.createDataFrame([("a", "entry"), ("b", "floor")], "camera_id string, role string"))
    assert {(r.cam_from, r.cam_to): r.base for r in edges.collect()}[("a", "b")] == 0.85 and edges.count() == 6


@pytest.mark.parametrize("blacks, zone, want", [([0.9] * 10, False, (True, 0.9)), ([0.1] * 4, False, (False, 0.3)), ([0.0] * 3, True, (True, 0.99))])
def test_staff(spark, blacks, zone, want):
    rows = spark.createDataFrame([("v", k, b, "Z", "C", zone) for k, b in enumerate(blacks)], "visitor_id string, seq long, black double, zone_id string, camera_id string, staff_zone boolean")
    r = floor.staff_scores(rows).collect()[0]
    assert (r.is_staff, r.confidence) == want


def test_groups_and_numbers(spark):
    rng = random.Random(2)
    spots = [(rng.random() * 960, rng.random() * 540) for _ in range(60)]
    rows = spark.createDataFrame([("C", 0, f"v{k:02d}", x, y) for k, (x, y) in enumerate(spots)], "camera_id string, frame long, visitor_id string, px double, py double")
    want = {(f"v{i:02d}", f"v{j:02d}") for i in range(60) for j in range(i + 1, 60) if math.dist(spots[i], spots[j]) <= 150}
    assert {(r.a, r.b) for r in floor.group_pairs(rows).collect()} == want
    numbers = spark.range(200_000).select((F.col("id") * 7).alias("k")).repartition(5)
    made = ranks.dense_positions(numbers, "k")
    assert made.filter("position <> k div 7 + 1").count() == 0
    health = spark.createDataFrame([(0.0,)] * 3, "health double")
    assert floor.collapsed_tracks(health).count() == 1 and floor.collapsed_tracks(health.limit(2)).count() == 0


def test_near_pairs_meet_once(spark):
    """Positions on the borders of squares, left of zero and twice in a frame; a position is entered in five squares, not in nine."""
    rng = random.Random(5)
    spots = [(f"v{k % 40:02d}", rng.choice((-150.0, 0.0, 150.0, rng.uniform(-300, 500))), rng.choice((-150.0, 0.0, 150.0, rng.uniform(-300, 500)))) for k in range(70)]
    rows = spark.createDataFrame([("C", 0, *s) for s in spots], "camera_id string, frame long, visitor_id string, px double, py double")
    want = sorted(("C", 0, p[0], q[0]) for p in spots for q in spots if p[0] < q[0] and math.dist(p[1:], q[1:]) <= 150)
    found = floor.group_pairs(rows)
    assert sorted(map(tuple, found.collect())) == want
    entered = found._jdf.queryExecution().optimizedPlan().toString().split("explode(")[1].split("]]")[0]
    assert entered.count("[") == 6


def test_a_crowded_place_is_met_in_shares(spark, monkeypatch):
    """All of a square's visitors at a few places: more than one task has its pairs, and each pair comes once. A rounded distance of 150 counts two squares away."""
    monkeypatch.setattr(floor, "SHARE", 16, raising=False)
    monkeypatch.setattr(floor, "PACK", 7, raising=False)
    spots = [(f"v{k:03d}", 10.0 * (k % 3), 10.0) for k in range(120)]
    rows = spark.createDataFrame([("C", 0, *s) for s in spots], "camera_id string, frame long, visitor_id string, px double, py double")
    found = floor.group_pairs(rows).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in found) == [(p[0], q[0]) for k, p in enumerate(spots) for q in spots[k + 1 :]]
    assert len({r.task for r in found}) > 1
    edge = spark.createDataFrame([("C", 0, "v", -1e-20, 0.0), ("C", 0, "w", 150.0, 0.0)], rows.schema)
    assert [(r.a, r.b) for r in floor.group_pairs(edge).collect()] == [("v", "w")]
