import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import floor, graph, identity, lifecycle, ranks

SECOND = 1_000_000


def plain_groups(rows, size=6):
    """Groups merged in order, as sets."""
    of = {}
    for _, a, b in sorted((s, a, b) for a, b, s in rows):
        both = of.get(a, {a}) | of.get(b, {b})
        if len(both) <= size:
            for v in both:
                of[v] = both
    return {v: (min(g), len(g)) for v, g in of.items()}


def test_groups_merge_in_order_up_to_six(spark):
    rng = random.Random(3)
    rows = {k: list({(a, b): (a, b, rng.randrange(500)) for a, b in (sorted(rng.sample([f"V{i:02d}" for i in range(40)], 2)) for _ in range(45))}.values()) for k in ("s1", "s2", "s3")}
    table = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "store_id string, a string, b string, seq long")
    made = {(r.store_id, r.visitor_id): (r.group_id, r.members) for r in floor.merge_groups(table, "store_id").collect()}
    assert made == {(k, v): g for k, rs in rows.items() for v, g in plain_groups(rs).items()}
    rounds = floor.merge_groups(table, "store_id", fold_pairs=20).collect()
    assert {(r.store_id, r.visitor_id): (r.group_id, r.members) for r in rounds} == made
    assert max(n for _, n in made.values()) == 6 and floor.merge_groups(table.limit(0), "store_id").collect() == []


def test_groups_of_met_visitors_without_their_pairs(spark):
    rng = random.Random(5)
    spots = [(c, f, f"V{v}", rng.random() * 960, rng.random() * 540) for c in ("s1", "s2") for f in range(6) for v in rng.sample(range(90), 50)]
    pairs = {}
    for (c, f, a, ax, ay), (d, g, b, bx, by) in ((p, q) for p in spots for q in spots if p[:2] == q[:2] and p[2] < q[2]):
        if math.hypot(ax - bx, ay - by) <= 150:
            pairs.setdefault((c, a, b), f)
    want = {(k, v): g for k in ("s1", "s2") for v, g in plain_groups([(a, b, f) for (c, a, b), f in pairs.items() if c == k]).items()}
    table = spark.createDataFrame(spots, "camera_id string, frame long, visitor_id string, px double, py double")
    made = floor.meeting_groups(table).collect()
    assert len(made) == len(want) and {(r.camera_id, r.visitor_id): (r.group_id, r.members) for r in made} == want
    assert len({n for _, n in want.values()}) > 1 and floor.meeting_groups(table.limit(0)).collect() == []


@pytest.mark.parametrize("block", [8192, 9])
def test_company_of_blocks_without_the_pairs_of_a_frame(spark, block):
    rng = random.Random(6)
    spots = [(c, f, f"V{v}", rng.randrange(96) * 10.0, rng.randrange(54) * 10.0) for c in ("s1", "s2") for f in range(8) for v in rng.sample(range(60), 40)]
    table = spark.createDataFrame([*spots, ("s1", 1, "V98", None, 1.0), (None, 1, "V99", 1.0, 1.0)], "camera_id string, frame long, visitor_id string, px double, py double")
    want = sorted(map(tuple, floor.companions(floor.group_pairs(table), frames=3).collect()))
    assert sorted(map(tuple, floor.company(table, frames=3, block=block).collect())) == want and len(want) > 20
    assert floor.company(table.limit(0)).collect() == []


def test_company_measures_each_place_once(monkeypatch):
    """Two blocks of 200 visitors at 12 places through 300 frames: 144 distances a frame at most, not 40,000, and counts that outgrow 8 bits."""
    rng, measured, root = np.random.default_rng(3), [], np.sqrt
    monkeypatch.setattr(floor.np, "sqrt", lambda d: measured.append(d.size) or root(d))
    spots, pair, want = rng.integers(0, 40, (12, 2)) * 20.0, floor._BlockPair(0, 1, 150.0), np.zeros((200, 200), int)
    pair.names = {0: [f"A{k:03d}" for k in range(200)], 1: [f"B{k:03d}" for k in range(200)]}
    for frame in range(300):
        # the second block is here as a whole, or with few
        who = np.arange(150, dtype=np.int32), np.arange(200 if frame < 280 else 5, dtype=np.int32)
        at = [np.where(w < 20, 0, rng.integers(0, 12, len(w))) for w in who]
        for block in (0, 1):
            pair.put((frame, "c"), block, [who[block], *spots[at[block]].T])
        apart = spots[at[0]][:, None] - spots[at[1]]
        want[: len(at[0]), : len(at[1])] += root((apart * apart).sum(axis=2)) <= 150
    made = [r for batch in pair.told(3) for r in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(made) == [(f"A{k:03d}", f"B{m:03d}", want[k, m]) for k in range(200) for m in range(200) if want[k, m] >= 3]
    assert want.max() == 300 and sum(measured) <= 300 * 144


def test_identity_bursts_by_a_running_sum(spark):
    rng = random.Random(8)
    seen = [("s", f"V{n}", rng.randrange(400) * 500_000 if n % 3 else 150_000_000 + rng.randrange(20) * 500_000) for n in range(300)]
    recent = {t: sum(t - 60_000_000 <= u <= t for _, _, u in seen) for _, _, t in seen}
    base = next(recent[t] for t in sorted(recent) if recent[t] >= 10)
    since = next(t for t in sorted(recent) if recent[t] >= 10)
    made = floor.identity_bursts(spark.createDataFrame(seen, "store_id string, visitor_id string, ts_us long"))
    assert sorted(map(tuple, made.collect())) == sorted(("s", t, n, base) for t, n in recent.items() if t >= since and n > 3 * base) != []
    # a window of the last minute would be added up anew for each of its rows
    assert "RangeFrame" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_groups_split_at_their_own_camera(spark):
    spots = spark.createDataFrame([(c, 1, v, x, 0.0) for c in ("c", "d") for v, x in (("a", 0.0), ("b", 400.0))], "camera_id string, frame int, visitor_id string, px double, py double")
    groups = spark.createDataFrame([("c", "a", "a"), ("c", "b", "a")], "camera_id string, visitor_id string, group_id string")
    assert [(r.camera_id, r.apart) for r in floor.group_splits(spots, groups).collect()] == [("c", 400.0)]


def test_directions_along_diagonals_as_the_c_library_has_them(spark):
    spots = [(f"V{n}", a, b) for n, (a, b) in enumerate((a, b) for a in range(420, 1000, 29) for b in range(420, 1000, 23))]
    ends = [(v, k, k * 1_000_000, (a - 400 * k) / 1000, (b - 400 * k) / 1000, None, "ZONE_ENTER", 0) for v, a, b in spots for k in (0, 1)]
    made = {r.visitor_id: r.rhythm for r in identity.visitor_dna(spark.createDataFrame(ends, "visitor_id string, seq int, ts_us long, x double, y double, zone_id string, event_type string, dwell_ms long")).collect()}
    angle = lambda a, b: math.atan2((b - 400) / 1000 - b / 1000, (a - 400) / 1000 - a / 1000) + 2 * math.pi
    assert {v: r.index(1.0) for v, r in made.items()} == {v: int(angle(a, b) / (2 * math.pi) * 8) for v, a, b in spots}


def test_pairs_are_confirmed_once_and_boost_their_group(spark):
    near = [1, 1, 1, 1, 0, 1, 1, 1]
    frames = spark.createDataFrame([("a", "b", i, bool(n)) for i, n in enumerate(near)] + [("a", "c", i, i < 4) for i in range(9)], "a string, b string, seq int, near boolean")
    assert [tuple(r) for r in floor.confirmed_pairs(frames).collect()] == [("a", "b", 6)]
    groups = spark.createDataFrame([("s", v, "a", 5) for v in "abcde"] + [("s", "x", "x", 2)], "k string, visitor_id string, group_id string, members int")
    close = spark.createDataFrame([("s", "a", o) for o in "bcdex"] + [("s", "b", "a"), ("s", "x", "a")], "k string, visitor_id string, other_id string")
    assert {r.visitor_id: round(r.boost, 6) for r in floor.group_boost(close, groups, "k").collect()} == {"a": 0.3, "b": 0.1}
    spots = spark.createDataFrame([("c", 1, "a", 0.0, 0.0), ("c", 1, "b", 100.0, 120.0), ("c", 2, "a", 0.0, 0.0), ("c", 2, "b", 10.0, 10.0)], "camera_id string, frame int, visitor_id string, px double, py double")
    assert [(r.frame, r.group_id) for r in floor.group_splits(spots, groups).collect()] == [(1, "a")]


def test_teleports_are_reported_at_most_every_thirty_seconds(spark):
    times = [0, 10, 29, 30, 59, 61, 200]
    jumps = spark.createDataFrame([("v", t * SECOND, k, "x") for k, t in enumerate(times)] + [("w", 5 * SECOND, 0, "y")], "visitor_id string, ts_us long, seq long, zone_to string")
    told = floor.teleport_reports(jumps)
    assert told.columns == jumps.columns
    assert sorted((r.visitor_id, r.ts_us // SECOND) for r in told.collect()) == [("v", 0), ("v", 30), ("v", 61), ("v", 200), ("w", 5)]


def plain_continuation(tracks, pairs, beside):
    visitor, taken, out = {}, set(), {}
    for _, track in sorted((s, t) for t, s in tracks):
        free = sorted((-sc, lost) for lost, seen, sc, ok in pairs if seen == track and ok and lost in visitor and lost not in taken)
        if free:
            taken.add(free[0][1])
            visitor[track] = visitor[free[0][1]]
            out[track] = (visitor[track], False, -free[0][0])
        elif track in beside and beside[track][0] in visitor:
            visitor[track] = visitor[beside[track][0]]
            out[track] = (visitor[track], False, beside[track][1])
        else:
            visitor[track] = track
            out[track] = (track, True, 1.0)
    return out


@pytest.mark.parametrize("with_overlaps", [False, True])
def test_identities_are_taken_over_once(spark, with_overlaps):
    rng = random.Random(6)
    tracks = [(t, rng.randrange(1000)) for t in range(80)]
    pairs = [(a, b, round(rng.random(), 2), rng.random() < 0.6) for a in range(80) for b in rng.sample(range(80), 3) if a != b]
    beside = {t: (rng.randrange(80), 0.75) for t in range(0, 80, 4)} if with_overlaps else {}
    table = spark.createDataFrame([(k, t, s) for k in ("x", "y") for t, s in tracks], "k string, track_id long, start_us long")
    scored = spark.createDataFrame([("x", *p) for p in pairs], "k string, lost_id long, seen_id long, identity_score double, should_associate boolean")
    overlaps = spark.createDataFrame([(t, w, s) for t, (w, s) in beside.items()], "track_id long, with_id long, similarity double") if with_overlaps else None
    made = {(r.k, r.track_id): (r.visitor_id, r.is_new, r.reid_confidence) for r in lifecycle.continue_identities(table, scored, "k", overlaps).collect()}
    want = {("x", t): v for t, v in plain_continuation(tracks, pairs, beside).items()} | {("y", t): v for t, v in plain_continuation(tracks, [], beside).items()}
    assert made == want and sum(not new for _, new, _ in made.values()) > 20


def test_shadows_step_by_step(spark):
    rng = random.Random(2)
    lost = [("c", f"v{k}", 0, *(x := [rng.uniform(0, 0.9), rng.uniform(0, 0.9)]), x[0] + 0.1, x[1] + 0.1, rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)) for k in range(40)] + [("c", "still", 0, 0.1, 0.1, 0.2, 0.2, 0.0005, 0.0)]
    table = spark.createDataFrame(lost, "camera_id string, visitor_id string, lost_frame int, x1 double, y1 double, x2 double, y2 double, vx double, vy double")
    for frames in (0, 1, 7, 75, 76, 95):
        want = {}
        for _, v, _, *box, vx, vy in lost[:-1]:
            sure = 1.0
            for _ in range(frames):
                box = [max(0.0, min(1.0, c + (vx if k % 2 == 0 else vy))) for k, c in enumerate(box)]
                vx, vy, sure = vx * 0.98, vy * 0.98, sure * 0.97
            if frames <= 90 and sure >= 0.1:
                want[v] = [*box, sure]
        made = {r.visitor_id: [r.x1, r.y1, r.x2, r.y2, r.confidence] for r in lifecycle.shadows(table, F.lit(frames)).collect()}
        assert set(made) == set(want) and all(np.allclose(made[v], want[v]) for v in want)


def test_ghosts_that_nobody_brought_back(spark):
    lost = spark.createDataFrame([("s", "a", "c1", 0.5, 20.0, 0), ("s", "b", "c1", 0.3, 20.0, 0), ("s", "c", "c2", 0.9, 0.0, 0), ("s", "d", "c2", 0.9, 5.0, 0), ("s", "e", "c2", 0.9, 0.0, 80 * SECOND)], "store_id string, visitor_id string, camera_id string, confidence double, retain_sec double, lost_us long")
    back = spark.createDataFrame([("d",)], "visitor_id string")
    assert sorted((r.visitor_id, r.expired_us // SECOND) for r in lifecycle.ghost_failures(lost, back, 100 * SECOND).collect()) == [("a", 20), ("c", 30)]


def test_hops_on_long_lines_and_dense_clusters(spark):
    links = [(f"L{k:02d}", f"L{k + 1:02d}") for k in range(30)] + [(f"H{a}", f"H{b}") for a in range(9) for b in range(a)] + [("H0", "L15"), ("Z", None), ("I", "J")]
    made = {(r.cam_from, r.cam_to): r.hops for r in graph.hops(spark, spark.createDataFrame(links, "camera_id string, neighbour_id string")).collect()}
    beside = {}
    for a, b in links:
        if b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    want = {}
    for start in beside:
        seen, edge, n = {start: 0}, {start}, 0
        while edge:
            n += 1
            edge = {y for x in edge for y in beside[x]} - set(seen)
            seen |= dict.fromkeys(edge, n)
        want |= {(start, c): d for c, d in seen.items()}
    assert made == want and max(made.values()) == 30


def test_adjacency_names_known_cameras_only(spark):
    cameras = spark.createDataFrame([("a",), ("b",), ("c",)], "camera_id string")
    good = spark.createDataFrame([("a", ["b", "c"]), ("c", [])], "camera_id string, neighbours array<string>")
    assert sorted(map(tuple, graph.adjacency_of(good, cameras).collect())) == [("a", "b"), ("a", "c")]
    for bad in ([("a", ["x"])], [("y", [])]):
        with pytest.raises(ValueError, match="unknown cameras"):
            graph.adjacency_of(spark.createDataFrame(bad, "camera_id string, neighbours array<string>"), cameras)


def test_reputation_folds_in_spans_like_one_by_one(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(camera, k, rng.choice(["success", "failure", "loss", "detection"])) for camera in ("CAM_ENTRY_01", "CAM_FLOOR_02", "CAM_GODOWN") for k in rng.sample(range(1000), 400)]
    table = spark.createDataFrame(rows, "camera_id string, seq long, kind string")
    whole = sorted(map(tuple, identity.camera_reputation(table).collect()))
    monkeypatch.setattr(identity, "FOLD_SPAN", 7)
    assert sorted(map(tuple, identity.camera_reputation(table).collect())) == whole
    for camera, role, reliability, risk, *_ in whole:
        y, x = (round(1000 * v) for v in identity.CAMERA_PRIORS[role])
        for _, k, kind in sorted(r for r in rows if r[0] == camera):
            x = min(1000, x + 10) if kind == "success" else max(500, x - 5) if kind == "failure" else x
            y = min(900, y + 3) if kind == "loss" else y
        assert (round(reliability * 1000), round(risk * 1000)) == (x, y)


def test_numbers_and_sums_in_spans(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), t, k, rng.choice([1, -1, 2])) for k, t in enumerate(rng.sample(range(10_000), 400))]
    table = spark.createDataFrame(rows, "k string, t long, n long, step long")
    made = {r.n: r.s for r in ranks.sum_before(table, ["k"], ["t", "n"], F.col("step"), "s", span=500).collect()}
    assert made == {n: sum(s for q, u, _, s in rows if q == k and u < t) for k, t, n, _ in rows}
    spread = spark.createDataFrame([(t * 100_000,) for t in rng.sample(range(10**7), 300)], "t long")
    got = [r.position for r in ranks.dense_positions(spread, "t").orderBy("t").collect()]
    assert got == list(range(1, 301))


def test_nearest_against_all_rows_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 8)).round(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, 120, 10):
        sims = {i: round(float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), 6) for i in range(120) if i != q}
        want[q] = [i for i, _ in sorted(sims.items(), key=lambda p: (-p[1], p[0]))[:3]]
    for blocks in ({}, {"query_block": 3, "vector_block": 20}):
        made = {}
        for r in identity.nearest(table.filter("vec_id % 10 = 0"), table, **blocks).orderBy("query_id", "rank").collect():
            made.setdefault(r.query_id, []).append(r.vec_id)
        assert made == want


def test_nearest_keeps_few_of_many_copies(spark):
    rows = [(n, [1.0, 2.0, 3.0] if n % 2 else [3.0, -2.0, float(n)]) for n in range(300)]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 3.0]), (303, [1.0, 2.0]), (304, [1.0, float("nan"), 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    side = table.selectExpr("'' AS at", "vec_id AS id", "embedding AS v")
    kept = identity.may_be_best(side.filter("id = 1"), side, 3, 1, 1, others=True).select("id").collect()
    assert sorted(r.id for r in kept) == [3, 5, 7, 304]
    made = [(r.vec_id, r.similarity) for r in identity.nearest(table.filter("vec_id = 1"), table.filter("vec_id < 304")).orderBy("rank").collect()]
    assert made == [(3, 1.0), (5, 1.0), (7, 1.0)]
    links = spark.createDataFrame([("c", "d")], "camera_id string, neighbour_id string")
    new, there = table.filter("vec_id in (1, 301)").selectExpr("vec_id AS track_id", "'c' AS camera_id", "embedding"), table.filter("vec_id < 303").selectExpr("concat('v', vec_id) AS visitor_id", "'d' AS camera_id", "embedding")
    assert [tuple(r) for r in lifecycle.adjacent_matches(new, there, links).collect()] == [(1, "v99", 1.0)]
