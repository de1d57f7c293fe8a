import random

from footfall.operators import lifecycle


def test_company_is_a_sum_held_at_zero(spark):
    rng = random.Random(9)
    steps = [(f"p{rng.randrange(8)}", "q", k, rng.random() < 0.45) for k in range(500)]
    want = {}
    for a, _, _, near in steps:
        want[a] = max(0, want.get(a, 0) + (1 if near else -1))
    rows = spark.createDataFrame(steps, "a string, b string, seq long, near boolean")
    assert {r.a: r.score for r in lifecycle.company_scores(rows).collect()} == want


def test_states(spark):
    s = 1_000_000
    rows = spark.createDataFrame([("a", 0, 0, 10.0), ("b", 95 * s, 1, 10.0), ("c", 0, 2, 10.0), ("c", 20 * s, 3, 10.0), ("c", 100 * s, 4, 10.0), ("d", 200 * s, 5, 10.0)], "visitor_id string, ts_us long, seq long, retain_sec double")
    made = {r.visitor_id: (r.state, r.expirations) for r in lifecycle.lifecycle(rows, 100 * s).collect()}
    assert made == {"a": ("EXPIRED", 0), "b": ("SUSPENDED", 0), "c": ("ACTIVE", 2)}


def test_matches_ghosts_and_shapes(spark):
    new = spark.createDataFrame([(1, "A", [1.0, 0.0]), (2, "C", [1.0, 0.0])], "track_id long, camera_id string, embedding array<double>")
    active = spark.createDataFrame([("v", "B", [0.9, 0.1]), ("w", "B", [0.8, 0.6]), ("x", "A", [1.0, 0.0]), ("y", "B", None)], "visitor_id string, camera_id string, embedding array<double>")
    links = spark.createDataFrame([("B", "A")], "camera_id string, neighbour_id string")
    assert [(r.track_id, r.visitor_id) for r in lifecycle.adjacent_matches(new, active, links).collect()] == [(1, "v")]
    lost = spark.createDataFrame([("S", "v", "A", 0.5, 0.5, 0.1, 0.0, 0.9, 0.0, 0), ("S", "w", "A", 0.5, 0.5, 0.0, 0.0, 0.3, 0.0, 0), ("S", "x", "A", 0.5, 0.5, 0.0, 0.0, 0.9, 1.0, 0)], "store_id string, visitor_id string, camera_id string, x double, y double, vx double, vy double, confidence double, retain_sec double, lost_us long")
    alive = lifecycle.ghosts(lost, 2_000_000)
    assert [(r.visitor_id, round(r.predicted_x, 6)) for r in alive.collect()] == [("v", round(0.5 + 0.2 * 0.95**2, 6))]
    seen = spark.createDataFrame([(1, "S", "A", 0.7, 0.5), (2, "S", "A", 0.0, 0.0), (3, "S", "B", 0.0, 0.0)], "track_id long, store_id string, camera_id string, x double, y double")
    assert sorted(r.track_id for r in lifecycle.ghost_candidates(alive, seen).collect()) == [1, 3]
    events = spark.createDataFrame([(1, "C", "Z"), (2, "C", "Y"), (3, "C", None)], "arrival_seq long, camera_id string, zone_id string")
    shapes = spark.createDataFrame([("C", "Z", "queue_area", "q")], "camera_id string, shape_id string, role string, label string")
    assert {r.arrival_seq: r.role for r in lifecycle.shape_of(events, shapes).collect()} == {1: "queue_area", 2: None, 3: None}
