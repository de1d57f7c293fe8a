import random

import pytest

from footfall.operators import verifier
from footfall.schema import SECOND

from .helpers import BASE_US, log


def plain_staff(rows):
    """(seq, staff, second) one by one, the window kept as a list."""
    out, window = [], []
    for seq, staff, at in rows:
        window = [(s, t) for s, t in [*window, (staff, at)] if t > at - 300]
        share = sum(s for s, _ in window) / len(window)
        if len(window) >= 10 and share > 0.5:
            out.append((seq, len(window), round(share, 3)))
    return out


@pytest.mark.parametrize("runs", [3, 40, 10_000])
def test_staff_share_in_arrival_order(spark, runs):
    rng = random.Random(runs)
    made = []
    for n in range(400):
        late = rng.choice((0, 0, 0, 0, 40, 290, 300, 301, 900))
        made.append((n, rng.random() < (0.8 if n // 60 % 2 else 0.3), max(0, n * 7 - late)))
    events = log(spark, *[(f"V{n % 9}", "ZONE_ENTER", at, {"is_staff": staff, "zone_id": "Z"}) for n, staff, at in made])
    got = sorted((r.arrival_seq, r.n, r.staff_fraction) for r in verifier.staff_explosions_as_arrived(events, arrivals=runs).collect())
    want = plain_staff(made)
    assert [(a, n) for a, n, _ in got] == [(a, n) for a, n, _ in want] and want
    assert all(abs(x[2] - y[2]) < 0.0011 for x, y in zip(got, want))
    assert verifier.staff_explosions_as_arrived(events.limit(0)).collect() == []


def test_a_window_of_many_runs_takes_no_round_a_run(spark):
    made = [(n, n % 7 < 4, n if n < 250 else n + 300) for n in range(260)]
    events = log(spark, *[("V", "ZONE_ENTER", at, {"is_staff": staff}) for _, staff, at in made])
    spark.sparkContext.setJobGroup("runs", "")
    try:
        got = sorted((r.arrival_seq, r.n) for r in verifier.staff_explosions_as_arrived(events, arrivals=2).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("runs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(a, n) for a, n, _ in plain_staff(made)] and jobs < 80


def test_both_forms_agree_on_an_ordered_log(spark):
    rng = random.Random(2)
    times, at = [], 0
    for _ in range(300):
        at += rng.choice((1, 2, 30))
        times.append(at)
    events = log(spark, *[(f"V{k % 5}", "ZONE_ENTER", t, {"is_staff": rng.random() < 0.55, "zone_id": "Z"}) for k, t in enumerate(times)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(verifier.staff_explosions(events)) == rows(verifier.staff_explosions_as_arrived(events, arrivals=50))


def test_exits_and_two_cameras_and_teleports(spark):
    events = log(
        spark, ("A", "EXIT", 0), ("A", "ENTRY", 10), ("A", "ZONE_ENTER", 11, {"zone_id": "ZONE_0"}), ("A", "EXIT", 20), ("A", "EXIT", 30), ("B", "REENTRY", 1), ("B", "EXIT", 2),
        ("C", "ZONE_ENTER", 100, {"zone_id": "ZONE_0", "camera_id": "X"}), ("C", "ZONE_ENTER", 101, {"zone_id": "ZONE_3", "camera_id": "Y"}), ("C", "ZONE_ENTER", 102, {"zone_id": "ZONE_2", "camera_id": "X"}),
        ("C", "ZONE_ENTER", 200, {"zone_id": "ZONE_4", "camera_id": "X"}), ("C", "ZONE_ENTER", 203, {"zone_id": "FAR", "camera_id": "Z"}),
    )
    assert sorted((r.visitor_id, r.arrival_seq) for r in verifier.exits_without_entry(events).collect()) == [("A", 0), ("A", 4)]
    both = verifier.simultaneous_cameras(verifier.presence(events.filter("visitor_id = 'C'"), 2 * SECOND)).collect()
    assert [(r.camera_a, r.camera_b, (r.since_us - BASE_US) // SECOND, (r.until_us - BASE_US) // SECOND) for r in both] == [("X", "Y", 101, 103)]
    hops = spark.createDataFrame([(f"ZONE_{a}", f"ZONE_{b}", abs(a - b)) for a in range(5) for b in range(5) if a != b], "zone_from string, zone_to string, hops int")
    far = verifier.visitor_teleports(events, hops).collect()
    assert sorted((r.zone_from, r.zone_to, r.hops) for r in far) == [("ZONE_0", "ZONE_3", 3), ("ZONE_4", "FAR", None)]
