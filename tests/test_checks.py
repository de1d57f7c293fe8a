import pytest

from footfall.operators import audit, calibration, sessions, verifier

from .helpers import log


def codes(spark, *events):
    return {r.code for r in verifier.warnings(log(spark, *events)).collect()}


CAM = lambda c: {"camera_id": c}


@pytest.mark.parametrize(
    "events, code",
    [
        ([("V", "BILLING_QUEUE_JOIN", 0, {"queue_depth": -1})], "QUEUE_DEPTH_NEGATIVE"),
        ([("V", "ENTRY", 0), ("V", "ZONE_ENTER", 1, {"confidence": 0.3})], "CONFIDENCE_CLIFF"),
        ([("V", "ENTRY", 0), ("V", "ZONE_ENTER", 1, CAM("CAM_FLOOR_09"))], "IMPOSSIBLE_CAMERA_TRANSITION"),
        ([("V", "ENTRY", 0, CAM("CAM_FLOOR_01"))], "ENTRY_WITHOUT_DOORWAY"),
        ([("V", "ENTRY", 0), ("V", "EXIT", 5), ("V", "REENTRY", 7)], "REENTRY_TOO_FAST"),
        ([(f"V{k}", "ENTRY", k, {"is_staff": k > 3}) for k in range(10)], "STAFF_COUNT_EXPLOSION"),
    ],
)
def test_rules_fire(spark, events, code):
    assert codes(spark, *events) == {code}


@pytest.mark.parametrize(
    "events",
    [
        [("V", "BILLING_QUEUE_JOIN", 0, {"queue_depth": 0})],
        [("V", "ENTRY", 0), ("V", "ZONE_ENTER", 1, {"confidence": 0.5})],
        [("V", "ENTRY", 0), ("V", "ZONE_ENTER", 60, CAM("CAM_FLOOR_09"))],
        [("V", "ENTRY", 0), ("V", "ZONE_ENTER", 0, CAM("CAM_FLOOR_09"))],
        [("V", "ENTRY", 0), ("V", "ZONE_ENTER", 1, CAM("CAM_FLOOR_00")), ("V", "ZONE_EXIT", 2, CAM("DOOR"))],
        [("V", "ENTRY", 0, CAM("cam_door_1"))],
        [("V", "ENTRY", 0), ("V", "EXIT", 5), ("V", "REENTRY", 15)],
        [(f"V{k}", "ENTRY", k, {"is_staff": k > 4}) for k in range(10)],
        [(f"V{k}", "ENTRY", k * 40, {"is_staff": True}) for k in range(20)],
    ],
)
def test_rules_hold_back(spark, events):
    assert codes(spark, *events) == set()


def test_equal_times_count_only_earlier_arrivals(spark):
    events = log(spark, *[(f"V{k}", "ENTRY", 0, {"is_staff": True}) for k in range(12)])
    assert sorted((r.arrival_seq, r.n) for r in verifier.staff_explosions(events).collect()) == [(9, 10), (10, 11), (11, 12)]


def test_limits_and_filters(spark):
    found = verifier.warnings(log(spark, *[("V", "BILLING_QUEUE_JOIN", k, {"queue_depth": -1}) for k in range(150)]))
    assert verifier.newest_by_store(found).count() == 100 and verifier.newest_by_store(found, severity="warn").count() == 0
    assert {r.seq for r in verifier.newest(found, 3).collect()} == {1470, 1480, 1490}


def test_audit_order_and_words(spark):
    events = log(spark, ("V", "ENTRY", 0, {"is_staff": True}), ("V", "ZONE_EXIT", 3, {"zone_id": "Z", "dwell_ms": 2500}), ("V", "EXIT", 10), ("V", "REENTRY", 12, {"reid_score": 0.5}), ("V", "BILLING_QUEUE_JOIN", 13), ("V", "BILLING_QUEUE_ABANDON", 14))
    rows = audit.audit_timeline(events).orderBy("arrival_seq", "sub_seq").collect()
    assert [r.category for r in rows] == ["DETECTION", "SESSION", "ZONE", "EXIT", "REENTRY", "TRACKING", "QUEUE", "QUEUE"]
    reasons = [r.reason for r in rows]
    assert reasons[0] == "ENTRY detected on CAM_ENTRY_01 with confidence 0.90" and reasons[1].endswith("[STAFF]")
    assert reasons[2] == "Left zone Z after 2.5s" and "Duration: 10.0s" in reasons[3] and reasons[4] == "reentry #1 for V; appearance similarity 0.50; camera=CAM_ENTRY_01; time gap 2.0 sec"
    assert "depth=None" in reasons[6] and reasons[7].endswith("unknown")
    text = audit.explain(audit.audit_timeline(events)).collect()[0].explanation
    assert text.startswith("1. [DETECTION] ENTRY") and len(text.split("\n")) == 8
    s = sessions.sessions(sessions.number_sessions(events))
    assert audit.audit_summary(audit.audit_timeline(events), s).collect()[0].categories == "DETECTION,EXIT,QUEUE,REENTRY,SESSION,TRACKING,ZONE"


def test_calibration_freezes_at_the_last_multiple(spark):
    events = [("V", "ENTRY", k, {"confidence": 0.6 + (k % 40) / 100}) for k in range(430)]
    rows = calibration.camera_trust(log(spark, *events)).collect()
    seen = sorted(0.6 + (k % 40) / 100 for k in range(400))
    assert [(round(r.camera_trust, 4), r.observations) for r in rows] == [(round(seen[99], 4), 400)]
    few = calibration.store_thresholds(log(spark, *events[:150])).collect()[0]
    assert (few.calibrations, few.reid_confidence_threshold, few.queue_join_dwell_sec, few.dwell_threshold_ms) == (0, 0.65, 5.0, 30000.0)


def test_staff_threshold_and_occlusion(spark):
    from pyspark.sql import functions as F

    scores = spark.createDataFrame([("S", k, k / 40) for k in range(40)], "store_id string, seq long, x double")
    assert abs(calibration.staff_threshold(scores, ["store_id"]).collect()[0].staff_confidence_threshold - 0.7) < 1e-9
    row = spark.range(1).select(calibration.occlusion_timeout(F.lit(0.5), F.lit(30)).alias("a"), calibration.occlusion_timeout(F.lit(1.0), F.lit(30)).alias("b"), calibration.occlusion_timeout(F.lit(0.5), F.lit(3)).alias("c")).collect()[0]
    assert tuple(row) == (40.0, 60.0, 20.0)
