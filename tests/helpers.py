"""Small logs for the tests: events by name and second."""

from footfall.schema import EVENT

BASE_US = 1_772_546_400_000_000  # 2026-03-03T14:00:00Z
AS_OF_US = BASE_US + 5_400_000_000


def log(spark, *events, store="STORE_1"):
    """Rows out of (visitor, type, second, extra dict), in order of arrival."""
    rows = []
    for n, (visitor, kind, second, *rest) in enumerate(events):
        extra = rest[0] if rest else {}
        row = {
            "arrival_seq": n, "event_id": f"e{n}", "store_id": store, "camera_id": "CAM_ENTRY_01", "visitor_id": visitor, "event_type": kind, "ts_us": BASE_US + int(second * 1_000_000),
            "zone_id": None, "dwell_ms": 0, "is_staff": False, "confidence": 0.9, "queue_depth": None, "wait_ms": None, "reid_score": None,
        }
        row.update(extra)
        rows.append(tuple(row[f.name] for f in EVENT.fields))
    return spark.createDataFrame(rows, EVENT)
