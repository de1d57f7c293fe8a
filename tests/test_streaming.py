import json
import os

from pyspark.sql import functions as F

from footfall.operators import sessions
from footfall.sources import sinks
from footfall.sources.fixtures import store_events
from footfall.streaming import sessions as streams

from .helpers import AS_OF_US, BASE_US

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = store_events(spark, SF).withColumns({"event_id": F.md5("event_id"), "ts_us": F.col("ts_us") + BASE_US}).dropDuplicates(["visitor_id", "ts_us"])
    lines = [r.value for r in sinks.event_json(events).orderBy("arrival_seq").collect()]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        part = lines[len(lines) * k // 3 : len(lines) * (k + 1) // 3]
        (folder / f"{k}.jsonl").write_text("\n".join([*part, "{broken", part[0]]))
        os.utime(folder / f"{k}.jsonl", (1_000_000 + k, 1_000_000 + k))  # files are taken in order of their times
    live = streams.first_arrivals(streams.valid_events(streams.read_lines(spark, f"file://{folder}", files_per_batch=1), AS_OF_US))
    out = f"{tmp_path}/updates"

    def keep(batch, number):
        batch.withColumn("version", F.lit(number)).write.mode("append").parquet(out)

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    query = streams.project_each_batch(streams.session_updates(live), keep, f"{tmp_path}/check")
    query.awaitTermination(240)
    assert query.exception() is None
    columns = ["visitor_id", "session_no", "store_id", "start_us", "end_us", "is_staff", "event_count", "reentry_count", "purchase_candidate"]
    made = streams.latest_sessions(spark.read.parquet(out), "version").select(*columns)
    batch = sessions.sessions(sessions.number_sessions(events.withColumn("arrival_seq", F.col("ts_us")))).select(*columns)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_feed_windows_and_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"event_id": "6f9619ff8b86d011b42d00cf4fc96400", "store_id": "S", "camera_id": "C", "visitor_id": "V", "event_type": "ENTRY", "timestamp": "2026-03-03T14:00:00Z", "confidence": 0.5}
    (folder / "a.jsonl").write_text("\n".join(json.dumps({**row, "event_id": f"6f9619ff8b86d011b42d00cf4fc964{k:02d}", "timestamp": f"2026-03-03T14:{k:02d}:00Z"}) for k in range(12)))
    live = streams.valid_events(streams.read_lines(spark, f"file://{folder}"), AS_OF_US)
    for name, frame, mode in (("feed", streams.feed_state(live), "complete"), ("windows", streams.windowed_counts(live), "update"), ("bounded", streams.first_arrivals(live, "1 hour").select("event_id"), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(r.store_id, r.last_event_us, r.events) for r in spark.table("feed").collect()] == [("S", BASE_US + 660_000_000, 12)]
    assert sorted(r.events for r in spark.table("windows").collect()) == [2, 5, 5] and spark.table("bounded").count() == 12


def test_idle_fold():
    class E:
        def __init__(self, kind, t):
            self.event_type, self.ts_us, self.store_id, self.is_staff, self.zone_id = kind, t, "S", False, None

    state = streams._start()
    first = list(streams.fold(state, iter([E("ENTRY", 1), E("ENTRY", 5), E("ZONE_ENTER", 6)])))
    assert [(s["session_no"], s["end_us"], s["event_count"]) for s in first] == [(1, 5, 1), (2, None, 1)]
    assert [(s["session_no"], s["end_us"], s["event_count"]) for s in streams.fold(state, iter([E("EXIT", 9), E("EXIT", 11)]))] == [(2, 9, 2), (3, 11, 2)]
