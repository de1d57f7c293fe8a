import json

import pytest
from pyspark.sql import functions as F

from footfall import __main__ as command
from footfall.api import ReplayResult, ReplayRunning, StoreAnalytics, StoreNotFound
from footfall.operators import audit, calibration, ingest
from footfall.schema import POS
from footfall.sources import sinks

from .helpers import AS_OF_US, BASE_US, log


def lines_of(spark, *events, store="STORE_1", start=0):
    made = log(spark, *events, store=store).withColumn("event_id", F.md5(F.concat(F.lit(f"{start}:"), "event_id")))
    return sinks.event_json(made).select((F.col("arrival_seq") + start).alias("arrival_seq"), "value")


@pytest.fixture
def pos(spark):
    return spark.createDataFrame([], POS)


def test_later_batches_arrive_later_whatever_their_numbers(spark, pos):
    empty = StoreAnalytics(log(spark).limit(0), pos, AS_OF_US)
    first, _, counts = empty.ingest(lines_of(spark, ("A", "ENTRY", 0), ("A", "ZONE_ENTER", 5, {"zone_id": "Z"}), ("A", "EXIT", 9)))
    assert counts.first().asDict() == {"accepted": 3, "duplicate": 0, "rejected": 0}
    second, _, _ = first.ingest(lines_of(spark, ("A", "REENTRY", 20), ("A", "EXIT", 30), start=0).withColumn("value", F.regexp_replace("value", '"event_id":"..', '"event_id":"00')))
    events = second.events.orderBy("arrival_seq").collect()
    assert [e.event_type for e in events] == ["ENTRY", "ZONE_ENTER", "EXIT", "REENTRY", "EXIT"] and len({e.arrival_seq for e in events}) == 5
    with second:
        assert second.sessions.count() == 2 and second.sessions.is_cached
        held = second.sessions
    assert not held.is_cached


def test_broken_lines_are_no_single_key(spark):
    raw = spark.createDataFrame([(i, "{broken" if i % 2 else '{"event_id": null}') for i in range(300)], "arrival_seq long, value string")
    checked = ingest.with_status(ingest.validate(raw, AS_OF_US), log(spark))
    assert ingest.summary(checked).first().rejected == 300
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "dedup_key" in plan and checked.columns == ingest.with_status(ingest.validate(raw, AS_OF_US)).columns


def test_thresholds_of_known_and_unknown_stores(spark, pos):
    events = [(f"V{k}", kind, 10 * k + (kind == "EXIT"), {"confidence": 0.6 + 0.001 * (k % 100), "reid_score": 0.5 + 0.001 * k}) for k in range(240) for kind in ("ENTRY", "REENTRY", "EXIT")]
    store = StoreAnalytics(log(spark, *events), pos, AS_OF_US)
    known = store.calibration("STORE_1").first()
    assert known.asDict() == store.all_profiles().first().asDict() and known.calibrations > 0
    assert store.get_threshold("STORE_1", "reid_confidence_threshold") == known.reid_confidence_threshold != calibration.REID[0]
    nobody = store.calibration("NOWHERE").first()
    assert (nobody.store_id, nobody.calibrations, nobody.queue_join_dwell_sec, nobody.dwell_threshold_ms) == ("NOWHERE", 0, 5.0, 30000.0)
    assert store.get_threshold("NOWHERE", "camera_trust") == 1.0 and store.get_threshold("STORE_1", "no such thing") == 0.5
    assert {r.parameter for r in store.calibrate_all().collect()} == {"reid_confidence_threshold"}
    with pytest.raises(StoreNotFound):
        store.metrics("NOWHERE")


def test_replay_tells_what_it_took(spark, pos, tmp_path):
    rows = [r.value for r in lines_of(spark, ("A", "ENTRY", 0), ("A", "EXIT", 9), ("B", "ENTRY", 4)).collect()]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([*rows, rows[0], '{"event_id": 5}']) + "\n")
    store = StoreAnalytics.replay(spark, f"file://{path}", pos, AS_OF_US)
    told = store.replayed.to_dict()
    assert {k: told[k] for k in ("total", "accepted", "duplicates", "rejected")} == {"total": 5, "accepted": 3, "duplicates": 1, "rejected": 1} and told["elapsed_sec"] > 0
    assert StoreAnalytics.progress(f"file://{path}") == {"is_replaying": False, "replayed": 5, "total": 5, "pct": 100.0}
    assert StoreAnalytics.progress("elsewhere")["replayed"] == 0
    with pytest.raises(FileNotFoundError):
        StoreAnalytics.replay(spark, f"file://{tmp_path}/none.jsonl", pos, AS_OF_US)
    assert not StoreAnalytics._replays[f"file://{tmp_path}/none.jsonl"].running
    StoreAnalytics._replays["busy"] = ReplayResult("busy")
    with pytest.raises(ReplayRunning):
        StoreAnalytics.replay(spark, "busy", pos, AS_OF_US)


def test_command_line(spark, tmp_path, capsys):
    rows = [r.value for r in lines_of(spark, ("A", "ENTRY", 0), ("A", "EXIT", 9), ("B", "ENTRY", 4)).collect()]
    (tmp_path / "log.jsonl").write_text("\n".join(rows) + "\n")
    given = ["--events", f"file://{tmp_path}/log.jsonl", "--as-of-us", str(AS_OF_US)]
    assert command.main([*given, "--answers", "metrics", "calibration", "--store", "STORE_1", "--log", f"{tmp_path}/stored"]) == 0
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert said[0]["accepted"] == 3 and [x["answer"] for x in said[1:]] == ["metrics", "calibration"]
    assert spark.read.parquet(f"{tmp_path}/stored").count() == 3
    assert command.main([*given, "--output", f"{tmp_path}/out", "--answers", "health"]) == 0 and spark.read.json(f"{tmp_path}/out/health").count() == 1
    assert command.main(["--events", f"file://{tmp_path}/none", "--as-of-us", "0"]) == 2
    assert command.main([*given, "--store", "STORE_1", "--answers", "funnel"]) == 0


def test_files_hold_the_first_arrival_and_split_a_store(spark, tmp_path):
    events = log(spark, *[(f"V{k}", "ENTRY", k) for k in range(400)])
    again = events.withColumns({"arrival_seq": F.col("arrival_seq") + 1000, "camera_id": F.lit("LATE")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_events(events.unionByName(again), f"{tmp_path}/out")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.text(f"{tmp_path}/out")
    assert written.count() == 400 and written.filter(F.col("value").contains("LATE")).count() == 0
    assert written.select(F.input_file_name()).distinct().count() > 1


def test_identity_decisions_become_records(spark):
    made = audit.identity_records(spark.createDataFrame([("V", "S", 3, "REUSED", 0.8, "looked alike", None), ("V", "S", 4, "NEW", None, "first seen", "Tracker")], "visitor_id string, store_id string, arrival_seq long, decision string, confidence double, explanation string, source string"))
    timeline = audit.audit_timeline(log(spark, ("V", "ENTRY", 0)))
    both = timeline.unionByName(made).orderBy("arrival_seq", "sub_seq").collect()
    assert [(r.category, r.event_type, r.source) for r in both[-2:]] == [("IDENTITY", "REUSED", "Sessionizer"), ("IDENTITY", "NEW", "Tracker")]
    assert BASE_US < AS_OF_US
