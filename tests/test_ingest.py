import json

import pytest
from pyspark.sql import functions as F

from footfall.api import StoreAnalytics, StoreNotFound, VisitorNotFound
from footfall.operators import geometry, ingest
from footfall.schema import POS
from footfall.sources import readers, sinks

from .helpers import AS_OF_US, BASE_US, log

GOOD = {"event_id": "6f9619ff-8b86-d011-b42d-00cf4fc964ff", "store_id": "S", "camera_id": "CAM_ENTRY_01", "visitor_id": " V1 ", "event_type": "ENTRY", "timestamp": "2026-03-03T14:00:00Z", "confidence": 0.9}


def raw(spark, *objects):
    return spark.createDataFrame([(k, o if isinstance(o, str) else json.dumps(o)) for k, o in enumerate(objects)], "arrival_seq long, value string")


def reason(spark, change):
    body = {k: v for k, v in {**GOOD, **change}.items() if v != "absent"}
    return ingest.validate(raw(spark, body), AS_OF_US).select(F.array_join("errors", "; ")).collect()[0][0]


@pytest.mark.parametrize(
    "change, word",
    [
        ({"timestamp": "not-a-time"}, "timestamp"), ({"timestamp": "2026-03-03T14:00:00"}, "timestamp"), ({"timestamp": "2026-03-03"}, "timestamp"), ({"timestamp": "2096-03-03T14:00:00Z"}, "future"),
        ({"event_id": "nope"}, "valid UUID"), ({"event_id": " "}, "empty"), ({"dwell_ms": "500"}, "dwell_ms"), ({"dwell_ms": -1}, "dwell_ms"), ({"dwell_ms": 1.5}, "dwell_ms"),
        ({"is_staff": "True"}, "is_staff"), ({"is_staff": 1}, "is_staff"), ({"confidence": 1.1}, "confidence"), ({"confidence": "0.5"}, "confidence"), ({"confidence": "absent"}, "confidence"),
        ({"event_type": "JUMP"}, "event_type"), ({"store_id": 7}, "store_id"), ({"visitor_id": None}, "visitor_id"), ({"metadata": []}, "metadata"), ({"metadata": {"queue_depth": "3"}}, "queue_depth"),
    ],
)
def test_rejections(spark, change, word):
    assert word in reason(spark, change)


@pytest.mark.parametrize("change", [{}, {"confidence": 1}, {"timestamp": "2026-03-03T19:30:00.250+05:30"}, {"timestamp": "2026-03-03T19:30:00+0530"}, {"zone_id": None, "dwell_ms": 5, "is_staff": True}, {"metadata": {"queue_depth": -2, "other": {"a": 1}}}, {"event_id": "{6F9619FF8B86D011B42D00CF4FC964FF}"}])
def test_acceptance(spark, change):
    assert reason(spark, change) == ""


def test_typed_fields(spark):
    row = ingest.validate(raw(spark, {**GOOD, "timestamp": "2026-03-03T19:30:00.250+05:30", "metadata": {"queue_depth": -2, "x": "y"}}), AS_OF_US).collect()[0]
    assert (row.visitor_id, row.ts_us, row.queue_depth, row.dwell_ms, row.is_staff) == ("V1", BASE_US + 250_000, -2, 0, False) and json.loads(row.metadata)["x"] == "y"


def test_split_dedup_and_batches(spark):
    second = {**GOOD, "event_id": "6f9619ff-8b86-d011-b42d-00cf4fc964f0"}
    bad = {**GOOD, "confidence": 7}
    batch = raw(spark, bad, GOOD, second, GOOD, "[1]", "{oops", "7")
    accepted, rejected, summary = ingest.ingest(batch, AS_OF_US)
    assert [r.arrival_seq for r in accepted.orderBy("arrival_seq").collect()] == [1, 2]
    assert tuple(summary.collect()[0]) == (2, 1, 4) and rejected.filter("error like '%JSON object%'").count() == 3
    again = ingest.ingest(batch, AS_OF_US, accepted)[2].collect()[0]
    assert tuple(again) == (0, 3, 4)
    with pytest.raises(ValueError):
        ingest.ingest(batch.limit(0), AS_OF_US)
    with pytest.raises(ValueError):
        ingest.ingest(batch, AS_OF_US, batch_limit=6)


def test_jsonl_replay(spark, tmp_path):
    ids = [f"6f9619ff-8b86-d011-b42d-00cf4fc964{k:02d}" for k in range(10, 14)]
    lines = [json.dumps({**GOOD, "event_id": i, "timestamp": f"2026-03-03T14:00:{s:02d}Z", "store_id": st}) for i, s, st in zip(ids, (30, 10, 20, 10), "SSTS")]
    (tmp_path / "a.jsonl").write_text("\n".join([lines[0], "", "{broken", *lines[1:]]))
    path = f"file://{tmp_path}/a.jsonl"
    events, checked = readers.replay_file(spark, path, AS_OF_US)
    assert [r.event_id for r in events.orderBy("arrival_seq").collect()] == [ids[1], ids[3], ids[2], ids[0]]
    assert readers.malformed(readers.read_event_lines(spark, path)).collect()[0][0] == 1 and checked.count() == 5
    assert readers.replay_file(spark, path, AS_OF_US, "T")[0].count() == 1


def test_transactions_in_both_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("store_id,transaction_id,timestamp,basket_value_inr\nS,T1,2026-03-03T14:00:00Z,12.5\nS,T1,2026-03-03T15:00:00Z,1\nS,,2026-03-03T14:00:00Z,1\nS,T2,bad,1\nS,T3,2026-03-03T14:00:00Z,x\n")
    rows = readers.read_transactions(spark, f"file://{tmp_path}/a.csv").orderBy("transaction_id").collect()
    assert [(r.transaction_id, r.ts_us, r.basket_value) for r in rows] == [("T1", BASE_US, 12.5), ("T3", BASE_US, 0.0)]
    (tmp_path / "b.csv").write_text("order_id,invoice_number,order_date,order_time,store_id,store_name,GMV,NMV,total_amount\n104363838,I,10-04-2026,16:55:36,ST1008,N,1,2,274.36\n,I2,2026-04-10,16:55:36,,Named,5,,\n")
    rows = readers.read_transactions(spark, f"file://{tmp_path}/b.csv").orderBy("transaction_id").collect()
    assert [(r.store_id, r.transaction_id, r.basket_value) for r in rows] == [("ST1008", "104363838", 274.36), ("Named", "I2", 5.0)]
    assert rows[0].ts_us == rows[1].ts_us == 1_775_840_136_000_000
    assert readers.add_transactions(readers.read_transactions(spark, f"file://{tmp_path}/a.csv"), readers.read_transactions(spark, f"file://{tmp_path}/b.csv")).count() == 4


def test_calibrations(spark, tmp_path):
    shape = {"shape_id": "Z", "shape_type": "polygon", "role": "zone", "label": "l", "points": [[0.1, 0.1], [0.5, 0.1], [0.5, 0.5]], "enabled": True}
    doc = {"store_id": "S", "version": "1", "cameras": {"C1": {"shapes": [shape, {**shape, "shape_id": "Y", "enabled": False}]}, "C2": {"shapes": [{"shape_id": "L", "shape_type": "line", "role": "entry_line", "label": "d", "points": [[0, 0], [1, 1]], "meta": {"inside_is": "below"}}]}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    path = f"file://{tmp_path}/c.json"
    shapes = readers.read_calibration(spark, path)
    assert {(r.camera_id, r.shape_id, r.enabled, r.inside_is) for r in shapes.collect()} == {("C1", "Z", True, None), ("C1", "Y", False, None), ("C2", "L", True, "below")}
    assert geometry.calibration_issues(shapes).count() == 0
    sinks.write_calibration(shapes, f"file://{tmp_path}/out", "S", "2")
    assert readers.read_calibration(spark, f"file://{tmp_path}/out").count() == 3
    (tmp_path / "o.json").write_text(json.dumps({"C2": [{"zone_id": "Q", "sku_zone": "s", "polygon_norm": [[0, 0], [1, 0], [1, 1]], "color_bgr": [1, 2, 255]}], "C3": [], "entry_line_norm": {"C2": [[0, 0], [1, 1]], "C9": [[0, 0], [1, 1]]}}))
    old = readers.read_override(spark, f"file://{tmp_path}/o.json")
    assert {(r.camera_id, r.shape_id, r.color) for r in old.collect()} == {("C2", "Q", "#FF0201"), ("C2", "ENTRY_LINE", "#FF0033")}
    both = readers.first_source(shapes, old)
    assert {r.shape_id for r in both.filter("camera_id = 'C2'").collect()} == {"L"}
    templates = old.withColumn("camera_id", F.lit("CAM_ENTRY_03"))
    assert readers.from_templates(spark.createDataFrame([("my_entry",), ("other",)], "camera_id string"), templates).count() == 2
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text("{}")
    codes = [[r.code for r in readers.calibration_file_issues(spark, f"file://{tmp_path}/{n}.json").collect()] for n in ("c", "bad", "none", "missing")]
    assert codes == [[], ["JSON_PARSE_ERROR"], ["MISSING_CAMERAS"], ["FILE_NOT_FOUND"]]


def test_clocks_and_colours(spark):
    day = 86_400_000_000
    rows = [("a", 0, 5 * day + 100, 6 * day), ("b", 1, 5 * day + 200, 6 * day), ("c", 2, 9 * day + 300, 6 * day), ("d", 3, None, 6 * day)]
    cams = spark.createDataFrame(rows, "camera_id string, ord int, read_us long, max_mtime_us long")
    assert {r.camera_id: r.start_us for r in readers.start_times(cams, 7).collect()} == {"a": 5 * day + 100, "b": 5 * day + 200, "c": 5 * day + 300, "d": 5 * day + 100}
    one = spark.range(1).select(readers.frame_time_us(F.lit(0), F.lit(30)).alias("t"), readers.hex_to_bgr(F.lit("#FF0201")).alias("c"), sinks.event_confidence(F.lit(0.9), F.lit(0.8), F.lit(1.0), F.lit(0.5), F.lit(0.75)).alias("p"), sinks.iso_time(F.lit(BASE_US)).alias("i"), sinks.iso_time(F.lit(BASE_US + 5)).alias("j")).collect()[0]
    assert (one.t, one.c, one.p, one.i, one.j) == (2_000_000, [1, 2, 255], 0.27, "2026-03-03T14:00:00Z", "2026-03-03T14:00:00.000005Z")


def test_event_files_round_trip(spark, tmp_path):
    events = log(spark, ("V", "ENTRY", 0), ("V", "BILLING_QUEUE_JOIN", 1, {"queue_depth": 2}), ("V", "EXIT", 2.5)).withColumn("event_id", F.md5("event_id"))
    sinks.write_events(events, f"file://{tmp_path}/log")
    back, checked = readers.replay_file(spark, f"file://{tmp_path}/log", AS_OF_US)
    assert checked.filter("status <> 'accepted'").count() == 0
    assert [(r.event_type, r.ts_us, r.queue_depth) for r in back.orderBy("arrival_seq").collect()] == [(r.event_type, r.ts_us, r.queue_depth) for r in events.orderBy("arrival_seq").collect()]
    sinks.write_log(events, f"file://{tmp_path}/parquet")
    assert spark.read.parquet(f"file://{tmp_path}/parquet").count() == 3


def test_analytics_object(spark):
    events = log(spark, ("V", "ENTRY", 0), ("V", "BILLING_QUEUE_JOIN", 1, {"queue_depth": 6}), ("V", "EXIT", 9))
    pos = spark.createDataFrame([("POS_ONLY", "T", BASE_US, 1.0)], POS)
    store = StoreAnalytics(events, pos, AS_OF_US)
    assert store.metrics("STORE_1").collect()[0].unique_visitors == 1 and store.metrics("POS_ONLY").collect()[0].unique_visitors == 0
    assert store.funnel("POS_ONLY").count() == 4 and store.heatmap("POS_ONLY").count() == 0
    assert "BILLING_QUEUE_SPIKE" in {r.type for r in store.anomalies("STORE_1").collect()}
    assert store.health().collect()[0].status == "STALE_FEED" and store.audit("V").count() == 4
    assert store.calibration("STORE_1").count() == 1 and store.json(store.metrics()).count() == 2
    with pytest.raises(StoreNotFound):
        store.metrics("NOPE")
    with pytest.raises(VisitorNotFound):
        store.audit("NOPE")
    later, rejected, summary = store.ingest(raw(spark, {**GOOD, "store_id": "STORE_1"}, "[]"))
    assert later.metrics("STORE_1").collect()[0].unique_visitors == 2 and rejected.count() == 1 and summary.collect()[0].accepted == 1


def test_a_field_is_looked_up_once(spark):
    """However many checks name it; and blanks before a line's object are no other type."""
    good = '{"event_id":"00000000-0000-4000-8000-000000000001","store_id":" S ","camera_id":"C","visitor_id":"V","event_type":"EXIT","timestamp":"2026-03-03T14:00:00Z","confidence":%s,"metadata":%s}'
    lines = [good % ("1e0", "{}"), " \t\r\n" + good % ("0.25", '{"queue_depth":3}'), good % ("1", "[]"), good % ("true", "null"), " [{}]", '"{"', "7", "{", "", None, good % ("0.5", '{"queue_depth":"3"}')]
    raw = spark.createDataFrame(list(enumerate(lines)), "arrival_seq long, value string")
    checked = ingest.validate(raw, 1_772_551_800_000_000)
    no_object = ["Event must be a JSON object"]
    want = [[], [], ["metadata: must be an object"], ["confidence: must be a number"], *[no_object] * 6, ["metadata.queue_depth: must be an integer"]]
    got = checked.orderBy("arrival_seq").collect()
    assert [r.errors for r in got] == want
    assert [(r.store_id, r.confidence, r.queue_depth) for r in got[:2]] == [("S", 1.0, None), ("S", 0.25, 3)]
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    for field in ("event_id", "timestamp", "confidence"):
        assert plan.count(f"$.{field},") == 1


def test_lines_are_read_as_parse_json_reads_them(spark):
    """Broken and odd lines: the parser that all lines share takes and refuses the same ones."""
    good = json.dumps(GOOD)
    odd = ["", "  ", "null", "[]", "1", "{", "{'a': 1}", "{a: 1}", '{"a": NaN}', '{"a": Infinity}', '{"a": 01}', '{"a": .5}', '{"a": 1, "a": 2}', '\ufeff{"a": 1}', '{"a": 1}x', '{"a": 1} {"b": 2}', '{"a": 1,}', '{"a": "\\x"}', '{"a": "\t"}', '{"a": 9223372036854775808}', '{"a": 1e400}', '{"a": 0.10}', "tru"]
    lines = raw(spark, *odd, *[good[:k] for k in range(0, len(good), 9)], *[good[:k] + c + good[k + 1 :] for k in range(0, len(good), 5) for c in "{}\"',:0 "])
    made = lines.select("value", F.try_parse_json("value").alias("a"), ingest.parse_line(F.col("value")).alias("b"))
    told = [made[c] for c in "ab"]
    differ = made.filter(~F.to_json(told[0]).eqNullSafe(F.to_json(told[1])) | ~F.schema_of_variant(told[0]).eqNullSafe(F.schema_of_variant(told[1])))
    assert differ.count() == 0 and 0 < made.filter("a is null").count() < made.count()


def test_sound_lines_have_no_reasons_listed(spark):
    """One parser serves all lines, and reasons are listed only where a check fails."""
    checked = ingest.validate(raw(spark, GOOD, {**GOOD, "dwell_ms": -1}, "[]", "{broken", {**GOOD, "confidence": None}), AS_OF_US)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "parseJson" not in plan and "parse_json" not in plan
    assert "ELSE filter" not in plan.split("AS errors")[0].split("THEN filter")[0] and "THEN [] WHEN" in plan
    assert [r.errors for r in checked.orderBy("arrival_seq").collect()] == [[], ["dwell_ms: must not be negative"], ["Event must be a JSON object"], ["Event must be a JSON object"], ["confidence: field required"]]
