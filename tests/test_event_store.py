import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from footfall.api import StoreAnalytics
from footfall.operators import ingest
from footfall.schema import EVENT, POS
from footfall.sources import sinks
from footfall.sources.event_store import FRESH, EventStore, keep_each_batch
from footfall.streaming import sessions as streams

from .helpers import AS_OF_US, BASE_US, log

UUID = "00000000-0000-4000-8000-{:012d}"


def line(n, second=None, kind="ZONE_ENTER", **metadata):
    at = BASE_US + (n if second is None else second) * 1_000_000
    return {"event_id": UUID.format(n), "store_id": "S", "camera_id": "CAM_1", "visitor_id": f"V{n % 7}", "event_type": kind, "timestamp": at, "zone_id": "Z", "dwell_ms": 0, "is_staff": False, "confidence": 0.5, "metadata": metadata}


def texts(rows):
    from datetime import datetime, timezone

    stamp = lambda us: datetime.fromtimestamp(us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return [json.dumps({**r, "timestamp": stamp(r["timestamp"])}) if isinstance(r, dict) else r for r in rows]


def batch(spark, rows, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts(rows))], "arrival_seq long, value string").repartition(3)


@pytest.fixture
def pos(spark):
    return spark.createDataFrame([], POS)


def test_replay_then_batches_are_as_one_load(spark, pos, tmp_path):
    rows = [line(k, second=(k * 37) % 100) for k in range(120)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.jsonl").write_text("\n".join(texts([*rows[k * 30 : k * 30 + 30], rows[0], "{broken"])))
    store = StoreAnalytics.replay(spark, f"file://{folder}", pos, AS_OF_US)
    assert store.replayed.to_dict() | {"elapsed_sec": 0, "source": ""} == {"source": "", "total": 128, "accepted": 120, "duplicates": 4, "rejected": 4, "elapsed_sec": 0}
    late, later = [line(k, second=k - 150) for k in range(200, 230)], [line(k) for k in range(220, 250)]
    store, rejected, counts = store.ingest(batch(spark, [*late, rows[5], {**line(999), "dwell_ms": "500"}], start=7))
    assert counts.first().asDict() == {"accepted": 30, "duplicate": 1, "rejected": 1}
    assert [r.event_id for r in rejected.collect()] == [UUID.format(999)]
    store, _, counts = store.ingest(batch(spark, later))
    assert counts.first().asDict() == {"accepted": 20, "duplicate": 10, "rejected": 0}
    ordered = [e.event_id for e in store.events.orderBy("arrival_seq").collect()]
    want = [r["event_id"] for r in sorted(rows, key=lambda r: (r["timestamp"], rows.index(r)))] + [r["event_id"] for r in late + later[10:]]
    assert ordered == want
    # one number an event in all branches of a plan
    numbers = store.events.groupBy("event_id").agg(F.max("arrival_seq").alias("other"))
    assert store.events.join(numbers, "event_id").filter("other <> arrival_seq").count() == 0
    assert store.metrics("S").count() == 1 and store.anomalies().count() >= 0 and store.audit("V1").count() > 0
    again = StoreAnalytics.stored(spark, store.log.path, pos, AS_OF_US)
    assert again.events.count() == 170
    store.close()


def test_replayed_numbers_do_not_differ_between_branches(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(texts([line(k, second=k % 50) for k in range(3000)])))
    from footfall.sources import readers

    events, checked = readers.replay_file(spark, f"file://{path}", AS_OF_US)
    numbers = events.filter("visitor_id <> 'V3'").repartition(5).groupBy("event_id").agg(F.min("arrival_seq").alias("other"))
    assert events.join(numbers, "event_id").filter("arrival_seq <> other").count() == 0 and checked.count() == 3000


def test_only_the_buckets_of_the_batch_are_read(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/log", buckets=64)
    store.append(batch(spark, [line(k) for k in range(600)]), AS_OF_US, limit=None)
    asked = [UUID.format(5), UUID.format(6)]
    found = store.ids(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:300]
    assert found.filter(F.col("event_id").isin(asked)).count() == 2 and found.select("bucket").distinct().count() <= 2
    checked = ingest.with_status(ingest.validate(batch(spark, [line(5), line(601)]), AS_OF_US), found, bounded=True)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert {r.event_id: r.status for r in checked.collect()} == {UUID.format(5): "duplicate", UUID.format(601): "accepted"}


def test_fresh_ids_are_dealt_and_the_store_compacted(spark, tmp_path):
    store = EventStore(spark, f"file://{tmp_path}/log", buckets=4, fresh_batches=3)
    for k in range(5):
        store.append(batch(spark, [line(10 * k + j) for j in range(12)]), AS_OF_US)
    buckets = {(r.bucket, r.batch) for r in store.ids().select("bucket", "batch").distinct().collect()}
    assert {b for b in buckets if b[0] == FRESH} == {(FRESH, 3), (FRESH, 4)} and {b for _, b in buckets if _ != FRESH} == {3}
    assert store.events().count() == 52 == store.events().select("event_id").distinct().count() == store.ids().select("event_id").distinct().count()
    small = EventStore(spark, f"file://{tmp_path}/small", buckets=4)
    store.compact(small)
    assert small.last().counts() == {"accepted": 52, "duplicate": 8, "rejected": 0} and small.last().next_seq == store.last().next_seq
    assert small.append(batch(spark, [line(51), line(52)]), AS_OF_US).counts() == {"accepted": 1, "duplicate": 1, "rejected": 0}
    with pytest.raises(ValueError):
        store.compact(small)


def test_a_batch_that_fails_midway_writes_once(spark, tmp_path, monkeypatch):
    store = EventStore(spark, f"file://{tmp_path}/log", buckets=4)
    store.append(batch(spark, [line(k) for k in range(4)]), AS_OF_US, 0)
    put = EventStore._put
    monkeypatch.setattr(EventStore, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(batch(spark, [line(k) for k in range(2, 9)] + ["{broken"]), AS_OF_US, 1)
    monkeypatch.setattr(EventStore, "_put", put)
    assert store.events().count() == 4 and store.ids().count() == 4 and store.last().batch == 0
    done = store.append(batch(spark, [line(k) for k in range(2, 9)]), AS_OF_US, 1)
    assert done.counts() == {"accepted": 5, "duplicate": 2, "rejected": 0} == store.append(batch(spark, [line(99)]), AS_OF_US, 1).counts()
    assert store.events().count() == 9 and store.ids().count() == 9 and store.rejected().count() == 0
    with pytest.raises(ValueError):
        store.append(batch(spark, [line(k) for k in range(501)]), AS_OF_US)


def test_a_stream_of_files_is_kept_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = EventStore(spark, f"file://{tmp_path}/log", buckets=4)

    def run():
        query = streams.project_each_batch(streams.read_lines(spark, f"file://{folder}", 1), keep_each_batch(store), f"{tmp_path}/check")
        query.awaitTermination(120)
        assert query.exception() is None

    now = int(time.time())
    ahead = [{**line(50), "timestamp": (now + 120) * 1_000_000}]
    (folder / "a.jsonl").write_text("\n".join(texts([line(k) for k in range(5)] + ahead)))
    run()
    (folder / "b.jsonl").write_text("\n".join(texts([line(k) for k in range(3, 8)])))
    run()
    assert sorted(r.event_id for r in store.events().collect()) == [UUID.format(k) for k in range(8)]
    assert [r.error for r in store.rejected().collect()] == ["timestamp: too far in the future"] and store.last().batch == 1


def test_the_clock_of_a_stream_moves_on(spark):
    """Events of this very hour pass and those ahead do not, whenever the plan was made."""
    now = int(time.time())
    rows = [{**line(1), "timestamp": (now - 1) * 1_000_000}, {**line(2), "timestamp": (now + 120) * 1_000_000}, {**line(3), "timestamp": (now + 3) * 1_000_000}]
    checked = ingest.validate(batch(spark, rows), ingest.clock())
    assert {r.event_id[-1]: bool(r.errors) for r in checked.collect()} == {"1": False, "2": True, "3": False}
    plan = streams.valid_events(spark.readStream.format("rate").load().select(F.lit("{}").alias("value")))._jdf.queryExecution().analyzed().toString()
    assert "current_timestamp" in plan


def test_metadata_comes_back(spark, pos, tmp_path):
    extra = {"queue_depth": 3, "shelf": {"row": 4, "tags": ["a", None]}, "confidence_lineage": {"det": 0.5}, "ratio": 0.25}
    store = StoreAnalytics(log(spark).limit(0), pos, AS_OF_US)
    store, _, _ = store.ingest(batch(spark, [line(1, **extra), line(2)]))
    path = f"file://{tmp_path}/out"
    sinks.write_events(store.events, path)
    back = StoreAnalytics.replay(spark, path, pos, AS_OF_US, folder=f"file://{tmp_path}/log")
    assert back.events.columns == [*EVENT.fieldNames(), "metadata"] and dict(back.events.dtypes)["metadata"] == "variant"
    found = {r.event_id: json.loads(r.m) for r in back.events.select("event_id", F.to_json("metadata").alias("m")).collect()}
    assert found == {UUID.format(1): extra, UUID.format(2): {}}
    row = back.events.select("queue_depth", F.try_variant_get("metadata", "$.shelf.row", "int").alias("row")).orderBy("queue_depth").collect()[1]
    assert (row.queue_depth, row.row) == (3, 4)
    back, _, _ = back.ingest(batch(spark, [line(5, shelf=1)]))
    assert back.events.filter("try_variant_get(metadata, '$.shelf', 'int') = 1").count() == 1
    with pytest.raises(ValueError):
        StoreAnalytics.replay(spark, path, pos, AS_OF_US, folder=f"file://{tmp_path}/log")


def test_progress_while_replaying(spark, pos, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(60):
        (folder / f"{k}.jsonl").write_text("\n".join(texts([line(500 * k + j) for j in range(500)])))
    path, seen, end = f"file://{folder}", [], []

    def run():
        end.append(StoreAnalytics.replay(spark, path, pos, AS_OF_US).replayed.total)

    thread = threading.Thread(target=run)
    thread.start()
    while thread.is_alive():
        seen.append(StoreAnalytics.progress(path))
        time.sleep(0.02)
    thread.join()
    assert end == [30000] and any(0 < s["pct"] < 100 and s["is_replaying"] for s in seen)
    assert StoreAnalytics.progress(path) == {"is_replaying": False, "replayed": 30000, "total": 30000, "pct": 100.0}


@pytest.mark.parametrize("name", ["incremental_ingest", "replay_then_ingest"])
def test_lines_are_made_by_many_tasks(spark, monkeypatch, name):
    """A table in one file is dealt to all tasks before its rows become lines, which are then checked there."""
    from footfall.plans import catalog

    made, event_json = [], sinks.event_json
    monkeypatch.setattr(sinks, "event_json", lambda events: made.append(events) or event_json(events))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
        parts = [[n for n in events.groupBy(F.spark_partition_id()).count().toPandas()["count"]] for events in made]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert made and all(len(p) >= 6 and max(p) < sum(p) / 2 for p in parts)
