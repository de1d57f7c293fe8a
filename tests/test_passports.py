import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from footfall.operators import behavior, lifecycle
from footfall.sources.fixtures import store_events
from footfall.streaming import passports

SF = "/root/testdata/sf0.001"
END_US = 2_592_000_000


def test_one_by_one():
    """Sightings and silences of one visitor against ages worked out at every second."""
    rng = random.Random(6)
    for _ in range(200):
        p, changes, seen, at = None, [], [], 0
        for _ in range(rng.randrange(1, 12)):
            at += rng.choice((1, 4, 5, 6, 20, 31, 100)) * 1_000_000
            retain = rng.choice((0, 3, 10, 30)) * 1_000_000
            seen.append((at, retain))
            p, made, _ = passports.sight(p, at, retain, "", 5_000_000)
            changes += made
        changes += [(t, what, "", 0, 0) for t, what in passports.elapse(p, at + 60_000_000, 5_000_000)]
        for now in range(seen[0][0], at + 60_000_000, 500_000):
            last, retain = max(s for s in seen if s[0] <= now)
            want = "ACTIVE" if now - last <= 5_000_000 else "SUSPENDED" if now - last <= retain else "EXPIRED"
            assert [c[1] for c in changes if c[0] <= now][-1] == want
        assert p["expirations"] == sum(b[0] - a[0] > max(a[1], 5_000_000) for a, b in zip(seen, seen[1:]))


def test_stream_equals_batch(spark, tmp_path):
    log = store_events(spark, SF).select("visitor_id", "ts_us", F.col("arrival_seq").alias("seq"), F.expr("cast(8 + arrival_seq % 53 AS double)").alias("retain_sec"), "zone_id").persist()
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        log.filter((F.col("ts_us") >= k * 900_000_000) & (F.col("ts_us") < (k + 1) * 900_000_000)).coalesce(1).write.mode("append").parquet(folder)
    # two sightings far ahead move the watermark past all silences
    for k in (1, 2):
        spark.createDataFrame([("LAST", END_US + k * 10_000_000_000, 10**9 + k, 1.0, None)], log.schema).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    before = spark.conf.get(passports.PROVIDER[0])
    spark.conf.set(*passports.PROVIDER)
    try:
        live = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = passports.passport_changes(live, active_us=5_000_000, delay="10 seconds", forget_us=10**15).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(400)
        assert query.exception() is None
    finally:
        spark.conf.set(passports.PROVIDER[0], before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    told = spark.read.parquet(out).filter("visitor_id <> 'LAST'").persist()
    for clock in (1_000_000_000, END_US, END_US + 8_000_000, END_US + 10**9):
        want = lifecycle.lifecycle(log, clock, active_us=5_000_000).select("visitor_id", "state", "expirations").collect()
        got = passports.states_at(told, clock).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), clock
    stays = behavior.zone_changes(store_events(spark, SF).withColumn("seq", F.col("arrival_seq")))
    want = behavior.dwell_checkpoints(stays).select("visitor_id", "zone_id", "ts_us", "dwell_ms").collect()
    got = told.filter("what = 'DWELL'").select("visitor_id", "zone_id", F.col("at_us").alias("ts_us"), "dwell_ms").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    log.unpersist()
    told.unpersist()


class _Counted:
    """A stand-in for the state of one visitor that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_state_is_read_and_written_once_a_batch():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    s, state, work = 1_000_000, _Counted(), passports.Passports(5_000_000, passports.FORGET_US)
    work.init(state)
    seen = [Row(visitor_id="v", ts_us=k * s, seq=k, retain_us=9 * s, zone_id=f"Z{k % 7}") for k in range(400)]
    for part in (seen[:200], seen[200:]):
        state.calls = 0
        told = list(work.handleInputRows(("v",), iter(random.Random(4).sample(part, 200)), TimerValues(0, 0)))
        assert state.calls <= 4 and [r.what for r in told] == ["ACTIVE"] * (part is not seen and part[0].seq == 0)
    left = dict(zip(passports._FIELDS, state.value))["zones"]
    assert left == {f"Z{k}": sum(s for t in range(399) if t % 7 == k) for k in range(7)}
    # once the watermark has passed both, the loss and the end are told by one timer
    (due,) = state.timers
    state.timers.clear()
    told = list(work.handleExpiredTimer(("v",), TimerValues(0, due + 3_600_000), ExpiredTimerInfo(due)))
    assert [r.what for r in told] == ["SUSPENDED", "EXPIRED"] and len(state.timers) == 1
    (due,) = state.timers
    assert list(work.handleExpiredTimer(("v",), TimerValues(0, due), ExpiredTimerInfo(due))) == [] and state.value is None
