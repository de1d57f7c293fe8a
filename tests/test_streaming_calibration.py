import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from footfall.operators import calibration
from footfall.sources.fixtures import store_events
from footfall.streaming import calibration as live
from footfall.streaming import passports

SF = "/root/testdata/sf0.01"


def test_stream_equals_batch(spark, tmp_path):
    # re-identified visitors and queue waits in every store, and one store that never recalibrates
    log = store_events(spark, SF).filter("arrival_seq < 6000").withColumn("store_id", F.when(F.col("arrival_seq") % 97 == 0, "QUIET").otherwise(F.col("store_id")))
    log = log.withColumn("wait_ms", F.when(F.col("event_type") == "BILLING_QUEUE_ABANDON", F.col("arrival_seq") % 90000)).persist()
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        log.filter((F.col("arrival_seq") >= 2000 * k) & (F.col("arrival_seq") < 2000 * (k + 1))).coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get(passports.PROVIDER[0])
    spark.conf.set(*passports.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = live.threshold_updates(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.set(passports.PROVIDER[0], before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = calibration.store_thresholds(log)
    got = live.latest_thresholds(spark.read.parquet(out), log).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and any(r.calibrations > 0 for r in got.collect())
    assert {r.store_id: r.calibrations for r in got.collect()}["QUIET"] == 0
    log.unpersist()


def test_kth_smallest_is_the_batch_rule(spark):
    for n in (29, 30, 31, 99, 250):
        xs = [(k * 37) % 101 / 101 for k in range(n)]
        table = spark.createDataFrame([("s", k, x) for k, x in enumerate(xs)], "store_id string, seq int, x double")
        assert live.kth_smallest(xs, calibration.REID) == calibration.order_statistic(table, ["store_id"], calibration.REID).first().value
