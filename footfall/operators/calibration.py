"""Thresholds that follow the data: order statistics over the last samples, frozen at every 200th observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clamp, half_even
from ..schema import ENTRY, EXIT, QUEUE_ABANDON, QUEUE_JOIN, REENTRY, ZONE_EVENTS

# Fixed values by parameter: default, least, most, samples kept, samples needed, quantile, decimals.
REID = (0.65, 0.40, 0.90, 1000, 30, 0.10, 4)
QUEUE = (5.0, 2.0, 30.0, 500, 15, 0.10, 2)
STAFF = (0.55, 0.35, 0.85, 500, 20, 0.25, 4)
DWELL = (30000.0, 10000.0, 90000.0, 2000, 50, 0.05, 0)
TRUST = (1.0, 0.5, 1.0, 500, 20, 0.25, 4)
OCCLUSION = (20.0, 5.0, 60.0)
EVERY = 200
#: Taken off the staff score's quantile.
STAFF_MARGIN = 0.05


def snapshots(events: DataFrame, every: int = EVERY) -> DataFrame:
    """(store_id, snapshot_seq, calibrations): where each store last recalibrated, at a multiple of ``every``
    entries and exits. Stores that never got so far are missing.

    The number of an observation in its store comes from two steps, spans of the log and places in a
    span, so that a store is no single window.
    """
    seen = events.filter(F.col("event_type").isin(ENTRY, EXIT)).withColumn("span", F.expr("arrival_seq div 65536"))
    spans = seen.groupBy("store_id", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("store_id").orderBy("span")
    spans = spans.withColumn("upto", F.sum("n").over(before))
    total = F.max("upto").over(Window.partitionBy("store_id"))
    spans = spans.withColumn("target", total - total % every)
    holder = spans.filter((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target")) & (F.col("target") > 0))
    rows = seen.join(holder.select("store_id", "span", (F.col("target") - F.col("upto") + F.col("n")).alias("place"), "target"), ["store_id", "span"])
    nth = F.row_number().over(Window.partitionBy("store_id", "span").orderBy("arrival_seq"))
    return rows.withColumn("nth", nth).filter("nth = place").select("store_id", F.col("arrival_seq").alias("snapshot_seq"), F.expr(f"target div {every}").alias("calibrations"))


def order_statistic(samples: DataFrame, keys: list[str], rule: tuple, descending: bool = False) -> DataFrame:
    """(keys, value, observations): the k-th smallest of the last samples, k = max(1, floor(quantile * n)).

    ``samples(keys, seq, x)``. Groups with too few samples are missing.
    """
    _, _, _, kept, least, quantile, _ = rule
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    last = samples.withColumn("age", newest).filter(F.col("age") <= kept)
    groups = last.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count(F.lit(1)).alias("observations"))
    k = F.greatest(F.lit(1), F.floor(F.lit(quantile) * F.col("observations"))).cast("int")
    value = F.element_at("xs", -k if descending else k)
    return groups.select(*keys, "observations", F.when(F.col("observations") >= least, value).alias("value"))


def setting(value: Column, rule: tuple, shift: float = 0.0) -> Column:
    """A parameter's value as it is used: shifted, held within its bounds and rounded; the default for null."""
    default, low, high, *_, digits = rule
    return half_even(F.coalesce(clamp(value + shift, low, high), F.lit(default)), digits)


def _samples(events: DataFrame, at: DataFrame, x: Column) -> DataFrame:
    """Samples up to each store's snapshot; rows without a sample are left out."""
    upto = events.join(at.select(F.col("store_id").alias("s"), "snapshot_seq"), (F.col("store_id") == F.col("s")) & (F.col("arrival_seq") <= F.col("snapshot_seq")))
    return upto.select("store_id", "camera_id", F.col("arrival_seq").alias("seq"), x.cast("double").alias("x")).filter("x is not null")


def queue_sample(kind: Column) -> Column:
    wait = F.coalesce(F.nullif(F.col("wait_ms"), F.lit(0)), F.nullif(F.col("dwell_ms"), F.lit(0)))
    return F.when((kind == QUEUE_JOIN) & (F.col("dwell_ms") > 0), F.col("dwell_ms") / 1000).when(kind == QUEUE_ABANDON, wait / 1000)


def camera_trust(events: DataFrame) -> DataFrame:
    """(store_id, camera_id, camera_trust, occlusion_timeout_sec, observations) of each store's last calibration."""
    at = snapshots(events)
    found = order_statistic(_samples(events, at, F.when(F.col("event_type").isin(ENTRY, EXIT), F.col("confidence"))), ["store_id", "camera_id"], TRUST)
    return found.select("store_id", "camera_id", setting(F.col("value"), TRUST).alias("camera_trust"), F.lit(OCCLUSION[0]).alias("occlusion_timeout_sec"), "observations")


def occlusion_timeout(rate: Column, samples: Column) -> Column:
    """Seconds to keep a hidden track: 20 plus 40 times the share of hidden samples, once there are 20."""
    default, low, high = OCCLUSION
    return F.when(samples >= 20, clamp(default + rate * 40.0, low, high)).otherwise(F.lit(default))


def staff_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The staff threshold of ``scores(keys, seq, x)``: just under the upper quartile."""
    return order_statistic(scores, keys, STAFF, descending=True).withColumn("staff_confidence_threshold", setting(F.col("value"), STAFF, -STAFF_MARGIN)).drop("value")


def threshold_samples(kind: Column) -> dict[str, Column]:
    """What an event of this type is a sample of, by parameter; null where it is none."""
    zoned = kind.isin(*ZONE_EVENTS) & (F.coalesce("zone_id", F.lit("")) != "") & (F.col("dwell_ms") > 0)
    return {"reid_confidence_threshold": F.when(kind == REENTRY, F.col("reid_score")), "queue_join_dwell_sec": queue_sample(kind), "dwell_threshold_ms": F.when(zoned, F.col("dwell_ms"))}


def store_thresholds(events: DataFrame) -> DataFrame:
    """One row per known store with its four thresholds; defaults where samples are too few or no snapshot came."""
    at = snapshots(events)
    rules = {"reid_confidence_threshold": REID, "queue_join_dwell_sec": QUEUE, "dwell_threshold_ms": DWELL}
    out = events.select("store_id").distinct().join(at, "store_id", "left").withColumn("staff_confidence_threshold", F.lit(STAFF[0]))
    for name, x in threshold_samples(F.col("event_type")).items():
        rule = rules[name]
        found = order_statistic(_samples(events, at, x), ["store_id"], rule)
        out = out.join(found.select("store_id", F.col("value").alias(name)), "store_id", "left").withColumn(name, setting(F.col(name), rule))
    return out.withColumn("calibrations", F.coalesce("calibrations", F.lit(0))).drop("snapshot_seq")


#: Parameters by name, with the rule that has their default.
PARAMETERS = {"reid_confidence_threshold": REID, "queue_join_dwell_sec": QUEUE, "staff_confidence_threshold": STAFF, "dwell_threshold_ms": DWELL, "camera_trust": TRUST, "occlusion_timeout_sec": OCCLUSION}
#: What an unknown parameter is worth.
UNKNOWN_PARAMETER = 0.5


def profile_of(events: DataFrame, store_id: str) -> DataFrame:
    """The row of ``store_thresholds`` for one store; all defaults where nothing has been seen of it."""
    found = store_thresholds(events.filter(F.col("store_id") == store_id))
    defaults = {"calibrations": F.lit(0).cast("long"), **{n: F.lit(float(r[0])) for n, r in PARAMETERS.items()}}
    own = events.sparkSession.range(1).select(F.lit(store_id).alias("store_id")).join(found, "store_id", "left")
    return own.select("store_id", *[F.coalesce(F.col(c), defaults[c]).alias(c) for c in found.columns if c != "store_id"])


def changes(thresholds: DataFrame) -> DataFrame:
    """(store_id, parameter, before, after) of the thresholds that left their defaults."""
    defaults = {"reid_confidence_threshold": REID, "queue_join_dwell_sec": QUEUE, "staff_confidence_threshold": STAFF, "dwell_threshold_ms": DWELL}
    rows = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(float(r[0])).alias("before"), F.col(n).alias("after")) for n, r in defaults.items()])
    return thresholds.select("store_id", F.explode(rows).alias("r")).select("store_id", "r.*").filter("before <> after")
