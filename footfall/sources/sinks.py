"""Tables to files and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import dedup
from ..schema import BILLING_ZONE


def iso_time(ts_us: Column) -> Column:
    """UTC text of a time; without a fraction where it is zero."""
    at = F.timestamp_micros(ts_us)
    return F.concat(F.when(ts_us % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("Z"))


def event_json(events: DataFrame) -> DataFrame:
    """One JSON line per event in the shape that ingest reads, with whatever else its VARIANT ``metadata`` holds."""
    meta = F.struct("queue_depth", F.col("wait_ms").alias("wait_duration_ms"), "reid_score")
    if dict(events.dtypes).get("metadata") == "variant":
        meta = F.coalesce("metadata", F.try_parse_json(F.to_json(meta)))
    body = F.struct("event_id", "store_id", "camera_id", "visitor_id", "event_type", iso_time(F.col("ts_us")).alias("timestamp"), "zone_id", "dwell_ms", "is_staff", "confidence", meta.alias("metadata"))
    return events.select("store_id", "arrival_seq", F.to_json(body).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines in a folder per store, the first arrival of each id, each file a run of arrivals in order.

    A store with many events is cut into several files by its arrivals.
    """
    lines = event_json(dedup(events))
    lines.repartitionByRange("store_id", "arrival_seq").sortWithinPartitions("store_id", "arrival_seq").select("store_id", "value").write.mode("append").partitionBy("store_id").text(path)


def write_log(events: DataFrame, path: str) -> None:
    """Appends the log as Parquet by store, clustered by visitor for the window operators."""
    events.repartition("store_id", "visitor_id").sortWithinPartitions("store_id", "visitor_id", "arrival_seq").write.mode("append").partitionBy("store_id").parquet(path)


def write_warnings(warnings: DataFrame, path: str) -> None:
    warnings.write.mode("append").json(path)


def write_calibration(shapes: DataFrame, path: str, store_id: str, version: str) -> None:
    """A calibration of a store as one JSON text; a store's shapes are a small table."""
    shape = F.struct("shape_id", "shape_type", "role", "label", "points", "color", "enabled", F.struct("inside_is").alias("meta"))
    cameras = shapes.groupBy("camera_id").agg(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", shape.alias("s")))), lambda x: x["s"]).alias("shapes")).alias("c"))
    whole = cameras.agg(F.map_from_entries(F.collect_list(F.struct("camera_id", "c"))).alias("cameras"))
    whole.select(F.to_json(F.struct(F.lit(store_id).alias("store_id"), F.lit(version).alias("version"), "cameras"))).write.mode("overwrite").text(path)


def emitted(kind: str, zone: Column | None = None, **metadata: Column) -> list[Column]:
    """Columns of one emitted event; queue events always carry the billing zone."""
    fixed = F.lit(BILLING_ZONE) if kind.startswith("BILLING") else zone if zone is not None else F.lit(None).cast("string")
    return [F.lit(kind).alias("event_type"), fixed.alias("zone_id"), F.struct(*[c.alias(n) for n, c in metadata.items()]).alias("metadata") if metadata else F.lit(None).alias("metadata")]


def event_confidence(detection: Column, track: Column, reid: Column, zone: Column, modifier: Column | None = None) -> Column:
    """Product of the four confidences to four decimals, then times the camera's modifier."""
    product = F.bround(detection * track * reid * zone, 4)
    return product if modifier is None else F.bround(product * modifier, 4)
