"""Files to tables: event logs, transactions, calibrations. Schemas are stated, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..operators import ingest

_PLACE = ("file_path", "block", "line")


def _placed(lines: DataFrame) -> DataFrame:
    """Adds where each row stands: file, block of the file, place in the block."""
    return lines.withColumns({"file_path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()})


def _event_lines(spark: SparkSession, path: str, store_id: str | None = None) -> DataFrame:
    lines = _placed(spark.read.text(path)).filter(F.trim("value") != "")
    if store_id is not None:
        lines = lines.filter(F.try_variant_get(F.try_parse_json("value"), "$.store_id", "string") == store_id)
    return lines


def read_event_lines(spark: SparkSession, path: str, store_id: str | None = None) -> DataFrame:
    """Non-blank lines of a JSONL log as (arrival_seq, value), in file order; one store's if named.

    arrival_seq grows with the order of lines in a file without being dense. The numbered lines are written once, so that every
    branch of a plan sees the same numbers. Lines that are no JSON are kept, to be counted by ``ingest.validate``, unless a store is asked for.
    """
    ordered = _event_lines(spark, path, store_id).repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    return cut(ordered.select(F.monotonically_increasing_id().alias("arrival_seq"), "value"))


def malformed(lines: DataFrame) -> DataFrame:
    """How many lines are no JSON at all."""
    return lines.agg(F.count_if(F.try_parse_json("value").isNull()).alias("malformed"))


def replay_lines(spark: SparkSession, path: str, as_of_us: int, store_id: str | None = None) -> DataFrame:
    """Checked lines of a JSONL log with arrival numbers by time, then by place in the files; rejected lines without a time come first.

    Each line is parsed once; of one event id the first line in the files is accepted. To be written before it is read twice.
    """
    lines = _event_lines(spark, path, store_id).select(F.struct(*_PLACE).alias("arrival_seq"), "value")
    return ingest.replay_order(ingest.with_status(ingest.validate(lines, as_of_us))).drop("file_seq")


def replay_file(spark: SparkSession, path: str, as_of_us: int, store_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted events in replay order, checked lines) of a JSONL log, both out of one written table."""
    checked = cut(replay_lines(spark, path, as_of_us, store_id))
    return ingest.accepted(checked), checked


def _first_text(columns: list[str], names: tuple[str, ...]) -> Column:
    have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


_FORMATS = ("dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``schema.POS`` out of a CSV with a header, in the standard or the production layout.

    Rows without store, transaction or a readable time are skipped, a bad value counts 0, and of rows with
    one store and transaction the first in the file is kept.
    """
    raw = spark.read.csv(path, header=True, multiLine=False)
    rows = _placed(raw)
    names = raw.columns
    value = F.coalesce(_first_text(names, ("basket_value_inr", "total_amount", "NMV", "GMV")).try_cast("double"), F.lit(0.0))
    if "timestamp" in names:
        at = F.try_to_timestamp(F.trim("timestamp"))
    else:
        joined = F.concat_ws(" ", *[F.trim(c) for c in ("order_date", "order_time") if c in names])
        at = reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(joined, F.lit(f)) for f in _FORMATS])
    named = rows.select(
        _first_text(names, ("store_id", "store_name")).alias("store_id"),
        _first_text(names, ("transaction_id", "order_id", "invoice_number")).alias("transaction_id"),
        F.unix_micros(at).alias("ts_us"),
        value.alias("basket_value"),
        *_PLACE,
    ).filter("store_id is not null and transaction_id is not null and ts_us is not null")
    first = F.row_number().over(Window.partitionBy("store_id", "transaction_id").orderBy(*_PLACE))
    return named.withColumn("nth", first).filter("nth = 1").select("store_id", "transaction_id", "ts_us", "basket_value")


def add_transactions(pos: DataFrame, more: DataFrame) -> DataFrame:
    """Transactions added by hand are not checked for repeats."""
    return pos.unionByName(more.select(*pos.columns))


_SHAPE = "struct<shape_id:string,shape_type:string,role:string,label:string,points:array<array<double>>,color:string,enabled:boolean,meta:struct<inside_is:string>>"
_SHAPES = ("camera_id", "shape_id", "shape_type", "role", "label", "points", "color", "inside_is", "enabled", "ord")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of a versioned calibration file, one row each, also disabled ones (``enabled`` null counts as true)."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"struct<store_id:string,version:string,cameras:map<string,struct<shapes:array<{_SHAPE}>>>>").alias("d"))
    cameras = parsed.select(F.explode("d.cameras").alias("camera_id", "c"))
    shapes = cameras.select("camera_id", F.posexplode("c.shapes").alias("ord", "s"))
    made = shapes.select("camera_id", "s.shape_id", F.coalesce("s.shape_type", F.lit("polygon")).alias("shape_type"), "s.role", "s.label", "s.points", "s.color", F.col("s.meta.inside_is").alias("inside_is"), F.coalesce("s.enabled", F.lit(True)).alias("enabled"), "ord")
    return made.select(*_SHAPES)


def calibration_file_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues of the file itself: not there, no JSON, or no cameras."""
    schema = "code string, severity string"
    try:
        text = spark.read.text(path, wholetext=True)
        found = text.select(F.try_parse_json("value").alias("v"))
        kind = F.schema_of_variant(F.try_variant_get("v", "$.cameras", "variant"))
        code = F.when(F.col("v").isNull(), "JSON_PARSE_ERROR").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "MISSING_CAMERAS")
        return found.select(code.alias("code"), F.lit("ERROR").alias("severity")).filter("code is not null")
    except Exception as e:  # Spark names a missing path only when the plan is made
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([("FILE_NOT_FOUND", "ERROR")], schema)


def read_override(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of a legacy override file: zones by camera, and entry lines with the inside below."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "body"))
    zone = "array<struct<zone_id:string,sku_zone:string,polygon_norm:array<array<double>>,color_bgr:array<int>>>"
    zones = parsed.filter("key <> 'entry_line_norm'").select(F.col("key").alias("camera_id"), F.posexplode(F.from_json("body", zone)).alias("ord", "z"))
    lines = parsed.filter("key = 'entry_line_norm'").select(F.explode(F.from_json("body", "map<string,array<array<double>>>")).alias("camera_id", "points")).filter("size(points) = 2")
    null = F.lit(None).cast("string")
    shapes = zones.select("camera_id", F.col("z.zone_id").alias("shape_id"), F.lit("polygon").alias("shape_type"), F.lit("zone").alias("role"), F.coalesce("z.sku_zone", "z.zone_id").alias("label"), F.col("z.polygon_norm").alias("points"), bgr_to_hex(F.col("z.color_bgr")).alias("color"), null.alias("inside_is"), F.lit(True).alias("enabled"), "ord")
    doors = lines.select("camera_id", F.lit("ENTRY_LINE").alias("shape_id"), F.lit("line").alias("shape_type"), F.lit("entry_line").alias("role"), F.lit("ENTRY_DOOR").alias("label"), "points", F.lit("#FF0033").alias("color"), F.lit("below").alias("inside_is"), F.lit(True).alias("enabled"), F.lit(1000).alias("ord"))
    return shapes.unionByName(doors.join(zones.select("camera_id").distinct(), "camera_id", "left_semi").select(*_SHAPES))


def first_source(*sources: DataFrame) -> DataFrame:
    """Shapes of each camera from the first source that has the camera."""
    ranked = reduce(lambda a, b: a.unionByName(b), [s.withColumn("priority", F.lit(k)) for k, s in enumerate(sources)])
    best = ranked.groupBy("camera_id").agg(F.min("priority").alias("priority"))
    return ranked.join(best, ["camera_id", "priority"], "left_semi").drop("priority")


def template_camera(camera: Column) -> Column:
    """The template whose zones a camera without any takes, by its name."""
    up = F.upper(camera)
    floor = F.when(up.contains("_02"), "CAM_FLOOR_02").otherwise("CAM_FLOOR_01")
    return F.when(up.contains("ENTRY"), "CAM_ENTRY_03").when(up.contains("BILLING"), "CAM_BILLING_05").when(up.contains("GODOWN") | up.contains("STAFF"), "CAM_GODOWN_04").when(up.contains("FLOOR"), floor)


def from_templates(cameras: DataFrame, templates: DataFrame) -> DataFrame:
    """The templates' shapes bound to the cameras whose names call for them."""
    wanted = cameras.select("camera_id", template_camera(F.col("camera_id")).alias("t"))
    return wanted.join(templates.withColumnRenamed("camera_id", "t"), "t").drop("t").select(*_SHAPES)


def bgr_to_hex(bgr: Column) -> Column:
    """``#RRGGBB`` of a blue-green-red triple (green by default)."""
    part = lambda k, d: F.lpad(F.hex(F.coalesce(F.try_element_at(bgr, F.lit(k)), F.lit(d))), 2, "0")
    return F.concat(F.lit("#"), part(3, 128), part(2, 255), part(1, 0))


def hex_to_bgr(color: Column) -> Column:
    return F.array(*[F.conv(F.substring(color, at, 2), 16, 10).cast("int") for at in (6, 4, 2)])


def frame_time_us(start_us: Column, frame: Column, fps: float = 15.0) -> Column:
    """Event time of a frame."""
    return (start_us + F.floor(frame * (1e6 / fps))).cast("long")


def start_times(cameras: DataFrame, fallback_us: int) -> DataFrame:
    """Start of each camera's clip out of ``cameras(camera_id, ord, read_us, max_mtime_us)``, read_us null where no clock was read.

    The commonest date that is not after the newest file's holds for all; cameras keep their time of day,
    those without one take the first that was read.
    """
    day = 86_400_000_000
    limit = F.expr(f"coalesce(max_mtime_us, {fallback_us}) div {day}")
    dated = cameras.withColumn("date", F.expr(f"read_us div {day}")).withColumn("valid", F.col("date") <= limit)
    agreed = dated.agg(F.coalesce(F.mode(F.when(F.col("valid"), F.col("date"))), F.lit(fallback_us // day)).alias("date"), F.min_by(F.expr(f"read_us % {day}"), F.when(F.col("read_us").isNotNull(), F.col("ord"))).alias("first"))
    date, first = (agreed.select(c).scalar() for c in ("date", "first"))
    own = F.coalesce(F.expr(f"read_us % {day}"), first)
    return dated.withColumns({"d": date, "t": own}).select("camera_id", F.coalesce(F.col("d") * day + F.col("t"), F.lit(fallback_us)).alias("start_us"))
