"""Queries that write files and read them again, look shapes up, and apply the scalar rules; with their DuckDB equivalents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import audit, behavior, floor, identity, ingest, lifecycle, projections, ranks, verifier
from ..sources import readers, sinks
from ..sources.event_store import EventStore
from ..sources.fixtures import store_events
from .floor_queries import AS_OF_EPOCH_US, RECTANGLES, SQL as FLOOR_SQL, _zones, health_fold, occlusion_class
from .store_queries import AUDIT_SQL, BASE, EV, TRACED_SQL, WARNINGS_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- event files

_UUID = "concat('00000000-0000-4000-8000-', lpad(cast(arrival_seq AS {text}), 12, '0'))"
_EVENT = "event_id, store_id, camera_id, visitor_id, event_type, ts_us, zone_id, dwell_ms, is_staff, confidence, queue_depth"
#: The log with ids as an ingest wants them, and each tenth event arriving twice.
_FILED_SQL = f"fl AS (SELECT * REPLACE ({_UUID.format(text='VARCHAR')} AS event_id) FROM ev)"


def _filed(spark: SparkSession, sf: str) -> DataFrame:
    return store_events(spark, sf).withColumn("event_id", F.expr(_UUID.format(text="string")))


@query(f"{EV}, {_FILED_SQL} SELECT {_EVENT} FROM fl")
def event_files(spark, sf):
    """The log, each tenth event twice, written as JSON lines, read again and validated."""
    events, path = _filed(spark, sf), shared_folder(spark)
    sinks.write_events(events.unionByName(events.filter("arrival_seq % 10 = 0").withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000)), path)
    return readers.replay_file(spark, path, AS_OF_EPOCH_US)[0].selectExpr(*_EVENT.split(", "))


@query(f"{EV}, {_FILED_SQL} SELECT {_EVENT} FROM fl WHERE store_id = 'STORE_1'")
def event_files_of_a_store(spark, sf):
    path = shared_folder(spark)
    sinks.event_json(_filed(spark, sf)).select("value").write.text(path)
    return readers.replay_file(spark, path, AS_OF_EPOCH_US, "STORE_1")[0].selectExpr(*_EVENT.split(", "))


@query(f"{EV} SELECT count(*) FILTER (arrival_seq % 7 = 0) AS malformed FROM ev")
def malformed_lines(spark, sf):
    """Every seventh line is cut off in the middle, and every fifth is blank besides."""
    path = shared_folder(spark)
    lines = sinks.event_json(_filed(spark, sf)).withColumn("value", F.when(F.col("arrival_seq") % 7 == 0, F.substring("value", 1, 20)).otherwise(F.col("value")))
    lines.unionByName(lines.filter("arrival_seq % 5 = 0").withColumn("value", F.lit("  "))).select("value").write.text(path)
    return readers.malformed(readers.read_event_lines(spark, path))


@query(f"{EV} SELECT * FROM ev")
def log_table(spark, sf):
    path = shared_folder(spark)
    sinks.write_log(store_events(spark, sf), path)
    return spark.read.parquet(path)


@query(f"{EV}, {TRACED_SQL}, {WARNINGS_SQL} SELECT * FROM warn")
def warning_files(spark, sf):
    found, path = verifier.warnings(store_events(spark, sf)), shared_folder(spark)
    sinks.write_warnings(found, path)
    return spark.read.schema(found.schema).json(path)


@query(f"{EV} SELECT arrival_seq, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0') END || 'Z' AS timestamp FROM ev")
def event_times_as_text(spark, sf):
    return store_events(spark, sf).select("arrival_seq", sinks.iso_time(F.col("ts_us")).alias("timestamp"))


@query(f"{EV} SELECT arrival_seq, ts_us FROM ev")
def event_times_from_text(spark, sf):
    """Times written with an offset of five and a half hours, and read."""
    local = F.concat(F.date_format(F.timestamp_micros(F.col("ts_us") + 19_800_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    return store_events(spark, sf).select("arrival_seq", ingest.parse_timestamp_us(local).alias("ts_us"))


# ---------------------------------------------------------------- a log that grows

#: The batch that brings each event first: two thirds of the log, then its even numbers, then all of it.
_BATCH = "CASE WHEN arrival_seq % 3 <> 0 THEN 0 WHEN arrival_seq % 2 = 0 THEN 1 ELSE 2 END"
_GROWN = f"{EV}, {_FILED_SQL}, bt AS (SELECT *, {_BATCH} AS batch FROM fl)"


def _grown(store: EventStore) -> DataFrame:
    """Accepted events with their batch and place, and the number that another branch of the plan finds for each."""
    kept = store.lines().filter("status = 'accepted'")
    other = kept.filter("store_id is not null").groupBy("event_id").agg(F.max("arrival_seq").alias("other"))
    placed = ranks.dense_positions(kept.join(other, "event_id"), "arrival_seq")
    return placed.select("event_id", F.col("batch").cast("int").alias("batch"), "position", (F.col("other") != F.col("arrival_seq")).alias("differs"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log as lines, dealt to many tasks while it is narrow: few splits of the table hold very many lines."""
    return sinks.event_json(_filed(spark, sf).repartition("arrival_seq"))


@query(f"{_GROWN} SELECT event_id, batch, row_number() OVER (ORDER BY batch, arrival_seq) AS position, false AS differs FROM bt")
def incremental_ingest(spark, sf):
    """Three overlapping batches of lines appended to a store: each event is taken from the first one that has it."""
    lines, store = _lines(spark, sf), EventStore(spark, shared_folder(spark), buckets=16)
    for part in (lines.filter("arrival_seq % 3 <> 0"), lines.filter("arrival_seq % 2 = 0"), lines):
        store.append(part, AS_OF_EPOCH_US, limit=None)
    return _grown(store)


@query(f"{_GROWN} SELECT event_id, batch, row_number() OVER (ORDER BY batch, CASE WHEN batch = 0 THEN ts_us ELSE 0 END, arrival_seq) AS position, false AS differs FROM bt")
def replay_then_ingest(spark, sf):
    """The first of those batches is replayed from files, in order of time, and the others arrive after it."""
    lines, path = _lines(spark, sf), shared_folder(spark)
    first = _filed(spark, sf).filter("arrival_seq % 3 <> 0").repartitionByRange("arrival_seq").sortWithinPartitions("arrival_seq")
    sinks.event_json(first).select("value").write.text(path)
    store = EventStore(spark, shared_folder(spark), buckets=16)
    store.replay(path, AS_OF_EPOCH_US)
    for part in (lines.filter("arrival_seq % 2 = 0"), lines):
        store.append(part, AS_OF_EPOCH_US, limit=None)
    return _grown(store)


@query(f"{EV}, {_FILED_SQL} SELECT event_id, arrival_seq % 5 AS shelf, arrival_seq % 3 = 0 AS tagged, queue_depth FROM fl")
def open_metadata(spark, sf):
    """Metadata that the log has no column for, through a store, its files and a replay of these."""
    extra = F.to_json(F.struct("queue_depth", F.struct((F.col("arrival_seq") % 5).alias("row")).alias("shelf"), F.when(F.col("arrival_seq") % 3 == 0, F.array(F.lit("promo"))).alias("tags")))
    events, path = _filed(spark, sf).withColumn("metadata", F.parse_json(extra)), shared_folder(spark)
    first, again = (EventStore(spark, shared_folder(spark), buckets=16) for _ in range(2))
    first.append(sinks.event_json(events), AS_OF_EPOCH_US, limit=None)
    sinks.write_events(first.events(), path)
    again.replay(path, AS_OF_EPOCH_US)
    found = lambda name, kind: F.try_variant_get("metadata", name, kind)
    return again.events().select("event_id", found("$.shelf.row", "long").alias("shelf"), F.coalesce(found("$.tags[0]", "string") == "promo", F.lit(False)).alias("tagged"), "queue_depth")


# ---------------------------------------------------------------- transaction files

_ORDERS = "o_orderkey AS k, o_orderdate AS d, o_totalprice AS v"
_KEPT = "k % 7 <> 3 AND k % 13 <> 5"


@query(f"""WITH o AS (SELECT {_ORDERS} FROM orders) SELECT CASE WHEN k % 4 = 1 THEN 'Shop ' || k % 5 ELSE 'ST' || k % 5 END AS store_id, CASE WHEN k % 5 = 0 THEN 'INV' || k ELSE 'O' || k END AS transaction_id,
  epoch_us(d) + (k % 86400) * 1000000 AS ts_us, CASE k % 6 WHEN 0 THEN floor(v) WHEN 1 THEN 0 ELSE v END::DOUBLE AS basket_value FROM o WHERE {_KEPT}""")
def transaction_files(spark, sf):
    """The orders as a CSV of the production layout: three ways to write a date, ids, names and values that are missing, repeated rows."""
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*[c.strip() for c in _ORDERS.split(",")])
    text = lambda e: F.expr(f"cast({e} AS string)")
    day = F.when(F.expr("k % 3 = 0"), F.date_format("d", "dd-MM-yyyy")).when(F.expr("k % 3 = 1"), F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    rows = o.select(
        F.when(F.expr("k % 13 <> 5 and k % 5 <> 0"), F.concat(F.lit("O"), text("k"))).alias("order_id"),
        F.when(F.expr("k % 13 <> 5"), F.concat(F.lit("INV"), text("k"))).alias("invoice_number"),
        F.when(F.expr("k % 7 = 3"), "soon").otherwise(day).alias("order_date"),
        F.date_format(F.timestamp_seconds(F.expr("k % 86400")), "HH:mm:ss").alias("order_time"),
        F.when(F.expr("k % 4 <> 1"), F.concat(F.lit("ST"), text("k % 5"))).alias("store_id"),
        F.concat(F.lit("Shop "), text("k % 5")).alias("store_name"),
        F.when(F.expr("k % 6 = 1"), "none").when(F.expr("k % 6 <> 0"), text("v")).alias("total_amount"),
        text("floor(v)").alias("NMV"),
    )
    path = shared_folder(spark)
    rows.unionByName(rows).write.csv(path, header=True)
    return readers.read_transactions(spark, path)


_SOLD_SQL = "so AS (SELECT 'ST' || o_orderkey % 5 AS store_id, 'O' || o_orderkey AS transaction_id, epoch_us(o_orderdate) + (o_orderkey % 86400) * 1000000 AS ts_us, o_totalprice::DOUBLE AS basket_value FROM orders)"


@query(f"WITH {_SOLD_SQL} SELECT * FROM so UNION ALL SELECT * FROM so WHERE store_id = 'ST2'")
def transactions_added(spark, sf):
    """The orders as a CSV of the standard layout, with one store's transactions inserted once more by hand."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.expr("o_orderkey % 86400") * 1_000_000
    sold = o.select(F.expr("concat('ST', cast(o_orderkey % 5 AS string))").alias("store_id"), F.expr("concat('O', cast(o_orderkey AS string))").alias("transaction_id"), at.alias("ts_us"), F.col("o_totalprice").cast("double").alias("basket_value"))
    path = shared_folder(spark)
    sold.select("store_id", "transaction_id", sinks.iso_time(F.col("ts_us")).alias("timestamp"), F.col("basket_value").alias("basket_value_inr")).write.csv(path, header=True)
    return readers.add_transactions(readers.read_transactions(spark, path), sold.filter("store_id = 'ST2'"))


# ---------------------------------------------------------------- calibration files

_ROLES = ("zone", "queue_area", "zone", "billing_counter", "staff_area")
_PLACES = "(VALUES " + ", ".join(f"({k}, {n!r}, {_ROLES[k]!r}, {a}, {b}, {c}, {d})" for k, (n, a, b, c, d) in enumerate(RECTANGLES)) + ") v(k, n, r, x1, y1, x2, y2)"
_SHAPES_SQL = f"""cam AS (SELECT DISTINCT camera_id FROM ev), shp AS (SELECT camera_id, n AS shape_id, 'polygon' AS shape_type, r AS role, 'label ' || n AS label, '#00FF80' AS color,
  CASE WHEN k = 1 THEN 'below' END AS inside_is, k <> 2 AS enabled, k AS ord, x1, y1, x2, y2 FROM cam CROSS JOIN {_PLACES})"""


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), F.col("ord") + 1)
    points = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    return _zones(spark, sf).select(
        "camera_id", F.col("zone_id").alias("shape_id"), F.lit("polygon").alias("shape_type"), role.alias("role"), F.concat(F.lit("label "), "zone_id").alias("label"), points.alias("points"),
        F.lit("#00FF80").alias("color"), F.when(F.col("ord") == 1, "below").alias("inside_is"), (F.col("ord") != 2).alias("enabled"), "ord",
    )


def _corners(shapes: DataFrame) -> DataFrame:
    spread = shapes.select(*[c for c in shapes.columns if c != "points"], F.posexplode("points").alias("corner", "p"))
    return spread.select(*[c for c in spread.columns if c != "p"], F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"{EV}, {_SHAPES_SQL}, co AS (SELECT * EXCLUDE (x1, y1, x2, y2), unnest([0, 1, 2, 3]) AS corner, unnest([x1, x2, x2, x1])::DOUBLE AS x, unnest([y1, y1, y2, y2])::DOUBLE AS y FROM shp) SELECT * FROM co")
def calibration_files(spark, sf):
    path = shared_folder(spark)
    sinks.write_calibration(_shapes(spark, sf), path, "STORE_1", "1")
    return _corners(readers.read_calibration(spark, path))


_TEMPLATES = ("CAM_ENTRY_03", "CAM_FLOOR_01", "CAM_FLOOR_02", "CAM_BILLING_05", "CAM_GODOWN_04")
_NAMES = ("CAM_ENTRY_01", "CAM_ENTRY_09", "cam_billing_2", "GODOWN", "MAIN_FLOOR_02", "MAIN_FLOOR_7", "STAFF_ROOM", "YARD")
#: A legacy override: zones of two cameras, and doors of one of them and of a camera without zones.
_OVERRIDE = {
    "CAM_ENTRY_01": [{"zone_id": "OWN", "polygon_norm": [[0, 0], [1, 0], [1, 1]], "color_bgr": [255, 16, 1]}, {"zone_id": "OWN_2", "sku_zone": "snacks", "polygon_norm": [[0, 0], [1, 0], [0, 1]]}],
    "YARD": [{"zone_id": "GATE", "polygon_norm": [[0, 0], [1, 0], [1, 1]], "color_bgr": [0, 0, 0]}],
    "entry_line_norm": {"CAM_ENTRY_01": [[0.1, 0.5], [0.9, 0.5]], "CAM_FLOOR_01": [[0.1, 0.5], [0.9, 0.5]]},
}
_OWN = (("CAM_ENTRY_01", "OWN", "OWN", "#0110FF"), ("CAM_ENTRY_01", "OWN_2", "snacks", "#80FF00"), ("CAM_ENTRY_01", "ENTRY_LINE", "ENTRY_DOOR", "#FF0033"), ("YARD", "GATE", "GATE", "#000000"))


def _template_sql(name: str) -> str:
    up = f"upper({name})"
    return f"CASE WHEN contains({up}, 'ENTRY') THEN 'CAM_ENTRY_03' WHEN contains({up}, 'BILLING') THEN 'CAM_BILLING_05' WHEN contains({up}, 'GODOWN') OR contains({up}, 'STAFF') THEN 'CAM_GODOWN_04' WHEN contains({up}, 'FLOOR') THEN CASE WHEN contains({up}, '_02') THEN 'CAM_FLOOR_02' ELSE 'CAM_FLOOR_01' END END"


@query(f"""{EV}, {_SHAPES_SQL}, own AS (SELECT * FROM (VALUES {", ".join(map(repr, _OWN))}) v(camera_id, shape_id, label, color)),
file AS (SELECT camera_id, shape_id, label, color FROM shp WHERE camera_id LIKE 'CAM_ENTRY%' AND camera_id NOT IN (SELECT camera_id FROM own)),
nam AS (SELECT camera_id, {_template_sql("camera_id")} AS t FROM (SELECT camera_id FROM cam UNION SELECT unnest([{", ".join(map(repr, _NAMES))}]))),
tpl AS (SELECT camera_id, 'T_' || t AS shape_id, t AS label, '#111111' AS color FROM nam WHERE t IS NOT NULL AND camera_id NOT IN (SELECT camera_id FROM own UNION SELECT camera_id FROM file))
SELECT * FROM own UNION ALL SELECT * FROM file UNION ALL SELECT * FROM tpl""")
def shape_sources(spark, sf):
    """Each camera's shapes from the first that has it: the override file, the entry cameras' calibration file, the templates."""
    override, written = shared_folder(spark), shared_folder(spark)
    spark.createDataFrame([(json.dumps(_OVERRIDE),)], "value string").coalesce(1).write.text(override)
    sinks.write_calibration(_shapes(spark, sf).filter("camera_id like 'CAM_ENTRY%'"), written, "STORE_1", "1")
    names = store_events(spark, sf).select("camera_id").distinct().union(spark.createDataFrame([(n,) for n in _NAMES], "camera_id string")).distinct()
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))])
    templates = spark.createDataFrame([(t,) for t in _TEMPLATES], "camera_id string").select(
        "camera_id", F.concat(F.lit("T_"), "camera_id").alias("shape_id"), F.lit("polygon").alias("shape_type"), F.lit("zone").alias("role"), F.col("camera_id").alias("label"), square.alias("points"),
        F.lit("#111111").alias("color"), F.lit(None).cast("string").alias("inside_is"), F.lit(True).alias("enabled"), F.lit(0).alias("ord"),
    )
    found = readers.first_source(readers.read_override(spark, override), readers.read_calibration(spark, written), readers.from_templates(names, templates))
    return found.select("camera_id", "shape_id", "label", "color")


@query(f"{EV}, {_SHAPES_SQL} SELECT arrival_seq, ev.camera_id, zone_id, role, label FROM (SELECT * REPLACE (CASE arrival_seq % 4 WHEN 0 THEN 'ZONE_A' WHEN 1 THEN 'ZONE_B' ELSE zone_id END AS zone_id) FROM ev) ev LEFT JOIN shp ON shp.camera_id = ev.camera_id AND shape_id = zone_id")
def event_shapes(spark, sf):
    named = F.when(F.col("arrival_seq") % 4 == 0, "ZONE_A").when(F.col("arrival_seq") % 4 == 1, "ZONE_B").otherwise(F.col("zone_id"))
    return lifecycle.shape_of(store_events(spark, sf).withColumn("zone_id", named), _shapes(spark, sf)).select("arrival_seq", "camera_id", "zone_id", "role", "label")


@query(f"{EV} SELECT arrival_seq, printf('#%02X%02X%02X', arrival_seq % 256, arrival_seq * 7 % 256, arrival_seq * 13 % 256) AS color, arrival_seq * 13 % 256 AS blue, arrival_seq * 7 % 256 AS green, arrival_seq % 256 AS red FROM ev")
def colour_codes(spark, sf):
    bgr = F.array(*[F.expr(f"cast(arrival_seq * {k} % 256 AS int)") for k in (13, 7, 1)])
    coded = store_events(spark, sf).select("arrival_seq", readers.bgr_to_hex(bgr).alias("color"))
    back = readers.hex_to_bgr(F.col("color"))
    return coded.select("arrival_seq", "color", *[back[k].cast("long").alias(n) for k, n in enumerate(("blue", "green", "red"))])


# ---------------------------------------------------------------- clocks

_DAY = 86_400_000_000
#: Of three cameras one has no clock; one in five of the others shows a date after the newest file's.
_CLOCKS = f"CASE WHEN n % 3 <> 1 THEN ({{day}} + CASE WHEN n % 5 = 0 THEN 9 WHEN n % 4 = 2 THEN -1 ELSE 0 END) * {_DAY} + n * 61000000 END"


@query(f"""{EV}, c AS (SELECT camera_id, row_number() OVER (ORDER BY camera_id) - 1 AS n FROM (SELECT DISTINCT camera_id FROM ev)), r AS (SELECT *, {_CLOCKS.format(day=20_000)} AS read_us FROM c),
m AS (SELECT read_us // {_DAY} AS day, count(*) AS many FROM r WHERE read_us // {_DAY} <= 20003 GROUP BY 1 ORDER BY many DESC LIMIT 1)
SELECT camera_id, m.day * {_DAY} + coalesce(read_us % {_DAY}, (SELECT read_us % {_DAY} FROM r WHERE read_us IS NOT NULL ORDER BY n LIMIT 1)) AS start_us FROM r CROSS JOIN m""")
def clip_starts(spark, sf):
    order = F.expr("row_number() OVER (ORDER BY camera_id) - 1")  # the cameras of a store: some dozens of rows
    cameras = store_events(spark, sf).select("camera_id").distinct().withColumn("n", order)
    return readers.start_times(cameras.select("camera_id", F.col("n").alias("ord"), F.expr(_CLOCKS.format(day=20_000)).alias("read_us"), F.lit(20_003 * _DAY).alias("max_mtime_us")), 0)


@query(f"{EV} SELECT arrival_seq, {AS_OF_EPOCH_US} + floor(arrival_seq * (1000000::DOUBLE / 15))::BIGINT AS frame_us FROM ev")
def frame_times(spark, sf):
    return store_events(spark, sf).select("arrival_seq", readers.frame_time_us(F.lit(AS_OF_EPOCH_US), F.col("arrival_seq")).alias("frame_us"))


@query(f"""{EV}, s AS (SELECT visitor_id, arrival_seq, CASE arrival_seq % 3 WHEN 0 THEN 'ENTERED' WHEN 1 THEN 'QUEUEING' ELSE 'DWELLING' END AS state, arrival_seq % 17 AS stayed FROM ev)
SELECT visitor_id, arrival_seq, CASE WHEN state = 'ENTERED' AND stayed >= 5 THEN 'BROWSING' WHEN state = 'QUEUEING' AND stayed >= 10 THEN 'PURCHASE_CANDIDATE' ELSE state END AS state FROM s""")
def behavior_ticks(spark, sf):
    state = F.when(F.col("arrival_seq") % 3 == 0, "ENTERED").when(F.col("arrival_seq") % 3 == 1, "QUEUEING").otherwise("DWELLING")
    states = store_events(spark, sf).withColumn("state", state)
    return behavior.time_ticks(states, F.col("ts_us") + F.col("arrival_seq") % 17 * 1_000_000).select("visitor_id", "arrival_seq", "state")


# ---------------------------------------------------------------- scalar rules

_PARTS = ("arrival_seq * 37 % 101", 101), ("arrival_seq * 11 % 97", 97), ("arrival_seq * 5 % 89", 89), ("arrival_seq * 3 % 83", 83)


@query(f"""{EV}, p AS (SELECT arrival_seq, round_even({" * ".join(f"(({e})::DOUBLE / {n})" for e, n in _PARTS)}, 4) AS product FROM ev) SELECT arrival_seq, product AS confidence, round_even(product * (0.7::DOUBLE + (arrival_seq % 79)::DOUBLE / 271), 4) AS with_modifier FROM p""")
def emitted_confidence(spark, sf):
    parts = [F.expr(f"cast({e} AS double)") / n for e, n in _PARTS]
    modifier = 0.7 + F.expr("cast(arrival_seq % 79 AS double)") / 271
    return store_events(spark, sf).select("arrival_seq", sinks.event_confidence(*parts).alias("confidence"), sinks.event_confidence(*parts, modifier).alias("with_modifier"))


@query(f"{EV} SELECT arrival_seq, 'ZONE_EXIT' AS event_type, zone_id, dwell_ms AS emitted_dwell_ms, 'BILLING_QUEUE_JOIN' AS queue_type, 'ZONE_BILLING_QUEUE' AS queue_zone, queue_depth AS emitted_depth FROM ev")
def emitted_events(spark, sf):
    left = sinks.emitted("ZONE_EXIT", F.col("zone_id"), dwell_ms=F.col("dwell_ms"))
    join = [c.alias(n) for c, n in zip(sinks.emitted("BILLING_QUEUE_JOIN", F.lit("elsewhere"), queue_depth=F.col("queue_depth")), ("queue_type", "queue_zone", "queue_metadata"))]
    return store_events(spark, sf).select("arrival_seq", *left, *join).select("arrival_seq", "event_type", "zone_id", F.col("metadata.dwell_ms").alias("emitted_dwell_ms"), "queue_type", "queue_zone", F.col("queue_metadata.queue_depth").alias("emitted_depth"))


@query(f"WITH k AS ({FLOOR_SQL['occlusion_class']}) SELECT arrival_seq, kind, round_even(greatest(0, 1 - CASE kind WHEN 'SHELF_OCCLUSION' THEN 0.5 WHEN 'CAMERA_BOUNDARY_EXIT' THEN 1 WHEN 'TRUE_STORE_EXIT' THEN 0.3 ELSE 0.7 END::DOUBLE * (arrival_seq % 31)::DOUBLE / retain_sec), 6) AS sure FROM k")
def occlusion_fading(spark, sf):
    left = identity.occlusion_decay(F.col("kind"), F.expr("cast(arrival_seq % 31 AS double)"), F.col("retain_sec"))
    return occlusion_class(spark, sf).select("arrival_seq", "kind", F.bround(left, 6).alias("sure"))


_STD, _ASPECT, _HEIGHT = "cast(vec_id % 13 AS double) / 23", "cast(vec_id % 7 AS double) / 29", "cast(vec_id % 5 AS double) / 31"


def _term_sql(present: str, term: str, weight: float) -> str:
    return f"CASE WHEN {present} THEN ({term}) * {weight}::DOUBLE ELSE 0 END"


_HAVE = {"embedding": "p.vec_id % 11 <> 0 AND q.vec_id % 11 <> 0", "colours": "p.vec_id % 3 <> 0 AND q.vec_id % 3 <> 0", "motion": "p.vec_id % 2 = 0 AND q.vec_id % 2 = 0"}


def _like_sql(lo: int, hi: int) -> str:
    return f"list_cosine_similarity(p.embedding[{lo}:{hi}]::DOUBLE[], q.embedding[{lo}:{hi}]::DOUBLE[])"


_LIKE_SQL = [
    _term_sql(_HAVE["embedding"], f"{_like_sql(1, 64)} * greatest(0.5::DOUBLE, 1 - least(p.sd, q.sd))", 0.5), _term_sql(_HAVE["colours"], _like_sql(1, 32), 0.25),
    "greatest(0, 1 - (abs(p.aspect - q.aspect) / 0.5::DOUBLE + abs(p.height - q.height) / 0.3::DOUBLE)) * 0.15::DOUBLE", _term_sql(_HAVE["motion"], _like_sql(1, 8), 0.1),
]


@query(f"""WITH e AS (SELECT vec_id, embedding, {", ".join(f"{x.replace('AS double', 'AS DOUBLE')} AS {n}" for x, n in ((_STD, 'sd'), (_ASPECT, 'aspect'), (_HEIGHT, 'height')))} FROM embeddings)
SELECT p.vec_id AS vec_id, round_even(({" + ".join(_LIKE_SQL)}) / (CASE WHEN {_HAVE["embedding"]} THEN 0.5 ELSE 0 END + CASE WHEN {_HAVE["colours"]} THEN 0.25 ELSE 0 END + 0.15 + CASE WHEN {_HAVE["motion"]} THEN 0.1 ELSE 0 END)::DOUBLE, 4) AS likeness
FROM e p JOIN e q ON q.vec_id = p.vec_id + 2""")
def fingerprint_likeness(spark, sf):
    """Each fingerprint against the one two places on; some know no vector, colours or motion."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("v", F.expr("cast(embedding AS array<double>)"))
    part = lambda missing, n: F.when(~F.expr(missing), F.slice("v", 1, n))
    fields = {"embedding": part("vec_id % 11 = 0", 64), "embedding_std": F.expr(_STD), "aspect": F.expr(_ASPECT), "height": F.expr(_HEIGHT), "colours": part("vec_id % 3 = 0", 32), "motion": part("vec_id % 2 <> 0", 8)}
    made = vectors.select("vec_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("f"))
    pairs = made.withColumnRenamed("f", "p").join(made.select((F.col("vec_id") - 2).alias("vec_id"), F.col("f").alias("q")), "vec_id")
    return pairs.select("vec_id", identity.fingerprint_similarity("p", "q").alias("likeness"))


@query(f"WITH h AS ({FLOOR_SQL['health_fold']}), c AS (SELECT count(*) FILTER (health <= 40) AS collapsed FROM h) SELECT * FROM c WHERE collapsed >= 3")
def health_collapse(spark, sf):
    """Health above 40 is counted from there, as the test tracks never come to zero."""
    return floor.collapsed_tracks(health_fold(spark, sf).withColumn("health", F.col("health") - 40))


# ---------------------------------------------------------------- answers


@query(f"""{EV}, n AS (SELECT store_id, event_type, count(*) AS events FROM ev GROUP BY ALL), j AS (SELECT store_id, '{{"event_type":"' || event_type || '","events":' || events || '}}' AS line FROM n) SELECT store_id, '[' || string_agg(line, ',' ORDER BY line) || ']' AS body FROM j GROUP BY store_id""")
def answers_as_json(spark, sf):
    return projections.as_json(store_events(spark, sf).groupBy("store_id", "event_type").agg(F.count(F.lit(1)).alias("events")))


@query(f"""{BASE}, {TRACED_SQL}, {WARNINGS_SQL}, {AUDIT_SQL}, l AS (SELECT visitor_id, row_number() OVER (PARTITION BY visitor_id ORDER BY arrival_seq, sub_seq) AS n, '[' || category || '] ' || event_type || ' ' || reason AS line FROM rec)
SELECT visitor_id, string_agg(n || '. ' || line, chr(10) ORDER BY n) AS explanation FROM l GROUP BY visitor_id""")
def audit_explanations(spark, sf):
    return audit.explain(audit.audit_timeline(store_events(spark, sf)))
