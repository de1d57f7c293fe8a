"""Checks that need intervals, arrival order or rate limits, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import floor, graph, lifecycle, verifier
from ..schema import STAFF_MIN_EVENTS, STAFF_WINDOW_US
from ..sources.fixtures import EVENTS_SQL, store_events
from ..streaming import passports
from ..streaming.sessions import project_each_batch
from .floor_queries import LIVE_UNTIL_US, POSITIONS_SQL, SQL as FLOOR_SQL, _spots, positions, visitor_groups
from .store_queries import EV


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query(FLOOR_SQL["identity_lifecycle"].replace("last_us, expirations FROM l", "expirations FROM l"))
def live_lifecycle(spark, sf):
    """The lifecycle of ``identity_lifecycle`` told by a stream: the log in files by time, taken in parts, and the state at its end."""
    log = store_events(spark, sf).select("visitor_id", "ts_us", F.col("arrival_seq").alias("seq"), F.expr("cast(8 + arrival_seq % 53 AS double)").alias("retain_sec"), "zone_id")
    log = log.filter(F.col("ts_us") <= LIVE_UNTIL_US)
    base = shared_folder(spark)
    ahead = lambda seconds: log.agg(F.lit("").alias("visitor_id"), (F.max("ts_us") + seconds * 1_000_000).alias("ts_us"), F.max("seq").alias("seq"), F.lit(0.0).alias("retain_sec"), F.lit(None).cast("string").alias("zone_id"))
    name, provider = passports.PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        # the later half of the log, and two sightings far ahead that let all others run out, come in batches of their own
        for part in (log.filter(F.col("ts_us") < LIVE_UNTIL_US // 2), log.filter(F.col("ts_us") >= LIVE_UNTIL_US // 2), ahead(10_000), ahead(20_000)):
            part.write.mode("append").parquet(f"{base}/in")
            live = spark.readStream.schema(log.schema).parquet(f"{base}/in")
            changes = passports.passport_changes(live, active_us=5_000_000, delay="30 minutes")
            project_each_batch(changes, keep, f"{base}/check").awaitTermination()
    finally:
        spark.conf.set(name, before)
    told = spark.read.schema(changes.schema).parquet(f"{base}/out/batch=*").filter("visitor_id <> ''")
    return passports.states_at(told, LIVE_UNTIL_US)


#: Every fourth event arrives a minute and a half late, and every eleventh over six minutes.
_LATE = "CASE WHEN arrival_seq % 11 = 0 THEN ts_us - 400000000 WHEN arrival_seq % 4 = 0 THEN ts_us - 90000000 ELSE ts_us END"


@query(f"""{EV}, lt AS (SELECT store_id, arrival_seq AS q, {_LATE} AS t, is_staff::INT AS f FROM ev),
ot AS (SELECT a.store_id, min(b.q) AS q, a.f FROM lt a JOIN lt b ON a.store_id = b.store_id AND b.q > a.q AND b.t >= a.t + {STAFF_WINDOW_US} GROUP BY a.store_id, a.q, a.f),
st AS (SELECT store_id, q, 1 AS d, f AS s, true AS own FROM lt UNION ALL SELECT store_id, q, -1, -f, false FROM ot),
rn AS (SELECT store_id, q, sum(d) AS d, sum(s) AS s FROM st GROUP BY ALL),
cu AS (SELECT store_id, q, (sum(d) OVER o)::BIGINT AS n, (sum(s) OVER o)::BIGINT AS s FROM rn WINDOW o AS (PARTITION BY store_id ORDER BY q))
SELECT q AS arrival_seq, store_id, n, round_even(s::DOUBLE / n::DOUBLE, 3) AS staff_fraction FROM cu WHERE n >= {STAFF_MIN_EVENTS} AND 2 * s > n""")
def staff_explosion_as_arrived(spark, sf):
    """The staff share of a store's trailing five minutes in a log that does not arrive in order of time."""
    late = store_events(spark, sf).withColumn("ts_us", F.expr(_LATE))
    return verifier.staff_explosions_as_arrived(late, arrivals=1000)


@query(f"""{EV}, b AS (SELECT *, last_value(CASE WHEN event_type IN ('ENTRY', 'REENTRY', 'EXIT') THEN event_type END IGNORE NULLS) OVER (PARTITION BY visitor_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)
SELECT arrival_seq, store_id, visitor_id, ts_us FROM b WHERE event_type = 'EXIT' AND coalesce(before, 'EXIT') = 'EXIT'""")
def exit_without_entry(spark, sf):
    return verifier.exits_without_entry(store_events(spark, sf))


_HOLD_US = 2_000_000
_STAY_SQL = f"""op AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY visitor_id, camera_id ORDER BY ts_us, arrival_seq) <= {_HOLD_US} THEN 0 ELSE 1 END AS opens FROM ev),
rs AS (SELECT *, sum(opens) OVER (PARTITION BY visitor_id, camera_id ORDER BY ts_us, arrival_seq) AS stay FROM op),
stays AS (SELECT min_by(store_id, arrival_seq) AS store_id, visitor_id, camera_id, min(ts_us) AS start_us, max(ts_us) + {_HOLD_US} AS end_us FROM rs GROUP BY visitor_id, camera_id, stay)"""


@query(f"""{EV}, {_STAY_SQL} SELECT a.store_id, a.visitor_id, a.camera_id AS camera_a, b.camera_id AS camera_b, greatest(a.start_us, b.start_us) AS since_us, least(a.end_us, b.end_us) AS until_us
  FROM stays a JOIN stays b ON a.visitor_id = b.visitor_id AND a.camera_id < b.camera_id AND a.start_us < b.end_us AND b.start_us < a.end_us""")
def simultaneous_cameras(spark, sf):
    """Visitors held to be at two cameras at once, a sighting standing for the two seconds after it."""
    return verifier.simultaneous_cameras(verifier.presence(store_events(spark, sf), _HOLD_US))


#: Numbered zones stand in a row; the billing zone is beside none of them.
_ZONE_NUMBER = "try_cast(substr(zone_id, 6) AS INT)"
_TELEPORT_SQL = """zd AS (SELECT *, lag(zone_id) OVER (PARTITION BY visitor_id ORDER BY arrival_seq) AS zone_from, lag(ts_us) OVER (PARTITION BY visitor_id ORDER BY arrival_seq) AS from_us FROM ev WHERE zone_id <> ''),
tp AS (SELECT arrival_seq, store_id, visitor_id, ts_us, zone_from, zone_id AS zone_to, abs(try_cast(substr(zone_id, 6) AS INT) - try_cast(substr(zone_from, 6) AS INT)) AS hops, ts_us - from_us AS us FROM zd WHERE zone_from <> zone_id),
tl AS (SELECT arrival_seq, store_id, visitor_id, ts_us, zone_from, zone_to, hops FROM tp WHERE hops IS NULL OR (hops >= 2 AND us < hops * 1000000))"""


def _teleports(spark, sf) -> DataFrame:
    events = store_events(spark, sf)
    numbered = events.select("zone_id", F.expr(_ZONE_NUMBER).alias("k")).filter("k is not null").distinct()
    links = numbered.join(numbered.select((F.col("k") - 1).alias("k"), F.col("zone_id").alias("neighbour_id")), "k").select(F.col("zone_id").alias("camera_id"), "neighbour_id")
    hops = graph.hops(spark, links).select(F.col("cam_from").alias("zone_from"), F.col("cam_to").alias("zone_to"), "hops")
    return verifier.visitor_teleports(events, hops)


@query(f"{EV}, {_TELEPORT_SQL} SELECT arrival_seq, store_id, visitor_id, zone_from, zone_to, hops FROM tl")
def visitor_teleport(spark, sf):
    """Zone changes over more zones than the time allows, or to a zone that none leads to."""
    return _teleports(spark, sf)


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {_TELEPORT_SQL}, nr AS (SELECT visitor_id, ts_us, arrival_seq, row_number() OVER (PARTITION BY visitor_id ORDER BY ts_us, arrival_seq) AS k FROM tl),
rl AS (SELECT visitor_id, arrival_seq, k, ts_us AS told_us, true AS told FROM nr WHERE k = 1 UNION ALL
  SELECT n.visitor_id, n.arrival_seq, n.k, CASE WHEN n.ts_us - r.told_us < 30000000 THEN r.told_us ELSE n.ts_us END, n.ts_us - r.told_us >= 30000000 FROM rl r JOIN nr n ON n.visitor_id = r.visitor_id AND n.k = r.k + 1)
SELECT visitor_id, arrival_seq, told_us AS ts_us FROM rl WHERE told""")
def teleport_reports(spark, sf):
    """Teleports as the auditor reports them: at most one of a visitor in 30 s."""
    times = store_events(spark, sf).select("arrival_seq", "ts_us")
    jumps = _teleports(spark, sf).join(times, "arrival_seq").withColumn("seq", F.col("arrival_seq"))
    return floor.teleport_reports(jumps).select("visitor_id", "arrival_seq", "ts_us")


@query(f"""{EV}, {POSITIONS_SQL}, lo AS (SELECT arrival_seq::VARCHAR AS visitor_id, camera_id, ts_us + (CASE WHEN arrival_seq % 4 = 0 THEN 30 ELSE arrival_seq % 13 + 5 END) * 1000000 AS expired_us FROM po WHERE event_type = 'ZONE_EXIT' AND confidence >= 0.4::DOUBLE)
SELECT * FROM lo WHERE expired_us < {LIVE_UNTIL_US} AND visitor_id::BIGINT % 3 <> 0""")
def ghost_failures(spark, sf):
    """Ghosts that ran out before anyone brought them back; every third one was."""
    lost = positions(spark, sf).filter("event_type = 'ZONE_EXIT'").select(F.col("arrival_seq").cast("string").alias("visitor_id"), "camera_id", "confidence", F.expr("cast(CASE WHEN arrival_seq % 4 = 0 THEN 0 ELSE arrival_seq % 13 + 5 END AS double)").alias("retain_sec"), F.col("ts_us").alias("lost_us"))
    return lifecycle.ghost_failures(lost, lost.filter("cast(visitor_id AS bigint) % 3 = 0"), LIVE_UNTIL_US)


@query(f"""{FLOOR_SQL["visitor_groups"].rsplit("SELECT camera_id, unnest(g)", 1)[0]}, mb AS (SELECT camera_id, unnest(g) AS visitor_id, g[1] AS group_id FROM gr),
sp AS (SELECT camera_id, frame, group_id, sqrt(pow(max(px) - min(px), 2) + pow(max(py) - min(py), 2)) AS apart, count(*) AS n FROM g JOIN mb USING (camera_id, visitor_id) GROUP BY ALL)
SELECT camera_id, frame, group_id, round_even(apart, 6) AS apart FROM sp WHERE n > 1 AND apart > 150""")
def group_splits(spark, sf):
    """Frames in which a group's members spread over more than the distance that made them one."""
    groups = visitor_groups(spark, sf)
    return floor.group_splits(_spots(spark, sf), groups).withColumn("apart", F.bround("apart", 6))
