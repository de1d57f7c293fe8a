"""Queries over the store log and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, calibration, correlation, projections, sessions, verifier
from ..sources.fixtures import AS_OF_US, EVENTS_SQL, POS_SQL, pos_transactions, store_events

#: Stand-in for a day in the compressed log.
PERIOD_US = 180_000_000

# ---------------------------------------------------------------- shared plans


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.number_sessions(store_events(spark, sf))


def plain_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(numbered(spark, sf))


def matched_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.with_conversion(plain_sessions(spark, sf), pos_transactions(spark))


def dwell(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.session_dwell(numbered(spark, sf))


# ---------------------------------------------------------------- SQL blocks

NUMBERED_SQL = """
tagged AS (SELECT *, lag(event_type) OVER (PARTITION BY visitor_id ORDER BY arrival_seq) AS before_type FROM ev),
num AS (SELECT *,
  (sum(CASE WHEN event_type = 'ENTRY' OR before_type IS NULL OR before_type = 'EXIT' THEN 1 ELSE 0 END) OVER o)::BIGINT AS session_no,
  NOT (event_type IN ('ZONE_ENTER', 'ZONE_EXIT', 'ZONE_DWELL') AND coalesce(zone_id, '') = '') AS counted,
  CASE WHEN event_type = 'ZONE_ENTER' THEN nullif(zone_id, '') WHEN event_type = 'BILLING_QUEUE_JOIN' THEN coalesce(nullif(zone_id, ''), 'ZONE_BILLING_QUEUE') END AS visit_zone,
  (sum(CASE WHEN event_type = 'REENTRY' THEN 1 ELSE 0 END) OVER o)::BIGINT AS reentries
  FROM tagged WINDOW o AS (PARTITION BY visitor_id ORDER BY arrival_seq))"""

SESSIONS_SQL = """
folded AS (SELECT visitor_id, session_no, min_by(store_id, arrival_seq) AS store_id, min_by(event_id, arrival_seq) AS opener_event_id, min_by(event_type, arrival_seq) AS opener,
  min_by(confidence, arrival_seq) AS opener_confidence, min_by(ts_us, arrival_seq) AS start_us, min_by(is_staff, arrival_seq) AS is_staff,
  max_by(event_type, arrival_seq) AS closer, max_by(ts_us, arrival_seq) AS last_us, sum(counted::INT)::BIGINT AS n_counted, avg(confidence) FILTER (counted) AS mean_confidence,
  coalesce(max(reentries) FILTER (event_type = 'REENTRY'), 0) AS reentry_count, max(ts_us) FILTER (event_type = 'BILLING_QUEUE_JOIN') AS last_join_us,
  bool_or(event_type = 'BILLING_QUEUE_JOIN') AS joined, bool_or(event_type = 'BILLING_QUEUE_ABANDON') AS abandoned,
  max(queue_depth) FILTER (event_type = 'BILLING_QUEUE_JOIN') AS deepest FROM num GROUP BY ALL),
zones AS (SELECT visitor_id, session_no, visit_zone AS zone_id, min(arrival_seq) AS first_seq FROM num WHERE visit_zone IS NOT NULL GROUP BY ALL),
zone_list AS (SELECT visitor_id, session_no, string_agg(zone_id, '>' ORDER BY first_seq) AS zones, bool_or(regexp_matches(upper(zone_id), '^(ZONE_BILLING|ZONE_CASH|BILLING|ZONE_CHECKOUT)')) AS billing FROM zones GROUP BY ALL),
ses AS (SELECT f.*, CASE WHEN closer = 'EXIT' THEN last_us ELSE lead(start_us) OVER (PARTITION BY visitor_id ORDER BY session_no) END AS end_us,
  sha256(visitor_id || '|' || opener_event_id) AS session_id, z.zones, coalesce(z.billing, false) AS saw_billing FROM folded f LEFT JOIN zone_list z USING (visitor_id, session_no)),
billed AS (SELECT *, coalesce(last_join_us, CASE WHEN saw_billing THEN coalesce(end_us, start_us) END) AS billing_us FROM ses),
dwl AS (SELECT visitor_id, session_no, zone_id, sum(dwell_ms)::BIGINT AS dwell_ms FROM num WHERE event_type IN ('ZONE_EXIT', 'ZONE_DWELL') AND coalesce(zone_id, '') <> '' GROUP BY ALL),
conv AS (SELECT *, NOT is_staff AND billing_us IS NOT NULL AND EXISTS (SELECT 1 FROM pos p WHERE p.store_id = b.store_id AND p.ts_us >= b.billing_us AND p.ts_us <= b.billing_us + 300000000) AS pos_converted FROM billed b),
cust AS (SELECT *, joined OR pos_converted AS buyer FROM conv WHERE NOT is_staff)"""

BASE = f"WITH {EVENTS_SQL}, {POS_SQL}, {NUMBERED_SQL}, {SESSIONS_SQL}"
EV = f"WITH {EVENTS_SQL}"

TRACED_SQL = """
traced AS (SELECT *, lag(camera_id) OVER o AS prev_camera, lag(ts_us) OVER o AS prev_us, lag(confidence) OVER o AS prev_confidence,
  last_value(CASE WHEN event_type = 'EXIT' THEN ts_us END IGNORE NULLS) OVER (PARTITION BY visitor_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_exit_us
  FROM ev WINDOW o AS (PARTITION BY visitor_id ORDER BY arrival_seq)),
hop AS (SELECT *, (ts_us - prev_us)::DOUBLE / 1000000 AS elapsed, coalesce(abs(nullif(try_cast(regexp_extract(camera_id, '([0-9]+)$', 1) AS INT), 0) - nullif(try_cast(regexp_extract(prev_camera, '([0-9]+)$', 1) AS INT), 0)), 1) AS hops FROM traced),
staffed AS (SELECT a.arrival_seq, a.store_id, count(*) AS n, count(*) FILTER (b.is_staff) AS s FROM ev a JOIN ev b ON a.store_id = b.store_id AND b.arrival_seq <= a.arrival_seq AND b.ts_us > a.ts_us - 300000000 GROUP BY ALL)"""

WARNINGS_SQL = """
warn AS (SELECT arrival_seq * 10 AS seq, store_id, visitor_id, 'QUEUE_DEPTH_NEGATIVE' AS code, 'CRITICAL' AS severity, 'reset the queue counter' AS suggested_action FROM ev WHERE queue_depth < 0
  UNION ALL SELECT arrival_seq * 10 + 1, store_id, visitor_id, 'CONFIDENCE_CLIFF', 'WARN', 'look for a split track' FROM traced WHERE prev_confidence - confidence > 0.4::DOUBLE
  UNION ALL SELECT arrival_seq * 10 + 2, store_id, visitor_id, 'IMPOSSIBLE_CAMERA_TRANSITION', 'WARN', 'look for swapped identities' FROM hop WHERE prev_camera <> camera_id AND elapsed > 0 AND hops > greatest(elapsed * 1.5::DOUBLE, 1)
  UNION ALL SELECT arrival_seq * 10 + 3, store_id, visitor_id, 'ENTRY_WITHOUT_DOORWAY', 'WARN', 'review the camera''s zones' FROM ev WHERE event_type = 'ENTRY' AND NOT regexp_matches(upper(camera_id), '^(CAM_ENTRY|CAM_DOOR|CAM_THRESHOLD)')
  UNION ALL SELECT arrival_seq * 10 + 4, store_id, visitor_id, 'REENTRY_TOO_FAST', 'CRITICAL', 'look for a doubled track' FROM traced WHERE event_type = 'REENTRY' AND ts_us - last_exit_us > 0 AND ts_us - last_exit_us < 10000000
  UNION ALL SELECT arrival_seq * 10 + 5, store_id, NULL, 'STAFF_COUNT_EXPLOSION', 'WARN', 'review the staff threshold' FROM staffed WHERE n >= 10 AND s::DOUBLE / n > 0.5::DOUBLE)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- the log, sessions


@query(f"{EV} SELECT * FROM ev")
def store_log(spark, sf):
    return store_events(spark, sf)


@query(f"{EV}, {POS_SQL} SELECT p.*, (SELECT count(*) FROM ev WHERE ev.store_id = p.store_id AND event_type = 'BILLING_QUEUE_JOIN' AND ev.ts_us BETWEEN p.ts_us - 300000000 AND p.ts_us) AS joins FROM pos p WHERE store_id IN (SELECT store_id FROM ev)")
def pos_grid(spark, sf):
    """The transactions of the log's stores, with the queue joins that each could belong to."""
    pos = pos_transactions(spark)
    joins = store_events(spark, sf).filter("event_type = 'BILLING_QUEUE_JOIN'").select("store_id", F.col("ts_us").alias("at"), F.expr("ts_us div 300000000").alias("bin"))
    bins = pos.withColumn("bin", F.explode(F.array(F.expr("ts_us div 300000000"), F.expr("ts_us div 300000000") - 1)))
    near = bins.join(joins, ["store_id", "bin"]).filter("at between ts_us - 300000000 and ts_us").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("joins"))
    stores = store_events(spark, sf).select("store_id").distinct()
    return pos.join(stores, "store_id", "left_semi").join(near, "transaction_id", "left").withColumn("joins", F.coalesce("joins", F.lit(0)))


@query(f"""{BASE} SELECT session_id, visitor_id, session_no, store_id, start_us, end_us, (end_us - start_us) // 1000 AS duration_ms, end_us IS NULL AS is_active, is_staff,
  n_counted + CASE WHEN opener = 'EXIT' THEN 1 ELSE 0 END AS event_count, round_even(coalesce(mean_confidence, opener_confidence), 6) AS avg_confidence, reentry_count, joined AS purchase_candidate,
  coalesce(zones, '') AS zones FROM ses""")
def sessions_core(spark, sf):
    made = plain_sessions(spark, sf).withColumns({"zones": F.array_join("zones_visited", ">"), "avg_confidence": F.bround("avg_confidence", 6)})
    return made.drop("zones_visited", "queue_events", "last_join_us")


@query(f"{BASE} SELECT visitor_id, session_no, zone_id, row_number() OVER (PARTITION BY visitor_id, session_no ORDER BY first_seq) AS position FROM zones")
def session_zones(spark, sf):
    return sessions.session_zones(numbered(spark, sf))


@query(f"{BASE} SELECT * FROM dwl")
def session_dwell(spark, sf):
    return dwell(spark, sf)


@query(f"{BASE} SELECT visitor_id, session_no, zone_id, sum(dwell_ms)::BIGINT AS dwell_ms FROM num WHERE event_type = 'ZONE_EXIT' AND coalesce(zone_id, '') <> '' GROUP BY ALL")
def session_dwell_exit_only(spark, sf):
    return sessions.session_dwell_exit_only(numbered(spark, sf))


@query(f"""{BASE} SELECT visitor_id, session_no, row_number() OVER (PARTITION BY visitor_id, session_no ORDER BY arrival_seq) AS position, event_type, ts_us,
  CASE WHEN event_type = 'BILLING_QUEUE_JOIN' THEN queue_depth END AS queue_depth, CASE WHEN event_type = 'BILLING_QUEUE_ABANDON' THEN coalesce(nullif(wait_ms, 0), nullif(dwell_ms, 0)) END AS wait_ms
  FROM num WHERE event_type LIKE 'BILLING%'""")
def session_queue_events(spark, sf):
    rows = plain_sessions(spark, sf).select("visitor_id", "session_no", F.posexplode("queue_events").alias("p", "q"))
    return rows.select("visitor_id", "session_no", (F.col("p") + 1).alias("position"), "q.event_type", "q.ts_us", "q.queue_depth", "q.wait_ms")


@query(f"{BASE} SELECT session_id, store_id, billing_us FROM billed WHERE billing_us IS NOT NULL")
def last_billing_presence(spark, sf):
    return correlation.last_billing_presence(plain_sessions(spark, sf)).filter("billing_us is not null").select("session_id", "store_id", "billing_us")


@query(f"{BASE} SELECT session_id FROM conv WHERE pos_converted")
def pos_correlation(spark, sf):
    return correlation.correlate(plain_sessions(spark, sf), pos_transactions(spark))


# ---------------------------------------------------------------- projections

QUEUES = """q AS (SELECT store_id, count(*) FILTER (joined) AS join_sessions, count(*) FILTER (abandoned) AS abandon_sessions, greatest(0, coalesce(max(deepest), 0))::BIGINT AS max_queue_depth,
  count(*) AS total_sessions, count(*) FILTER (end_us IS NULL) AS active_sessions, CASE WHEN count(*) FILTER (joined) > 0 THEN round_even(count(*) FILTER (abandoned)::DOUBLE / count(*) FILTER (joined), 4) ELSE 0 END AS abandonment_rate FROM cust GROUP BY store_id)"""
VISITORS = "vis AS (SELECT store_id, visitor_id, bool_or(buyer) AS buyer, bool_or(zones IS NOT NULL) AS zoned, bool_or(pos_converted) AS paid FROM cust GROUP BY ALL)"


@query(f"""{BASE}, {QUEUES}, {VISITORS}, v AS (SELECT store_id, count(*) AS unique_visitors, count(*) FILTER (buyer) AS converted_count FROM vis GROUP BY ALL)
SELECT *, round_even(converted_count::DOUBLE / unique_visitors, 4) AS conversion_rate FROM v JOIN q USING (store_id)""")
def metrics_by_store(spark, sf):
    events = store_events(spark, sf)
    return projections.metrics(matched_sessions(spark, sf), projections.known_stores(events, pos_transactions(spark)))


@query(f"{BASE}, {QUEUES} SELECT * FROM q")
def queue_stats(spark, sf):
    return projections.queue_stats(matched_sessions(spark, sf))


@query(f"{BASE} SELECT c.store_id, zone_id, round_even(sum(d.dwell_ms)::DOUBLE / count(*), 0)::BIGINT AS avg_dwell_ms FROM cust c JOIN dwl d USING (visitor_id, session_no) GROUP BY ALL")
def avg_dwell_per_zone(spark, sf):
    return projections.avg_dwell_per_zone(matched_sessions(spark, sf), dwell(spark, sf))


def _funnel_sql(last: str) -> str:
    return f"""{BASE}, {VISITORS}, c AS (SELECT store_id, count(*) AS n0, count(*) FILTER (zoned) AS n1, count(*) FILTER (buyer) AS n2, count(*) FILTER ({last}) AS n3 FROM vis GROUP BY ALL),
st AS (SELECT store_id, 0 AS stage_no, 'ENTRY' AS stage, n0 AS visitors, n0 AS prev, n0 AS top FROM c UNION ALL SELECT store_id, 1, 'ZONE_VISIT', n1, n0, n0 FROM c
  UNION ALL SELECT store_id, 2, 'BILLING_QUEUE', n2, n1, n0 FROM c UNION ALL SELECT store_id, 3, 'PURCHASE', n3, n2, n0 FROM c)
SELECT store_id, stage_no, stage, visitors, CASE WHEN stage_no = 0 THEN 100.0::DOUBLE WHEN top > 0 THEN round_even(100 * visitors::DOUBLE / top, 1) ELSE 0 END AS pct_of_top,
  CASE WHEN stage_no > 0 AND prev > 0 THEN round_even(100 * (prev - visitors)::DOUBLE / prev, 1) ELSE 0 END AS drop_off_pct FROM st"""


@query(_funnel_sql("buyer"))
def funnel_by_store(spark, sf):
    return projections.funnel(matched_sessions(spark, sf))


@query(_funnel_sql("paid"))
def funnel_pos_only(spark, sf):
    return projections.funnel(matched_sessions(spark, sf), pos_only=True)


@query(f"""{BASE}, v AS (SELECT store_id, z.zone_id, count(*) AS visits FROM cust c JOIN zones z USING (visitor_id, session_no) GROUP BY ALL),
d AS (SELECT store_id, zone_id, sum(dwell_ms)::BIGINT AS total_dwell_ms, count(*) AS n FROM cust JOIN dwl USING (visitor_id, session_no) GROUP BY ALL),
b AS (SELECT coalesce(v.store_id, d.store_id) AS store_id, coalesce(v.zone_id, d.zone_id) AS zone_id, coalesce(visits, 0) AS visits, coalesce(total_dwell_ms, 0) AS total_dwell_ms,
  round_even(coalesce(total_dwell_ms, 0)::DOUBLE / coalesce(n, 1), 0)::BIGINT AS avg_dwell_ms FROM v FULL JOIN d ON v.store_id = d.store_id AND v.zone_id = d.zone_id),
f AS (SELECT *, CASE WHEN max(visits) OVER w > 0 THEN round_even(100 * visits::DOUBLE / max(visits) OVER w, 0)::BIGINT ELSE 0 END AS frequency_score,
  CASE WHEN max(avg_dwell_ms) OVER w > 0 THEN round_even(100 * avg_dwell_ms::DOUBLE / max(avg_dwell_ms) OVER w, 0)::BIGINT ELSE 0 END AS dwell_score FROM b WINDOW w AS (PARTITION BY store_id)),
g AS (SELECT *, round_even((frequency_score + dwell_score)::DOUBLE / 2, 0)::BIGINT AS combined_score FROM f), e AS (SELECT store_id, count(*) >= 20 AS data_confidence FROM cust GROUP BY ALL)
SELECT g.*, data_confidence, row_number() OVER (PARTITION BY store_id ORDER BY combined_score DESC, zone_id) AS rank FROM g JOIN e USING (store_id)""")
def heatmap_by_store(spark, sf):
    return projections.heatmap(matched_sessions(spark, sf), dwell(spark, sf))


SPIKES = """spike AS (SELECT store_id, greatest(0, coalesce(max(deepest), 0))::BIGINT AS max_queue_depth FROM ses GROUP BY ALL HAVING max(deepest) >= 5)"""
DEAD = f"""dead AS (SELECT store_id, z.zone_id, max(coalesce(end_us, start_us)) AS last_seen_us FROM ses JOIN zones z USING (visitor_id, session_no) GROUP BY ALL HAVING {AS_OF_US} - max(coalesce(end_us, start_us)) > 1800000000)"""
DROPS = f"""pv AS (SELECT store_id, start_us // {PERIOD_US} AS period, visitor_id, bool_or(buyer) AS buyer FROM cust GROUP BY ALL),
pr AS (SELECT store_id, period, round_even(count(*) FILTER (buyer)::DOUBLE / count(*), 4) AS conversion_rate FROM pv GROUP BY ALL),
ph AS (SELECT *, avg(conversion_rate) OVER (PARTITION BY store_id ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h FROM pr), drops AS (SELECT * FROM ph WHERE h > 0 AND conversion_rate < h * 0.7::DOUBLE)"""


@query(f"""{BASE}, {SPIKES} SELECT store_id, 'BILLING_QUEUE_SPIKE' AS type, CASE WHEN max_queue_depth >= 8 THEN 'CRITICAL' ELSE 'WARN' END AS severity, max_queue_depth,
  'Billing queue depth reached ' || max_queue_depth || ' — customers may abandon' AS message FROM spike""")
def anomaly_queue_spike(spark, sf):
    return projections.queue_spikes(plain_sessions(spark, sf))


@query(f"""{BASE}, {DEAD} SELECT store_id, 'DEAD_ZONE' AS type, 'INFO' AS severity, zone_id, last_seen_us, round_even(({AS_OF_US} - last_seen_us)::DOUBLE / 1000000 / 60, 1) AS minutes_idle,
  'Zone ' || zone_id || ' has had no visits in >30 min' AS message FROM dead""")
def anomaly_dead_zone(spark, sf):
    return projections.dead_zones(plain_sessions(spark, sf), AS_OF_US)


@query(f"""{BASE}, {DROPS} SELECT store_id, 'CONVERSION_DROP' AS type, 'WARN' AS severity, period, conversion_rate, round_even(h, 6) AS historical_avg, round_even(100 * (h - conversion_rate) / h, 1) AS drop_pct FROM drops""")
def anomaly_conversion_drop(spark, sf):
    return projections.conversion_drops(matched_sessions(spark, sf), PERIOD_US)


@query(f"""{BASE}, {SPIKES}, {DEAD}, {DROPS}, {TRACED_SQL}, {WARNINGS_SQL} SELECT store_id, code AS type, severity, 0 AS section, coalesce(visitor_id, '') AS subject FROM warn
  UNION ALL SELECT store_id, 'BILLING_QUEUE_SPIKE', CASE WHEN max_queue_depth >= 8 THEN 'CRITICAL' ELSE 'WARN' END, 1, max_queue_depth::VARCHAR FROM spike
  UNION ALL SELECT store_id, 'CONVERSION_DROP', 'WARN', 2, period::VARCHAR FROM drops UNION ALL SELECT store_id, 'DEAD_ZONE', 'INFO', 3, zone_id FROM dead""")
def anomalies_all(spark, sf):
    return projections.anomalies(matched_sessions(spark, sf), verifier.warnings(store_events(spark, sf)), AS_OF_US, PERIOD_US)


HEALTH = f"""h AS (SELECT coalesce(e.store_id, s.store_id) AS store_id, last_event_us, coalesce(event_count, 0) AS event_count, coalesce(active_sessions, 0) AS active_sessions,
  round_even(({AS_OF_US} - last_event_us)::DOUBLE / 1000000, 1) AS lag_seconds, coalesce({AS_OF_US} - last_event_us > 600000000, true) AS stale_feed
  FROM (SELECT store_id, max_by(ts_us, arrival_seq) AS last_event_us, count(*) AS event_count FROM ev GROUP BY ALL) e FULL JOIN
  (SELECT store_id, count(*) FILTER (end_us IS NULL) AS active_sessions FROM ses GROUP BY ALL) s ON e.store_id = s.store_id)"""


@query(f"{BASE}, {HEALTH} SELECT *, CASE WHEN stale_feed THEN 'STALE_FEED' ELSE 'OK' END AS status FROM h")
def health_by_store(spark, sf):
    return projections.health(store_events(spark, sf), plain_sessions(spark, sf), AS_OF_US)


@query(f"{BASE}, {HEALTH} SELECT CASE WHEN coalesce(bool_or(stale_feed), false) THEN 'DEGRADED' ELSE 'OK' END AS status, count(*) AS stores FROM h")
def health_status(spark, sf):
    return projections.system_status(health_by_store(spark, sf))


# ---------------------------------------------------------------- verifier


@query(f"{EV} SELECT arrival_seq, store_id, visitor_id, camera_id, queue_depth FROM ev WHERE queue_depth < 0")
def verify_queue_depth_negative(spark, sf):
    return verifier.negative_queues(store_events(spark, sf))


@query(f"""{EV}, {TRACED_SQL} SELECT arrival_seq, store_id, visitor_id, prev_confidence, confidence, round_even(prev_confidence - confidence, 3) AS "drop" FROM traced WHERE prev_confidence - confidence > 0.4::DOUBLE""")
def verify_confidence_cliff(spark, sf):
    return verifier.confidence_cliffs(verifier.with_previous(store_events(spark, sf)))


@query(f"""{EV}, {TRACED_SQL} SELECT arrival_seq, store_id, visitor_id, prev_camera, camera_id, hops, round_even(elapsed, 2) AS elapsed_sec FROM hop
  WHERE prev_camera <> camera_id AND elapsed > 0 AND hops > greatest(elapsed * 1.5::DOUBLE, 1)""")
def verify_camera_transition(spark, sf):
    return verifier.camera_jumps(verifier.with_previous(store_events(spark, sf)))


@query(f"{EV} SELECT arrival_seq, store_id, visitor_id, camera_id FROM ev WHERE event_type = 'ENTRY' AND NOT regexp_matches(upper(camera_id), '^(CAM_ENTRY|CAM_DOOR|CAM_THRESHOLD)')")
def verify_entry_camera(spark, sf):
    return verifier.entries_off_door(store_events(spark, sf))


@query(f"""{EV}, {TRACED_SQL} SELECT arrival_seq, store_id, visitor_id, round_even((ts_us - last_exit_us)::DOUBLE / 1000000, 2) AS gap_sec FROM traced
  WHERE event_type = 'REENTRY' AND ts_us - last_exit_us > 0 AND ts_us - last_exit_us < 10000000""")
def verify_reentry_speed(spark, sf):
    return verifier.fast_reentries(verifier.with_previous(store_events(spark, sf)))


@query(f"{EV}, {TRACED_SQL} SELECT arrival_seq, store_id, n, round_even(s::DOUBLE / n, 3) AS staff_fraction FROM staffed WHERE n >= 10 AND s::DOUBLE / n > 0.5::DOUBLE")
def verify_staff_explosion(spark, sf):
    return verifier.staff_explosions(store_events(spark, sf))


@query(f"{BASE}, dup AS (SELECT * FROM ses UNION ALL SELECT * FROM ses WHERE is_staff) SELECT store_id, visitor_id, count(*) AS active_sessions FROM dup WHERE end_us IS NULL GROUP BY ALL HAVING count(*) > 1")
def verify_duplicate_active(spark, sf):
    """The sessionizer never leaves two open sessions, so staff sessions are doubled here to show the check."""
    made = plain_sessions(spark, sf)
    return verifier.duplicate_active(made.unionByName(made.filter("is_staff")))


@query(f"{EV}, {TRACED_SQL}, {WARNINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY seq DESC) AS k FROM warn) SELECT seq, store_id, visitor_id, code, severity, suggested_action FROM r WHERE k <= 100")
def warnings_newest_by_store(spark, sf):
    return verifier.newest_by_store(verifier.warnings(store_events(spark, sf)))


@query(f"{EV}, {TRACED_SQL}, {WARNINGS_SQL} SELECT * FROM warn ORDER BY seq DESC LIMIT 1000")
def warnings_newest(spark, sf):
    return verifier.newest(verifier.warnings(store_events(spark, sf)))


# ---------------------------------------------------------------- audit trail

AUDIT_SQL = """
exits AS (SELECT arrival_seq, last_exit_us FROM traced), opened AS (SELECT visitor_id, session_no, min_by(ts_us, arrival_seq) AS opened_us FROM num GROUP BY ALL),
a AS (SELECT *, coalesce(nullif(wait_ms, 0), nullif(dwell_ms, 0)) AS wait, format('{:.1f}', round_even(dwell_ms::DOUBLE / 1000, 1)) AS dwelt FROM num JOIN exits USING (arrival_seq) JOIN opened USING (visitor_id, session_no)),
rec AS (
  SELECT visitor_id, store_id, arrival_seq, 0 AS sub_seq, 'DETECTION' AS category, event_type, confidence, 'IngestionPipeline' AS source, event_type || ' detected on ' || camera_id || ' with confidence ' || format('{:.2f}', round_even(confidence, 2)) AS reason FROM a WHERE event_type = 'ENTRY'
  UNION ALL SELECT visitor_id, store_id, arrival_seq, 1, 'SESSION', event_type, confidence, 'Sessionizer', 'Session opened for ' || visitor_id || ' at ' || store_id || CASE WHEN is_staff THEN ' [STAFF]' ELSE '' END FROM a WHERE event_type = 'ENTRY'
  UNION ALL SELECT visitor_id, store_id, arrival_seq, 0, 'EXIT', event_type, confidence, 'Sessionizer', 'Session closed for ' || visitor_id || '. Duration: ' || format('{:.1f}', round_even(((ts_us - opened_us) // 1000)::DOUBLE / 1000, 1)) || 's' FROM a WHERE event_type = 'EXIT'
  UNION ALL SELECT visitor_id, store_id, arrival_seq, 0, 'REENTRY', event_type, confidence, 'Sessionizer', concat_ws('; ', 'reentry #' || reentries || ' for ' || visitor_id, 'appearance similarity ' || format('{:.2f}', round_even(reid_score, 2)), 'camera=' || camera_id,
    CASE WHEN last_exit_us IS NOT NULL THEN 'time gap ' || format('{:.1f}', round_even((ts_us - last_exit_us)::DOUBLE / 1000000, 1)) || ' sec' END) FROM a WHERE event_type = 'REENTRY'
  UNION ALL SELECT visitor_id, store_id, arrival_seq, 0, 'ZONE', event_type, confidence, 'Sessionizer', CASE event_type WHEN 'ZONE_ENTER' THEN 'Entered zone ' || zone_id WHEN 'ZONE_EXIT' THEN 'Left zone ' || zone_id || ' after ' || dwelt || 's'
    ELSE 'Dwelled in zone ' || zone_id || ' for ' || dwelt || 's (periodic checkpoint)' END FROM a WHERE event_type LIKE 'ZONE%' AND coalesce(zone_id, '') <> ''
  UNION ALL SELECT visitor_id, store_id, arrival_seq, 0, 'QUEUE', event_type, confidence, 'Sessionizer', CASE WHEN event_type = 'BILLING_QUEUE_JOIN' THEN 'Joined billing queue (depth=' || coalesce(queue_depth::VARCHAR, 'None') || '). Marked as purchase_candidate.'
    ELSE 'Abandoned billing queue after waiting ' || coalesce(format('{:.1f}', round_even(wait::DOUBLE / 1000, 1)) || 's', 'unknown') END FROM a WHERE event_type LIKE 'BILLING%'
  UNION ALL SELECT visitor_id, store_id, seq // 10, 10 + seq % 10, 'TRACKING', code, 0, 'VerifierEngine', suggested_action FROM warn WHERE visitor_id IS NOT NULL)"""


@query(f"{BASE}, {TRACED_SQL}, {WARNINGS_SQL}, {AUDIT_SQL} SELECT * FROM rec")
def audit_timeline(spark, sf):
    return audit.audit_timeline(store_events(spark, sf))


@query(f"{BASE}, {TRACED_SQL}, {WARNINGS_SQL}, {AUDIT_SQL}, c AS (SELECT visitor_id, count(*) AS records, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM rec GROUP BY ALL) SELECT DISTINCT ses.store_id, ses.visitor_id, records, categories FROM ses JOIN c USING (visitor_id)")
def audit_summary(spark, sf):
    return audit.audit_summary(audit.audit_timeline(store_events(spark, sf)), plain_sessions(spark, sf))


# ---------------------------------------------------------------- calibration

SNAP_SQL = """
obs AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY arrival_seq) AS nth, count(*) OVER (PARTITION BY store_id) AS total FROM ev WHERE event_type IN ('ENTRY', 'EXIT')),
snap AS (SELECT store_id, arrival_seq AS snapshot_seq, nth // 200 AS calibrations FROM obs WHERE nth = total - total % 200 AND nth > 0)"""


def _rule_sql(name: str, keys: str, x: str, rule: tuple) -> str:
    _, _, _, kept, least, quantile, _ = rule
    return f"""{name}_s AS (SELECT {keys}, arrival_seq AS seq, ({x})::DOUBLE AS x FROM ev JOIN snap USING (store_id) WHERE arrival_seq <= snapshot_seq),
{name}_l AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS age FROM {name}_s WHERE x IS NOT NULL),
{name}_k AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS observations, row_number() OVER (PARTITION BY {keys} ORDER BY x, seq) AS k FROM {name}_l WHERE age <= {kept}),
{name} AS (SELECT {keys}, observations, CASE WHEN observations >= {least} THEN x END AS value FROM {name}_k WHERE k = greatest(1, floor({quantile}::DOUBLE * observations)))"""


def _setting_sql(value: str, rule: tuple) -> str:
    default, low, high, *_, digits = rule
    return f"round_even(CASE WHEN {value} IS NULL THEN {default}::DOUBLE ELSE greatest({low}::DOUBLE, least({high}::DOUBLE, {value})) END, {digits})"


_C = calibration
_TRUSTED = "CASE WHEN event_type IN ('ENTRY', 'EXIT') THEN confidence END"


@query(f"{EV}, {SNAP_SQL}, {_rule_sql('cam', 'store_id, camera_id', _TRUSTED, _C.TRUST)} SELECT store_id, camera_id, {_setting_sql('value', _C.TRUST)} AS camera_trust, 20.0::DOUBLE AS occlusion_timeout_sec, observations FROM cam")
def calibration_camera_trust(spark, sf):
    return calibration.camera_trust(store_events(spark, sf))


_X = {
    "reid": ("CASE WHEN event_type = 'REENTRY' THEN reid_score END", _C.REID),
    "que": ("CASE WHEN event_type = 'BILLING_QUEUE_JOIN' AND dwell_ms > 0 THEN dwell_ms::DOUBLE / 1000 WHEN event_type = 'BILLING_QUEUE_ABANDON' THEN coalesce(nullif(wait_ms, 0), nullif(dwell_ms, 0))::DOUBLE / 1000 END", _C.QUEUE),
    "dw": ("CASE WHEN event_type LIKE 'ZONE%' AND coalesce(zone_id, '') <> '' AND dwell_ms > 0 THEN dwell_ms END", _C.DWELL),
}
THRESHOLDS_SQL = f"""{EV}, {SNAP_SQL}, {", ".join(_rule_sql(n, "store_id", x, r) for n, (x, r) in _X.items())},
th AS (SELECT s.store_id, coalesce(snap.calibrations, 0) AS calibrations, 0.55::DOUBLE AS staff_confidence_threshold, {_setting_sql("reid.value", _C.REID)} AS reid_confidence_threshold,
  {_setting_sql("que.value", _C.QUEUE)} AS queue_join_dwell_sec, {_setting_sql("dw.value", _C.DWELL)} AS dwell_threshold_ms
  FROM (SELECT DISTINCT store_id FROM ev) s LEFT JOIN snap USING (store_id) LEFT JOIN reid USING (store_id) LEFT JOIN que USING (store_id) LEFT JOIN dw USING (store_id))"""


@query(f"{THRESHOLDS_SQL} SELECT * FROM th")
def calibration_store_thresholds(spark, sf):
    return calibration.store_thresholds(store_events(spark, sf))


@query(f"""{THRESHOLDS_SQL} SELECT store_id, 'reid_confidence_threshold' AS parameter, 0.65::DOUBLE AS "before", reid_confidence_threshold AS "after" FROM th WHERE reid_confidence_threshold <> 0.65::DOUBLE
  UNION ALL SELECT store_id, 'queue_join_dwell_sec', 5, queue_join_dwell_sec FROM th WHERE queue_join_dwell_sec <> 5 UNION ALL SELECT store_id, 'dwell_threshold_ms', 30000, dwell_threshold_ms FROM th WHERE dwell_threshold_ms <> 30000""")
def calibration_changes(spark, sf):
    return calibration.changes(calibration.store_thresholds(store_events(spark, sf)))
