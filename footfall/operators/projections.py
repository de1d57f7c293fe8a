"""Store projections: metrics, funnel, heatmap, anomalies and feed health, each over all stores in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import half_even, ratio
from ..schema import CONVERSION_DROP_RATIO, DEAD_ZONE_US, MIN_CONFIDENT_SESSIONS, MINUTE, QUEUE_ABANDON, QUEUE_JOIN, QUEUE_SPIKE_CRITICAL, QUEUE_SPIKE_WARN, SECOND, STALE_FEED_US
# Messages that clients of the service read.
QUEUE_TEXT = "Billing queue depth reached %d — customers may abandon"
ZONE_TEXT = f"Zone %s has had no visits in >{DEAD_ZONE_US // MINUTE} min"


def known_stores(*tables: DataFrame) -> DataFrame:
    """Store ids that any of the tables has."""
    out = tables[0].select("store_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("store_id"))
    return out.filter("store_id is not null").distinct()


def _with_stores(made: DataFrame, stores: DataFrame | None, zeros: dict[str, Column]) -> DataFrame:
    """``made`` for every known store, with zeros for those without rows."""
    if stores is None:
        return made
    out = stores.join(made, "store_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), z) for c, z in zeros.items()})


def _queue_of(kind: str) -> Column:
    return F.exists("queue_events", lambda q: q["event_type"] == kind)


def queue_depth(sessions: DataFrame) -> Column:
    depths = F.transform("queue_events", lambda q: F.coalesce(q["queue_depth"], F.lit(0)))
    return F.greatest(F.lit(0), F.coalesce(F.array_max(depths), F.lit(0))).cast("long")


def conversions(sessions: DataFrame) -> DataFrame:
    """Non-staff visitors by store, each with whether any of their sessions converted."""
    return sessions.filter("not is_staff").groupBy("store_id", "visitor_id").agg(F.bool_or("purchase_candidate").alias("converted"))


def metrics(sessions: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Visitors, conversion, abandonment, queue depth and session counts of each store, in one pass by visitor and then by store."""
    each = _queue_counts(sessions.filter("not is_staff").groupBy("store_id", "visitor_id"), sessions, F.bool_or("purchase_candidate").alias("converted"))
    sums = [F.sum(c).alias(c) for c in ("join_sessions", "abandon_sessions", "total_sessions", "active_sessions")]
    out = each.groupBy("store_id").agg(F.count(F.lit(1)).alias("unique_visitors"), F.count_if("converted").alias("converted_count"), F.max("max_queue_depth").alias("max_queue_depth"), *sums)
    out = out.withColumns({"abandonment_rate": ratio(F.col("abandon_sessions"), F.col("join_sessions")), "conversion_rate": ratio(F.col("converted_count"), F.col("unique_visitors"))})
    zeros = {c: F.lit(0).cast("long") for c in ("unique_visitors", "converted_count", "join_sessions", "abandon_sessions", "max_queue_depth", "total_sessions", "active_sessions")}
    return _with_stores(out, stores, zeros | {"abandonment_rate": F.lit(0.0), "conversion_rate": F.lit(0.0)})


def _queue_counts(groups: GroupedData, sessions: DataFrame, *more: Column) -> DataFrame:
    return groups.agg(
        F.count_if(_queue_of(QUEUE_JOIN)).alias("join_sessions"),
        F.count_if(_queue_of(QUEUE_ABANDON)).alias("abandon_sessions"),
        F.max(queue_depth(sessions)).alias("max_queue_depth"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if("is_active").alias("active_sessions"),
        *more,
    )


def queue_stats(sessions: DataFrame) -> DataFrame:
    out = _queue_counts(sessions.filter("not is_staff").groupBy("store_id"), sessions)
    return out.withColumn("abandonment_rate", ratio(F.col("abandon_sessions"), F.col("join_sessions")))


def avg_dwell_per_zone(sessions: DataFrame, dwell: DataFrame) -> DataFrame:
    """(store_id, zone_id, avg_dwell_ms) over the non-staff sessions that have the zone."""
    named = _dwell_of(sessions, dwell)
    return named.groupBy("store_id", "zone_id").agg(half_even(F.sum("dwell_ms") / F.count(F.lit(1))).cast("long").alias("avg_dwell_ms"))


def _dwell_of(sessions: DataFrame, dwell: DataFrame) -> DataFrame:
    return sessions.filter("not is_staff").select("visitor_id", "session_no", "store_id").join(dwell, ["visitor_id", "session_no"])


FUNNEL = ("ENTRY", "ZONE_VISIT", "BILLING_QUEUE", "PURCHASE")


def funnel(sessions: DataFrame, stores: DataFrame | None = None, pos_only: bool = False) -> DataFrame:
    """Four rows per store: visitors that reached each stage, their share of the top and the drop from the stage before.

    A purchase is any purchase candidate, which makes it equal the billing stage; ``pos_only`` counts the
    matched transactions alone.
    """
    bought = F.col("pos_converted") if pos_only else F.col("purchase_candidate")
    flags = sessions.filter("not is_staff").groupBy("store_id", "visitor_id").agg(
        F.bool_or((F.size("zones_visited") > 0)).alias("zone"), F.bool_or("purchase_candidate").alias("billing"), F.bool_or(bought).alias("purchase")
    )
    counts = flags.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n0"), F.count_if("zone").alias("n1"), F.count_if("billing").alias("n2"), F.count_if("purchase").alias("n3")
    )
    counts = _with_stores(counts, stores, {f"n{k}": F.lit(0).cast("long") for k in range(4)})
    stages = F.array(*[F.struct(F.lit(k).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"n{k}").alias("n"), F.col(f"n{max(0, k - 1)}").alias("prev"), F.col("n0").alias("top")) for k, name in enumerate(FUNNEL)])
    rows = counts.select("store_id", F.explode(stages).alias("s")).select("store_id", "s.*")
    share = F.when(F.col("stage_no") == 0, F.lit(100.0)).when(F.col("top") > 0, half_even(100 * F.col("n") / F.col("top"), 1)).otherwise(F.lit(0.0))
    drop = F.when((F.col("stage_no") > 0) & (F.col("prev") > 0), half_even(100 * (F.col("prev") - F.col("n")) / F.col("prev"), 1)).otherwise(F.lit(0.0))
    return rows.select("store_id", "stage_no", "stage", F.col("n").alias("visitors"), share.alias("pct_of_top"), drop.alias("drop_off_pct"))


def heatmap(sessions: DataFrame, dwell: DataFrame) -> DataFrame:
    """Per store and zone: visits, dwell, both scaled to 100 in the store, their mean, and rank; thin data is marked."""
    guests = sessions.filter("not is_staff")
    visits = guests.select("store_id", F.explode("zones_visited").alias("zone_id")).groupBy("store_id", "zone_id").agg(F.count(F.lit(1)).alias("visits"))
    dwelt = _dwell_of(sessions, dwell).groupBy("store_id", "zone_id").agg(F.sum("dwell_ms").alias("total_dwell_ms"), F.count(F.lit(1)).alias("n"))
    both = visits.join(dwelt, ["store_id", "zone_id"], "full").fillna(0, ["visits", "total_dwell_ms"]).fillna(1, ["n"])
    both = both.withColumn("avg_dwell_ms", half_even(F.col("total_dwell_ms") / F.col("n")).cast("long"))
    store = Window.partitionBy("store_id")
    scaled = lambda c: F.when(F.max(c).over(store) > 0, half_even(100 * F.col(c) / F.max(c).over(store))).otherwise(F.lit(0.0)).cast("long")
    both = both.withColumns({"frequency_score": scaled("visits"), "dwell_score": scaled("avg_dwell_ms")})
    both = both.withColumn("combined_score", half_even((F.col("frequency_score") + F.col("dwell_score")) / 2).cast("long"))
    enough = guests.groupBy("store_id").agg((F.count(F.lit(1)) >= MIN_CONFIDENT_SESSIONS).alias("data_confidence"))
    rank = F.row_number().over(store.orderBy(F.desc("combined_score"), "zone_id"))
    return both.join(enough, "store_id").select("store_id", "zone_id", "visits", "total_dwell_ms", "avg_dwell_ms", "frequency_score", "dwell_score", "combined_score", "data_confidence", rank.alias("rank"))


def queue_spikes(sessions: DataFrame) -> DataFrame:
    """Stores whose deepest queue ever, staff sessions included, is at the warning depth or over."""
    depth = sessions.groupBy("store_id").agg(F.max(queue_depth(sessions)).alias("max_queue_depth")).filter(F.col("max_queue_depth") >= QUEUE_SPIKE_WARN)
    severity = F.when(F.col("max_queue_depth") >= QUEUE_SPIKE_CRITICAL, "CRITICAL").otherwise("WARN")
    message = F.format_string(QUEUE_TEXT, "max_queue_depth")
    return depth.select("store_id", F.lit("BILLING_QUEUE_SPIKE").alias("type"), severity.alias("severity"), "max_queue_depth", message.alias("message"))


def dead_zones(sessions: DataFrame, as_of_us: int) -> DataFrame:
    """Zones not seen for over 30 minutes, by the ends (or starts) of all sessions that visited them."""
    seen = sessions.select("store_id", F.explode("zones_visited").alias("zone_id"), F.coalesce("end_us", "start_us").alias("at"))
    last = seen.groupBy("store_id", "zone_id").agg(F.max("at").alias("last_seen_us")).filter(as_of_us - F.col("last_seen_us") > DEAD_ZONE_US)
    idle = half_even((as_of_us - F.col("last_seen_us")) / SECOND / 60, 1)
    message = F.format_string(ZONE_TEXT, "zone_id")
    return last.select("store_id", F.lit("DEAD_ZONE").alias("type"), F.lit("INFO").alias("severity"), "zone_id", "last_seen_us", idle.alias("minutes_idle"), message.alias("message"))


def conversion_by_period(sessions: DataFrame, period_us: int) -> DataFrame:
    """Conversion of each store in periods of ``period_us`` by session start."""
    by = sessions.filter("not is_staff").withColumn("period", F.expr(f"start_us div {period_us}"))
    visitors = by.groupBy("store_id", "period", "visitor_id").agg(F.bool_or("purchase_candidate").alias("converted"))
    rates = visitors.groupBy("store_id", "period").agg(F.count_if("converted").alias("c"), F.count(F.lit(1)).alias("n"))
    return rates.select("store_id", "period", ratio(F.col("c"), F.col("n")).alias("conversion_rate"))


def conversion_drops(sessions: DataFrame, period_us: int, history: int = 7) -> DataFrame:
    """Periods whose conversion is under 0.7 of the mean of the (up to) ``history`` periods before."""
    before = Window.partitionBy("store_id").orderBy("period").rowsBetween(-history, -1)
    rates = conversion_by_period(sessions, period_us).withColumn("historical_avg", F.avg("conversion_rate").over(before))
    low = rates.filter((F.col("historical_avg") > 0) & (F.col("conversion_rate") < F.col("historical_avg") * CONVERSION_DROP_RATIO))
    pct = half_even(100 * (F.col("historical_avg") - F.col("conversion_rate")) / F.col("historical_avg"), 1)
    return low.select("store_id", F.lit("CONVERSION_DROP").alias("type"), F.lit("WARN").alias("severity"), "period", "conversion_rate", half_even(F.col("historical_avg"), 6).alias("historical_avg"), pct.alias("drop_pct"))


_FACT = "struct<section:int,zone_id:string,period:bigint,guest:string,bought:boolean,most:bigint>"


def session_anomalies(sessions: DataFrame, as_of_us: int, period_us: int, history: int = 7) -> DataFrame:
    """Queue spikes, conversion drops and dead zones by name: (store_id, type, severity, section, subject), in one pass.

    Each session tells its store's queue, its zones and, if it is a guest's, its period; all three are added up together.
    """
    none = {"zone_id": F.lit(None).cast("string"), "period": F.lit(None).cast("long"), "guest": F.lit(None).cast("string"), "bought": F.lit(None).cast("boolean"), "most": F.lit(None).cast("long")}
    fact = lambda section, **given: F.struct(F.lit(section).alias("section"), *[given.get(n, c).alias(n) for n, c in none.items()])
    visit = fact(2, period=F.expr(f"start_us div {period_us}"), guest=F.col("visitor_id"), bought=F.col("purchase_candidate"))
    facts = F.concat(
        F.array(fact(1, most=queue_depth(sessions))),
        F.when(~F.col("is_staff"), F.array(visit)).otherwise(F.array().cast(f"array<{_FACT}>")),
        F.transform("zones_visited", lambda z: fact(3, zone_id=z, most=F.coalesce("end_us", "start_us"))),
    )
    keys = ("store_id", "section", "zone_id", "period")
    each = sessions.select("store_id", F.explode(facts).alias("f")).select("store_id", "f.*").groupBy(*keys, "guest").agg(F.max("most").alias("most"), F.bool_or("bought").alias("bought"))
    made = each.groupBy(*keys).agg(F.max("most").alias("most"), ratio(F.count_if("bought"), F.count("guest")).alias("rate"))
    before = Window.partitionBy("store_id", "section").orderBy("period").rowsBetween(-history, -1)
    made = made.withColumn("usual", F.avg(F.when(F.col("section") == 2, F.col("rate"))).over(before))
    spike, dead = (F.col("section") == 1) & (F.col("most") >= QUEUE_SPIKE_WARN), (F.col("section") == 3) & (as_of_us - F.col("most") > DEAD_ZONE_US)
    drop = (F.col("section") == 2) & (F.col("usual") > 0) & (F.col("rate") < F.col("usual") * CONVERSION_DROP_RATIO)
    named = lambda kind, severity, subject: F.struct(F.lit(kind).alias("type"), severity.alias("severity"), subject.cast("string").alias("subject"))
    said = F.when(spike, named("BILLING_QUEUE_SPIKE", F.when(F.col("most") >= QUEUE_SPIKE_CRITICAL, "CRITICAL").otherwise("WARN"), F.col("most")))
    said = said.when(drop, named("CONVERSION_DROP", F.lit("WARN"), F.col("period"))).when(dead, named("DEAD_ZONE", F.lit("INFO"), F.col("zone_id")))
    return made.select("store_id", "section", said.alias("a")).filter("a is not null").select("store_id", "a.type", "a.severity", "section", "a.subject")


def anomalies(sessions: DataFrame, warnings: DataFrame, as_of_us: int, period_us: int) -> DataFrame:
    """All anomalies of all stores: verifier warnings, queue spikes, conversion drops and dead zones."""
    checked = warnings.select("store_id", F.col("code").alias("type"), "severity", F.lit(0).alias("section"), F.coalesce("visitor_id", F.lit("")).alias("subject"))
    return checked.unionByName(session_anomalies(sessions, as_of_us, period_us))


def health(events: DataFrame, sessions: DataFrame, as_of_us: int) -> DataFrame:
    """Feed state of each store by its last appended event, which need not be its latest."""
    last = events.groupBy("store_id").agg(F.max_by("ts_us", "arrival_seq").alias("last_event_us"), F.count(F.lit(1)).alias("event_count"))
    active = sessions.groupBy("store_id").agg(F.count_if("is_active").alias("active_sessions"))
    lag = F.col("as_of_us") - F.col("last_event_us")
    both = last.join(active, "store_id", "full").withColumn("as_of_us", F.lit(as_of_us).cast("long"))
    both = both.withColumn("lag_seconds", half_even(lag / SECOND, 1)).withColumn("stale_feed", F.coalesce(lag > STALE_FEED_US, F.lit(True)))
    status = F.when(F.col("stale_feed"), "STALE_FEED").otherwise("OK")
    return both.select("store_id", "last_event_us", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("active_sessions", F.lit(0)).alias("active_sessions"), "lag_seconds", "stale_feed", status.alias("status"))


def system_status(by_store: DataFrame) -> DataFrame:
    return by_store.agg(F.when(F.coalesce(F.bool_or("stale_feed"), F.lit(False)), "DEGRADED").otherwise("OK").alias("status"), F.count(F.lit(1)).alias("stores"))


def as_json(projection: DataFrame, key: str = "store_id") -> DataFrame:
    """One JSON answer per store, rows of a store as an array ordered by their text."""
    rows = projection.withColumn("row", F.to_json(F.struct(*[c for c in projection.columns if c != key])))
    return rows.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ","), F.lit("]")).alias("body"))


