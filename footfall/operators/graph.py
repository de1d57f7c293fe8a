"""The store as a graph: zone and camera transitions, hops, walking plausibility, visitor journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import half_even
from ..functions.lineage import cut

# Probability of a move from the first zone to the second.
LOW, MED, HIGH, VERY_HIGH = 0.10, 0.40, 0.75, 0.90
ZONE_EDGES = {
    "ZONE_ENTRANCE": {"ZONE_EB": VERY_HIGH, "ZONE_TFS": HIGH, "ZONE_FRAGRANCE": HIGH, "ZONE_MINIMALIST": MED, "ZONE_BILLING_QUEUE": LOW, "ZONE_STAFF_AREA": LOW},
    "ZONE_EB": {"ZONE_TFS": VERY_HIGH, "ZONE_FRAGRANCE": HIGH, "ZONE_ENTRANCE": HIGH},
    "ZONE_TFS": {"ZONE_FRAGRANCE": HIGH, "ZONE_NAIL": MED, "ZONE_MINIMALIST": MED},
    "ZONE_FRAGRANCE": {"ZONE_NAIL": HIGH, "ZONE_FOH": MED},
    "ZONE_NAIL": {"ZONE_FOH": HIGH, "ZONE_FACES": MED, "ZONE_MINIMALIST": MED},
    "ZONE_FOH": {"ZONE_MAKEUP": HIGH, "ZONE_FACES": MED, "ZONE_ENTRANCE": MED},
    "ZONE_FACES": {"ZONE_SWISS_PLUS": HIGH, "ZONE_ENTRANCE": MED},
    "ZONE_SWISS_PLUS": {"ZONE_MARS_NYBAE": MED},
    "ZONE_MINIMALIST": {"ZONE_AQUALOGICA": VERY_HIGH},
    "ZONE_AQUALOGICA": {"ZONE_PILGRIM": VERY_HIGH},
    "ZONE_PILGRIM": {"ZONE_DK": VERY_HIGH},
    "ZONE_DK": {"ZONE_MAKEUP": HIGH},
    "ZONE_MAKEUP": {"ZONE_MARS_NYBAE": HIGH, "ZONE_FOH": HIGH},
    "ZONE_MARS_NYBAE": {"ZONE_LOREAL": HIGH},
    "ZONE_LOREAL": {"ZONE_BEAUTY": HIGH},
    "ZONE_BEAUTY": {"ZONE_BILLING_QUEUE": MED},
    "ZONE_BILLING_QUEUE": {"ZONE_CASH_COUNTER": HIGH, "ZONE_ACCESSORIES": MED, "ZONE_ENTRANCE": HIGH, "ZONE_STAFF_AREA": 0.20},
    "ZONE_CASH_COUNTER": {"ZONE_BILLING_QUEUE": MED, "ZONE_ENTRANCE": HIGH},
    "ZONE_STAFF_AREA": {"ZONE_BILLING_QUEUE": 0.60, "ZONE_ENTRANCE": 0.50},
}
# Fixed values by pair of camera roles: probability, expected seconds, tolerance in seconds.
ROLE_PAIRS = {
    ("entry", "floor"): (0.85, 3.0, 4.0),
    ("floor", "entry"): (0.70, 3.0, 4.0),
    ("floor", "floor"): (0.80, 4.0, 5.0),
    ("floor", "billing"): (0.65, 4.0, 5.0),
    ("billing", "floor"): (0.65, 4.0, 5.0),
    ("floor", "godown"): (0.30, 6.0, 8.0),
    ("godown", "floor"): (0.30, 6.0, 8.0),
    ("entry", "billing"): (0.15, 10.0, 12.0),
    ("billing", "entry"): (0.15, 10.0, 12.0),
}
DEFAULT_PAIR = (0.40, 5.0, 6.0)
# Zones on the two sides of a wall.
BARRIERS = (
    (("ZONE_EB", "ZONE_TFS", "ZONE_FRAGRANCE"), ("ZONE_MINIMALIST", "ZONE_AQUALOGICA")),
    (("ZONE_STAFF_AREA",), ("ZONE_FRAGRANCE", "ZONE_NAIL", "ZONE_FACES")),
)
# Events that a shape of each role can give.
ROLE_EVENTS = {
    "zone": ("ZONE_ENTER", "ZONE_EXIT", "ZONE_DWELL"),
    "entry_line": ("ENTRY", "EXIT", "REENTRY"),
    "inside_region": ("ENTRY", "REENTRY"),
    "outside_region": ("EXIT",),
    "billing_counter": ("ZONE_ENTER", "ZONE_EXIT", "ZONE_DWELL"),
    "queue_area": ("BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON", "ZONE_DWELL"),
    "staff_area": (),
}
WALK_SPEED, WALK_SPREAD, LEAST_SECONDS, UNKNOWN_HOPS = 1.4, 0.5, 1.5, 99


def zone_edges(spark: SparkSession) -> DataFrame:
    rows = [(a, b, p) for a, to in ZONE_EDGES.items() for b, p in to.items()]
    return spark.createDataFrame(rows, "zone_from string, zone_to string, p double")


def role_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, e) for r, events in ROLE_EVENTS.items() for e in events], "role string, event_type string")


def zone_probability(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``zone_probability`` to ``moves(zone_from, zone_to)``: known edge, .8 of the reverse edge, .1; 1 for staying, .5 if unknown."""
    there = edges.select("zone_from", "zone_to", F.col("p").alias("there"))
    back = edges.select(F.col("zone_to").alias("zone_from"), F.col("zone_from").alias("zone_to"), (F.col("p") * 0.8).alias("back"))
    out = moves.join(there, ["zone_from", "zone_to"], "left").join(back, ["zone_from", "zone_to"], "left")
    p = F.when(F.col("zone_from").isNull() | F.col("zone_to").isNull(), 0.5).when(F.col("zone_from") == F.col("zone_to"), 1.0).otherwise(F.coalesce("there", "back", F.lit(LOW)))
    return out.withColumn("zone_probability", p).drop("there", "back")


def camera_edges(spark: SparkSession, adjacency: DataFrame, roles: DataFrame) -> DataFrame:
    """Both directions of ``adjacency(camera_id, neighbour_id)`` with the priors of ``roles(camera_id, role)`` (else floor)."""
    pairs = adjacency.select(F.col("camera_id").alias("cam_from"), F.col("neighbour_id").alias("cam_to"))
    pairs = pairs.unionByName(pairs.select(F.col("cam_to").alias("cam_from"), F.col("cam_from").alias("cam_to"))).distinct()
    named = pairs.join(roles.select(F.col("camera_id").alias("cam_from"), F.col("role").alias("a")), "cam_from", "left").join(roles.select(F.col("camera_id").alias("cam_to"), F.col("role").alias("b")), "cam_to", "left")
    named = named.fillna("floor", ["a", "b"])
    priors = spark.createDataFrame([(*k, *v) for k, v in ROLE_PAIRS.items()], "a string, b string, base double, expected double, tolerance double")
    out = named.join(priors, ["a", "b"], "left")
    return out.select("cam_from", "cam_to", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("base", "expected", "tolerance"), DEFAULT_PAIR)])


def camera_probability(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``camera_probability`` to ``moves(cam_from, cam_to, elapsed_sec)``: the prior times how well the time fits."""
    out = moves.join(edges, ["cam_from", "cam_to"], "left")
    off = F.abs(F.col("elapsed_sec") - F.col("expected"))
    fit = F.when(off <= F.col("tolerance"), F.exp(-(off * off) / (2 * F.col("tolerance") * F.col("tolerance")))).otherwise(F.lit(0.05))
    same = F.when(F.col("elapsed_sec") < 5, 0.90).otherwise(F.greatest(F.lit(0.40), 1 - F.col("elapsed_sec") / 30))
    p = F.when(F.col("cam_from").isNull() | F.col("cam_to").isNull(), F.lit(0.5)).when(F.col("cam_from") == F.col("cam_to"), same).when(F.col("base").isNull(), F.lit(0.10)).otherwise(half_even(F.col("base") * fit, 4))
    return out.withColumn("camera_probability", p).drop("base", "expected", "tolerance")


def unknown_cameras(adjacency: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera_id): ids that ``adjacency`` names and ``cameras(camera_id)`` does not hold."""
    named = adjacency.select("camera_id").unionByName(adjacency.select(F.col("neighbour_id").alias("camera_id"))).filter("camera_id is not null").distinct()
    return named.join(cameras.select("camera_id"), "camera_id", "left_anti")


def adjacency_of(neighbours: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera_id, neighbour_id) of ``neighbours(camera_id, neighbours)``, an adjacency map as a site gives it.

    A map that names a camera the site does not have raises ValueError.
    """
    links = neighbours.select("camera_id", F.explode("neighbours").alias("neighbour_id")).distinct()
    asked = links.unionByName(neighbours.select("camera_id", F.col("camera_id").alias("neighbour_id")))
    unknown = [r.camera_id for r in unknown_cameras(asked, cameras).orderBy("camera_id").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown cameras: {', '.join(unknown)}")
    return links


def hops(spark: SparkSession, adjacency: DataFrame) -> DataFrame:
    """(cam_from, cam_to, hops): fewest links between all cameras that are joined, at any distance; others are 99 apart.

    Links count both ways and each camera is 0 from itself. Breadth first from every camera at once: a round follows the links of
    the pairs found last and keeps the pairs not found before, until there are none.
    """
    links = adjacency.select("camera_id", "neighbour_id").unionByName(adjacency.select(F.col("neighbour_id").alias("camera_id"), F.col("camera_id").alias("neighbour_id")))
    links = cut(links.filter("camera_id is not null and neighbour_id is not null").distinct())
    last, edge = None, cut(links.select(F.col("camera_id").alias("cam_from"), F.col("camera_id").alias("cam_to")).distinct().withColumn("hops", F.lit(0)))
    found = edge
    while not edge.isEmpty():
        onward = edge.join(links, edge.cam_to == links.camera_id).select("cam_from", F.col("neighbour_id").alias("cam_to"), (F.col("hops") + 1).alias("hops")).distinct()
        # links run both ways, so what was found before is found in the last two rounds or not reached from here
        near = edge if last is None else edge.unionByName(last)
        last, edge = edge, cut(onward.join(near, ["cam_from", "cam_to"], "left_anti"))
        found = found.unionByName(edge)
    return found


def _barred(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for left, right in BARRIERS:
        out = out | (a.isin(*left) & b.isin(*right)) | (b.isin(*left) & a.isin(*right))
    return F.coalesce(out, F.lit(False))


def physics(moves: DataFrame) -> DataFrame:
    """Adds speed_score, barred and possible to ``moves(zone_from, zone_to, distance_m, elapsed_sec, zone_probability)``."""
    speed = F.col("distance_m") / F.nullif(F.col("elapsed_sec"), F.lit(0.0))
    over = speed - WALK_SPEED
    score = F.when(F.col("elapsed_sec") <= 0, F.when(F.col("distance_m") > 0, 0.0).otherwise(1.0)).when(over <= 0, 1.0).otherwise(F.greatest(F.lit(0.01), F.exp(-(over * over) / (2 * WALK_SPREAD * WALK_SPREAD))))
    still = F.col("zone_from").isNull() | F.col("zone_to").isNull() | F.col("zone_from").eqNullSafe(F.col("zone_to"))
    possible = still | ((F.col("zone_probability") >= 0.05) & (F.col("elapsed_sec") >= LEAST_SECONDS))
    return moves.withColumns({"speed_score": half_even(score, 6), "barred": ~still & _barred(F.col("zone_from"), F.col("zone_to")), "possible": possible})


def memory_edges(events: DataFrame) -> DataFrame:
    """The log as typed edges of a visitor: to the store, the camera and the zone, in that order for one event."""
    kind, zone = F.col("event_type"), F.nullif(F.col("zone_id"), F.lit(""))
    edge = lambda when, kind_, target, rel: F.when(when, F.struct(F.lit(kind_).alias("target_type"), target.alias("target_id"), rel.alias("relation")))
    word = F.when(kind == "ZONE_ENTER", "ENTERED").when(kind == "ZONE_EXIT", "EXITED").when(kind == "ZONE_DWELL", "DWELLED").when(kind == "BILLING_QUEUE_JOIN", "QUEUED")
    edges = F.array(
        edge(kind.isin("ENTRY", "REENTRY", "EXIT"), "Store", F.lit("STORE"), F.when(kind == "EXIT", "EXITED").otherwise("ENTERED")),
        edge(F.coalesce("camera_id", F.lit("")) != "", "Camera", F.col("camera_id"), F.lit("SEEN_ON")),
        edge(zone.isNotNull() & word.isNotNull(), "Zone", zone, word),
    )
    rows = events.select("visitor_id", "arrival_seq", "ts_us", F.posexplode(F.filter(edges, lambda e: e.isNotNull())).alias("place", "e"))
    return rows.select("visitor_id", "ts_us", "arrival_seq", "place", "e.*")


def journey(edges: DataFrame) -> DataFrame:
    """Edges numbered by time within each visitor."""
    order = Window.partitionBy("visitor_id").orderBy("ts_us", "arrival_seq", "place")
    return edges.withColumn("step", F.row_number().over(order))


def continuity(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected(visitor_id, camera_id, zone_id)`` with .9 if that is where the visitor was last, else .5."""
    seq = F.struct("ts_us", "arrival_seq", "place")
    last = edges.groupBy("visitor_id").agg(*[F.max_by(F.when(F.col("target_type") == t, F.col("target_id")), F.when(F.col("target_type") == t, seq)).alias(c) for t, c in (("Camera", "last_camera"), ("Zone", "last_zone"))])
    joined = expected.join(last, "visitor_id", "left")
    here = F.col("camera_id").eqNullSafe(F.col("last_camera")) & F.col("zone_id").eqNullSafe(F.col("last_zone"))
    return joined.withColumn("continuity", F.when(here, 0.9).otherwise(0.5)).drop("last_camera", "last_zone")


def next_cameras(edges: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("cam_from").orderBy(F.desc("base"), "cam_to")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("cam_from", "cam_to", "base", "rank")
