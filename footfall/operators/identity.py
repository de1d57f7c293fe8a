"""Re-identification over tables of candidates: signals, weighted vote, courtroom, occlusion, evidence, folds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clamp, cosine, half_even

# The vote's raw weights by signal.
RAW_WEIGHTS = {
    "reid": 0.35, "fingerprint": 0.05, "trajectory": 0.20, "temporal": 0.15, "camera_transition": 0.15, "zone_plausibility": 0.10,
    "detection": 0.05, "track_health": 0.0, "group_continuity": 0.05, "staff_reputation": 0.0, "visitor_dna": 0.05,
}
THRESHOLD, REID_MIN, AMBIGUOUS_GAP = 0.65, 0.40, 0.05
EVIDENCE_ROWS = 50
CROSS_CAMERA_SECONDS = 5.0

_TOTAL = sum(RAW_WEIGHTS.values())
WEIGHTS = {k: v / _TOTAL for k, v in RAW_WEIGHTS.items()}


def candidates(lost: DataFrame, seen: DataFrame, bin_seconds: int = 60) -> DataFrame:
    """Pairs of a lost track and a later sighting of its store that may be one person.

    ``lost(lost_id, store_id, camera_id, lost_us, retain_sec)`` meets ``seen(seen_id, store_id, camera_id,
    ts_us)`` no later than its retention, on another camera no later than 5 s. Times are binned for an equality join.
    """
    span = bin_seconds * 1_000_000
    a = lost.withColumn("bin", F.explode(F.expr(f"sequence(lost_us div {span}, (lost_us + cast(retain_sec * 1000000 AS bigint)) div {span})")))
    b = seen.select("seen_id", F.col("store_id").alias("s"), F.col("camera_id").alias("seen_camera"), "ts_us", F.expr(f"ts_us div {span}").alias("b"))
    age = (F.col("ts_us") - F.col("lost_us")) / 1_000_000
    pairs = a.join(b, (F.col("store_id") == F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("ts_us") >= F.col("lost_us"))).withColumn("age_sec", age)
    near = (F.col("age_sec") <= F.col("retain_sec")) & ((F.col("camera_id") == F.col("seen_camera")) | (F.col("age_sec") <= CROSS_CAMERA_SECONDS))
    return pairs.filter(near).drop("bin", "b", "s")


def temporal_score(age: Column, retain: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - age / retain)


def vote(signals: DataFrame) -> DataFrame:
    """Adds contributions, identity_score, should_associate, band and dominant to a table with all signal columns."""
    parts = {k: half_even(F.lit(w) * F.col(k), 5) for k, w in WEIGHTS.items()}
    scored = signals.withColumns({f"c_{k}": v for k, v in parts.items()})
    # the parts have five decimals each: adding them as whole numbers keeps ties exact
    units = F.lit(0).cast("long")
    for k in WEIGHTS:
        units = units + F.round(F.col(f"c_{k}") * 100_000).cast("long")
    gate = F.col("reid") < REID_MIN
    scored = scored.withColumn("units", units).withColumn("vote", F.col("units") / 100_000)
    band = F.when(gate, "REJECT").when(F.col("vote") >= 0.85, "HIGH").when(F.col("vote") >= THRESHOLD, "MEDIUM").when(F.col("vote") >= THRESHOLD * 0.8, "LOW").otherwise("REJECT")
    most = F.greatest(*[F.col(f"c_{k}") for k in WEIGHTS])
    dominant = F.lit(None).cast("string")
    for k in reversed(WEIGHTS):
        dominant = F.when(F.col(f"c_{k}") == most, k).otherwise(dominant)
    return scored.withColumns(
        {
            "identity_score": F.when(gate, F.col("reid")).otherwise(half_even(F.col("units") / 10) / 10_000),
            "should_associate": ~gate & (F.col("vote") >= THRESHOLD),
            "band": band,
            "dominant": F.when(gate, F.lit("reid")).otherwise(dominant),
        }
    )


def decide(voted: DataFrame, key: str, candidate: str) -> DataFrame:
    """The best accepted candidate of each ``key``, with the runner-up; a gap under 0.05 makes the band LOW."""
    order = Window.partitionBy(key).orderBy(F.desc("identity_score"), candidate)
    ranked = voted.filter("should_associate").withColumns({"rank": F.row_number().over(order), "second": F.lead(candidate).over(order), "second_score": F.lead("identity_score").over(order)})
    gap = F.col("identity_score") - F.col("second_score")
    best = ranked.filter("rank = 1").withColumn("competing", F.coalesce(gap < AMBIGUOUS_GAP, F.lit(False)))
    return best.withColumns({"gap": half_even(gap, 4), "band": F.when(F.col("competing"), "LOW").otherwise(F.col("band"))}).drop("rank")


def courtroom(cases: DataFrame, physics: str | None = None) -> DataFrame:
    """Adds defender, prosecutor, should_match and final_score to LOW and REJECT cases (others get nulls).

    ``physics`` names the column of the physical plausibility. The established results know no such signal,
    so by default it counts as 0 and each case that is heard ends in a veto.
    """
    reid, finger, temporal = F.col("reid"), F.col("fingerprint"), F.col("temporal")
    physical = F.col(physics) if physics else F.lit(0.0)
    points = lambda *rules: sum((F.when(when, F.lit(p)).otherwise(F.lit(0.0)) for when, p in rules), F.lit(0.0))
    defender = points((reid > 0.8, 0.4), (finger > 0.8, 0.3), (physical > 0.8, 0.2), (F.col("trajectory") > 0.7, 0.2), (F.col("group_continuity") > 0.5, 0.3), (F.col("visitor_dna") > 0.7, 0.2))
    prosecutor = points(((reid > 0) & (reid < 0.4), 0.3), ((finger > 0) & (finger < 0.4), 0.2), (physical < 0.1, 0.8), (temporal < 0.2, 0.2))
    heard = F.col("band").isin("LOW", "REJECT")
    tried = cases.withColumns({"defender": F.when(heard, half_even(defender, 4)), "prosecutor": F.when(heard, half_even(prosecutor, 4))})
    d, p, base = F.col("defender"), F.col("prosecutor"), F.col("identity_score")
    verdict = F.when(p >= 0.70, "veto").when(d < 0.30, "weak").when(d > 1.5 * p, "match").otherwise("inconclusive")
    tried = tried.withColumn("verdict", F.when(heard, verdict))
    final = F.when(F.col("verdict") == "veto", base * 0.5).when(F.col("verdict") == "weak", base * 0.8).when(F.col("verdict") == "match", F.least(F.lit(0.99), base + 0.15)).otherwise(base)
    return tried.withColumns({"should_match": F.when(heard, F.col("verdict") == "match"), "final_score": F.when(heard, half_even(final, 6))})


def occlusion(lost: DataFrame, margin: float = 0.08) -> DataFrame:
    """Why a track went: adds kind, retain_sec and confidence to ``lost(cx, cy, frame_w, frame_h, nearby, zone_id, confirmed_exit)``."""
    side = (F.col("cx") < F.col("frame_w") * margin) | (F.col("cx") > F.col("frame_w") * (1 - margin))
    ends = (F.col("cy") < F.col("frame_h") * margin) | (F.col("cy") > F.col("frame_h") * (1 - margin))
    shelf = F.col("zone_id").isNotNull() & ~F.col("zone_id").isin("ZONE_ENTRANCE", "ZONE_BILLING_QUEUE", "ZONE_CASH_COUNTER", "ZONE_STAFF_AREA")
    pick = lambda *v: F.when(F.col("confirmed_exit"), v[0]).when(side | ends, v[1]).when(F.col("nearby") >= 3, v[2]).when(shelf, v[3]).otherwise(v[4])
    sure = pick(F.lit(0.95), F.when(side, 0.80).otherwise(0.70), F.least(F.lit(0.90), 0.60 + 0.10 * F.col("nearby")), F.lit(0.65), F.lit(0.50))
    return lost.withColumns(
        {
            "kind": pick("TRUE_STORE_EXIT", "CAMERA_BOUNDARY_EXIT", "CROWD_OCCLUSION", "SHELF_OCCLUSION", "UNKNOWN"),
            "retain_sec": pick(60.0, 8.0, 15.0, 20.0, 15.0),
            "confidence": half_even(sure, 6),
        }
    )


def occlusion_decay(kind: Column, age: Column, retain: Column) -> Column:
    """What is left of a lost track's confidence after ``age``."""
    rate = F.when(kind == "SHELF_OCCLUSION", 0.5).when(kind == "CAMERA_BOUNDARY_EXIT", 1.0).when(kind == "TRUE_STORE_EXIT", 0.3).otherwise(0.7)
    return F.when(retain <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - rate * age / retain))


def evidence(voted: DataFrame, visitor: str, order: str, keep: int = EVIDENCE_ROWS) -> DataFrame:
    """One row per signal of each visitor's last 50 decisions: (visitor, order, signal, value, weight, contribution)."""
    newest = F.row_number().over(Window.partitionBy(visitor).orderBy(F.desc(order)))
    last = voted.withColumn("age", newest).filter(F.col("age") <= keep)
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).cast("double").alias("value"), F.lit(w).alias("weight"), F.col(f"c_{k}").alias("contribution")) for k, w in WEIGHTS.items()])
    return last.select(visitor, order, "identity_score", F.explode(rows).alias("r")).select(visitor, order, "identity_score", "r.*")


def fingerprint_similarity(a: str, b: str) -> Column:
    """Likeness of two fingerprint structs: half embedding, a quarter colour, body and motion, over what both have."""
    p, q = F.col(a), F.col(b)
    steady = F.greatest(F.lit(0.5), 1 - F.least(p["embedding_std"], q["embedding_std"]))
    body = F.greatest(F.lit(0.0), 1 - (F.abs(p["aspect"] - q["aspect"]) / 0.5 + F.abs(p["height"] - q["height"]) / 0.3))
    terms = [(F.when(p["embedding"].isNotNull() & q["embedding"].isNotNull(), cosine(p["embedding"], q["embedding"]) * steady), 0.50)]
    terms += [(F.when(p["colours"].isNotNull() & q["colours"].isNotNull(), cosine(p["colours"], q["colours"])), 0.25), (body, 0.15)]
    terms += [(F.when(p["motion"].isNotNull() & q["motion"].isNotNull(), cosine(p["motion"], q["motion"])), 0.10)]
    top = sum((F.coalesce(t * w, F.lit(0.0)) for t, w in terms), F.lit(0.0))
    whole = sum((F.when(t.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for t, w in terms), F.lit(0.0))
    return half_even(top / whole, 4)


def embedding_ewma(observations: DataFrame, key: str, order: str, vector: str, alpha: float = 0.30) -> DataFrame:
    """(key, embedding): each key's vectors folded in order with weight 0.3 for the new one, brought back to unit length.

    The fold is ordered, so a key is one task's; it streams through it sorted, with one vector held. Null vectors are passed over.
    """
    kind = observations.schema[key].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        now, held = None, None
        for frame in frames:
            done = []
            for k, v in zip(frame[key], frame["v"]):
                v = np.asarray(v, float)
                if held is None or k != now:
                    if held is not None:
                        done.append((now, held.tolist()))
                    now, held = k, v
                    continue
                mixed = (1 - alpha) * held + alpha * v
                norm = float(np.sqrt(mixed @ mixed))
                held = mixed / norm if norm > 1e-8 else mixed
            yield pd.DataFrame(done, columns=[key, "embedding"])
        if held is not None:
            yield pd.DataFrame([(now, held.tolist())], columns=[key, "embedding"])

    rows = observations.filter(F.col(vector).isNotNull()).select(key, order, F.col(vector).cast("array<double>").alias("v"))
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind}, embedding array<double>")


# What each event adds to a track's health, which starts at 50 within 0 to 100.
HEALTH_STEPS = {"frame": 0.5, "reassociated": 10.0, "zone_confirmed": 5.0, "ambiguous": -5.0, "competing": -10.0, "teleport": -15.0}


def track_health(happenings: DataFrame) -> DataFrame:
    """Final health of ``happenings(visitor_id, seq, kind, seconds)``: suspended time costs 0.3 a second."""
    gain = F.lit(0.0)
    for kind, step in HEALTH_STEPS.items():
        gain = F.when(F.col("kind") == kind, F.lit(step)).otherwise(gain)
    gain = F.when(F.col("kind") == "suspended", -0.3 * F.col("seconds")).otherwise(gain)
    acts = F.array_sort(F.collect_list(F.struct("seq", gain.alias("d"))))
    folded = happenings.groupBy("visitor_id").agg(acts.alias("acts"))
    score = F.aggregate("acts", F.lit(50.0), lambda x, s: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x + s["d"])))
    level = F.when(F.col("health") >= 75, "HIGH").when(F.col("health") >= 40, "MEDIUM").otherwise("LOW")
    return folded.select("visitor_id", half_even(score, 4).alias("health")).withColumn("trust", level)


# Fixed values by camera role: occlusion risk and reliability.
CAMERA_PRIORS = {"floor": (0.40, 0.80), "entry": (0.15, 0.95), "godown": (0.60, 0.65), "billing": (0.20, 0.90)}


def camera_role(camera: Column) -> Column:
    up = F.upper(camera)
    return F.when(up.contains("ENTRY"), "entry").when(up.contains("BILLING"), "billing").when(up.contains("GODOWN") | up.contains("STAFF"), "godown").otherwise("floor")


#: Happenings of a camera that one array holds, by the span of their numbers.
FOLD_SPAN = 65536
_FAR = 1 << 60


def _held(acts: Column, steps: dict[str, tuple[int, int | None, int | None]]) -> Column:
    """What a list of happenings does to a number held within bounds: (shift, low, high), so that x becomes x + shift held to low..high.

    ``steps`` has by kind the step and the least or most that it may reach.
    """
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"))

    def step(acc: Column, s: Column) -> Column:
        out = acc
        for kind, (by, least, most) in steps.items():
            bound = lambda x: F.least(x + by, F.lit(most).cast("long")) if most is not None else F.greatest(x + by, F.lit(least).cast("long"))  # noqa: B023, E731
            out = F.when(s["kind"] == kind, F.struct((acc["shift"] + by).alias("shift"), bound(acc["low"]).alias("low"), bound(acc["high"]).alias("high"))).otherwise(out)
        return out

    return F.aggregate(acts, start, step)


def _after(x: Column, held: Column) -> Column:
    return F.greatest(held["low"], F.least(held["high"], x + held["shift"]))


# Fixed values in thousandths: how reliability and occlusion risk move, and where they stop.
RELIABLE_STEPS = {"success": (10, None, 1000), "failure": (-5, 500, None)}
RISK_STEPS = {"loss": (3, None, 900)}


def camera_reputation(happenings: DataFrame) -> DataFrame:
    """Modifier of each camera out of ``happenings(camera_id, seq, kind)`` (detection, success, failure, loss).

    Reliability rises by .01 or falls by .005 within .5 to 1, occlusion risk rises by .003 up to .9; past
    50 detections the share of successes counts as well. Steps between bounds add up to one shift between
    bounds, so spans of a camera's history are folded apart and then one after the other; all in whole thousandths.
    """
    acts = F.array_sort(F.collect_list(F.when(F.col("kind").isin("success", "failure", "loss"), F.struct("seq", "kind"))))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("detection", "success", "failure")]
    spans = happenings.groupBy("camera_id", F.expr(f"seq div {FOLD_SPAN}").alias("span")).agg(acts.alias("acts"), *counts)
    spans = spans.withColumns({"reliable": _held(F.col("acts"), RELIABLE_STEPS), "risky": _held(F.col("acts"), RISK_STEPS)})
    by = spans.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("span", "reliable", "risky"))).alias("spans"), *[F.sum(k).alias(k) for k in ("detection", "success", "failure")])
    by = by.withColumn("role", camera_role(F.col("camera_id")))
    prior = lambda k: F.coalesce(*[F.when(F.col("role") == r, F.lit(round(v[k] * 1000)).cast("long")) for r, v in CAMERA_PRIORS.items()])
    fold = lambda k, name: F.aggregate("spans", prior(k), lambda x, s: _after(x, s[name])) / 1000
    by = by.withColumns({"reliability": fold(1, "reliable"), "occlusion_risk": fold(0, "risky")})
    shift = F.when(F.col("detection") > 50, 0.1 * (F.col("success") / F.greatest(F.lit(1), F.col("success") + F.col("failure")) - 0.5)).otherwise(F.lit(0.0))
    modifier = half_even(clamp(F.col("reliability") - F.col("occlusion_risk") * 0.15 + shift, 0.70, 1.0), 4)
    level = F.when(F.col("modifier") >= 0.90, "HIGH").when(F.col("modifier") >= 0.80, "MEDIUM").otherwise("LOW")
    return by.withColumn("modifier", modifier).withColumn("trust", level).select("camera_id", "role", half_even("reliability", 6).alias("reliability"), half_even("occlusion_risk", 6).alias("occlusion_risk"), "modifier", "trust")


def _atan2(y: pd.Series, x: pd.Series) -> pd.Series:
    """The C library's atan2, which is SQL's: Java's may be one unit in the last place off, and a move along a diagonal lies on the edge of two bins."""
    return pd.Series(np.fromiter(map(math.atan2, y, x), float, len(y)))


def visitor_dna(sightings: DataFrame) -> DataFrame:
    """Habits of each visitor out of ``sightings(visitor_id, seq, ts_us, x, y, zone_id, event_type, dwell_ms)``.

    Speed is an average that gives a new step .15 (steps under 2 s), rhythm counts directions in eight
    bins (moves over .01), pattern is the last 20 zones without repeats in a row; queue and dwell tendencies.
    """
    order = Window.partitionBy("visitor_id").orderBy("seq")
    dt = (F.col("ts_us") - F.lag("ts_us").over(order)) / 1_000_000
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    steps = sightings.withColumns({"dt": dt, "dx": dx, "dy": dy, "zone_before": F.last(F.nullif("zone_id", F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    near = (F.col("dt") > 0) & (F.col("dt") < 2)
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    angle = F.pandas_udf(_atan2, "double")("dy", "dx")
    bin_ = F.pmod(F.floor(F.when(angle < 0, angle + 2 * 3.141592653589793).otherwise(angle) / (2 * 3.141592653589793) * 8).cast("int"), F.lit(8))
    zone = F.nullif(F.col("zone_id"), F.lit(""))
    made = steps.withColumns({"speed": F.when(near, far / F.col("dt")), "bin": F.when(near & (far > 0.01), bin_), "entered": F.when(zone.isNotNull() & ~zone.eqNullSafe(F.col("zone_before")), zone)})
    by = made.groupBy("visitor_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("speed").isNotNull(), F.struct("seq", "speed")))), lambda s: s["speed"]).alias("speeds"),
        F.array(*[F.count_if(F.col("bin") == k).cast("double") for k in range(8)]).alias("rhythm"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("entered").isNotNull(), F.struct("seq", "entered")))), lambda s: s["entered"]).alias("zones"),
        F.count_if(F.col("event_type") == "BILLING_QUEUE_JOIN").alias("joins"),
        F.sum("dwell_ms").alias("dwell_ms"),
    )
    speed = F.aggregate("speeds", F.lit(0.0), lambda a, s: F.when(a == 0, s).otherwise(0.85 * a + 0.15 * s))
    pattern = F.when(F.size("zones") > 20, F.slice("zones", -20, 20)).otherwise(F.col("zones"))
    by = by.withColumns({"speed": speed, "pattern": pattern})
    return by.select("visitor_id", "observations", "speed", "rhythm", "pattern", F.least(F.lit(1.0), F.col("joins") / 2).alias("queue_tendency"), F.when(F.size("pattern") > 0, F.col("dwell_ms") / 1000 / F.size("pattern")).otherwise(F.lit(0.0)).alias("dwell_tendency"))


def dna_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity`` to pairs whose columns end in _a and _b; .5 if either has under ten observations."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    half = F.lit(0.5)
    speed = F.when((a("speed") > 0) & (b("speed") > 0), F.greatest(F.lit(0.0), 1 - F.abs(a("speed") - b("speed")) / 0.1)).otherwise(half)
    moved = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) > 0
    rhythm = F.when(moved(a("rhythm")) & moved(b("rhythm")), cosine(a("rhythm"), b("rhythm"))).otherwise(half)
    both = F.size(F.array_intersect(a("pattern"), b("pattern"))) / F.nullif(F.size(F.array_union(a("pattern"), b("pattern"))), F.lit(0))
    pattern = F.when((F.size(a("pattern")) > 0) & (F.size(b("pattern")) > 0), both).otherwise(half)
    queue = F.greatest(F.lit(0.0), 1 - F.abs(a("queue_tendency") - b("queue_tendency")))
    dwell = F.when((a("dwell_tendency") > 0) & (b("dwell_tendency") > 0), F.least(a("dwell_tendency"), b("dwell_tendency")) / F.greatest(a("dwell_tendency"), b("dwell_tendency"))).otherwise(half)
    score = clamp(0.20 * speed + 0.15 * rhythm + 0.35 * pattern + 0.15 * queue + 0.15 * dwell, 0.0, 1.0)
    thin = (a("observations") < 10) | (b("observations") < 10)
    return pairs.withColumn("similarity", F.when(thin, half).otherwise(half_even(score, 6)))


#: How far a product of blocks may be from a cosine that is added up component by component and rounded to six digits.
ROUGH = 2e-6


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, query_block: int = 1024, vector_block: int = 4096) -> DataFrame:
    """The ``k`` most similar of all vectors for each of a stated set of query vectors (vec_id, embedding): (query_id, vec_id, similarity, rank).

    Both sides are dealt to blocks and each pair of blocks meets once, as one product of matrices; what may be among a query's best ``k`` there
    is then compared exactly, and the best of these picked. A vector is not compared with rows of its own id; ties go to the smaller id.
    """
    rows, columns = max(1, -(-queries.count() // query_block)), max(1, -(-vectors.count() // vector_block))
    side = lambda t: t.select(F.lit("").alias("at"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = may_be_best(side(queries), side(vectors), k, rows, columns, others=True)
    scored = pairs.select("query_id", F.col("id").alias("vec_id"), half_even(cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", best).filter(F.col("rank") <= k)


def may_be_best(queries: DataFrame, vectors: DataFrame, k: int, rows: int, columns: int, others: bool = False, smaller: bool = True) -> DataFrame:
    """(query_id, q, id, v): pairs of ``queries(at, id, v)`` and ``vectors(at, id, v)`` of one ``at`` that may be among a query's ``k`` most similar.

    Queries are dealt to ``rows`` blocks and vectors to ``columns``; of each pair of blocks all pairs stay that come within ``ROUGH`` of the ``k``-th best there.
    Of pairs that round to one similarity, only ``k`` stay, those of the smaller ids or else the larger ones, so that copies do not add up.
    With ``others`` a vector of the query's own id is left out. Cosines are those of ``functions.cosine``.
    """
    spot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    kind = {"query_id": queries.schema["id"].dataType.simpleString(), "id": vectors.schema["id"].dataType.simpleString()}
    whole = F.when(~F.exists("v", lambda x: x.isNull()), F.col("v").cast("array<double>")).alias("v")
    asked = queries.select("at", F.col("id").alias("query_id"), F.lit(None).cast(kind["id"]).alias("id"), whole, spot(rows, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    known = vectors.select("at", F.lit(None).cast(kind["query_id"]).alias("query_id"), "id", whole, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), spot(columns, 2).alias("j"))

    def found(block: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, part in block.groupby("at"):
            asks = part["query_id"].notna().to_numpy()
            q, v = part[asks].reset_index(drop=True), part[~asks].reset_index(drop=True)
            if not len(q) or not len(v):
                continue
            near = _cosines(q["v"].to_numpy(), v["v"].to_numpy())
            if others:
                near[q["query_id"].to_numpy()[:, None] == v["id"].to_numpy()[None, :]] = -np.inf
            last = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
            for s in range(0, len(q), 64):
                a, b = np.nonzero((near[s : s + 64] >= last[s : s + 64, None] - ROUGH) & (near[s : s + 64] > -np.inf))
                # what lies far enough from a tie rounds as it does exactly; the others stay apart
                sure = near[s + a, b] * 1e6
                tie = np.isfinite(sure) & (np.abs(np.mod(sure, 1, where=np.isfinite(sure), out=np.zeros(len(sure))) - 0.5) < 1e-3)
                same = pd.DataFrame({"a": s + a, "b": b, "key": np.rint(sure), "tie": np.where(tie, b, -1), "id": v["id"].to_numpy()[b]})
                few = same.sort_values("id", ascending=smaller).groupby(["a", "key", "tie"]).head(k)
                made.append(pd.DataFrame({"query_id": q["query_id"].to_numpy()[few["a"]], "q": q["v"].to_numpy()[few["a"]], "id": few["id"].to_numpy(), "v": v["v"].to_numpy()[few["b"]]}))
        return pd.concat(made) if made else pd.DataFrame(columns=["query_id", "q", "id", "v"])

    return asked.unionByName(known).groupBy("i", "j").applyInPandas(found, f"query_id {kind['query_id']}, q array<double>, id {kind['id']}, v array<double>")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of two lists of vectors, 0 where ``functions.cosine`` has 0 and infinite where it has no number, which is above all others."""
    out = np.zeros((len(a), len(b)))
    length = lambda vs: np.array([-1 if v is None else len(v) for v in vs])
    la, lb = length(a), length(b)
    for n in set(la[la > 0]) & set(lb[lb > 0]):
        p, q = np.flatnonzero(la == n), np.flatnonzero(lb == n)
        x, y = np.stack(a[p]).astype(float), np.stack(b[q]).astype(float)
        nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        good = ~(nx < 1e-8)[:, None] & ~(ny < 1e-8)[None, :]
        with np.errstate(all="ignore"):
            cosines = x @ y.T / (nx[:, None] * ny[None, :])
            out[np.ix_(p, q)] = np.where(good, np.where(np.isnan(cosines), np.inf, cosines), 0.0)
    return out
