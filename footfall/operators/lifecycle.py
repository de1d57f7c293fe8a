"""Identities over time: active, suspended and expired tracks, ghosts of lost ones, matches between cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cosine, half_even
from ..functions.lineage import cut
from ..schema import SECOND
from .identity import may_be_best

# Fixed values.
ADJACENT_MATCH = 0.70
#: Tracks of a block that meets four times as many visitors at once.
MATCH_BLOCK = 1024
GHOST_LEAST, GHOST_TTL, GHOST_DECAY, GHOSTS_KEPT, GHOST_REACH, GHOST_RETURN = 0.40, 30.0, 0.95, 50, 0.3, 0.55
SHADOW_FRAMES, SHADOW_DAMPING, SHADOW_FADE, SHADOW_LEAST, SHADOW_STILL, SHADOW_REACH, SHADOW_MATCH = 90, 0.98, 0.97, 0.10, 0.001, 120.0, 0.40
COLOUR_BINS, COLOUR_BOXES = 32, 10


def absences(sightings: DataFrame) -> DataFrame:
    """Gaps between the sightings of each visitor: (visitor_id, last_us, back_us), back_us null for the last one.

    ``sightings(visitor_id, ts_us, seq, retain_sec)``, retain_sec being how long a loss at that place is kept.
    """
    order = Window.partitionBy("visitor_id").orderBy("seq")
    return sightings.select("visitor_id", F.col("ts_us").alias("last_us"), F.lead("ts_us").over(order).alias("back_us"), "retain_sec", "seq")


def lifecycle(sightings: DataFrame, as_of_us: int, active_us: int = 0) -> DataFrame:
    """(visitor_id, state, last_us, expirations) at ``as_of_us``.

    A visitor is ACTIVE while seen (within ``active_us``), then SUSPENDED for the retention of the last
    sighting, then EXPIRED. A visitor that came back later than its retention was expired in between.
    """
    gaps = absences(sightings.filter(F.col("ts_us") <= as_of_us))
    over = lambda until: (until - F.col("last_us")) / SECOND > F.col("retain_sec")
    by = gaps.groupBy("visitor_id").agg(F.max_by(F.struct("last_us", "retain_sec"), "seq").alias("last"), F.count_if(F.col("back_us").isNotNull() & over(F.col("back_us"))).alias("expirations"))
    age = F.lit(as_of_us) - F.col("last.last_us")
    state = F.when(age <= active_us, "ACTIVE").when(age / SECOND <= F.col("last.retain_sec"), "SUSPENDED").otherwise("EXPIRED")
    return by.select("visitor_id", state.alias("state"), F.col("last.last_us").alias("last_us"), "expirations")


def adjacent_matches(new: DataFrame, active: DataFrame, adjacency: DataFrame, least: float = ADJACENT_MATCH) -> DataFrame:
    """(track_id, visitor_id, similarity): the most similar visitor active on a neighbouring camera, from .70 up.

    ``new(track_id, camera_id, embedding)``, ``active(visitor_id, camera_id, embedding)``, ``adjacency(camera_id, neighbour_id)``.
    """
    links = adjacency.unionByName(adjacency.select(F.col("neighbour_id").alias("camera_id"), F.col("camera_id").alias("neighbour_id"))).distinct()
    asked = new.join(links, "camera_id").select(F.col("neighbour_id").alias("at"), F.col("track_id").alias("id"), F.col("embedding").alias("v"))
    there = active.select(F.col("camera_id").alias("at"), F.col("visitor_id").alias("id"), F.col("embedding").alias("v"))
    # tracks and visitors are dealt to blocks, so that a camera is no single task
    rows, columns = max(1, -(-asked.count() // MATCH_BLOCK)), max(1, -(-there.count() // (4 * MATCH_BLOCK)))
    pairs = may_be_best(asked, there, 1, rows, columns, smaller=False).select(F.col("query_id").alias("track_id"), F.col("id").alias("visitor_id"), half_even(cosine(F.col("q"), F.col("v")), 6).alias("similarity"))
    best = F.max(F.struct("similarity", F.col("visitor_id"))).alias("b")
    return pairs.filter(F.col("similarity") >= least).groupBy("track_id").agg(best).select("track_id", "b.visitor_id", "b.similarity")


def ghosts(lost: DataFrame, as_of_us: int, keep: int = GHOSTS_KEPT) -> DataFrame:
    """Ghosts of ``lost(store_id, visitor_id, camera_id, x, y, vx, vy, confidence, retain_sec, lost_us)`` that live at ``as_of_us``.

    Sure enough tracks leave a ghost for their retention (30 s if 0); a store holds the newest 50. The
    predicted place follows the last velocity, which fades by .95 a second.
    """
    made = lost.filter((F.col("confidence") >= GHOST_LEAST) & (F.col("lost_us") <= as_of_us))
    newest = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("lost_us"), "visitor_id"))
    made = made.withColumn("nth", newest).filter(F.col("nth") <= keep).drop("nth")
    dt = (F.lit(as_of_us) - F.col("lost_us")) / SECOND
    ttl = F.when(F.coalesce("retain_sec", F.lit(0.0)) > 0, F.col("retain_sec")).otherwise(F.lit(GHOST_TTL))
    alive = made.filter(dt <= ttl)
    ahead = dt * F.pow(F.lit(GHOST_DECAY), dt)
    return alive.withColumns({"predicted_x": F.col("x") + F.col("vx") * ahead, "predicted_y": F.col("y") + F.col("vy") * ahead})


def ghost_candidates(alive: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of a living ghost and ``new(track_id, store_id, camera_id, x, y)``: on the same camera no farther than .3 from the prediction."""
    seen = new.select("track_id", "store_id", F.col("camera_id").alias("seen_camera"), F.col("x").alias("seen_x"), F.col("y").alias("seen_y"))
    far = F.sqrt(F.pow(F.col("seen_x") - F.col("predicted_x"), 2) + F.pow(F.col("seen_y") - F.col("predicted_y"), 2))
    pairs = alive.join(seen, "store_id").withColumn("distance", far)
    return pairs.filter((F.col("camera_id") != F.col("seen_camera")) | (F.col("distance") <= GHOST_REACH)).select("track_id", "visitor_id", "distance")


def ghost_returns(candidates: DataFrame, scores: DataFrame, least: float = GHOST_RETURN) -> DataFrame:
    """(track_id, visitor_id, identity_score): the ghost that a new track brings back, of those the vote associates above .55.

    ``candidates(track_id, visitor_id)`` come from ``ghost_candidates``, ``scores(track_id, visitor_id, identity_score, should_associate)``
    from the vote. The best score wins, of equal ones the smaller visitor id.
    """
    heard = candidates.join(scores, ["track_id", "visitor_id"]).filter(F.col("should_associate") & (F.col("identity_score") > least))
    best = F.min(F.struct((-F.col("identity_score")).alias("minus"), "visitor_id")).alias("b")
    return heard.groupBy("track_id").agg(best).select("track_id", "b.visitor_id", (-F.col("b.minus")).alias("identity_score"))


def ghost_failures(lost: DataFrame, returned: DataFrame, as_of_us: int) -> DataFrame:
    """(visitor_id, camera_id, expired_us): ghosts of ``lost`` (as for ``ghosts``) that ran out by ``as_of_us`` and that ``returned(visitor_id)`` lacks."""
    ttl = F.when(F.coalesce("retain_sec", F.lit(0.0)) > 0, F.col("retain_sec")).otherwise(F.lit(GHOST_TTL))
    ended = lost.filter(F.col("confidence") >= GHOST_LEAST).withColumn("expired_us", F.col("lost_us") + (ttl * SECOND).cast("long"))
    return ended.filter(F.col("expired_us") < as_of_us).join(returned.select("visitor_id"), "visitor_id", "left_anti").select("visitor_id", "camera_id", "expired_us")


def shadows(lost: DataFrame, frame: Column) -> DataFrame:
    """Shadows at ``frame`` of ``lost(camera_id, visitor_id, lost_frame, x1, y1, x2, y2, vx, vy)``, boxes and speeds in shares of the frame.

    A shadow moves on with its velocity, which fades by .98 a frame, and stops at the frame's edges; its confidence
    fades by .97. It ends after 90 frames or under .1. Tracks that hardly moved leave none.
    """
    n = frame - F.col("lost_frame")
    moving = (F.abs("vx") >= SHADOW_STILL) | (F.abs("vy") >= SHADOW_STILL)
    sure = F.pow(F.lit(SHADOW_FADE), n)
    alive = lost.filter(moving & (n >= 0) & (n <= SHADOW_FRAMES) & (sure >= SHADOW_LEAST))
    # the steps of a fading velocity add up to a geometric sum, and one sign moves an edge one way only
    far = (1 - F.pow(F.lit(SHADOW_DAMPING), n)) / (1 - SHADOW_DAMPING)
    at = lambda c, v: F.when(n == 0, F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + F.col(v) * far)))
    return alive.withColumns({"x1": at("x1", "vx"), "y1": at("y1", "vy"), "x2": at("x2", "vx"), "y2": at("y2", "vy"), "confidence": sure})


def shadow_matches(alive: DataFrame, new: DataFrame) -> DataFrame:
    """(track_id, visitor_id, confidence): the shadow that ``new(track_id, camera_id, x1, y1, x2, y2, frame_w, frame_h)`` most likely continues.

    On one camera, under 120 px between centres; the nearer and the surer the shadow the better, above .4. Of
    equal ones the smaller visitor id counts.
    """
    here = alive.select("camera_id", "visitor_id", ((F.col("x1") + F.col("x2")) / 2).alias("sx"), ((F.col("y1") + F.col("y2")) / 2).alias("sy"), F.col("confidence").alias("shadow"))
    seen = new.select("track_id", "camera_id", ((F.col("x1") + F.col("x2")) / 2).alias("nx"), ((F.col("y1") + F.col("y2")) / 2).alias("ny"), "frame_w", "frame_h")
    dx, dy = (F.col("nx") - F.col("sx")) * F.col("frame_w"), (F.col("ny") - F.col("sy")) * F.col("frame_h")
    pairs = seen.join(here, "camera_id").withColumn("far", F.sqrt(dx * dx + dy * dy)).filter(F.col("far") < SHADOW_REACH)
    pairs = pairs.withColumn("confidence", (1 - F.col("far") / SHADOW_REACH) * F.col("shadow")).filter(F.col("confidence") > SHADOW_MATCH)
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), "visitor_id")).alias("b")
    return pairs.groupBy("track_id").agg(best).select("track_id", "b.visitor_id", (-F.col("b.minus")).alias("confidence"))


def match_in_turn(wishes: DataFrame, key: str) -> DataFrame:
    """(key, track, lost, score) of ``wishes(key, track, turn, lost, wish, score)``: tracks take, in order of ``turn``, their best lost track that is still free.

    Deferred acceptance instead of a fold: every track asks for the smallest ``wish`` it has left, a lost track keeps the earliest that
    asks, and every later wish for it is dropped, as it never goes back to a later one. All lost tracks prefer alike, so this
    ends with the one matching that taking turns gives. A round moves all tracks that were refused at once.
    """
    left = cut(wishes)
    n = left.count()
    while True:
        best = left.groupBy(key, "track").agg(F.min(F.struct("wish", "lost", "turn", "score")).alias("b"))
        kept = best.groupBy(key, F.col("b.lost").alias("lost")).agg(F.min("b.turn").alias("kept"))
        rest = cut(left.join(kept, [key, "lost"], "left").filter("kept is null or turn <= kept").drop("kept"))
        before, n = n, rest.count()
        if n == before:
            return best.select(key, "track", "b.lost", "b.score")
        left = rest


def roots(pointers: DataFrame, key: str) -> DataFrame:
    """(key, node, root) of ``pointers(key, node, parent)``, parent null at a root: each round doubles how far a node looks."""
    now = cut(pointers.select(key, "node", F.coalesce("parent", "node").alias("root")))
    while True:
        up = now.select(key, F.col("node").alias("root"), F.col("root").alias("further"))
        looked = now.join(up, [key, "root"]).select(key, "node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved"))
        looked = cut(looked)
        if looked.filter("moved").isEmpty():
            return now
        now = looked.drop("moved")


def continue_identities(tracks: DataFrame, scored: DataFrame, key: str, overlaps: DataFrame | None = None) -> DataFrame:
    """(key, track_id, visitor_id, is_new, reid_confidence) of ``tracks(key, track_id, start_us)`` in order of their start.

    A track takes over the identity of the best lost track of ``scored(key, lost_id, seen_id, identity_score, should_associate)`` that
    nobody has taken over yet (ties: the smaller id); else that of the track it overlaps, from
    ``overlaps(track_id, with_id, similarity)``; else it is a new visitor, named after itself. Only tracks that began before can
    be taken over. Matched in rounds, and names are found by following the chain of tracks in doubling steps; no key is a task.
    """
    long = lambda c: F.col(c).cast("long")
    known = cut(tracks.select(key, long("track_id").alias("track_id"), F.struct("start_us", long("track_id").alias("id")).alias("turn")))
    earlier = known.select(key, F.col("track_id").alias("lost"), F.col("turn").alias("lost_turn"))
    good = scored.filter("should_associate").select(key, long("seen_id").alias("track"), long("lost_id").alias("lost"), F.col("identity_score").cast("double").alias("score"))
    wishes = good.join(known.select(key, F.col("track_id").alias("track"), "turn"), [key, "track"]).join(earlier, [key, "lost"]).filter("lost_turn < turn")
    taken = match_in_turn(wishes.select(key, "track", "turn", "lost", F.struct((-F.col("score")).alias("minus"), "lost").alias("wish"), "score"), key)
    named = known.join(taken.withColumnRenamed("track", "track_id"), [key, "track_id"], "left")
    if overlaps is not None:
        one = overlaps.groupBy(long("track_id").alias("track_id")).agg(F.max(F.struct("similarity", (-F.col("with_id")).alias("minus"))).alias("o"))
        beside = one.select("track_id", (-F.col("o.minus")).cast("long").alias("lost_"), F.col("o.similarity").cast("double").alias("near"))
        named = named.join(beside, "track_id", "left").join(earlier.withColumnRenamed("lost", "lost_"), [key, "lost_"], "left")
        there = F.col("lost").isNull() & (F.col("lost_turn") < F.col("turn"))
        named = named.withColumns({"score": F.when(there, F.col("near")).otherwise(F.col("score")), "lost": F.when(there, F.col("lost_")).otherwise(F.col("lost"))})
    named = cut(named.select(key, "track_id", "lost", "score"))
    visitors = roots(named.select(key, F.col("track_id").alias("node"), F.col("lost").alias("parent")), key)
    made = named.join(visitors.withColumnRenamed("node", "track_id"), [key, "track_id"])
    return made.select(key, "track_id", F.col("root").alias("visitor_id"), F.col("lost").isNull().alias("is_new"), F.coalesce(F.when(F.col("lost").isNull(), F.lit(1.0)), F.col("score")).alias("reid_confidence"))


def colour_proxy(observations: DataFrame) -> DataFrame:
    """(visitor_id, colours) of the last ten boxes ``(visitor_id, seq, y1, y2, frame_h)``: where no crop is kept, the height in the frame
    stands for brightness, as a unit vector of three times 32 bins of which the last third is filled."""
    newest = F.row_number().over(Window.partitionBy("visitor_id").orderBy(F.desc("seq")))
    middle = (F.col("y1") + F.col("y2")) / 2 / F.greatest(F.lit(1), F.col("frame_h"))
    bin_ = F.floor(F.greatest(F.lit(0.0), F.least(1 - middle, F.lit(1.0))) * (COLOUR_BINS - 1)).cast("int")
    last = observations.withColumn("age", newest).filter(F.col("age") <= COLOUR_BOXES).withColumn("bin", bin_)
    counts = last.groupBy("visitor_id").agg(F.array(*[F.count_if(F.col("bin") == k).cast("double") for k in range(COLOUR_BINS)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    empty = F.array_repeat(F.lit(0.0), 2 * COLOUR_BINS)
    return counts.select("visitor_id", F.concat(empty, F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(x))).alias("colours"))


def appearance(observations: DataFrame) -> DataFrame:
    """Body proportions of each visitor's last 30 boxes ``(visitor_id, seq, x1, y1, x2, y2, frame_h)``: mean width to height and mean height in the frame."""
    newest = F.row_number().over(Window.partitionBy("visitor_id").orderBy(F.desc("seq")))
    last = observations.withColumn("age", newest).filter("age <= 30 and y2 > y1")
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return last.groupBy("visitor_id").agg(half_even(F.avg(wide / high), 6).alias("aspect"), half_even(F.avg(high / F.col("frame_h")), 6).alias("height"), F.count(F.lit(1)).alias("frames"))


def company_scores(frames: DataFrame) -> DataFrame:
    """(a, b, score) of ``frames(a, b, seq, near)``: up by one in a frame together, down by one apart, never under zero.

    The running sum less its running minimum, if that is below zero, is the sum held at zero; no fold is needed.
    """
    order = Window.partitionBy("a", "b").orderBy("seq")
    run = F.sum(F.when(F.col("near"), 1).otherwise(-1)).over(order)
    summed = frames.withColumn("run", run).withColumn("low", F.least(F.lit(0), F.min("run").over(order)))
    return summed.groupBy("a", "b").agg(F.max_by(F.col("run") - F.col("low"), "seq").alias("score"))


def shape_of(events: DataFrame, shapes: DataFrame) -> DataFrame:
    """Events with the role and label of the shape that their zone names on their camera."""
    named = shapes.select("camera_id", F.col("shape_id").alias("zone_id"), "role", "label").dropDuplicates(["camera_id", "zone_id"])
    return events.join(named, ["camera_id", "zone_id"], "left")
