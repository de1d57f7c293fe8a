"""Points, polygons and lines of a store's calibration: lookup, overlap and checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERLAP_WARN, OVERLAP_ERROR = 0.15, 0.60
EXCLUSIVE_ROLES = ("zone", "billing_counter", "queue_area")
SINGLE_ROLES = ("entry_line", "billing_counter", "queue_area")


def pixel_polygon(points: Column, width: int, height: int) -> Column:
    """Normalised vertices as whole pixels, cut off, not rounded."""
    return F.transform(points, lambda p: F.struct(F.floor(p["x"] * width).cast("double").alias("x"), F.floor(p["y"] * height).cast("double").alias("y")))


def _edges(points: Column) -> Column:
    return F.transform(points, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.element_at(points, F.pmod(i + 1, F.size(points)) + 1)["x"].alias("x2"), F.element_at(points, F.pmod(i + 1, F.size(points)) + 1)["y"].alias("y2")))


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds a point; its border counts as inside."""
    return edges_contain(_edges(points), x, y)


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))

    def over(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    hits = F.size(F.filter(edges, lambda e: F.coalesce(over(e), F.lit(False))))
    return F.exists(edges, on) | (hits % 2 == 1)


def locate(points: DataFrame, zones: DataFrame, width: int, height: int) -> DataFrame:
    """Adds ``zone_id``, the first zone by ``ord`` of the point's camera whose polygon holds it (null: none).

    ``points(point_id, camera_id, px, py)`` in pixels, ``zones(camera_id, zone_id, ord, points)``. A store has
    a few dozen zones; they are gathered to one array per camera, so points are joined once and not multiplied.
    """
    shapes = zones.withColumn("pixels", pixel_polygon(F.col("points"), width, height)).withColumn("edges", _edges(F.col("pixels")))
    xs, ys = F.transform("pixels", lambda p: p["x"]), F.transform("pixels", lambda p: p["y"])
    bounds = {"lo_x": F.array_min(xs), "hi_x": F.array_max(xs), "lo_y": F.array_min(ys), "hi_y": F.array_max(ys)}
    shapes = shapes.withColumns(bounds)
    listed = shapes.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("ord", "zone_id", "edges", *bounds))).alias("zones"))
    joined = points.join(listed, "camera_id", "left")
    x, y = F.col("px"), F.col("py")
    # most zones are ruled out by their bounding boxes
    boxed = lambda z: (x >= z["lo_x"]) & (x <= z["hi_x"]) & (y >= z["lo_y"]) & (y <= z["hi_y"])
    first = F.try_element_at(F.filter("zones", lambda z: boxed(z) & edges_contain(z["edges"], x, y)), F.lit(1))
    return joined.withColumn("zone_id", first["zone_id"]).drop("zones")


def area(points: Column) -> Column:
    return F.abs(F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


Point = tuple[float, float]


def clip_area(subject: list[Point], window: list[Point], exact: bool = False) -> float:
    """Area of ``subject`` within a convex counter-clockwise ``window`` (Sutherland and Hodgman).

    By default a crossing of two edges is placed where the established results have it, which mirrors one
    of the line's terms; ``exact`` places it on both lines.
    """
    kept = list(subject)
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in kept]
        made: list[Point] = []
        for k, p in enumerate(kept):
            q = kept[k - 1]
            if (side[k] >= 0) != (side[k - 1] >= 0):
                ux, uy, vx, vy = ax - bx, ay - by, q[0] - p[0], q[1] - p[1]
                det, line, edge = ux * vy - uy * vx, ax * by - ay * bx, q[0] * p[1] - q[1] * p[0]
                if abs(det) > 1e-10:
                    sign = 1 if exact else -1
                    made.append(((sign * line * vx - edge * ux) / det, (sign * line * vy - edge * uy) / det))
            if side[k] >= 0:
                made.append(p)
        kept = made
    return shoelace(kept)


def shoelace(points: list[Point]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, [*points[1:], *points[:1]]))) / 2 if len(points) > 2 else 0.0


def _turn(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def segments_cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments share a point."""
    t = (_turn(c, d, a), _turn(c, d, b), _turn(a, b, c), _turn(a, b, d))
    if t[0] * t[1] < 0 and t[2] * t[3] < 0:
        return True
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    return any(v == 0 and within(*s) for v, s in zip(t, ((c, d, a), (c, d, b), (a, b, c), (a, b, d))))


def crosses_itself(points: list[Point]) -> bool:
    n = len(points)
    edges = [(points[i], points[(i + 1) % n]) for i in range(n)]
    return any(segments_cross(*edges[i], *edges[j]) for i in range(n) for j in range(i + 2, n) if (j + 1) % n != i)


def clipped(points: Column, window: Column, exact: bool = False) -> Column:
    """``clip_area``'s polygon as an expression: the edges of ``window`` cut what is left of ``points`` one after the other."""

    def cut_at(kept: Column, e: Column) -> Column:
        side = lambda p: (e["x2"] - e["x1"]) * (p["y"] - e["y1"]) - (e["y2"] - e["y1"]) * (p["x"] - e["x1"])

        def corner(p: Column, k: Column) -> Column:
            q = F.element_at(kept, F.when(k == 0, F.size(kept)).otherwise(k))
            ux, uy, vx, vy = e["x1"] - e["x2"], e["y1"] - e["y2"], q["x"] - p["x"], q["y"] - p["y"]
            det, line, edge = ux * vy - uy * vx, e["x1"] * e["y2"] - e["y1"] * e["x2"], q["x"] * p["y"] - q["y"] * p["x"]
            turned = ((side(p) >= 0) != (side(q) >= 0)) & (F.abs(det) > 1e-10)
            term = line if exact else -line
            at = F.struct(F.try_divide(term * vx - edge * ux, det).alias("x"), F.try_divide(term * vy - edge * uy, det).alias("y"))
            return F.filter(F.array(F.when(turned, at), F.when(side(p) >= 0, F.struct(p["x"].alias("x"), p["y"].alias("y")))), lambda v: v.isNotNull())

        return F.flatten(F.transform(kept, corner))

    return F.aggregate(_edges(window), points.cast("array<struct<x:double,y:double>>"), cut_at)


def overlaps(zones: DataFrame, exact: bool = False) -> DataFrame:
    """(camera_id, a, b, role, fraction, code): same-role polygons of a camera that share 15 % or more of the smaller one.

    A share of all of it with centres far apart comes from a clip along a common edge and is left out.
    ``exact`` is that of ``clip_area``.
    """
    a = zones.filter(F.col("role").isin(*EXCLUSIVE_ROLES)).select("camera_id", "role", "ord", F.col("zone_id").alias("a"), F.col("points").alias("pa"))
    b = a.select("camera_id", "role", F.col("ord").alias("ord_b"), F.col("a").alias("b"), F.col("pa").alias("pb"))
    pairs = a.join(b, ["camera_id", "role"]).filter("ord < ord_b").withColumn("shared", clipped(F.col("pa"), F.col("pb"), exact))
    size = lambda p: F.when(F.size(p) > 2, area(F.col(p))).otherwise(F.lit(0.0))
    least = F.least(size("pa"), size("pb"))
    share = F.when(least >= 1e-8, F.least(F.try_divide(size("shared"), least), F.lit(1.0))).otherwise(F.lit(0.0))
    centre = lambda p, c: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[c]) / F.size(p)
    dx, dy = centre("pa", "x") - centre("pb", "x"), centre("pa", "y") - centre("pb", "y")
    far = F.sqrt(dx * dx + dy * dy) > 0.05
    found = pairs.withColumn("share", share).withColumn("fraction", F.bround(F.when((F.col("share") >= 0.99) & far, F.lit(0.0)).otherwise(F.col("share")), 6)).filter(F.col("fraction") >= OVERLAP_WARN)
    code = F.when(F.col("fraction") >= OVERLAP_ERROR, "POLYGON_OVERLAP_CRITICAL").otherwise("POLYGON_OVERLAP")
    return found.select("camera_id", "a", "b", "role", "fraction", code.alias("code"))


ISSUE = "camera_id string, shape_id string, code string, severity string"


def shape_issues(shapes: DataFrame) -> DataFrame:
    """Issues of single shapes: ids, labels, roles, points, lines and polygons. A calibration is a small table."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s in frame.itertuples():
                for code, severity in _shape_codes(s):
                    rows.append((s.camera_id, s.shape_id or None, code, severity))
            yield pd.DataFrame(rows, columns=["camera_id", "shape_id", "code", "severity"])

    return shapes.filter("enabled").select("camera_id", "shape_id", "shape_type", "role", "label", "points", "inside_is").mapInPandas(check, ISSUE)


def _shape_codes(s) -> Iterator[tuple[str, str]]:
    if not s.shape_id:
        yield "MISSING_SHAPE_ID", "ERROR"
    if not s.label:
        yield "MISSING_LABEL", "WARNING"
    if not s.role:
        yield "MISSING_ROLE", "ERROR"
    points = [] if s.points is None else [tuple(p) for p in s.points]
    if not points:
        yield "EMPTY_POINTS", "ERROR"
        return
    whole = 0
    for p in points:
        if len(p) != 2:
            yield "INVALID_POINT", "ERROR"
            break
        whole += 1
        if not (0 <= p[0] <= 1 and 0 <= p[1] <= 1):
            yield "POINT_OUT_OF_BOUNDS", "WARNING"
    if s.shape_type == "line":
        if len(points) != 2:
            yield "INVALID_LINE", "ERROR"
        elif whole == 2:
            (x1, y1), (x2, y2) = points
            if ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 < 0.05:
                yield "LINE_TOO_SHORT", "WARNING"
            if s.role == "entry_line" and not s.inside_is:
                yield "MISSING_INSIDE_IS", "ERROR"
    elif s.shape_type == "polygon":
        if len(points) < 3:
            yield "TOO_FEW_POINTS", "ERROR"
        elif whole == len(points):
            if len(points) > 3 and crosses_itself(points):
                yield "SELF_INTERSECT", "ERROR"
            if shoelace(points) < 0.001:
                yield "DEGENERATE_POLYGON", "WARNING"


def camera_issues(shapes: DataFrame) -> DataFrame:
    """Issues of whole cameras: roles that are missing or doubled, and labels used twice."""
    named = shapes.withColumns({"role": F.coalesce("role", F.lit("")), "label": F.coalesce("label", F.lit("")), "enabled": F.coalesce("enabled", F.lit(False))})
    on = named.filter("enabled")
    entry_name = F.upper(F.coalesce("shape_id", F.lit(""))).contains("ENTRY")
    by = named.groupBy("camera_id").agg(F.collect_set(F.when(F.col("enabled"), F.col("role"))).alias("roles"), F.bool_or(entry_name & F.col("enabled")).alias("named_entry"))
    has = lambda r: F.array_contains("roles", r)
    entry = (F.size("roles") > 0) & (F.col("named_entry") | F.upper("camera_id").contains("ENTRY") | has("inside_region") | has("outside_region"))
    billing = F.upper("camera_id").contains("BILLING") | has("billing_counter") | has("queue_area")
    issue = lambda when, code: F.when(when, F.lit(code))
    codes = F.array(issue(entry & ~has("entry_line"), "MISSING_ENTRY_LINE"), issue(billing & ~has("billing_counter"), "MISSING_BILLING_COUNTER"), issue(billing & ~has("queue_area"), "MISSING_QUEUE_AREA"))
    none = F.lit(None).cast("string").alias("shape_id")
    missing = by.select("camera_id", none, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), F.lit("WARNING").alias("severity"))
    doubled = on.filter(F.col("role").isin(*SINGLE_ROLES)).groupBy("camera_id", "role").count().filter("count > 1").select("camera_id", none, F.lit("DUPLICATE_ROLE").alias("code"), F.lit("ERROR").alias("severity"))
    twice = on.filter("label <> ''").groupBy("camera_id", "label").count().filter("count > 1").select("camera_id", none, F.lit("DUPLICATE_LABEL").alias("code"), F.lit("ERROR").alias("severity"))
    return missing.unionByName(doubled).unionByName(twice)


def calibration_issues(shapes: DataFrame) -> DataFrame:
    """All issues of a calibration's shapes (camera_id, shape_id, code, severity)."""
    polygons = shapes.filter("enabled and shape_type = 'polygon' and size(points) >= 3 and forall(points, p -> size(p) = 2)")
    order = F.row_number().over(Window.partitionBy("camera_id").orderBy("ord"))
    zones = polygons.select("camera_id", "role", F.col("shape_id").alias("zone_id"), order.alias("ord"), F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    shared = overlaps(zones).select("camera_id", F.col("a").alias("shape_id"), "code", F.when(F.col("code") == "POLYGON_OVERLAP", "WARNING").otherwise("ERROR").alias("severity"))
    return shape_issues(shapes).unionByName(camera_issues(shapes)).unionByName(shared)
