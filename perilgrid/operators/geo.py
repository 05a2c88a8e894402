"""Geometry on longitude/latitude and on plane cells; proximity joins are equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2))
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def project(lon: Column, lat: Column, lat0: float = 48.5, radius: float = 6_371_000.0) -> tuple[Column, Column]:
    """Equirectangular metres."""
    return F.radians(lon) * radius * F.cos(F.radians(F.lit(lat0))), F.radians(lat) * radius


def albers(lon: Column, lat: Column, lon0: float = -96.0, lat0: float = 23.0, lat1: float = 29.5, lat2: float = 45.5) -> tuple[Column, Column]:
    """Metres in an equal-area conic projection on the GRS 80 ellipsoid; the defaults are those usual for
    the conterminous United States."""
    a, e2 = 6_378_137.0, 0.0066943800229
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(math.sin(p2)) - q_of(math.sin(p1)))
    c = m_of(p1) ** 2 + n * q_of(math.sin(p1))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, rho0 = a / n * F.sqrt(c - n * q), a / n * math.sqrt(c - n * q_of(math.sin(p0)))
    theta = n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def near(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """All (points.id, others.id, d) within radius of points(id, x, y) and others(id, x, y)."""
    around = F.array(*(F.struct((cell(F.col("x"), radius) + i).alias("cx"), (cell(F.col("y"), radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = points.select(F.col("id").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(around).alias("c")).select("id", "ax", "ay", "c.*")
    b = others.select(F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return a.join(b, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).select("id", "other", "d")


#: Candidate pairs that a task measures at once.
_SLICE = 1 << 19


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by cx and cy: tables that hold whole cells only, a batch's worth at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cx, cy = b.column("cx").to_numpy(), b.column("cy").to_numpy()
        if held and (held[-1].column("cx")[0].as_py(), held[-1].column("cy")[0].as_py()) == (cx[-1], cy[-1]) == (cx[0], cy[0]):
            held.append(b)  # one cell goes on through the whole batch
            continue
        other = np.flatnonzero((cx != cx[-1]) | (cy != cy[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held.append(b.slice(0, cut))
        if whole := [x for x in held if x.num_rows]:
            yield pa.Table.from_batches(whole)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _close(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """(a, b, d) of the pairs within radius in each cell, of which one at least is at home there; points at
    home come first in their cell."""
    for t in _whole_cells(batches):
        cx, cy, guest, x, y = (t.column(c).to_numpy() for c in ("cx", "cy", "guest", "x", "y"))
        ids = t.column("id").combine_chunks()
        border = np.flatnonzero((np.diff(cx) != 0) | (np.diff(cy) != 0)) + 1
        size = np.diff(np.r_[0, border, len(cx)])
        last = np.repeat(np.cumsum(size), size)  # where a row's cell ends
        home = np.flatnonzero(guest == 0)
        n = last[home] - home - 1  # each meets all that follow it in the cell
        upto = np.cumsum(n)
        for lo in range(0, int(upto[-1]) if len(upto) else 0, _SLICE):
            hi = min(lo + _SLICE, int(upto[-1]))
            p, q = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi, "left") + 1
            begin = np.maximum(upto[p:q] - n[p:q], lo)
            count = np.minimum(upto[p:q], hi) - begin
            i = np.repeat(home[p:q], count)
            j = np.arange(lo, hi) + np.repeat(home[p:q] + 1 - (upto[p:q] - n[p:q]), count)
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
            near = np.flatnonzero(d <= radius)
            if len(near):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[near])), ids.take(pa.array(j[near])), pa.array(d[near])], ["a", "b", "d"])


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """All (id, other, d) with id < other within radius of one another, of points(id, x, y).

    A point is at home in its cell and a guest in four of the cells around it, so that two points meet in
    one cell only. Cells go to as many tasks as spark.sql.shuffle.partitions says (at least two a core):
    what they read is little and what they find much, so they are not dealt by the bytes they read."""
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    big = F.lit(float(1 << 53))
    at = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(F.col(c) / (radius * (1 + 1e-9)), big), -big)), big), -big).cast("long")
    finite = F.col("id").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite)
    stays = F.array(*(F.struct((at("x") + i).alias("cx"), (at("y") + j).alias("cy"), F.lit(int((i, j) != (0, 0))).alias("guest")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    dealt = p.select("id", "x", "y", F.explode(stays).alias("c")).select("id", "x", "y", "c.*").repartition(tasks, "cx", "cy").sortWithinPartitions("cx", "cy", "guest")
    kind = points.schema["id"].dataType.simpleString()
    met = dealt.mapInArrow(lambda batches: _close(batches, radius), f"a {kind}, b {kind}, d double")
    return met.where("a <> b").select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other"), "d")


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The distance of a point from a straight segment."""
    dx, dy = x2 - x1, y2 - y1
    at = F.greatest(F.least(F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.sqrt(F.pow(x - x1 - at * dx, F.lit(2)) + F.pow(y - y1 - at * dy, F.lit(2)))


def ring_segments(polygons: DataFrame) -> DataFrame:
    """(label, x1, y1, x2, y2) of the sides of polygons(label, ring)."""
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    side = F.explode(F.zip_with("ring", after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))))
    return polygons.select("label", side.alias("s")).select("label", "s.*")


def nearest_segment(points: DataFrame, segments: DataFrame, radius: float, distance: Column | None = None) -> DataFrame:
    """(id, label, d): of segments(label, x1, y1, x2, y2) the nearest within radius of each of points(id,
    x, y), ties to the smaller label. A segment is dealt to the cells of its box, widened by a little more
    than radius. ``distance``, of the columns of both, is for sides whose distance has to be rounded in a
    certain way: whether a point just radius away is within it may depend on the order of subtractions."""
    wide = radius * (1 + 1e-9)
    span = lambda a, b: F.sequence(cell(F.least(a, b) - wide, radius), cell(F.greatest(a, b) + wide, radius))
    s = segments.select("*", F.explode(span(F.col("x1"), F.col("x2"))).alias("cx")).select("*", F.explode(span(F.col("y1"), F.col("y2"))).alias("cy"))
    p = points.withColumn("cx", cell(F.col("x"), radius)).withColumn("cy", cell(F.col("y"), radius))
    d = segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))) if distance is None else distance
    hit = p.join(s, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius)
    return hit.groupBy("id").agg(F.min(F.struct("d", "label")).alias("m")).select("id", "m.label", "m.d")


def box_distance(x: Column, y: Column, x0: Column, y0: Column, low: float, high: float) -> Column:
    """The distance of a point from the nearest side of the square from (x0 + low, y0 + low) to (x0 + high,
    y0 + high). What lies beyond a side is measured from (x0, y0), what lies before it from the point."""
    after = lambda v, v0, at: v - v0 - at
    before = lambda v, v0, at: v0 + at - v
    inner = F.least(after(x, x0, low), before(x, x0, high), after(y, y0, low), before(y, y0, high))
    out = lambda v, v0: F.pow(F.greatest(before(v, v0, low), F.lit(0.0), after(v, v0, high)), F.lit(2))
    inside = x.between(x0 + low, x0 + high) & y.between(y0 + low, y0 + high)
    return F.when(inside, inner).otherwise(F.sqrt(out(x, x0) + out(y, y0)))


def touching(polygons: DataFrame, buffer: float) -> DataFrame:
    """(label, other) both ways for polygons(label, ring) whose sides come within buffer of each other:
    a corner of one that near a side of the other, or sides that cross."""
    s = ring_segments(polygons)
    span = lambda a, b: F.sequence(cell(F.least(a, b) - buffer, 10 * buffer), cell(F.greatest(a, b) + buffer, 10 * buffer))
    dealt = s.select("*", F.explode(span(F.col("x1"), F.col("x2"))).alias("cx")).select("*", F.explode(span(F.col("y1"), F.col("y2"))).alias("cy"))
    o = dealt.select("cx", "cy", F.col("label").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    a, b = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"o{c}") for c in ("x1", "y1", "x2", "y2")]
    close = F.least(segment_distance(a[0], a[1], *b), segment_distance(a[2], a[3], *b), segment_distance(b[0], b[1], *a), segment_distance(b[2], b[3], *a)) <= buffer
    turn = lambda p, q, x, y: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
    cross = (turn(a[:2], a[2:], b[0], b[1]) * turn(a[:2], a[2:], b[2], b[3]) < 0) & (turn(b[:2], b[2:], a[0], a[1]) * turn(b[:2], b[2:], a[2], a[3]) < 0)
    return dealt.join(o, ["cx", "cy"]).where((F.col("label") != F.col("other")) & (close | cross)).select("label", "other").distinct()


def densified(points: DataFrame, step: float) -> DataFrame:
    """(route, s, x, y): a point each ``step`` along the line through points(route, i, x, y), from its
    start to before its end. Every segment makes the points that lie on it, so nothing is joined."""
    w = Window.partitionBy("route").orderBy("i")
    d = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    p = points.select("route", "i", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null").withColumn("d", d)
    p = p.withColumn("b", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    first, last = F.ceil(F.col("a") / step), F.ceil(F.col("b") / step) - 1
    p = p.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)))).withColumn("s", F.col("k") * step)
    at = F.coalesce(F.try_divide(F.col("s") - F.col("a"), F.col("d")), F.lit(0.0))
    return p.select("route", "s", (F.col("x") + (F.col("x2") - F.col("x")) * at).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * at).alias("y"))


def events_along(dense: DataFrame, marks: DataFrame, tolerance: float, merge: float) -> DataFrame:
    """(route, n): marks(id, x, y) within tolerance of the route's points, each at its nearest one;
    neighbours at most ``merge`` apart along the route count once."""
    p = dense.select(F.struct("route", "s").alias("id"), "x", "y")
    hit = near(marks, p, tolerance).groupBy("id", F.col("other.route").alias("route")).agg(F.min(F.struct("d", F.col("other.s").alias("s"))).alias("m"))
    return merged_count(hit.select("route", F.col("m.s").alias("s")), ["route"], "s", merge)


def covered_km(dense: DataFrame, marks: DataFrame, tolerance: float, step: float, gap: float = 500.0) -> DataFrame:
    """(route, km, passages): how much of a route lies within tolerance of marks(id, x, y), by its points
    each ``step`` apart, and in how many stretches more than ``gap`` apart."""
    p = dense.select(F.struct("route", "s").alias("id"), "x", "y")
    on = near(p, marks, tolerance).select("id").distinct().select("id.route", "id.s")
    km = on.groupBy("route").agg((F.count("*") * step / 1000).alias("km"))
    return km.join(merged_count(on, ["route"], "s", gap).withColumnRenamed("n", "passages"), "route")


def coded_km(points: DataFrame, spans: DataFrame, good: tuple[int, ...]) -> DataFrame:
    """(route, km) in spans(route, a, b, code) of point places whose code isn't good, of points(route, i,
    metres), metres being of the segment that ends in a point."""
    w = Window.partitionBy("route").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = points.select("route", "i", F.sum("metres").over(w).alias("cum"))
    n = points.groupBy("route").agg(F.max("i").alias("end"))
    s = spans.where(~F.col("code").isin(*good)).join(n, "route").withColumn("b", F.least("b", "end"))
    at = lambda c: p.select("route", F.col("i").alias(c), F.col("cum").alias(f"at_{c}"))
    return s.join(at("a"), ["route", "a"]).join(at("b"), ["route", "b"]).groupBy("route").agg((F.sum(F.col("at_b") - F.col("at_a")) / 1000).alias("km"))


def nearest(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(id, other, d): the nearest other within radius, ties to the smaller."""
    return near(points, others, radius).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring (an array of structs x, y): crossings of a ray, counted."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1))

    def crossing(p: Column, q: Column) -> Column:
        cut = (p["y"] > y) != (q["y"] > y)
        at = F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]
        return F.when(cut & (x < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, after, crossing), F.lit(0), lambda s, c: s + c) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies on a side of a ring (an array of structs x, y)."""
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))

    def at(p: Column, q: Column) -> Column:
        level = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return level & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(F.zip_with(ring, after, at), lambda c: c)


def locate(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, label): the smallest polygon that holds each point, of polygons(label, area, ring, x0, y0,
    x1, y1); candidates come from the grid cells that a bounding box covers. A ray's crossings leave a
    point on a shared side to one of two neighbours; polygons whose column ``open`` (if there is one) is
    true hold no point of their sides."""
    span = lambda lo, hi: F.sequence(cell(F.col(lo), size), cell(F.col(hi), size))
    boxes = polygons.select("*", F.explode(span("x0", "x1")).alias("cx")).select("*", F.explode(span("y0", "y1")).alias("cy"))
    p = points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    at = F.col("x"), F.col("y"), F.col("ring")
    held = in_polygon(*at) & ~(F.col("open") & on_ring(*at)) if "open" in polygons.columns else in_polygon(*at)
    hit = p.join(boxes, ["cx", "cy"]).where(held)
    found = hit.groupBy("id").agg(F.min_by("label", F.struct("area", "label")).alias("label"))
    return points.select("id").join(found, "id", "left")


def merged_count(marks: DataFrame, by: list[str], at: str, tolerance: float) -> DataFrame:
    """(by, n): marks closer than tolerance to the one before are the same."""
    gap = F.col(at) - F.lag(at, 1).over(Window.partitionBy(*by).orderBy(at))
    return marks.withColumn("_g", gap).groupBy(*by).agg((F.count_if(F.col("_g") > tolerance) + 1).alias("n"))
