"""Road graphs from raw data: mapped ways, recorded routes and loose line segments. Edges are
(u, v, metres, seconds, profile); a profile lists (region, metres, seconds) in driving order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geo, graph

#: km/h by class of road.
SPEED = {"motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 75, "primary_link": 40, "secondary": 60, "secondary_link": 35}


def speed(highway: Column, maxspeed: Column) -> Column:
    """km/h of a way: its class's, or the posted one if that is a number and lower."""
    by_class = F.create_map(*(F.lit(x) for kv in SPEED.items() for x in (kv[0], float(kv[1]))))[highway]
    posted = F.split(F.trim(maxspeed), " ")[0].try_cast("double")
    return F.coalesce(F.least(by_class, posted), by_class)


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, i, a, b, metres, seconds, lon, lat, cut) of each step of ways(way, refs, kmh) between
    neighbouring nodes(ref, lon, lat); lon, lat: its middle; cut: b is used by another step of any way,
    or ends the way, so an edge ends there. Nodes without a place are left out of their ways."""
    pts = ways.select("way", "kmh", F.posexplode("refs").alias("i", "ref")).join(nodes.select("ref", "lon", "lat"), "ref")
    w = Window.partitionBy("way").orderBy("i")
    pts = pts.withColumn("first", F.row_number().over(w) == 1).withColumn("last", F.lead("i").over(w).isNull())
    use = pts.groupBy("ref").agg(F.sum(F.when(F.col("first") | F.col("last"), 2).otherwise(1)).alias("use"))
    pts = pts.join(use, "ref")
    to = lambda c: F.lead(c).over(w)
    steps = pts.select("way", "kmh", "i", F.col("ref").alias("a"), to("ref").alias("b"), "lon", "lat", to("lon").alias("lon2"), to("lat").alias("lat2"), (to("last") | (to("use") > 1)).alias("cut"))
    steps = steps.where("b is not null").withColumn("metres", geo.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    middle = lambda c: ((F.col(c) + F.col(f"{c}2")) / 2).alias(c)
    return steps.select("way", "i", "a", "b", "metres", (F.col("metres") * 3.6 / F.col("kmh")).alias("seconds"), middle("lon"), middle("lat"), "cut")


def junction_edges(steps: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Edges between the cuts of steps(way, i, a, b, metres, seconds, region, cut). A step goes into the
    piece before it if both are of one region and the piece stays within PIECE_S. Edges of which half
    or more lies in excluded regions go; of edges with the same ends the fastest stays."""
    before = Window.partitionBy("way").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.count_if("cut").over(before), F.lit(0))
    x = F.array_sort(F.collect_list(F.struct("i", "region", "metres", "seconds")))
    e = steps.withColumn("run", run).groupBy("way", "run").agg(F.min_by("a", "i").alias("u"), F.max_by("b", "i").alias("v"), F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"), x.alias("x"))
    pieces = F.transform("x", lambda p: F.struct(p["region"].alias("region"), p["metres"].alias("metres"), p["seconds"].alias("seconds")))
    e = e.where("u <> v").withColumn("profile", graph.folded(pieces, joint=True))
    if excluded:
        out = F.aggregate("profile", F.lit(0.0), lambda s, p: s + F.when(p["region"].isin(*excluded), p["metres"]).otherwise(0.0))
        e = e.where(out < 0.5 * F.col("metres"))
    return fastest(e)


def fastest(edges: DataFrame) -> DataFrame:
    """Of edges with the same ends the fastest, from the smaller end on."""
    ahead = F.col("u") < F.col("v")
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "metres", "seconds", F.when(ahead, F.col("profile")).otherwise(graph.turned("profile")).alias("profile"))
    best = e.groupBy("u", "v").agg(F.min_by(F.struct("metres", "seconds", "profile"), F.struct("seconds", "metres", F.to_json("profile"))).alias("x"))
    return best.select("u", "v", "x.metres", "x.seconds", "x.profile")


def point_times(points: DataFrame, steps: DataFrame) -> DataFrame:
    """(route, i, lon, lat, metres, seconds): of each segment from point i to the next, its middle and
    length, and its share by length of the duration of the step that spans it; of points(route, i,
    lon, lat) and steps(route, first, last, duration_s). Segments of a step without length share alike."""
    w = Window.partitionBy("route").orderBy("i")
    to = lambda c: F.lead(c).over(w)
    seg = points.select("route", "i", "lon", "lat", to("lon").alias("lon2"), to("lat").alias("lat2")).where("lon2 is not null")
    seg = seg.withColumn("metres", geo.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    part = steps.where(F.col("last") > F.col("first")).withColumn("step", F.row_number().over(Window.partitionBy("route").orderBy("first", "last", "duration_s")))
    part = part.select("route", "step", "duration_s", F.explode(F.sequence("first", F.col("last") - 1)).alias("i"))
    d = seg.join(part, ["route", "i"], "left")
    by = Window.partitionBy("route", "step")
    share = F.coalesce(F.try_divide(F.col("metres"), F.sum("metres").over(by)), 1 / F.count("*").over(by))
    d = d.withColumn("seconds", F.coalesce(F.col("duration_s") * share, F.lit(0.0)))
    d = d.groupBy("route", "i", "lon", "lat", "lon2", "lat2", "metres").agg(F.sum("seconds").alias("seconds"))
    return d.select("route", "i", ((F.col("lon") + F.col("lon2")) / 2).alias("lon"), ((F.col("lat") + F.col("lat2")) / 2).alias("lat"), "metres", "seconds")


def traversal(segments: DataFrame, least_m: float = 2000.0) -> DataFrame:
    """(route, k, region, metres, enter_s, exit_s): the regions that segments(route, i, region, metres,
    seconds) cross, in order. A stay of less than least_m counts as one in the region before, but for
    the first; the rule looks back at what it has made, so it is a fold over a route's few stays."""
    w = Window.partitionBy("route").orderBy("i")
    new = F.coalesce((~F.col("region").eqNullSafe(F.lag("region").over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = segments.withColumn("new", new.cast("int"))
    s = s.withColumn("run", F.sum("new").over(upto)).withColumn("exit_s", F.sum("seconds").over(upto)).withColumn("enter_s", F.col("exit_s") - F.col("seconds"))
    runs = s.groupBy("route", "run").agg(F.first("region").alias("region"), F.sum("metres").alias("metres"), F.min("enter_s").alias("enter_s"), F.max("exit_s").alias("exit_s"))
    listed = runs.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("run", "region", "metres", "enter_s", "exit_s"))).alias("x"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["run"].alias("run"), last["region"].alias("region"), (last["metres"] + x["metres"]).alias("metres"), last["enter_s"].alias("enter_s"), x["exit_s"].alias("exit_s"))
        join = (x["metres"] < least_m) | last["region"].eqNullSafe(x["region"])
        return F.when(F.size(done) == 0, F.array(x)).when(join, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    merged = listed.select("route", F.posexplode(F.aggregate("x", F.slice("x", 1, 0), add)).alias("k", "y"))
    return merged.select("route", "k", "y.region", "y.metres", "y.enter_s", "y.exit_s")


def cell_edges(points: DataFrame, size: float = 150.0, old: str = "9.0") -> DataFrame:
    """(a, b, metres, seconds, region) between cells of points(route, version, i, x, y, metres, seconds,
    region), where metres, seconds and region are of the segment that ends in a point. A step from
    cell to cell counts all that was driven since the last one. Metres and pace are medians over all
    steps of a pair of cells; the pace of versions that begin with ``old`` is first brought to the
    others' level, by the median ratio over pairs that both have driven."""
    w = Window.partitionBy("route").orderBy("i")
    cell = F.struct(geo.cell(F.col("x"), size).alias("cx"), geo.cell(F.col("y"), size).alias("cy"))
    p = points.withColumn("cell", cell).withColumn("from", F.lag("cell").over(w))
    p = p.withColumn("moved", F.coalesce(F.col("from") != F.col("cell"), F.lit(False)))
    p = p.withColumn("g", F.coalesce(F.count_if("moved").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("from is not null")
    step = p.groupBy("route", "version", "g").agg(F.sum("metres").alias("d"), F.sum("seconds").alias("t"), F.max_by(F.struct("from", "cell", "moved", "region", "i"), "i").alias("x")).where("x.moved")
    step = step.select("route", "version", "d", "t", "x.region", "x.i", F.least("x.from", "x.cell").alias("a"), F.greatest("x.from", "x.cell").alias("b"))
    step = step.withColumn("old", F.col("version").startswith(old)).withColumn("pace", F.when(F.col("d") > 0, F.col("t") / F.col("d")))
    median = lambda c: F.percentile(c, 0.5)
    both = step.groupBy("a", "b").agg(median(F.when(F.col("old"), F.col("pace"))).alias("was"), median(F.when(~F.col("old"), F.col("pace"))).alias("now"))
    k = both.agg(F.coalesce(median(F.try_divide("now", "was")), F.lit(1.0)).alias("k"))
    step = step.crossJoin(F.broadcast(k))  # one row
    pace = F.when(F.col("old"), F.col("pace") * F.col("k")).otherwise(F.col("pace"))
    e = step.groupBy("a", "b").agg(median("d").alias("metres"), median(pace).alias("pace"), F.min_by("region", F.struct("route", "i")).alias("region"))
    return e.select("a", "b", "metres", (F.col("metres") * F.col("pace")).alias("seconds"), "region")


def time_factor(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(k): the median over known(s, t, seconds) of the known time to the graph's fastest one."""
    arc = graph.arcs(edges.select("u", "v", F.col("seconds").alias("w")))
    found = graph.many_to_many(known.select("s", "t"), arc)
    return found.join(known, ["s", "t"]).agg(F.percentile(F.col("seconds") / F.col("cost"), 0.5).alias("k"))


def scaled(edges: DataFrame, factor: DataFrame) -> DataFrame:
    """edges with all times multiplied by factor(k), one row."""
    e = edges.crossJoin(F.broadcast(factor.select("k")))
    longer = F.transform("profile", lambda p: F.struct(p["region"].alias("region"), p["metres"].alias("metres"), (p["seconds"] * F.col("k")).alias("seconds")))
    return e.select("u", "v", "metres", (F.col("seconds") * F.col("k")).alias("seconds"), longer.alias("profile"))


def crossings(lines: DataFrame, size: float) -> DataFrame:
    """(line, other, at): where straight lines(line, x1, y1, x2, y2) cross each other between their ends, as
    the share of line's length before the crossing; lines meet in the cells of their boxes."""
    span = lambda a, b: F.sequence(geo.cell(F.least(a, b), size), geo.cell(F.greatest(a, b), size))
    p = lines.select("line", "x1", "y1", "x2", "y2")
    dealt = p.select("*", F.explode(span(F.col("x1"), F.col("x2"))).alias("cx")).select("*", F.explode(span(F.col("y1"), F.col("y2"))).alias("cy"))
    other = dealt.select("cx", "cy", F.col("line").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = dealt.join(other, ["cx", "cy"]).where("line <> other").drop("cx", "cy").distinct()
    dx, dy, ox, oy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    gx, gy, cross = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1"), dx * oy - dy * ox
    found = pairs.withColumn("at", F.try_divide(gx * oy - gy * ox, cross)).withColumn("there", F.try_divide(gx * dy - gy * dx, cross))
    return found.where("at > 0 and at < 1 and there > 0 and there < 1").select("line", "other", "at")


def noded(lines: DataFrame, size: float) -> DataFrame:
    """lines(line, x1, y1, x2, y2, ...) cut at their crossings: (line, part, x1, y1, x2, y2, ...), the parts
    numbered from the line's start."""
    cuts = crossings(lines, size).groupBy("line").agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    d = lines.join(cuts, "line", "left").withColumn("ends", ends)
    pieces = F.arrays_zip(F.slice("ends", 1, F.size("ends") - 1).alias("a"), F.slice("ends", 2, F.size("ends") - 1).alias("b"))
    rest = [c for c in lines.columns if c not in ("line", "x1", "y1", "x2", "y2")]
    d = d.select("line", "x1", "y1", "x2", "y2", *rest, F.posexplode(pieces).alias("part", "p"))
    on = lambda lo, hi, at: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(at)
    return d.select("line", "part", on("x1", "x2", "p.a").alias("x1"), on("y1", "y2", "p.a").alias("y1"), on("x1", "x2", "p.b").alias("x2"), on("y1", "y2", "p.b").alias("y2"), *rest)


def snapped(lines: DataFrame, radius: float = 500.0) -> DataFrame:
    """(line, u, v): ends of lines(line, x1, y1, x2, y2) that lie within radius of one another, over any
    number of ends, are one node, named after its smallest end (2 line for a start, 2 line + 1 for an
    end). Lines whose ends are one node go."""
    ends = lines.select((F.col("line") * 2).alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(lines.select((F.col("line") * 2 + 1).alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    close = geo.pairs_within(ends, radius).select(F.col("id").alias("u"), F.col("other").alias("v"))
    of = graph.components(close, ends.select(F.col("id").alias("node")))
    a = of.where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("line"), F.col("component").alias("u"))
    b = of.where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("long").alias("line"), F.col("component").alias("v"))
    return a.join(b, "line").where("u <> v")


def line_profile(lines: DataFrame, regions: DataFrame, step: float) -> DataFrame:
    """(line, metres, seconds, profile) of straight lines(line, x1, y1, x2, y2, kmh), cut into equal
    parts of at most ``step``; a part is of the region whose centre is the nearest, of regions(label,
    x, y), a small table, and neighbouring parts of one region are one piece."""
    metres = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    p = lines.withColumn("metres", metres).withColumn("n", F.greatest(F.ceil(F.col("metres") / step), F.lit(1)))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("at", (F.col("j") + 0.5) / F.col("n"))
    p = p.withColumn("x", F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("at")).withColumn("y", F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("at"))
    r = regions.select("label", F.col("x").alias("rx"), F.col("y").alias("ry"))
    d = F.round(F.sqrt(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2)), 6)
    p = p.crossJoin(F.broadcast(r)).groupBy("line", "metres", "kmh", "n", "j").agg(F.min_by("label", F.struct(d, "label")).alias("region"))
    w = Window.partitionBy("line").orderBy("j")
    p = p.withColumn("new", (~F.col("region").eqNullSafe(F.lag("region").over(w))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.col("metres") / F.col("n")
    runs = p.groupBy("line", "metres", "kmh", "run").agg(F.first("region").alias("region"), F.sum(part).alias("m"))
    per_s = F.col("kmh") / 3.6
    listed = F.array_sort(F.collect_list(F.struct("run", "region", F.col("m").alias("metres"), (F.col("m") / per_s).alias("seconds"))))
    out = runs.groupBy("line", "metres", "kmh").agg(listed.alias("x"))
    pieces = F.transform("x", lambda q: F.struct(q["region"].alias("region"), q["metres"].alias("metres"), q["seconds"].alias("seconds")))
    return out.select("line", "metres", (F.col("metres") / per_s).alias("seconds"), pieces.alias("profile"))


def relabelled(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges whose pieces carry another level's names, of names(region, name), a small table; regions
    without one keep theirs, neighbouring pieces of one name are joined within PIECE_S."""
    table = names.agg(F.map_from_entries(F.collect_list(F.struct("region", "name"))).alias("to"))
    e = edges.crossJoin(F.broadcast(table))
    pieces = F.transform("profile", lambda p: F.struct(F.coalesce(F.try_element_at(F.col("to"), p["region"]), p["region"]).alias("region"), p["metres"].alias("metres"), p["seconds"].alias("seconds")))
    return e.withColumn("profile", graph.folded(pieces, joint=True)).drop("to")
