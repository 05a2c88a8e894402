"""Scans of the input formats: alert logs, polygons, routes, graphs, forecasts, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import parse_profile

ALERTS = "oblast string, raion string, hromada string, level string, started_at string, finished_at string"
STORMS = "EVENT_TYPE string, STATE string, CZ_TIMEZONE string, BEGIN_YEARMONTH int, BEGIN_DAY int, BEGIN_TIME int, END_YEARMONTH int, END_DAY int, END_TIME int"
ROUTES = (
    "metadata struct<engine: struct<version: string>>, features array<struct<geometry: struct<coordinates: array<array<double>>>, "
    "properties: struct<summary: struct<distance: double, duration: double>, segments: array<struct<steps: array<struct<duration: double, way_points: array<int>>>>>, "
    "extras: struct<surface: struct<values: array<array<int>>>>>>>"
)
POLYGONS = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def alert_log(spark: SparkSession, path: str, aliases: dict[str, str] | None = None, suffix: str = " oblast") -> DataFrame:
    """A CSV log, gzipped or not, cleaned: exact duplicates go, swapped region and district columns
    are put right, apostrophes and spaces unified, renamed regions mapped, rows without usable times
    dropped. A gzip file is one task; the rows are dealt out before anything else."""
    d = spark.read.schema(ALERTS).option("header", True).csv(path).repartition(spark.sparkContext.defaultParallelism).dropDuplicates()
    swap = F.col("raion").endswith(suffix) & ~F.coalesce(F.col("oblast").endswith(suffix), F.lit(False))
    swap = F.coalesce(swap, F.lit(False))
    d = d.select(F.when(swap, F.col("raion")).otherwise(F.col("oblast")).alias("oblast"), F.when(swap, F.col("oblast")).otherwise(F.col("raion")).alias("raion"), "hromada", "level", "started_at", "finished_at")
    for c in ("oblast", "raion"):
        d = d.withColumn(c, normalised(F.col(c), aliases or {}))
    for c in ("started_at", "finished_at"):
        d = d.withColumn(c, F.try_to_timestamp(c))
    return d.dropna(subset=["oblast", "started_at", "finished_at"])


def dated(spark: SparkSession, path: str, schema: str, dates: dict[str, str]) -> DataFrame:
    """A CSV with date columns in formats of their own; a value that isn't one becomes null."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d.withColumns({c: F.try_to_timestamp(c, F.lit(f)) for c, f in dates.items()})


def normalised(c: F.Column, aliases: dict[str, str]) -> F.Column:
    """One apostrophe, single spaces, and current names."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, "[’ʼ`']", "’"), r"\s+", " "))
    if not aliases:
        return c
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c)


def storm_events(spark: SparkSession, glob: str, kinds: list[str]) -> DataFrame:
    """Yearly CSVs by glob: (state, started_at, finished_at) in UTC from local times with an offset
    in the zone's name (CST-6)."""
    d = spark.read.schema(STORMS).option("header", True).csv(glob).where(F.col("EVENT_TYPE").isin(*kinds))
    offset = F.try_to_number(F.regexp_extract("CZ_TIMEZONE", r"([+-]?\d+)$", 1), F.lit("S99")).cast("int")

    def at(part: str) -> F.Column:
        ym, hm = F.col(f"{part}_YEARMONTH"), F.col(f"{part}_TIME")
        local = F.try_make_timestamp_ntz((ym / 100).cast("int"), ym % 100, F.col(f"{part}_DAY"), (hm / 100).cast("int"), hm % 100, F.lit(0))
        return local - F.make_dt_interval(hours=offset)

    return d.select(F.upper("STATE").alias("state"), at("BEGIN").alias("started_at"), at("END").alias("finished_at"), F.col("_metadata.file_path").alias("file")).dropna()


def polygons(spark: SparkSession, path: str, name: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(label, area, ring, x0, y0, x1, y1) of each outer ring in a GeoJSON file, smallest first
    wherever a point lies in several."""
    f = spark.read.schema(POLYGONS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    rings = f.select(F.col("f.properties")[name].alias("label"), F.explode(F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(many)).alias("p"))
    ring = F.transform(F.col("p")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    r = rings.select(normalised(F.col("label"), aliases or {}).alias("label"), ring.alias("ring"))
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("ring", after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2
    xs, ys = F.transform("ring", lambda c: c["x"]), F.transform("ring", lambda c: c["y"])
    return r.select("label", area.alias("area"), "ring", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def districts(spark: SparkSession, path: str, name: str, group: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(grp, districts) of a GeoJSON file: each group's districts (name, ring), sorted by name."""
    f = spark.read.schema(POLYGONS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    single = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    p = f.select(normalised(F.col("f.properties")[group], aliases or {}).alias("grp"), F.col("f.properties")[name].alias("name"), F.explode(F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(many)).alias("p"))
    ring = F.transform(F.col("p")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    return p.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("name", ring.alias("ring")))).alias("districts"))


def route_points(spark: SparkSession, path: str, corridor: str) -> DataFrame:
    """(corridor, route, i, lon, lat, km_total, h_total) of a routing service's GeoJSON answer."""
    f = spark.read.schema(ROUTES).option("multiLine", True).json(path).select(F.posexplode("features").alias("route", "f"))
    return f.select(F.lit(corridor).alias("corridor"), "route", F.posexplode("f.geometry.coordinates").alias("i", "c"), (F.col("f.properties.summary.distance") / 1000).alias("km_total"), (F.col("f.properties.summary.duration") / 3600).alias("h_total")).select(
        "corridor", "route", "i", F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"), "km_total", "h_total"
    )


def route_steps(spark: SparkSession, path: str, corridor: str) -> DataFrame:
    """(corridor, route, step, first, last, duration_s): which points each step spans."""
    f = spark.read.schema(ROUTES).option("multiLine", True).json(path).select(F.posexplode("features").alias("route", "f"))
    steps = F.flatten(F.transform("f.properties.segments", lambda s: s["steps"]))
    s = f.select("route", F.posexplode(steps).alias("step", "s"))
    return s.select(F.lit(corridor).alias("corridor"), "route", "step", F.col("s.way_points")[0].alias("first"), F.col("s.way_points")[1].alias("last"), F.col("s.duration").alias("duration_s"))


def route_extras(spark: SparkSession, path: str, corridor: str) -> DataFrame:
    """(corridor, route, a, b, code): the spans of points with one surface."""
    f = spark.read.schema(ROUTES).option("multiLine", True).json(path).select(F.posexplode("features").alias("route", "f"))
    s = f.select("route", F.explode("f.properties.extras.surface.values").alias("v"))
    return s.select(F.lit(corridor).alias("corridor"), "route", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("code"))


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of nodes.csv and edges.csv; an edge's profile is a JSON list in one column."""
    nodes = spark.read.schema("node_id int, lon double, lat double, city string").option("header", True).csv(f"{folder}/nodes.csv")
    edges = spark.read.schema("u int, v int, length_m double, time_s double, profile_json string").option("header", True).option("escape", '"').csv(f"{folder}/edges.csv")
    return nodes, edges.withColumn("profile", parse_profile("profile_json")).drop("profile_json")


def osm(spark: SparkSession, nodes_path: str, ways_path: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lon, lat, tags) and the ways (id, refs, tags) of given road classes, from an extract that
    was converted to Parquet (binary.roads reads one itself); kmh is the numeric part of the maximum
    speed."""
    ways = spark.read.parquet(ways_path).where(F.col("tags")["highway"].isin(*classes))
    speed = F.expr("try_cast(split(tags['maxspeed'], ' ')[0] as double)")
    bridge = F.coalesce(F.col("tags")["bridge"] != "no", F.lit(False))
    return spark.read.parquet(nodes_path), ways.withColumn("kmh", speed).withColumn("bridge", bridge)


def forecasts(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(hour, region, k, p) from Parquet; a bound on hour is pushed to the row groups."""
    d = spark.read.parquet(path)
    return d.where(F.col("hour") >= F.lit(since).cast("timestamp")) if since else d


def results(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result documents of many folders, with the file that each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_path"))
