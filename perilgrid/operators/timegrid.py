"""Intervals on an hour grid. Hours are whole numbers counted from an epoch, so that every later
join and window is on (region, h) and needs no calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, taken as UTC."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def hour_of(us: Column, epoch_us: int) -> Column:
    """The hour that holds an instant given in microseconds."""
    return F.floor((us - epoch_us) / (3600 * SECOND)).cast("long")


def clean_log(log: DataFrame, keys: list[str], start: str, finish: str) -> DataFrame:
    """Exact duplicates and rows without usable times go."""
    return log.dropDuplicates().dropna(subset=[*keys, start, finish])


def expand(log: DataFrame, variant: str, epoch_us: int, first: int, last: int, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Distinct (by, h) with an interval in that hour, of log(by, s_us, f_us), clipped to [first, last].

    variant: 'truth' counts the hours of [start, finish - 1 s] and drops intervals that this empties;
    'feature' counts the finish hour too; 'point' is 'truth' with at least the start hour."""
    lo = hour_of(F.col("s_us"), epoch_us)
    hi = hour_of(F.col("f_us") - (0 if variant == "feature" else SECOND), epoch_us)
    if variant == "point":
        hi = F.greatest(hi, lo)
    cut = log.select(*by, F.greatest(lo, F.lit(first)).alias("lo"), F.least(hi, F.lit(last)).alias("hi")).where("lo <= hi")
    return cut.select(*by, F.explode(F.sequence("lo", "hi")).alias("h")).distinct()


def grid(spark, regions: int, first: int, last: int) -> DataFrame:
    """Every (region, h): one range, no join."""
    n = last - first + 1
    return spark.range(regions * n).select((F.col("id") / n).cast("long").alias("region"), (F.col("id") % n + first).alias("h"))


def fill(cells: DataFrame, hits: DataFrame, by: tuple[str, ...] = ("region", "h")) -> DataFrame:
    """cells with a = 1 where hits has a row, else 0."""
    return cells.join(hits.withColumn("a", F.lit(1)), list(by), "left").select(*by, F.coalesce("a", F.lit(0)).cast("long").alias("a"))


def merge(log: DataFrame, by: str = "region") -> DataFrame:
    """Disjoint (by, s_us, f_us): overlapping and touching intervals become one."""
    w = Window.partitionBy(by).orderBy("s_us", "f_us")
    before = F.max("f_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("s_us") > before), 1).otherwise(0)
    run = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("opens", opens).withColumn("run", run).groupBy(by, "run").agg(F.min("s_us").alias("s_us"), F.max("f_us").alias("f_us")).drop("run")


def as_of(probes: DataFrame, events: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """probes(by, at, ...) with values of the last event at or before each: one union and one sorted
    window instead of a range join."""
    marked = events.select(by, at, F.struct(*values).alias("_v"), F.lit(0).alias("_probe"))
    both = probes.withColumn("_v", F.lit(None).cast(marked.schema["_v"].dataType)).withColumn("_probe", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_probe = 1").select(*probes.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def active_at(probes: DataFrame, log: DataFrame, by: str = "region") -> DataFrame:
    """probes(by, at) with active: started <= at < the running maximum of finishes, for intervals overlap."""
    w = Window.partitionBy(by).orderBy("s_us").rangeBetween(Window.unboundedPreceding, 0)
    running = log.select(by, F.col("s_us").alias("at"), F.max("f_us").over(w).alias("until"))
    return as_of(probes, running, by, "at", ["until"]).withColumn("active", F.coalesce((F.col("at") < F.col("until")).cast("long"), F.lit(0).cast("long")))


def instant_state(probes: DataFrame, merged: DataFrame, by: str = "region", most_elapsed: float = 72.0, most_since: float = 168.0) -> DataFrame:
    """probes(by, at) with active, elapsed_h (since the running interval began) and since_end_h
    (since the last one ended; most_since if none did)."""
    found = as_of(probes, merged.select(by, F.col("s_us").alias("at"), F.col("s_us").alias("began"), F.col("f_us").alias("ended")), by, "at", ["began", "ended"])
    active = F.coalesce(F.col("at") < F.col("ended"), F.lit(False))
    hours = lambda since: (F.col("at") - F.col(since)) / (3600.0 * SECOND)
    return found.select(
        by, "at", active.cast("long").alias("active"),
        F.when(active, F.least(hours("began"), F.lit(most_elapsed))).otherwise(0.0).alias("elapsed_h"),
        F.when(active, 0.0).otherwise(F.least(F.coalesce(hours("ended"), F.lit(most_since)), F.lit(most_since))).alias("since_end_h"),
    )


def instants_inside(log: DataFrame, epoch_us: int, by: str = "region", least_us: int = 60 * SECOND) -> DataFrame:
    """Distinct (by, h) of the full hours h:00 with s <= h:00 < max(f, s + least)."""
    hour = 3600 * SECOND
    lo = F.ceil((F.col("s_us") - epoch_us) / hour).cast("long")
    hi = F.floor((F.greatest(F.col("f_us"), F.col("s_us") + least_us) - 1 - epoch_us) / hour).cast("long")
    cut = log.select(by, lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    return cut.select(by, F.explode(F.sequence("lo", "hi")).alias("h")).distinct()
