"""Probability forecasts in long form: (region, h, lead, p), where h is the hour of departure and
lead counts hours after it. Everything is causal: only hours before h are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import by_region, last_rows

LEADS = 19


def leads(frame: DataFrame, n: int = LEADS) -> DataFrame:
    return frame.withColumn("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def climatology(panel: DataFrame, period: int = 168) -> DataFrame:
    """(region, slot, p): mean presence by hour of the week."""
    return panel.groupBy("region", F.pmod("h", F.lit(period)).alias("slot")).agg(F.avg("a").alias("p"))


def from_climatology(hours: DataFrame, table: DataFrame, period: int = 168, n: int = LEADS) -> DataFrame:
    """(region, h, lead, p) for hours(region, h)."""
    cells = leads(hours.select("region", "h"), n).withColumn("slot", F.pmod(F.col("h") + F.col("lead"), F.lit(period)))
    return cells.join(table, ["region", "slot"], "left").select("region", "h", "lead", F.coalesce("p", F.lit(0.0)).alias("p"))


def _rates(aa: Column, n1: Column, ba: Column, n0: Column) -> dict[str, Column]:
    """Transition rates from counts: 1 to 1, from 1, 0 to 1, from 0."""
    p11 = aa.cast("double") / F.greatest(n1, F.lit(1))
    p01 = ba.cast("double") / F.greatest(n0, F.lit(1))
    return {"p11": p11, "p01": p01, "pi": p01 / F.greatest(1 - p11 + p01, F.lit(1e-9)), "lam": p11 - p01}


def _pairs(panel: DataFrame) -> DataFrame:
    """Transitions into each hour: before is null for a region's first."""
    b = F.lag("a", 1).over(by_region())
    return panel.withColumn("n1", b).withColumn("aa", b * F.col("a")).withColumn("n0", 1 - b).withColumn("ba", (1 - b) * F.col("a"))


def markov(panel: DataFrame) -> DataFrame:
    """(region, p11, p01, pi, lam) over all hours of the panel."""
    s = _pairs(panel).groupBy("region").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("aa", "n1", "ba", "n0")))
    return s.select("region", *(c.alias(k) for k, c in _rates(*(F.col(c) for c in ("aa", "n1", "ba", "n0"))).items()))


def from_markov(state: DataFrame, params: DataFrame, n: int = LEADS) -> DataFrame:
    """(region, h, lead, p) for state(region, h, a): a is the presence known at departure."""
    p = F.col("pi") + (F.col("a") - F.col("pi")) * F.pow("lam", F.col("lead") + 1)
    return leads(state.join(params, "region"), n).select("region", "h", "lead", p.alias("p"))


def markov_rolling(panel: DataFrame, days: int) -> DataFrame:
    """(region, day, p11, p01, pi, lam) for each day: from the transitions wholly inside the days before it."""
    p = _pairs(panel)
    w = last_rows(24 * days - 1)
    summed = p.select("region", "h", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("aa", "n1", "ba", "n0")))
    ends = summed.where(F.pmod(F.col("h") + 1, F.lit(24)) == 0).withColumn("day", ((F.col("h") + 1) / 24).cast("long"))
    return ends.select("region", "day", *(c.alias(k) for k, c in _rates(*(F.col(c) for c in ("aa", "n1", "ba", "n0"))).items()))


def state_bin(active: Column, elapsed: Column, since: Column) -> Column:
    """Bins of time in state: inactive by hours since the end, active by hours since the start."""
    idle = F.when(since < 1, 0).when(since < 3, 1).when(since < 12, 2).otherwise(3)
    busy = F.when(elapsed < 0.5, 4).when(elapsed < 1, 5).when(elapsed < 2, 6).when(elapsed < 4, 7).when(elapsed < 8, 8).when(elapsed < 24, 9).otherwise(10)
    return F.when(active == 1, busy).otherwise(idle).cast("long")


def hazard(states: DataFrame, panel: DataFrame, n: int = LEADS) -> DataFrame:
    """(bin, lead, n, p): how often presence holds lead hours after an instant in a state bin, of
    states(region, h, bin)."""
    cells = leads(states, n).withColumn("at", F.col("h") + F.col("lead"))
    truth = panel.select("region", F.col("h").alias("at"), "a")
    return cells.join(truth, ["region", "at"]).groupBy("bin", "lead").agg(F.count("*").alias("n"), F.avg("a").alias("p"))


def semi_markov(states: DataFrame, panel: DataFrame, hours: DataFrame, days: int = 60, n: int = LEADS) -> DataFrame:
    """(region, h, lead, p) for hours(region, h): how often presence held lead hours after instants of
    the same state bin, over all regions and the instants of the ``days`` days before whose last
    target hour is over, refitted each day; in inactive bins times the region's own level (0.2 to 5),
    from what lead 6 held against what the rates expect. A bin without instants takes the mean of
    the lead's other bins. states(region, h, active, bin) has a row for each instant.

    Days are counted so that the instants which have ended by day D are just those of the days up to
    D - 1; of the earliest one only its last hours are inside. So windows are sums of daily rows."""
    late = n - 1
    cells = leads(states, n).withColumn("at", F.col("h") + F.col("lead"))
    cells = cells.join(panel.select("region", F.col("h").alias("at"), F.col("a").alias("y")), ["region", "at"])
    cells = cells.withColumn("s", F.floor((F.col("h") + late) / 24)).withColumn("inside", F.pmod(F.col("h") + late, F.lit(24)) >= late)

    def daily(rows: DataFrame, by: list[str]) -> DataFrame:
        one, y = F.lit(1), F.col("y")
        part = lambda x: F.sum(F.when(F.col("inside"), x).otherwise(0))
        return rows.groupBy(*by, "s").agg(F.sum(one).alias("n"), F.sum(y).alias("y"), part(one).alias("n_late"), part(y).alias("y_late"))

    def window(table: DataFrame, by: list[str], asked: DataFrame) -> DataFrame:
        """(by, day, n, y) of the window before each day, zero where nothing is."""
        zero = [F.lit(0).cast("long").alias(c) for c in ("n", "y", "n_late", "y_late")]
        every = table.withColumn("ask", F.lit(False)).unionByName(asked.select(*by, F.col("day").alias("s"), *zero, F.lit(True).alias("ask")))
        w = Window.partitionBy(*by).orderBy("s")
        total = lambda c: F.coalesce(F.sum(c).over(w.rangeBetween(-(days - 1), -1)), F.lit(0)) + F.coalesce(F.sum(f"{c}_late").over(w.rangeBetween(-days, -days)), F.lit(0))
        return every.select(*by, F.col("s").alias("day"), "ask", total("n").alias("n"), total("y").alias("y")).where("ask").drop("ask")

    wanted = hours.select("region", "h").distinct().withColumn("day", F.floor(F.col("h") / 24))
    when = wanted.select("day").distinct()
    bins = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("bin")
    pooled = window(daily(cells, ["bin", "lead"]), ["bin", "lead"], leads(when.select("day", bins), n))
    own = F.try_divide(F.col("y").cast("double"), F.col("n"))
    rate = pooled.withColumn("r", own).withColumn("rate", F.coalesce("r", F.avg("r").over(Window.partitionBy("day", "lead")))).select("day", "bin", "lead", "rate")
    idle = cells.where("active = 0 and lead = 6")
    by_region = window(daily(idle, ["region", "bin"]), ["region", "bin"], wanted.select("region", "day").distinct().select("region", "day", bins).where("bin < 4"))
    level = by_region.join(rate.where("lead = 6").drop("lead"), ["day", "bin"]).groupBy("region", "day").agg(
        ((F.sum("y") + 0.5) / (F.sum(F.col("n") * F.coalesce("rate", F.lit(0.0))) + 0.5)).alias("level")
    )
    level = level.withColumn("level", F.least(F.greatest("level", F.lit(0.2)), F.lit(5.0)))
    now = states.select("region", "h", "active", "bin").join(wanted, ["region", "h"]).join(rate, ["day", "bin"]).join(level, ["region", "day"])
    p = F.when(F.col("active") == 0, F.least(F.greatest(F.col("rate") * F.col("level"), F.lit(0.0)), F.lit(1.0))).otherwise(F.col("rate"))
    return now.select("region", "h", "lead", p.alias("p"))


def causal(model: DataFrame, now: DataFrame) -> DataFrame:
    """(region, h, lead, p) of model(region, row_h, k, p): the forecast of row h - 1 serves departure
    h with lead k - 1; at lead 0 an alert that runs now (now(region, h, active)) is certain."""
    f = model.select("region", (F.col("row_h") + 1).alias("h"), (F.col("k") - 1).alias("lead"), "p")
    sure = F.when(F.col("lead") == 0, F.greatest("p", F.coalesce(F.col("active").cast("double"), F.lit(0.0)))).otherwise(F.col("p"))
    return f.join(now, ["region", "h"], "left").select("region", "h", "lead", sure.alias("p"))


def missing(rows: DataFrame, forecast: DataFrame) -> DataFrame:
    """The (region, h) of rows for which there is no forecast."""
    return rows.select("region", "h").distinct().join(forecast.select("region", "h").distinct(), ["region", "h"], "left_anti")


def blend(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    on = ["region", "h", "lead"]
    return a.join(b.withColumnRenamed("p", "_q"), on).select(*on, (F.col("p") * share + F.col("_q") * (1 - share)).alias("p"))


def day_mean_to_date(panel: DataFrame, cutoff: int) -> DataFrame:
    """(region, rate): the mean of a before cutoff, by which later rates may be normalised without leaking."""
    return panel.groupBy("region").agg(F.coalesce(F.avg(F.when(F.col("h") < cutoff, F.col("a"))), F.lit(0.0)).alias("rate"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "Window", "F")]
