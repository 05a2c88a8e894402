"""Features of a complete (region, h, a) panel. All windows share one partitioning and order, so one
shuffle and one sort serve any number of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_region(region: str = "region", hour: str = "h") -> WindowSpec:
    return Window.partitionBy(region).orderBy(hour)


def last_rows(n: int, offset: int = 0) -> WindowSpec:
    """The n rows up to offset rows back."""
    return by_region().rowsBetween(-(n - 1) - offset, -offset)


def lag0(n: int, c: str = "a") -> Column:
    return F.coalesce(F.lag(c, n).over(by_region()), F.lit(0)).cast("long")


def rolling(n: int, c: str = "a") -> dict[str, Column]:
    w = last_rows(n)
    return {"mean": F.avg(c).over(w), "sum": F.sum(c).over(w), "std": F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))}


def rolling_sum(n: int, least: int, c: str = "a") -> Column:
    """Null until the frame holds at least so many rows."""
    w = last_rows(n)
    return F.when(F.count(c).over(w) >= least, F.sum(c).over(w))


def expanding_mean(c: str = "a") -> Column:
    return F.avg(c).over(by_region().rowsBetween(Window.unboundedPreceding, 0))


def difference(n: int, c: str = "a") -> Column:
    return F.col(c) - F.lag(c, n).over(by_region())


def with_runs(panel: DataFrame, most: int = 72) -> DataFrame:
    """run: how many hours a has had its present value, at most so many."""
    changed = F.when(F.col("a") == F.lag("a", 1).over(by_region()), 0).otherwise(1)
    island = F.sum("_c").over(by_region().rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("region", "_i").orderBy("h"))
    return panel.withColumn("_c", changed).withColumn("_i", island).withColumn("run", F.least(place, F.lit(most)).cast("long")).drop("_c", "_i")


def hours_since(c: str = "a", most: int = 720) -> Column:
    seen = F.last(F.when(F.col(c) == 1, F.col("h")), ignorenulls=True).over(by_region().rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.coalesce(F.col("h") - seen, F.lit(most)), F.lit(most)).cast("long")


def onset(c: str = "a") -> Column:
    return ((F.col(c) == 1) & (F.coalesce(F.lag(c, 1).over(by_region()), F.lit(0)) == 0)).cast("long")


def same_hour_mean(days: int, lead: int, c: str = "a") -> Column:
    """The mean at the target's clock hour over the days before: hours h + lead - 24 d that are known at h."""
    past = [F.lag(c, 24 * d - lead).over(by_region()) for d in range(1, days + 1) if 24 * d - lead >= 0]
    total, n = F.lit(0), F.lit(0)
    for p in past:
        total, n = total + F.coalesce(p, F.lit(0)), n + F.when(p.isNotNull(), 1).otherwise(0)
    return F.try_divide(total.cast("double"), n)


def mixed(panel: DataFrame, weights: DataFrame, c: str, name: str) -> DataFrame:
    """(region, h, name): sums of c over weights(region, other, w), a sparse matrix product."""
    other = panel.select(F.col("region").alias("other"), "h", F.col(c).alias("_x"))
    return weights.join(other, "other").groupBy("region", "h").agg(F.sum(F.col("w") * F.col("_x")).alias(name))


def hop_distance(adjacency: DataFrame, rounds: int = 3) -> DataFrame:
    """(region, other, hops): least hops up to 2 ** rounds, by squaring: a self-join that adds up
    distances and keeps the least."""
    d = adjacency.select("region", "other", F.lit(1).alias("hops")).distinct()
    d = d.unionByName(d.select("region").distinct().select("region", F.col("region").alias("other"), F.lit(0).alias("hops")))
    for _ in range(rounds):
        a = d.select("region", F.col("other").alias("mid"), F.col("hops").alias("h1"))
        b = d.select(F.col("region").alias("mid"), "other", F.col("hops").alias("h2"))
        d = a.join(b, "mid").groupBy("region", "other").agg(F.min(F.col("h1") + F.col("h2")).alias("hops"))
    return d


def neighbours_or_self(adjacency: DataFrame, regions: DataFrame) -> DataFrame:
    """Row-stochastic weights; a region without neighbours is its own."""
    alone = regions.select("region").join(adjacency, "region", "left_anti").select("region", F.col("region").alias("other"))
    return row_stochastic(adjacency.select("region", "other").unionByName(alone))


def all_mixed(panel: DataFrame, weights: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(region, h, names): sums over weights(region, other, w) of several columns at once; columns: from
    name to the column summed. Regions without weights get 0."""
    other = panel.select(F.col("region").alias("other"), "h", *(F.col(c).alias(n) for n, c in columns.items()))
    m = weights.join(other, "other").groupBy("region", "h").agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in columns))
    cells = panel.select("region", "h").join(m, ["region", "h"], "left")
    return cells.select("region", "h", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in columns))


#: Optional groups of the generic features.
GROUPS = ("lags", "onset", "inst", "regime", "anchor")


def generic(panel: DataFrame, adjacency: DataFrame, mates: DataFrame, groups: tuple[str, ...] = (), instant: DataFrame | None = None) -> DataFrame:
    """(region, h, a, features): lags, rolling means, time since, neighbours', group mates' and national
    levels, and the optional groups; of a complete panel(region, h, a), adjacency(region, other) and
    mates(region, grp). instant(region, h, active, elapsed_h, since_end_h) is the state at the end of
    hour h, for 'inst'. Only hours up to h are used. Windows by region share one shuffle and sort."""
    w = by_region()
    roll = {n: F.avg("a").over(last_rows(n)) for n in (3, 6, 24, 72, 168)}
    cols = {f"a{n}": F.lag("a", n).over(w) for n in (1, 2, 5)} | {f"r{n}": c for n, c in roll.items()} | {"since": hours_since()}
    if "lags" in groups:
        cols |= {f"a{n}": F.lag("a", n).over(w) for n in (3, 4, 6, 8, 12, 23, 24)}
    if "onset" in groups:
        cols |= {"on": onset()}
    if "anchor" in groups:
        cols |= {"rate28": F.avg("a").over(last_rows(672)), "rate42": F.avg("a").over(last_rows(1008)), "so_far": expanding_mean(), "before": F.lag("a", 1).over(w)}
    p = panel.join(mates.select("region", "grp"), "region").select("region", "grp", "h", "a", *(c.alias(n) for n, c in cols.items()))
    national = Window.partitionBy("h")
    p = p.withColumn("nat0", F.avg("a").over(national))
    if "lags" in groups:
        p = with_runs(p)
    if "onset" in groups:
        p = p.withColumn("on3", F.sum("on").over(last_rows(3))).withColumn("naton3", F.avg("on3").over(national))
    if "inst" in groups:
        p = p.join(instant.select("region", "h", F.col("active").alias("i_act"), F.col("elapsed_h").alias("i_elap"), F.col("since_end_h").alias("i_send")), ["region", "h"], "left")
        p = p.withColumn("i_nat", F.avg("i_act").over(national)).withColumn("i_nat_d", F.col("i_nat") - F.col("nat0"))
    if "regime" in groups:
        g = Window.partitionBy("grp", "h")
        p = p.withColumn("part", ((F.max("a").over(g) > 0) & (F.min("a").over(g) < 1)).cast("int")).withColumn("regime", F.avg("part").over(last_rows(720)))
    if "anchor" in groups:
        n1, n0 = F.col("before"), 1 - F.col("before")
        total = lambda x: F.when(F.count("before").over(last_rows(1008)) >= 24, F.sum(x).over(last_rows(1008)))
        p = p.withColumn("m_p11", total(n1 * F.col("a")) / F.greatest(total(n1), F.lit(1))).withColumn("m_p01", total(n0 * F.col("a")) / F.greatest(total(n0), F.lit(1)))
        p = p.withColumn("m_pi", F.coalesce(F.col("m_p01") / F.greatest(1 - F.col("m_p11") + F.col("m_p01"), F.lit(1e-6)), "so_far"))
        p = p.withColumn("m_p11", F.coalesce("m_p11", F.lit(0.0))).withColumn("m_p01", F.coalesce("m_p01", F.lit(0.0))).drop("before", "so_far")
    # the national series is one row an hour: its windows are small
    nat = p.groupBy("h").agg(F.first("nat0").alias("_n"), *([F.first("naton3").alias("_o")] if "onset" in groups else []))
    hours = Window.partitionBy().orderBy("h")
    nat = nat.withColumn("nat24", F.avg("_n").over(hours.rowsBetween(-23, 0)))
    if "lags" in groups:
        nat = nat.select("*", *((F.col("_n") - F.lag("_n", n).over(hours)).alias(f"nat_d{n}") for n in (1, 3, 24)))
    p = p.join(nat.drop("_n", "_o"), "h")
    regions = panel.select("region").distinct()
    near = neighbours_or_self(adjacency, regions)
    other = mates.select(F.col("region").alias("other"), "grp")
    own = neighbours_or_self(mates.select("region", "grp").join(other, "grp").where("region <> other").select("region", "other"), regions)
    more = {"nb0": "a", "nb6": "r6", "nb24": "r24"} | ({"nbon3": "on3"} if "onset" in groups else {}) | ({"i_nb": "i_act"} if "inst" in groups else {})
    p = p.join(all_mixed(p, near, more), ["region", "h"])
    p = p.join(all_mixed(p, own, {"ob0": "a", "ob6": "r6", "ob24": "r24"} | ({"i_ob": "i_act"} if "inst" in groups else {})), ["region", "h"])
    return p


def propagation(panel: DataFrame, adjacency: DataFrame, lift: DataFrame, instant: DataFrame) -> DataFrame:
    """(region, h, 13 features) of how onsets and activity spread: at one and two hops and along the
    lift(region, other, w) of upstream regions; instant(region, h, active) at the end of hour h."""
    before = F.lag("a", 1).over(by_region())
    p = panel.select("region", "h", "a", F.avg("a").over(last_rows(6)).alias("r6"), F.coalesce(((F.col("a") == 1) & (before == 0)).cast("double"), F.lit(0.0)).alias("on1"))
    p = p.withColumn("on3", F.sum("on1").over(last_rows(3)))
    p = p.join(instant.select("region", "h", F.col("active").cast("double").alias("act")), ["region", "h"], "left").fillna(0.0, ["act"])
    p = p.withColumn("new", F.col("act") * (1 - F.col("a"))).withColumn("naton3", F.avg("on3").over(Window.partitionBy("h")))
    hops = hop_distance(adjacency)
    one, two = (row_stochastic(hops.where(F.col("hops") == k).select("region", "other")) for k in (1, 2))
    out = p.select("region", "h", "on1", "on3", "naton3")
    for weights, columns in (
        (one, {"nbon1": "on1", "nbon3": "on3"}),
        (two, {"nb2_0": "a", "nb2_6": "r6", "i_nb2": "act", "nb2on3": "on3"}),
        (lift, {"up_on1": "on1", "up_on3": "on3", "up_inst": "act", "up_new": "new"}),
    ):
        out = out.join(all_mixed(p, weights, columns), ["region", "h"])
    return out


def row_stochastic(adjacency: DataFrame) -> DataFrame:
    """weights of adjacency(region, other): 1 / number of neighbours."""
    return adjacency.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("region")))


def two_hops(adjacency: DataFrame) -> DataFrame:
    """Row-stochastic weights of the regions at distance just two: a self-join with the direct ones taken off."""
    a = adjacency.select("region", F.col("other").alias("mid"))
    b = adjacency.select(F.col("region").alias("mid"), "other")
    far = a.join(b, "mid").where("region <> other").select("region", "other").distinct().join(adjacency, ["region", "other"], "left_anti")
    return row_stochastic(far)


def upstream_lift(panel: DataFrame, horizon: int = 3, least: int = 20) -> DataFrame:
    """(region, other, lift, w): how much likelier an onset in region is within ``horizon`` hours
    after one in other than at any hour; w: positive parts, each row summing to 1."""
    ahead = F.coalesce(F.max("on").over(by_region().rowsBetween(1, horizon)), F.lit(0))
    p = panel.withColumn("on", onset()).withColumn("next", ahead)
    base = p.groupBy("region").agg(F.avg("next").alias("base"))
    starts = p.where("on = 1").select(F.col("region").alias("other"), "h")
    enough = starts.groupBy("other").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    joint = starts.join(p.select("region", "h", "next"), "h").where("region <> other").groupBy("region", "other").agg(F.avg("next").alias("p"))
    lift = joint.join(enough, "other").join(base, "region").select("region", "other", F.try_divide("p", "base").alias("lift")).where("lift is not null")
    over = F.greatest(F.col("lift") - 1, F.lit(0.0))
    return lift.withColumn("w", F.coalesce(F.try_divide(over, F.sum(over).over(Window.partitionBy("region"))), F.lit(0.0)))


def calendar(hour: Column, weekday: Column, month: Column, day: Column) -> dict[str, Column]:
    """Cyclic and flag features of local time parts (Monday is 0)."""
    turn = lambda x, n: 2 * math.pi * x / n
    return {
        "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)),
        "dow_sin": F.sin(turn(weekday, 7)), "dow_cos": F.cos(turn(weekday, 7)),
        "month_sin": F.sin(turn(month, 12)), "doy_cos": F.cos(turn(day, 365.25)),
        "weekend": (weekday >= 5).cast("long"), "night": ((hour >= 22) | (hour <= 5)).cast("long"),
    }


def split(hours: DataFrame, train: float = 0.70, calibrate: float = 0.85) -> DataFrame:
    """hours(h) with part: chronological shares of the distinct hours."""
    d = hours.select("h").distinct()
    n = d.count()
    k = F.row_number().over(Window.orderBy("h")) - 1
    return d.select("h", F.when(k < int(train * n), "train").when(k < int(calibrate * n), "calibrate").otherwise("test").alias("part"))


def thinned(panel: DataFrame) -> DataFrame:
    """Every other row, alternating between regions."""
    return panel.where(F.pmod(F.col("h") + F.col("region"), F.lit(2)) == 0)
