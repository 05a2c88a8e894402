"""Routes as long tables: weights by lead hour and region, exposure, scores and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LEAD = 18
ROUTE = ("corridor", "route")


def timed(segments: DataFrame, order: list[str]) -> DataFrame:
    """segments(corridor, route, region, km, t_h, ...) with seq, enter_h, exit_h by running sums."""
    w = Window.partitionBy(*ROUTE).orderBy(*order)
    exit_h = F.sum("t_h").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("seq", F.row_number().over(w)).withColumn("exit_h", exit_h).withColumn("enter_h", F.col("exit_h") - F.col("t_h"))


def weights(seg: DataFrame) -> DataFrame:
    """(corridor, route, lead, region, w): the share of km by the hour of a piece's middle, late ones
    in the last lead; shares of a route sum to 1."""
    lead = F.least(F.floor((F.col("enter_h") + F.col("exit_h")) / 2 + 1e-9), F.lit(MOST_LEAD)).cast("long")
    d = seg.groupBy(*ROUTE, lead.alias("lead"), "region").agg(F.sum("km").alias("km"))
    return d.withColumn("w", F.try_divide("km", F.sum("km").over(Window.partitionBy(*ROUTE)))).drop("km")


def hours_in(seg: DataFrame, per: str | None = None) -> DataFrame:
    """(corridor, route, lead, region, hours): time spent in each lead hour; hours beyond the last
    lead are cut. per: a column to spread in proportion instead of the time."""
    cells = seg.withColumn("lead", F.explode(F.sequence(F.floor(F.col("enter_h") + 1e-9), F.floor(F.col("exit_h") - 1e-9)))).where(F.col("lead") <= MOST_LEAD)
    inside = F.greatest(F.least("exit_h", F.col("lead") + 1) - F.greatest("enter_h", "lead"), F.lit(0.0))
    value = inside if per is None else F.try_divide(F.col(per) * inside, F.col("t_h"))
    return cells.groupBy(*ROUTE, F.col("lead").cast("long").alias("lead"), "region").agg(F.sum(value).alias("hours"))


def shares(seg: DataFrame) -> DataFrame:
    """(corridor, route, region, w): share of km by region."""
    return seg.groupBy(*ROUTE, "region").agg(F.sum("km").alias("km")).withColumn("w", F.col("km") / F.sum("km").over(Window.partitionBy(*ROUTE))).drop("km")


def summary(seg: DataFrame) -> DataFrame:
    """(corridor, route, d_km, t_h, pos): pos is the candidate's place in its corridor."""
    r = seg.groupBy(*ROUTE).agg(F.sum("km").alias("d_km"), F.sum("t_h").alias("t_h"))
    return r.withColumn("pos", (F.row_number().over(Window.partitionBy("corridor").orderBy("route")) - 1).cast("long"))


def near_equal(seg: DataFrame, tolerance_km: float) -> DataFrame:
    """(corridor, route) to keep: routes with one region sequence and all lengths within tolerance of
    an earlier candidate go. A self-join on the sequence finds the pairs."""
    piece = F.array_sort(F.collect_list(F.struct("seq", "region", "km")))
    r = seg.groupBy(*ROUTE).agg(piece.alias("p")).withColumn("regions", F.transform("p", lambda x: x["region"])).withColumn("kms", F.transform("p", lambda x: x["km"]))
    first = r.select("corridor", "regions", F.col("route").alias("other"), F.col("kms").alias("other_kms"))
    close = F.forall(F.zip_with("kms", "other_kms", lambda x, y: F.abs(x - y) <= tolerance_km), lambda ok: ok)
    gone = r.join(first, ["corridor", "regions"]).where((F.col("other") < F.col("route")) & close).select(*ROUTE)
    return r.select(*ROUTE).join(gone, list(ROUTE), "left_anti")


def realized(hours: Column, w: DataFrame, panel: DataFrame, routes: DataFrame) -> DataFrame:
    """(corridor, route, h, share, km) under alert for departures in the array ``hours``."""
    cells = w.withColumn("h", F.explode(hours))
    at = panel.where("a = 1").select("region", F.col("h").alias("at"))
    hit = cells.withColumn("at", F.col("h") + F.col("lead")).join(at, ["region", "at"]).groupBy(*ROUTE, "h").agg(F.sum("w").alias("share"))
    every = routes.select(*ROUTE, "d_km", F.explode(hours).alias("h"))
    share = F.coalesce("share", F.lit(0.0))
    return every.join(hit, [*ROUTE, "h"], "left").select(*ROUTE, "h", share.alias("share"), (share * F.col("d_km")).alias("km"))


def expected(w: DataFrame, forecast: DataFrame, routes: DataFrame) -> DataFrame:
    """(corridor, route, h, e_km) of forecast(region, h, lead, p)."""
    s = w.join(forecast, ["region", "lead"]).groupBy(*ROUTE, "h").agg(F.sum(F.col("w") * F.col("p")).alias("e"))
    return s.join(routes.select(*ROUTE, "d_km"), list(ROUTE)).select(*ROUTE, "h", (F.col("e") * F.col("d_km")).alias("e_km"))


def current(s: DataFrame, now: DataFrame, routes: DataFrame, hours: Column) -> DataFrame:
    """(corridor, route, h, e_km): km in regions that are active at departure, of now(region, h, active)."""
    hit = s.join(now.where("active = 1"), "region").groupBy(*ROUTE, "h").agg(F.sum("w").alias("e"))
    every = routes.select(*ROUTE, "d_km", F.explode(hours).alias("h"))
    return every.join(hit, [*ROUTE, "h"], "left").select(*ROUTE, "h", (F.coalesce("e", F.lit(0.0)) * F.col("d_km")).alias("e_km"))


def choose(scores: DataFrame, prefer: DataFrame | None = None, score: str = "e_km", by: tuple[str, ...] = ("corridor", "h"), tie: float = 1e-9) -> DataFrame:
    """(by, route): the least score; the preferred route (prefer(corridor, pref)) wins ties, then the
    first candidate."""
    s = scores.withColumn("_s", F.round(score, 9))
    if prefer is not None:
        s = s.join(prefer, "corridor").withColumn("_s", F.col("_s") + F.when(F.col("route") == F.col("pref"), 0.0).otherwise(tie))
    return s.groupBy(*by).agg(F.min_by("route", F.struct("_s", "route")).alias("route"))


def choose_with_margin(scores: DataFrame, prefer: DataFrame, eps: Column, score: str = "e_km", by: tuple[str, ...] = ("corridor", "h")) -> DataFrame:
    """(by, route): the preferred route unless the best gains more than the share eps of its score."""
    s = scores.withColumn("_s", F.round(score, 9)).join(prefer, "corridor")
    own = F.max(F.when(F.col("route") == F.col("pref"), F.col("_s")))
    best = s.groupBy(*by).agg(F.min(F.struct("_s", "route")).alias("_b"), own.alias("_own"), F.first("pref").alias("pref"))
    return best.select(*by, F.when(F.col("_own") - F.col("_b._s") > eps * F.col("_own") + 1e-9, F.col("_b.route")).otherwise(F.col("pref")).alias("route"))


def trade_off(scores: DataFrame, gamma: float, e: str = "e_km", t: str = "t_h", by: tuple[str, ...] = ("corridor", "h")) -> DataFrame:
    """scores with value: g E / (1 - yE) + (1 - g) E / (1 - yT) over criteria normalised by their sum
    among the candidates; a candidate that holds all of a criterion is never chosen."""
    w = Window.partitionBy(*by)
    y = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w)), F.lit(0.0))
    ratio = lambda y: F.when(1 - y <= 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), 1 - y))
    s = scores.withColumn("_ye", y(e)).withColumn("_yt", y(t))
    return s.withColumn("value", gamma * ratio(F.col("_ye")) + (1 - gamma) * ratio(F.col("_yt"))).drop("_ye", "_yt")


def many_criteria(scores: DataFrame, static: list[str], share: Column, gamma_t: float = 0.2, e: str = "e_km", t: str = "t_h", by: tuple[str, ...] = ("corridor", "h")) -> DataFrame:
    """scores with value: the weighted sum of 1 / (1 - y) over criteria normalised by their sum among the
    candidates: time with weight gamma_t, the static ones with the weight ``share`` together, exposure
    with the rest. A candidate that holds all of a criterion with a weight is never chosen."""
    w = Window.partitionBy(*by)
    y = {c: F.coalesce(F.when(F.sum(c).over(w) > 0, F.try_divide(F.col(c).cast("double"), F.sum(c).over(w))), F.lit(0.0)) for c in (e, t, *static)}
    s = scores.select("*", *(v.alias(f"_y_{c}") for c, v in y.items()))
    part = lambda c, g: F.when(1 - F.col(f"_y_{c}") <= 0, F.when(g > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.try_divide(g, 1 - F.col(f"_y_{c}")))
    value = part(t, F.lit(gamma_t)) + part(e, 1 - gamma_t - share)
    for c in static:
        value = value + part(c, share / len(static))
    return s.withColumn("value", value).drop(*(f"_y_{c}" for c in y))


def churn(choice: DataFrame, by: tuple[str, ...] = ("corridor",)) -> DataFrame:
    """(by, changes, routes_used) of choice(by, h, route)."""
    moved = F.col("route") != F.lag("route").over(Window.partitionBy(*by).orderBy("h"))
    return choice.withColumn("_c", moved.cast("long")).groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"), F.array_sort(F.collect_set("route")).alias("routes_used"))


def assembled(seg: DataFrame, tolerance_km: float = 0.05) -> DataFrame:
    """(corridor, route, pos, d_km, t_h, regions, weights): a corridor's candidates after near-equal ones
    have gone, with the sorted set of regions and the weights by lead and region, nested."""
    kept = near_equal(seg, tolerance_km)
    s = seg.join(kept, list(ROUTE), "left_semi")
    w = weights(s).groupBy(*ROUTE).agg(F.array_sort(F.collect_list(F.struct("lead", "region", "w"))).alias("weights"))
    r = s.groupBy(*ROUTE).agg(F.array_sort(F.collect_set("region")).alias("regions"))
    return summary(s).join(r, list(ROUTE)).join(w, list(ROUTE))


def improvement(base: Column, x: Column) -> Column:
    """Percent by which the mean of x is below that of base; null if base is 0."""
    return F.try_divide(100 * (F.avg(base) - F.avg(x)), F.avg(base))
