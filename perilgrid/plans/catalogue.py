"""The query catalogue: each query with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import geo, graph, learn, routes, stats, timegrid
from . import fixtures as fx
from .fixtures import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Tables that several parts of the query being built read.
_shared: ContextVar[dict[str, DataFrame] | None] = ContextVar("shared", default=None)


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            token = _shared.set({} if _shared.get() is None else _shared.get())
            try:
                return f(spark, d)
            finally:
                _shared.reset(token)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return add


def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives, written once for the query being built, so that the facts behind it are
    scanned and joined once however many parts of the query read it."""
    held = _shared.get()
    if held is None:
        return make()
    if name not in held:
        held[name] = graph.checkpointed(make())
    return held[name]


def segments(spark: SparkSession, d: str) -> DataFrame:
    return once("segments", lambda: fx.segments(spark, d))


def presence(spark: SparkSession, d: str) -> DataFrame:
    return once("presence", lambda: fx.presence(spark, d))


def r(c: str | F.Column, digits: int = 6) -> F.Column:
    """A rounded double, free of negative zero."""
    name = c if isinstance(c, str) else None
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(name) if name else out



def leads_0_18() -> F.Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(18).cast("long"))


# --- time grid ---------------------------------------------------------------------------------


@query(sql("SELECT level, count(*) AS n, count(DISTINCT region) AS regions, min(s) AS first_us, max(f) AS last_us FROM lg GROUP BY 1", "lg"))
def alert_log_clean(spark, d):
    log = fx.alert_log(spark, d)
    return log.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("region").alias("regions"), F.min("s_us").alias("first_us"), F.max("f_us").alias("last_us"))


@query(sql("SELECT region, h::BIGINT AS h FROM hit", "hit"))
def presence_truth(spark, d):
    return timegrid.expand(fx.region_log(spark, d), "truth", fx.EPOCH_US, 0, fx.LAST)


@query(sql("SELECT DISTINCT region, unnest(generate_series((s - 1704067200000000) // 3600000000, least((f - 1704067200000000) // 3600000000, 720)))::BIGINT AS h FROM rl", "rl"))
def presence_feature_variant(spark, d):
    return timegrid.expand(fx.region_log(spark, d), "feature", fx.EPOCH_US, 0, fx.LAST)


@query(sql("SELECT DISTINCT district, unnest(generate_series((s - 1704067200000000) // 3600000000, least(greatest((f - 1000000 - 1704067200000000) // 3600000000, (s - 1704067200000000) // 3600000000), 720)))::BIGINT AS h FROM lg", "lg"))
def presence_point_events(spark, d):
    return timegrid.expand(fx.alert_log(spark, d), "point", fx.EPOCH_US, 0, fx.LAST, ("district",))


@query(sql("SELECT region, h, a FROM pr", "pr"))
def presence_grid(spark, d):
    return fx.presence(spark, d)


@query(sql("SELECT h // 24 AS day, " + ", ".join(f"sum(a) FILTER (region = {i})::BIGINT AS r{i}" for i in range(25)) + " FROM pr GROUP BY 1", "pr"))
def presence_pivot(spark, d):
    wide = fx.presence(spark, d).groupBy(F.floor(F.col("h") / 24).alias("day")).pivot("region", list(range(25))).agg(F.sum("a"))
    return wide.select("day", *(F.col(str(i)).alias(f"r{i}") for i in range(25)))


@query(sql("SELECT region % 5 AS grp, h, max(a) AS any_a, (max(a) > 0 AND min(a) < 1)::BIGINT AS partial FROM pr GROUP BY 1, 2", "pr"))
def presence_group_max(spark, d):
    g = fx.presence(spark, d).groupBy((F.col("region") % 5).alias("grp"), "h").agg(F.max("a").alias("any_a"), F.min("a").alias("lo"))
    return g.select("grp", "h", "any_a", ((F.col("any_a") > 0) & (F.col("lo") < 1)).cast("long").alias("partial"))


_MERGED = """mg0 AS (SELECT region, s, f, max(f) OVER (PARTITION BY region ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rl),
mg1 AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS run FROM mg0),
mg AS (SELECT region, min(s) AS s_us, max(f) AS f_us FROM mg1 GROUP BY region, run)"""


@query(sql("SELECT region, s_us, f_us FROM mg", "rl", _MERGED))
def interval_merge(spark, d):
    return timegrid.merge(fx.region_log(spark, d))


def _instants(spark) -> DataFrame:
    return timegrid.grid(spark, fx.REGIONS, 0, fx.LAST).withColumn("at", F.col("h") * 3_600_000_000 + fx.EPOCH_US)


_AT = "inst AS (SELECT r.r AS region, g.h AS h, g.h * 3600000000 + 1704067200000000 AS at FROM range(25) r(r) CROSS JOIN range(721) g(h))"


@query(sql("SELECT i.region, i.h, (count(l.s) > 0)::BIGINT AS active FROM inst i LEFT JOIN rl l ON l.region = i.region AND l.s <= i.at AND i.at < l.f GROUP BY 1, 2", "rl", _AT))
def active_at_instant(spark, d):
    return timegrid.active_at(_instants(spark), fx.region_log(spark, d)).select("region", "h", "active")


@query(sql("""SELECT i.region, i.at, coalesce(i.at < f_us, false)::BIGINT AS active,
  round(CASE WHEN coalesce(i.at < f_us, false) THEN least((i.at - s_us) / 3600000000.0, 72) ELSE 0 END, 6)::DOUBLE AS elapsed_h,
  round(CASE WHEN coalesce(i.at < f_us, false) THEN 0 ELSE least(coalesce((i.at - f_us) / 3600000000.0, 168), 168) END, 6)::DOUBLE AS since_end_h
  FROM inst i ASOF LEFT JOIN mg ON mg.region = i.region AND i.at >= mg.s_us""", "rl", _AT + ", " + _MERGED))
def instant_state(spark, d):
    s = timegrid.instant_state(_instants(spark).select("region", "at"), timegrid.merge(fx.region_log(spark, d)))
    return s.select("region", "at", "active", r("elapsed_h"), r("since_end_h"))


@query(sql("SELECT DISTINCT i.region, i.h FROM rl JOIN inst i ON i.region = rl.region AND i.at >= rl.s AND i.at < greatest(rl.f, rl.s + 60000000)", "rl", "inst AS (SELECT r.r AS region, g.h AS h, g.h * 3600000000 + 1704067200000000 AS at FROM range(25) r(r) CROSS JOIN range(900) g(h))"))
def instant_range_join(spark, d):
    return timegrid.instants_inside(fx.region_log(spark, d), fx.EPOCH_US)


# --- features ----------------------------------------------------------------------------------


@query(sql("SELECT region, h, coalesce(lag(a, 1) OVER w, 0) AS lag1, coalesce(lag(a, 6) OVER w, 0) AS lag6, coalesce(lag(a, 24) OVER w, 0) AS lag24, lead(a, 1) OVER w AS y1, lead(a, 6) OVER w AS y6 FROM pr WINDOW w AS (PARTITION BY region ORDER BY h)", "pr"))
def lag_features(spark, d):
    return fx.presence(spark, d).select("region", "h", *(ft.lag0(n).alias(f"lag{n}") for n in (1, 6, 24)), *(F.lead("a", n).over(ft.by_region()).alias(f"y{n}") for n in (1, 6)))


def _frames(ns, f):
    return ", ".join(f(n, f"OVER (PARTITION BY region ORDER BY h ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)") for n in ns)


@query(sql("SELECT region, h, " + _frames((3, 6, 12, 24, 48, 72), lambda n, w: f"round(avg(a) {w}, 6) AS mean{n}, (sum(a) {w})::BIGINT AS sum{n}, round(coalesce(stddev_samp(a) {w}, 0), 6) AS std{n}") + " FROM pr", "pr"))
def rolling_stats(spark, d):
    cols = []
    for n in (3, 6, 12, 24, 48, 72):
        s = ft.rolling(n)
        cols += [r(s["mean"]).alias(f"mean{n}"), s["sum"].alias(f"sum{n}"), r(s["std"]).alias(f"std{n}")]
    return fx.presence(spark, d).select("region", "h", *cols)


@query(sql("SELECT region, h, CASE WHEN count(a) OVER w >= 24 THEN (sum(a) OVER w)::BIGINT END AS sum672, round(avg(a) OVER (PARTITION BY region ORDER BY h ROWS UNBOUNDED PRECEDING), 6) AS so_far FROM pr WINDOW w AS (PARTITION BY region ORDER BY h ROWS BETWEEN 671 PRECEDING AND CURRENT ROW)", "pr"))
def rolling_min_periods(spark, d):
    return fx.presence(spark, d).select("region", "h", ft.rolling_sum(672, 24).alias("sum672"), r(ft.expanding_mean()).alias("so_far"))


@query(sql("SELECT region, h, a - lag(a, 1) OVER w AS d1, a - lag(a, 3) OVER w AS d3, a - lag(a, 24) OVER w AS d24 FROM pr WINDOW w AS (PARTITION BY region ORDER BY h)", "pr"))
def momentum_diff(spark, d):
    return fx.presence(spark, d).select("region", "h", *(ft.difference(n).alias(f"d{n}") for n in (1, 3, 24)))


@query(sql("SELECT region, h, least(row_number() OVER (PARTITION BY region, i ORDER BY h), 72) AS run FROM (SELECT *, sum(c) OVER (PARTITION BY region ORDER BY h) AS i FROM (SELECT *, CASE WHEN a = lag(a) OVER (PARTITION BY region ORDER BY h) THEN 0 ELSE 1 END AS c FROM pr))", "pr"))
def run_length(spark, d):
    return ft.with_runs(fx.presence(spark, d)).select("region", "h", "run")


@query(sql("SELECT region, h, least(coalesce(h - max(CASE WHEN a = 1 THEN h END) OVER (PARTITION BY region ORDER BY h), 720), 720)::BIGINT AS since FROM pr", "pr"))
def hours_since_event(spark, d):
    return fx.presence(spark, d).select("region", "h", ft.hours_since().alias("since"))


@query(sql("SELECT region, h, (sum(o) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS onsets3, coalesce(max(o) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS next3 FROM (SELECT *, (a = 1 AND coalesce(lag(a) OVER (PARTITION BY region ORDER BY h), 0) = 0)::BIGINT AS o FROM pr)", "pr"))
def onset_counts(spark, d):
    p = fx.presence(spark, d).withColumn("o", ft.onset())
    return p.select("region", "h", F.sum("o").over(ft.last_rows(3)).alias("onsets3"), F.coalesce(F.max("o").over(ft.by_region().rowsBetween(1, 3)), F.lit(0)).cast("long").alias("next3"))


@query(sql("SELECT p.region, p.h, round(avg(q.a), 6) AS rate FROM pr p LEFT JOIN pr q ON q.region = p.region AND q.h < p.h + 1 AND (p.h + 6 - q.h) % 24 = 0 AND q.h BETWEEN p.h + 6 - 672 AND p.h GROUP BY 1, 2", "pr"))
def same_hour_rate_28d(spark, d):
    return fx.presence(spark, d).select("region", "h", r(ft.same_hour_mean(28, 6)).alias("rate"))


_ADJ = "adj AS (SELECT src AS region, dst AS other, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ar)"


@query(sql("SELECT adj.region, h, round(sum(w * a), 6) AS nb_mean FROM adj JOIN pr ON pr.region = adj.other GROUP BY 1, 2", "pr ar", _ADJ))
def neighbour_spillover(spark, d):
    w = ft.row_stochastic(fx.adjacency(fx.road_edges(spark, d)))
    return ft.mixed(fx.presence(spark, d), w, "a", "nb_mean").select("region", "h", r("nb_mean"))


@query(sql("SELECT region, h, (sum(a) OVER (PARTITION BY h))::BIGINT AS national, round(avg(a) OVER (PARTITION BY region), 6) AS own FROM pr", "pr"))
def national_activity(spark, d):
    return fx.presence(spark, d).select("region", "h", F.sum("a").over(Window.partitionBy("h")).alias("national"), r(F.avg("a").over(Window.partitionBy("region"))).alias("own"))


_FAR = "far0 AS (SELECT DISTINCT x.src AS region, y.dst AS other FROM ar x JOIN ar y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM ar z WHERE z.src = x.src AND z.dst = y.dst)), far AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY region) AS w FROM far0)"


@query(sql("SELECT far.region, h, round(sum(w * a), 6) AS far_mean FROM far JOIN pr ON pr.region = far.other GROUP BY 1, 2", "pr ar", _FAR))
def two_hop_mix(spark, d):
    w = ft.two_hops(fx.adjacency(fx.road_edges(spark, d)))
    return ft.mixed(fx.presence(spark, d), w, "a", "far_mean").select("region", "h", r("far_mean"))


_LIFT = """o AS (SELECT region, h, (a = 1 AND coalesce(lag(a) OVER (PARTITION BY region ORDER BY h), 0) = 0)::BIGINT AS o FROM pr),
n AS (SELECT *, coalesce(max(o) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS nxt FROM o),
base AS (SELECT region, avg(nxt) AS base FROM n GROUP BY 1),
en AS (SELECT region AS other FROM o WHERE o = 1 GROUP BY 1 HAVING count(*) >= 20),
j AS (SELECT n.region, o.region AS other, avg(nxt) AS p FROM o JOIN n ON n.h = o.h AND n.region <> o.region WHERE o.o = 1 GROUP BY 1, 2),
l AS (SELECT j.region, j.other, p / base AS lift FROM j JOIN en USING (other) JOIN base ON base.region = j.region WHERE base > 0),
lw AS (SELECT *, coalesce(greatest(lift - 1, 0) / nullif(sum(greatest(lift - 1, 0)) OVER (PARTITION BY region), 0), 0) AS w FROM l)"""


@query(sql("SELECT region, other, round(lift, 6) AS lift, round(w, 6) AS w FROM lw", "pr", _LIFT))
def upstream_lift(spark, d):
    return ft.upstream_lift(fx.presence(spark, d)).select("region", "other", r("lift"), r("w"))


@query(sql("SELECT region, k, other, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(w, 9) DESC, other) AS k FROM lw) WHERE k <= 3", "pr", _LIFT))
def topk_upstream(spark, d):
    k = F.row_number().over(Window.partitionBy("region").orderBy(F.desc(F.round("w", 9)), "other")).cast("long")
    return ft.upstream_lift(fx.presence(spark, d)).withColumn("k", k).where("k <= 3").select("region", "k", "other", r("w"))


@query("""SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos, round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin,
 round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos, (isodow(ts) - 1 >= 5)::BIGINT AS weekend, (hour(ts) >= 22 OR hour(ts) <= 5)::BIGINT AS night FROM events""")
def calendar_features(spark, d):
    cols = ft.calendar(F.hour("ts"), F.weekday("ts"), F.month("ts"), F.dayofyear("ts"))
    return fx.table(spark, d, "events").select("event_id", *((r(c) if n not in ("weekend", "night") else c).alias(n) for n, c in cols.items()))


@query(sql("SELECT part, count(*) AS n, min(h) AS first, max(h) AS last FROM (SELECT h, CASE WHEN k < 504 THEN 'train' WHEN k < 612 THEN 'calibrate' ELSE 'test' END AS part FROM (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k FROM (SELECT DISTINCT h FROM pr))) GROUP BY 1", "pr"))
def temporal_split(spark, d):
    return ft.split(fx.presence(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))


@query(sql("SELECT region, count(*) AS n, sum(a)::BIGINT AS ones FROM pr WHERE (h + region) % 2 = 0 AND h + 6 < 480 GROUP BY 1", "pr"))
def train_thinning(spark, d):
    return ft.thinned(fx.presence(spark, d)).where(F.col("h") + 6 < fx.TEST).groupBy("region").agg(F.count("*").alias("n"), F.sum("a").alias("ones"))


@query(sql("SELECT pr.region, h, round((avg(a) OVER (PARTITION BY pr.region ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) / (rate + 1e-6), 6) AS rel FROM pr JOIN (SELECT region, avg(a) FILTER (h < 480) AS rate FROM pr GROUP BY 1) m USING (region)", "pr"))
def rel_rate_precutoff(spark, d):
    p = fx.presence(spark, d)
    roll = p.select("region", "h", ft.rolling(24)["mean"].alias("m"))
    return roll.join(fc.day_mean_to_date(p, fx.TEST), "region").select("region", "h", r(F.col("m") / (F.col("rate") + 1e-6)).alias("rel"))


# --- forecasts ---------------------------------------------------------------------------------


def _pre(p: DataFrame) -> DataFrame:
    return p.where(F.col("h") <= fx.PRE_LAST)


def _cells(p: DataFrame) -> DataFrame:
    return p.where(F.col("h").between(fx.TEST, fx.DECISION_LAST)).select("region", "h")


def _clim(p: DataFrame) -> DataFrame:
    return fc.from_climatology(_cells(p), fc.climatology(_pre(p)))


def _mark(p: DataFrame) -> DataFrame:
    known = p.select("region", (F.col("h") + 1).alias("h"), "a").where(F.col("h").between(fx.TEST, fx.DECISION_LAST))
    return fc.from_markov(known, fc.markov(_pre(p)))


@query(sql("SELECT region, slot, round(p, 6) AS p FROM cl", "cl"))
def climatology(spark, d):
    return fc.climatology(_pre(fx.presence(spark, d))).select("region", "slot", r("p"))


@query(sql("SELECT region, round(p11, 6) AS p11, round(p01, 6) AS p01, round(pi, 6) AS pi, round(lam, 6) + 0.0 AS lam FROM mk", "mk"))
def markov_params(spark, d):
    return fc.markov(_pre(fx.presence(spark, d))).select("region", r("p11"), r("p01"), r("pi"), r("lam"))


@query(sql("SELECT region, h, lead, round(p, 6) AS p FROM fm", "fm"))
def markov_forecast(spark, d):
    return _mark(fx.presence(spark, d)).select("region", "h", "lead", r("p"))


@query(sql("SELECT t.region, (t.h + 1) // 24 AS day, round(p11, 6) AS p11, round(p01, 6) AS p01 FROM (SELECT region, h, coalesce(sum(a * b) OVER w, 0) / greatest(coalesce(sum(b) OVER w, 0), 1)::DOUBLE AS p11, coalesce(sum((1 - b) * a) OVER w, 0) / greatest(coalesce(sum(1 - b) OVER w, 0), 1)::DOUBLE AS p01 FROM (SELECT *, lag(a) OVER (PARTITION BY region ORDER BY h) AS b FROM pr) WINDOW w AS (PARTITION BY region ORDER BY h ROWS BETWEEN 166 PRECEDING AND CURRENT ROW)) t WHERE (t.h + 1) % 24 = 0", "pr"))
def markov_rolling(spark, d):
    return fc.markov_rolling(fx.presence(spark, d), 7).select("region", "day", r("p11"), r("p01"))


@query(sql("""SELECT b.bin, l.lead, count(*) AS n, round(avg(pr.a), 6) AS p FROM (
  SELECT region, h, (CASE WHEN act THEN CASE WHEN el < 0.5 THEN 4 WHEN el < 1 THEN 5 WHEN el < 2 THEN 6 WHEN el < 4 THEN 7 WHEN el < 8 THEN 8 WHEN el < 24 THEN 9 ELSE 10 END
    ELSE CASE WHEN si < 1 THEN 0 WHEN si < 3 THEN 1 WHEN si < 12 THEN 2 ELSE 3 END END)::BIGINT AS bin
  FROM (SELECT i.region, i.h, coalesce(i.at < f_us, false) AS act, (i.at - s_us) / 3600000000.0 AS el, coalesce((i.at - f_us) / 3600000000.0, 168) AS si
    FROM inst i ASOF LEFT JOIN mg ON mg.region = i.region AND i.at >= mg.s_us WHERE i.h <= 461)) b, range(19) l(lead) JOIN pr ON pr.region = b.region AND pr.h = b.h + l.lead GROUP BY 1, 2""", "pr", _AT + ", " + _MERGED))
def semi_markov_rates(spark, d):
    at = _pre(_instants(spark))
    s = timegrid.instant_state(at.select("region", "at"), timegrid.merge(fx.region_log(spark, d)))
    s = s.select("region", ((F.col("at") - fx.EPOCH_US) / 3_600_000_000).cast("long").alias("h"), fc.state_bin(F.col("active"), F.col("elapsed_h"), F.col("since_end_h")).alias("bin"))
    return fc.hazard(s, fx.presence(spark, d)).select("bin", "lead", "n", r("p"))


@query(sql("SELECT fm.region, fm.h, fm.lead, round((fm.p + fc.p) / 2, 6) AS p FROM fm JOIN fc USING (region, h, lead)", "fm fc"))
def blend_forecast(spark, d):
    p = fx.presence(spark, d)
    return fc.blend(_mark(p), _clim(p)).select("region", "h", "lead", r("p"))


@query(sql("SELECT m.region, m.h, m.lead, round(CASE WHEN m.lead = 0 THEN greatest(m.p, coalesce(x.active, 0)) ELSE m.p END, 6) AS p FROM fm m LEFT JOIN (SELECT i.region, i.h, (count(l.s) > 0)::BIGINT AS active FROM inst i LEFT JOIN rl l ON l.region = i.region AND l.s <= i.at AND i.at < l.f GROUP BY 1, 2) x USING (region, h)", "fm rl", _AT))
def causal_forecast_view(spark, d):
    model = _mark(fx.presence(spark, d)).select("region", (F.col("h") - 1).alias("row_h"), (F.col("lead") + 1).alias("k"), "p")
    now = timegrid.active_at(_instants(spark), fx.region_log(spark, d)).select("region", "h", "active")
    return fc.causal(model, now).select("region", "h", "lead", r("p"))


@query(sql("SELECT region, h FROM pr WHERE h BETWEEN 479 AND 710 EXCEPT SELECT region, h FROM fm", "pr fm"))
def missing_forecasts(spark, d):
    p = fx.presence(spark, d)
    return fc.missing(p.where(F.col("h").between(479, 710)), _mark(p))


# --- routes and exposure -----------------------------------------------------------------------


@query(sql("SELECT corridor, route, seq, region, round(km, 6) AS km, round(enter_h, 6) + 0.0 AS enter_h, round(exit_h, 6) AS exit_h FROM sg", "sg"))
def route_segments(spark, d):
    return fx.segments(spark, d).select("corridor", "route", F.col("seq").cast("long").alias("seq"), "region", r("km"), r("enter_h"), r("exit_h"))


@query(sql("SELECT corridor, route, lead, region, round(w, 6) AS w FROM wt", "wt"))
def route_weights(spark, d):
    return routes.weights(fx.segments(spark, d)).select("corridor", "route", "lead", "region", r("w"))


@query(sql("SELECT corridor, route, l.lead AS lead, region, round(sum(greatest(least(exit_h, l.lead + 1) - greatest(enter_h, l.lead), 0)), 6) AS hours FROM sg, range(19) l(lead) WHERE l.lead BETWEEN floor(enter_h + 1e-9) AND floor(exit_h - 1e-9) GROUP BY ALL", "sg"))
def route_time_weights(spark, d):
    return routes.hours_in(fx.segments(spark, d)).select("corridor", "route", "lead", "region", r("hours"))


@query(sql("SELECT corridor, route, region, round(km / sum(km) OVER (PARTITION BY corridor, route), 6) AS w FROM sg", "sg"))
def route_shares(spark, d):
    return routes.shares(fx.segments(spark, d)).select("corridor", "route", "region", r("w"))


@query(sql("""SELECT DISTINCT corridor, route FROM sg a WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT corridor, route FROM sg) b WHERE b.corridor = a.corridor AND b.route < a.route
  AND (SELECT list((region) ORDER BY seq) FROM sg x WHERE x.corridor = b.corridor AND x.route = b.route) = (SELECT list(region ORDER BY seq) FROM sg x WHERE x.corridor = a.corridor AND x.route = a.route)
  AND (SELECT max(abs(x.km - y.km)) FROM sg x JOIN sg y ON x.seq = y.seq AND x.corridor = y.corridor WHERE x.corridor = a.corridor AND x.route = a.route AND y.route = b.route) <= 0.05)""", "sg"))
def route_dedupe(spark, d):
    return routes.near_equal(fx.segments(spark, d), 0.05)


def _realized(spark, d):
    seg = segments(spark, d)
    return routes.realized(fx.decision_hours(), routes.weights(seg), presence(spark, d), routes.summary(seg))


@query(sql("SELECT corridor, route, h, round(share, 6) + 0.0 AS share, round(km, 6) + 0.0 AS km FROM re", "re"))
def exposure_km(spark, d):
    return _realized(spark, d).select("corridor", "route", "h", r("share"), r("km"))


@query(sql("SELECT t.corridor, t.route, dh.h, round(coalesce(sum(hours) FILTER (a = 1), 0), 6) + 0.0 AS hours FROM (SELECT corridor, route, l.lead AS lead, region, sum(greatest(least(exit_h, l.lead + 1) - greatest(enter_h, l.lead), 0)) AS hours FROM sg, range(19) l(lead) WHERE l.lead BETWEEN floor(enter_h + 1e-9) AND floor(exit_h - 1e-9) GROUP BY ALL) t CROSS JOIN dh JOIN pr ON pr.region = t.region AND pr.h = dh.h + t.lead GROUP BY 1, 2, 3", "sg dh pr"))
def exposure_hours(spark, d):
    seg = segments(spark, d)
    per = routes.hours_in(seg).withColumnRenamed("hours", "w")
    out = routes.realized(fx.decision_hours(), per, presence(spark, d), routes.summary(seg))
    return out.select("corridor", "route", "h", r("share").alias("hours"))


@query(sql("SELECT s.corridor, s.route, p.h, round(sum(w * m), 6) + 0.0 AS share FROM (SELECT corridor, route, region, km / sum(km) OVER (PARTITION BY corridor, route) AS w FROM sg) s JOIN (SELECT region, h, max(a) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS m FROM pr) p ON p.region = s.region AND p.h BETWEEN 480 AND 702 GROUP BY 1, 2, 3", "sg pr"))
def exposure_window8(spark, d):
    p = presence(spark, d).select("region", "h", F.max("a").over(ft.by_region().rowsBetween(0, 8)).alias("m")).where(F.col("h").between(fx.TEST, fx.DECISION_LAST))
    return routes.shares(segments(spark, d)).join(p, "region").groupBy("corridor", "route", "h").agg(r(F.sum(F.col("w") * F.col("m"))).alias("share"))


def _expected(spark, d, which):
    seg = segments(spark, d)
    return routes.expected(routes.weights(seg), which(presence(spark, d)), routes.summary(seg))


@query(sql("SELECT corridor, route, h, round(e_km, 6) AS e_km FROM em", "em"))
def expected_km(spark, d):
    return _expected(spark, d, _mark).select("corridor", "route", "h", r("e_km"))


_NOW = _AT + ", now AS (SELECT DISTINCT i.region, i.h FROM inst i JOIN rl l ON l.region = i.region AND l.s <= i.at AND i.at < l.f), cu AS (SELECT rt.corridor, rt.route, dh.h, coalesce(sum(s.w) FILTER (now.h IS NOT NULL), 0) * any_value(d_km) AS e_km FROM rt CROSS JOIN dh JOIN (SELECT corridor, route, region, km / sum(km) OVER (PARTITION BY corridor, route) AS w FROM sg) s USING (corridor, route) LEFT JOIN now ON now.region = s.region AND now.h = dh.h GROUP BY 1, 2, 3)"


def _current(spark, d):
    seg = segments(spark, d)
    now = timegrid.active_at(_instants(spark), fx.region_log(spark, d)).select("region", "h", "active")
    return routes.current(routes.shares(seg), now, routes.summary(seg), fx.decision_hours())


@query(sql("SELECT corridor, route, h, round(e_km, 6) + 0.0 AS e_km FROM cu", "rt rl dh", _NOW))
def current_km(spark, d):
    return _current(spark, d).select("corridor", "route", "h", r("e_km"))


# --- decisions ---------------------------------------------------------------------------------


def _static(spark, d) -> DataFrame:
    """(corridor, pref): the least mean km under alert over the hours before the test. Hours meet
    routes as counts by (region, lead), so nothing is expanded by the hour."""
    seg = segments(spark, d)
    p = presence(spark, d).where("a = 1").withColumn("lead", F.explode(leads_0_18()))
    n = p.where((F.col("h") - F.col("lead")).between(0, fx.PRE_LAST)).groupBy("region", "lead").agg(F.count("*").alias("n"))
    s = routes.weights(seg).join(n, ["region", "lead"], "left").groupBy("corridor", "route").agg((F.coalesce(F.sum(F.col("w") * F.col("n")), F.lit(0.0)) / (fx.PRE_LAST + 1)).alias("x"))
    s = s.join(routes.summary(seg), ["corridor", "route"]).withColumn("pre", F.round(F.col("x") * F.col("d_km"), 9))
    return s.groupBy("corridor").agg(F.min_by("route", F.struct("pre", "route")).alias("pref"))


def _valued(choice: DataFrame, real: DataFrame) -> DataFrame:
    return choice.join(real.select("corridor", "route", "h", "km"), ["corridor", "route", "h"])


_PICK = "ch AS (SELECT s.corridor, s.h, arg_min(s.route, (round(s.e_km, 9) + CASE WHEN s.route = st.pref THEN 0 ELSE 1e-9 END, s.route)) AS route FROM {0} s JOIN st USING (corridor) GROUP BY 1, 2)"
_BASE = "bs AS (SELECT re.corridor, re.h, re.km AS b FROM re JOIN st ON st.corridor = re.corridor AND st.pref = re.route)"
_ORACLE = "orc AS (SELECT corridor, h, arg_min(route, (round(km, 9), route)) AS route FROM re GROUP BY 1, 2)"


@query(sql("SELECT bs.corridor, any_value(pref) AS pref, round(avg(b), 6) AS base_km, round(avg(km), 6) AS oracle_km, round(CASE WHEN avg(b) > 0 THEN 100 * (avg(b) - avg(km)) / avg(b) END, 6) AS improvement FROM bs JOIN st USING (corridor) JOIN orc USING (corridor, h) JOIN re ON re.corridor = bs.corridor AND re.h = bs.h AND re.route = orc.route GROUP BY 1", "re st", _BASE + ", " + _ORACLE))
def static_baseline(spark, d):
    real, static = _realized(spark, d), _static(spark, d)
    base = real.join(static, "corridor").where("route = pref").select("corridor", "h", "pref", F.col("km").alias("b"))
    best = _valued(routes.choose(real, None, "km"), real).select("corridor", "h", "km")
    return base.join(best, ["corridor", "h"]).groupBy("corridor").agg(F.max("pref").alias("pref"), r(F.avg("b")).alias("base_km"), r(F.avg("km")).alias("oracle_km"), r(routes.improvement(F.col("b"), F.col("km"))).alias("improvement"))


@query(sql("SELECT rt.corridor, arg_min(rt.route, (round(t_h, 9), rt.route)) AS fastest, arg_min(rt.route, (round(d_km, 9), rt.route)) AS shortest, any_value(pref) AS static_pre, arg_min(rt.route, (m.km, rt.route)) AS hindsight, arg_min(rt.route, (m.share, rt.route)) AS by_share FROM rt JOIN st USING (corridor) JOIN (SELECT corridor, route, round(avg(km), 9) AS km, round(avg(share), 9) AS share FROM re GROUP BY 1, 2) m ON m.corridor = rt.corridor AND m.route = rt.route GROUP BY 1", "re st"))
def fixed_choices(spark, d):
    seg = segments(spark, d)
    mean = _realized(spark, d).groupBy("corridor", "route").agg(F.round(F.avg("km"), 9).alias("km"), F.round(F.avg("share"), 9).alias("share"))
    t = routes.summary(seg).join(mean, ["corridor", "route"]).join(_static(spark, d), "corridor")
    pick = lambda c, n: F.min_by("route", F.struct(F.round(c, 9), "route")).alias(n)
    return t.groupBy("corridor").agg(pick("t_h", "fastest"), pick("d_km", "shortest"), F.max("pref").alias("static_pre"), pick("km", "hindsight"), pick("share", "by_share"))


def _choice_sql(view: str, needs: str, more: str = "") -> str:
    return sql("SELECT corridor, h, route FROM ch", needs + " st", (more + ", " if more else "") + _PICK.format(view))


@query(_choice_sql("cu", "rt rl dh", _NOW))
def reactive_choice(spark, d):
    return routes.choose(_current(spark, d), _static(spark, d))


@query(_choice_sql("ec", "ec"))
def climatology_choice(spark, d):
    return routes.choose(_expected(spark, d, _clim), _static(spark, d))


@query(_choice_sql("em", "em"))
def markov_choice(spark, d):
    return routes.choose(_expected(spark, d, _mark), _static(spark, d))


@query(sql("SELECT corridor, h, route FROM orc", "re", _ORACLE))
def oracle_choice(spark, d):
    return routes.choose(_realized(spark, d), None, "km")


def _paired(spark, d) -> DataFrame:
    """(corridor, h, route, b, x): static and Markov-scheduled km."""
    real, static = _realized(spark, d), _static(spark, d)
    base = real.join(static, "corridor").where("route = pref").select("corridor", "h", F.col("km").alias("b"))
    pick = _valued(routes.choose(_expected(spark, d, _mark), static), real).withColumnRenamed("km", "x")
    return base.join(pick, ["corridor", "h"])


_PAIR = _PICK.format("em") + ", " + _BASE + ", pd AS (SELECT bs.corridor, bs.h, ch.route, b, re.km AS x FROM bs JOIN ch USING (corridor, h) JOIN re ON re.corridor = bs.corridor AND re.h = bs.h AND re.route = ch.route)"


def _pair_sql(body: str) -> str:
    return sql(body, "em re st", _PAIR)


@query(_pair_sql("SELECT corridor, round(avg(b), 6) AS base_km, round(avg(x), 6) AS km, round(CASE WHEN avg(b) > 0 THEN 100 * (avg(b) - avg(x)) / avg(b) END, 6) AS improvement, sum(c)::BIGINT AS changes, count(DISTINCT route) AS used FROM (SELECT *, (route <> lag(route) OVER (PARTITION BY corridor ORDER BY h))::BIGINT AS c FROM pd) GROUP BY 1"))
def strategy_summary(spark, d):
    moved = (F.col("route") != F.lag("route").over(Window.partitionBy("corridor").orderBy("h"))).cast("long")
    p = _paired(spark, d).withColumn("c", moved)
    return p.groupBy("corridor").agg(r(F.avg("b")).alias("base_km"), r(F.avg("x")).alias("km"), r(routes.improvement(F.col("b"), F.col("x"))).alias("improvement"), F.sum("c").alias("changes"), F.count_distinct("route").alias("used"))


EPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.5)
LAMBDAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
MARGINS = (0.0, 0.02, 0.05, 0.1, 0.2)


def _values(name: str, values) -> str:
    return f"{name}(e) AS (VALUES " + ", ".join(f"({v}::DOUBLE)" for v in values) + ")"


def _each(values, name: str = "e") -> F.Column:
    return F.explode(F.array(*map(F.lit, map(float, values)))).alias(name)


def _mean_by(choice: DataFrame, real: DataFrame, by: list[str]) -> DataFrame:
    return _valued(choice, real).groupBy(*by).agg(r(F.avg("km")).alias("km"))


@query(sql("SELECT c.corridor, c.e, round(avg(re.km), 6) AS km FROM (SELECT em.corridor, em.h, v.e, arg_min(em.route, (round(em.e_km, 9), em.route)) AS route FROM em JOIN rt USING (corridor, route) JOIN (SELECT corridor, min(t_h) AS t0 FROM rt GROUP BY 1) m ON m.corridor = em.corridor, v WHERE rt.t_h <= t0 * (1 + v.e) + 1e-9 GROUP BY 1, 2, 3) c JOIN re ON re.corridor = c.corridor AND re.h = c.h AND re.route = c.route GROUP BY 1, 2", "em re", _values("v", EPS)))
def epsilon_front(spark, d):
    seg = segments(spark, d)
    t = routes.summary(seg).withColumn("t0", F.min("t_h").over(Window.partitionBy("corridor"))).select("corridor", "route", "t_h", "t0", _each(EPS))
    fit = t.where(F.col("t_h") <= F.col("t0") * (1 + F.col("e")) + 1e-9).select("corridor", "route", "e")
    pick = routes.choose(_expected(spark, d, _mark).join(fit, ["corridor", "route"]), None, by=("corridor", "h", "e"))
    return _mean_by(pick, _realized(spark, d), ["corridor", "e"])


@query(sql("SELECT c.corridor, c.e, round(avg(re.km), 6) AS km FROM (SELECT em.corridor, em.h, v.e, arg_min(em.route, (round(em.e_km / ds + v.e * (rt.t_h / t0 - 1), 9), em.route)) AS route FROM em JOIN rt USING (corridor, route) JOIN (SELECT rt.corridor, min(rt.t_h) AS t0, any_value(s.d_km) AS ds FROM rt JOIN st USING (corridor) JOIN rt s ON s.corridor = st.corridor AND s.route = st.pref GROUP BY 1) m ON m.corridor = em.corridor, v GROUP BY 1, 2, 3) c JOIN re ON re.corridor = c.corridor AND re.h = c.h AND re.route = c.route GROUP BY 1, 2", "em re st", _values("v", LAMBDAS)))
def lambda_front(spark, d):
    w = Window.partitionBy("corridor")
    t = routes.summary(segments(spark, d)).join(_static(spark, d), "corridor")
    t = t.withColumn("t0", F.min("t_h").over(w)).withColumn("ds", F.max(F.when(F.col("route") == F.col("pref"), F.col("d_km"))).over(w)).select("corridor", "route", "t_h", "t0", "ds", _each(LAMBDAS))
    s = _expected(spark, d, _mark).join(t, ["corridor", "route"]).withColumn("score", F.col("e_km") / F.col("ds") + F.col("e") * (F.col("t_h") / F.col("t0") - 1))
    return _mean_by(routes.choose(s, None, "score", ("corridor", "h", "e")), _realized(spark, d), ["corridor", "e"])


_TRADE = "y AS (SELECT em.corridor, em.route, em.h, coalesce(em.e_km / nullif(sum(em.e_km) OVER w, 0), 0) AS ye, coalesce(rt.t_h / nullif(sum(rt.t_h) OVER w, 0), 0) AS yt FROM em JOIN rt USING (corridor, route) WINDOW w AS (PARTITION BY em.corridor, em.h)), tv AS (SELECT *, 0.7 * CASE WHEN 1 - ye <= 0 THEN 'inf'::DOUBLE ELSE 1 / (1 - ye) END + 0.3 * CASE WHEN 1 - yt <= 0 THEN 'inf'::DOUBLE ELSE 1 / (1 - yt) END AS value FROM y)"


@query(sql("SELECT corridor, h, arg_min(route, (round(value, 9), route)) AS route FROM tv GROUP BY 1, 2", "em rt", _TRADE))
def nonlinear_tradeoff(spark, d):
    s = _expected(spark, d, _mark).join(routes.summary(segments(spark, d)), ["corridor", "route"])
    return routes.choose(routes.trade_off(s, 0.7), None, "value")


@query(sql("SELECT g.e, tv.corridor, h, arg_min(tv.route, (round(value + g.e / (1 - yr), 9), tv.route)) AS route FROM tv JOIN (SELECT corridor, route, n / sum(n) OVER (PARTITION BY corridor)::DOUBLE AS yr FROM (SELECT corridor, route, count(*) AS n FROM sg GROUP BY 1, 2)) q ON q.corridor = tv.corridor AND q.route = tv.route, v g GROUP BY 1, 2, 3", "em rt", _TRADE + ", " + _values("v", (0.0, 0.2, 0.4))))
def multi_criteria(spark, d):
    seg = segments(spark, d)
    n = seg.groupBy("corridor", "route").agg(F.count("*").alias("n"))
    n = n.withColumn("yr", F.col("n") / F.sum("n").over(Window.partitionBy("corridor")))
    n = n.select("corridor", "route", "yr", _each((0.0, 0.2, 0.4)))  # not in one step: the sum is over routes, not over values of e
    s = routes.trade_off(_expected(spark, d, _mark).join(routes.summary(seg), ["corridor", "route"]), 0.7).join(n, ["corridor", "route"])
    return routes.choose(s.withColumn("score", F.col("value") + F.col("e") * F.try_divide(F.lit(1.0), 1 - F.col("yr"))), None, "score", ("e", "corridor", "h")).select("e", "corridor", "h", "route")


@query(sql("SELECT v.e, s.corridor, s.h, CASE WHEN own - best > v.e * own + 1e-9 THEN route ELSE pref END AS route FROM (SELECT em.corridor, em.h, min(round(e_km, 9)) AS best, max(CASE WHEN em.route = pref THEN round(e_km, 9) END) AS own, arg_min(em.route, (round(e_km, 9), em.route)) AS route, any_value(pref) AS pref FROM em JOIN st USING (corridor) GROUP BY 1, 2) s, v", "em st", _values("v", MARGINS)))
def margin_switch(spark, d):
    s, static = _expected(spark, d, _mark), _static(spark, d)
    return routes.choose_with_margin(s.select("*", _each(MARGINS)), static, F.col("e"), by=("corridor", "h", "e")).select("e", "corridor", "h", "route")


@query()
def hysteresis(spark, d):
    s = _expected(spark, d, _mark).join(routes.summary(segments(spark, d)).select("corridor", "route", "d_km"), ["corridor", "route"])
    return learn.hysteresis(s.select("corridor", "route", "h", F.round(F.col("e_km") / F.col("d_km"), 9).alias("e")), _static(spark, d), 0.01)


@query(sql("SELECT corridor, h, arg_min(route, (round(t, 6), route)) AS route FROM (SELECT corridor, route, h, sum(km) OVER (PARTITION BY corridor, route ORDER BY h ROWS BETWEEN 186 PRECEDING AND 19 PRECEDING) AS t FROM re) WHERE h >= 500 GROUP BY 1, 2", "re"))
def rolling_static(spark, d):
    w = Window.partitionBy("corridor", "route").orderBy("h").rowsBetween(-186, -19)
    s = _realized(spark, d).withColumn("t", F.round(F.sum("km").over(w), 6)).where("h >= 500")
    return routes.choose(s, None, "t")


@query(sql("SELECT wt.corridor, wt.route, round(sum(CASE WHEN s.run = 1 THEN w END) * any_value(d_km) / 223, 6) AS ongoing_km, round(sum(CASE WHEN s.run = 0 AND s.a = 1 THEN w END) * any_value(d_km) / 223, 6) AS new_km FROM wt JOIN rt USING (corridor, route) JOIN (SELECT p.region, dh.h, l.lead, p.a, min(q.a) AS run FROM dh, range(19) l(lead) JOIN pr p ON p.h = dh.h + l.lead JOIN pr q ON q.region = p.region AND q.h BETWEEN dh.h - 1 AND dh.h + l.lead GROUP BY 1, 2, 3, 4) s ON s.region = wt.region AND s.lead = wt.lead GROUP BY 1, 2", "wt rt dh pr"))
def onset_decomposition(spark, d):
    seg, p = segments(spark, d), presence(spark, d)
    before = p.select("region", (F.col("h") + 1).alias("h"), F.col("a").alias("was"))
    cells = p.select("region", "a", F.col("h").alias("at")).withColumn("lead", F.explode(leads_0_18())).withColumn("h", F.col("at") - F.col("lead")).where(F.col("h").between(fx.TEST, fx.DECISION_LAST))
    sticky = F.min("a").over(Window.partitionBy("region", "h").orderBy("lead").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("run", sticky).join(before, ["region", "h"]).withColumn("run", F.least("run", "was"))
    n = cells.groupBy("region", "lead").agg(F.sum("run").alias("on"), F.sum(F.when(F.col("run") == 0, F.col("a")).otherwise(0)).alias("new"))
    s = routes.weights(seg).join(n, ["region", "lead"]).groupBy("corridor", "route").agg(F.sum(F.col("w") * F.col("on")).alias("on"), F.sum(F.col("w") * F.col("new")).alias("new"))
    s = s.join(routes.summary(seg), ["corridor", "route"])
    part = lambda c: r(F.when(F.col(c) > 0, F.col(c) * F.col("d_km") / 223))
    return s.select("corridor", "route", part("on").alias("ongoing_km"), part("new").alias("new_km"))


@query(_pair_sql("SELECT corridor, arg_max(h, (round(b - x, 6), -h)) AS h, round(max(b - x), 6) AS saved FROM pd GROUP BY 1"))
def case_study(spark, d):
    return _paired(spark, d).groupBy("corridor").agg(F.max_by("h", F.struct(F.round(F.col("b") - F.col("x"), 6), -F.col("h"))).alias("h"), r(F.max(F.col("b") - F.col("x"))).alias("saved"))


@query(_pair_sql("SELECT corridor, round(avg((x < b - 1e-9)::INT), 6) AS wins, round(avg((abs(x - b) <= 1e-9)::INT), 6) AS ties, round(avg((x > b + 1e-9)::INT), 6) AS losses, round(avg(b - x) FILTER (x < b - 1e-9), 6) AS won_km, round(avg(x - b) FILTER (x > b + 1e-9), 6) AS lost_km FROM pd GROUP BY 1"))
def win_tie_loss(spark, d):
    gain = F.col("b") - F.col("x")
    share = lambda c: r(F.avg(c.cast("int")))
    return _paired(spark, d).groupBy("corridor").agg(
        share(gain > 1e-9).alias("wins"), share(F.abs(gain) <= 1e-9).alias("ties"), share(gain < -1e-9).alias("losses"), r(F.avg(F.when(gain > 1e-9, gain))).alias("won_km"), r(F.avg(F.when(gain < -1e-9, -gain))).alias("lost_km")
    )


@query(_pair_sql("SELECT corridor, round(sum(b - x), 6) + 0.0 AS all_km, round(coalesce(sum(b - x) FILTER (h % 24 >= 22 OR h % 24 <= 5), 0), 6) + 0.0 AS night_km, round(coalesce(sum(b - x) FILTER ((h // 24) % 7 >= 5), 0), 6) + 0.0 AS weekend_km, round(coalesce(sum(b - x) FILTER (b > 0), 0), 6) + 0.0 AS exposed_km FROM pd GROUP BY 1"))
def subgroup_improvement(spark, d):
    gain, h = F.col("b") - F.col("x"), F.col("h") % 24
    total = lambda m: r(F.coalesce(F.sum(F.when(m, gain)), F.lit(0.0)))
    return _paired(spark, d).groupBy("corridor").agg(r(F.sum(gain)).alias("all_km"), total((h >= 22) | (h <= 5)).alias("night_km"), total(F.floor(F.col("h") / 24) % 7 >= 5).alias("weekend_km"), total(F.col("b") > 0).alias("exposed_km"))


@query(_pair_sql("SELECT coalesce(corridor, -1) AS corridor, week, count(*) AS n, round(CASE WHEN sum(b) > 0 THEN 100 * (sum(b) - sum(x)) / sum(b) END, 6) AS reduction FROM (SELECT *, h // 168 AS week FROM pd) GROUP BY ROLLUP (week, corridor) HAVING week IS NOT NULL AND count(*) >= 72"))
def weekly_improvement(spark, d):
    p = _paired(spark, d).withColumn("week", F.floor(F.col("h") / 168))
    out = p.rollup("week", "corridor").agg(F.count("*").alias("n"), r(F.try_divide(100 * (F.sum("b") - F.sum("x")), F.sum("b"))).alias("reduction"))
    return out.where("week is not null and n >= 72").select(F.coalesce("corridor", F.lit(-1)).alias("corridor"), "week", "n", "reduction")


@query(sql("SELECT corridor, (h + 2) % 24 AS local_hour, round(avg(m), 6) AS km FROM (SELECT corridor, h, min(km) AS m FROM re GROUP BY 1, 2) GROUP BY 1, 2", "re"))
def departure_hour(spark, d):
    at = F.from_utc_timestamp(F.timestamp_micros(F.col("h") * 3_600_000_000 + fx.EPOCH_US), "Europe/Kyiv")
    low = _realized(spark, d).groupBy("corridor", "h").agg(F.min("km").alias("m"))
    local = F.pmod(F.floor(F.unix_micros(at) / 3_600_000_000), F.lit(24))
    return low.groupBy("corridor", local.alias("local_hour")).agg(r(F.avg("m")).alias("km"))


@query(_pair_sql("SELECT pd.corridor, round(any_value(mean), 6) AS mean, round(any_value(p90), 6) AS p90, round(any_value(q.p95), 6) AS p95, round(any_value(q.over100), 6) AS over100, round(avg(x), 6) AS cvar95 FROM pd JOIN (SELECT corridor, avg(x) AS mean, avg((x > 100)::INT) AS over100, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.95) AS p95 FROM pd GROUP BY 1) q ON q.corridor = pd.corridor AND pd.x >= q.p95 - 1e-9 GROUP BY 1"))
def tail_risk(spark, d):
    p = _paired(spark, d).withColumn("x", F.round("x", 9))
    return stats.tails(p, ["corridor"], "x").select("corridor", r("mean"), r("p90"), r("p95"), r("over100"), r("cvar95"))


@query(_pair_sql("SELECT corridor, round(i, 6) AS reduction, cume_dist() OVER (ORDER BY round(i, 6)) AS ecdf FROM (SELECT corridor, 100 * (sum(b) - sum(x)) / sum(b) AS i FROM pd GROUP BY 1 HAVING sum(b) > 0)"))
def ecdf_reduction(spark, d):
    p = _paired(spark, d).groupBy("corridor").agg(r(F.try_divide(100 * (F.sum("b") - F.sum("x")), F.sum("b"))).alias("reduction")).where("reduction is not null")
    return p.select("corridor", "reduction", F.cume_dist().over(Window.orderBy("reduction")).alias("ecdf"))


@query(sql("SELECT s.name AS strategy, re.corridor, round(avg(re.km), 6) AS km FROM (SELECT 'markov' AS name, corridor, h, arg_min(route, (round(e_km, 9), route)) AS route FROM em GROUP BY ALL UNION ALL SELECT 'climatology', corridor, h, arg_min(route, (round(e_km, 9), route)) FROM ec GROUP BY ALL UNION ALL SELECT 'oracle', corridor, h, arg_min(route, (round(km, 9), route)) FROM re GROUP BY ALL UNION ALL SELECT 'static', st.corridor, dh.h, pref FROM st, dh) s JOIN re USING (corridor, h, route) GROUP BY 1, 2", "em ec re st"))
def strategy_matrix(spark, d):
    real = _realized(spark, d)
    every = fx.union([
        routes.choose(_expected(spark, d, _mark)).withColumn("strategy", F.lit("markov")),
        routes.choose(_expected(spark, d, _clim)).withColumn("strategy", F.lit("climatology")),
        routes.choose(real, None, "km").withColumn("strategy", F.lit("oracle")),
        _static(spark, d).select("corridor", F.explode(fx.decision_hours()).alias("h"), F.col("pref").alias("route")).withColumn("strategy", F.lit("static")),
    ])
    return _mean_by(every, real, ["strategy", "corridor"])


# --- quality and statistics --------------------------------------------------------------------


def _judged(spark, d, which=None) -> DataFrame:
    p = presence(spark, d)
    y = p.select("region", F.col("h").alias("at"), F.col("a").alias("y"))
    f = (which or _mark)(p)
    return f.withColumn("at", F.col("h") + F.col("lead")).withColumn("p", F.round("p", 9)).join(y, ["region", "at"])


_JUDGED = "jd AS (SELECT fm.region, fm.h, fm.lead, round(fm.p, 9) AS p, pr.a AS y FROM fm JOIN pr ON pr.region = fm.region AND pr.h = fm.h + fm.lead)"
_AUC = "sp AS (SELECT {0}, p, sum(y) AS pos, sum(1 - y) AS neg FROM jd GROUP BY ALL), up AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY {0} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS u FROM sp), au AS (SELECT {0}, sum(u) / (sum(pos) * sum(neg)) AS auc FROM up GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0)"


@query(sql("SELECT lead, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM (SELECT lead, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM jd GROUP BY 1, 2) GROUP BY 1", "fm", _JUDGED))
def reliability_ece(spark, d):
    return stats.ece(stats.reliability(_judged(spark, d), ["lead"]), ["lead"]).select("lead", r("ece"))


@query(sql("SELECT lead, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM jd GROUP BY 1, 2", "fm", _JUDGED))
def reliability_bins(spark, d):
    return stats.reliability(_judged(spark, d), ["lead"]).select("lead", "bin", "n", r("mean_p"), r("mean_y"))


@query(sql("SELECT lead, round(avg((p - y) ** 2), 6) AS brier, round(1 - avg((p - y) ** 2) / nullif(avg(y) * (1 - avg(y)), 0), 5) AS skill, round(avg(p - y), 6) + 0.0 AS bias, round(stddev_pop(p - y), 6) AS sd FROM jd GROUP BY 1", "fm", _JUDGED))
def brier_skill(spark, d):
    base = F.avg("y") * (1 - F.avg("y"))
    gap = F.col("p") - F.col("y")
    return _judged(spark, d).groupBy("lead").agg(r(stats.brier()).alias("brier"), r(1 - F.try_divide(stats.brier(), base), 5).alias("skill"), r(F.avg(gap)).alias("bias"), r(F.stddev_pop(gap)).alias("sd"))


@query(sql("SELECT lead, round(auc, 6) AS auc FROM au", "fm", _JUDGED + ", " + _AUC.format("lead")))
def auc_rank(spark, d):
    return stats.auc(_judged(spark, d), ["lead"]).select("lead", r("auc"))


@query(sql("SELECT lead, round(avg(auc), 6) AS auc, count(*) AS regions FROM au GROUP BY 1", "fm", _JUDGED + ", " + _AUC.format("region, lead")))
def within_region_auc(spark, d):
    return stats.auc(_judged(spark, d), ["region", "lead"]).groupBy("lead").agg(r(F.avg("auc")).alias("auc"), F.count("*").alias("regions"))


@query(sql("SELECT lead, round(brier, 6) AS brier, round(auc, 6) AS auc FROM (SELECT lead, avg((p - y) ** 2) AS brier FROM jd GROUP BY 1) LEFT JOIN au USING (lead)", "fm", _JUDGED + ", " + _AUC.format("lead")))
def lead_quality(spark, d):
    j = _judged(spark, d)
    return j.groupBy("lead").agg(stats.brier().alias("brier")).join(stats.auc(j, ["lead"]), "lead", "left").select("lead", r("brier"), r("auc"))


@query(_pair_sql("SELECT corridor, n, w_plus, round((w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 0), 6) AS z FROM (SELECT corridor, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w_plus, sum((t * t - 1.0)) AS ties FROM (SELECT corridor, d, t, rank() OVER (PARTITION BY corridor ORDER BY abs(d)) + (t - 1) / 2.0 AS rk FROM (SELECT corridor, d, count(*) OVER (PARTITION BY corridor, abs(d)) AS t FROM (SELECT corridor, round(b - x, 6) AS d FROM pd) WHERE d <> 0)) GROUP BY 1)"))
def wilcoxon_z(spark, d):
    p = _paired(spark, d).select("corridor", F.round(F.col("b") - F.col("x"), 6).alias("d"))
    return stats.wilcoxon(p, ["corridor"]).select("corridor", "n", F.col("w_plus").cast("double").alias("w_plus"), r("z"))


@query("SELECT s_nationkey, s_suppkey AS name, p, max(least(k * p, 1)) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT s_nationkey, s_suppkey, p, count(*) OVER (PARTITION BY s_nationkey) - row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) + 1 AS k FROM (SELECT s_nationkey, s_suppkey, abs(s_acctbal) / 1e6 AS p FROM supplier))")
def holm(spark, d):
    return stats.holm(fx.table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("name"), (F.abs("s_acctbal") / 1e6).alias("p")), family=["s_nationkey"])


@query("SELECT p_brand, round(corr(x, y), 6) AS rho FROM (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS y FROM part) GROUP BY 1")
def spearman(spark, d):
    return stats.spearman(fx.table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", r("rho"))


@query()
def bootstrap_ci(spark, d):
    s = _paired(spark, d).select("corridor", (F.col("h") - fx.TEST).alias("i"), "b", "x")
    return stats.bootstrap(s, stats.block_starts(spark, 223, 24, 500, 42), ["corridor"]).select("corridor", r("lo"), r("hi"))


@query()
def paired_ci(spark, d):
    real, static = _realized(spark, d), _static(spark, d)
    other = _valued(routes.choose(_expected(spark, d, _clim), static), real).select("corridor", "h", F.col("km").alias("x2"))
    days = _paired(spark, d).join(other, ["corridor", "h"]).groupBy("corridor", F.floor((F.col("h") - fx.TEST) / 24).alias("i")).agg(F.sum("b").alias("b"), F.sum("x").alias("x1"), F.sum("x2").alias("x2"))
    return stats.paired(days, stats.block_starts(spark, 10, 3, 500, 7), ["corridor"]).select("corridor", r("lo"), r("hi"))


# --- graph -------------------------------------------------------------------------------------


def _profiled(spark, d) -> DataFrame:
    half = lambda c: F.struct(F.col(c).alias("region"), (F.col("w") * 500).alias("metres"), (F.col("w") * 30).alias("seconds"))
    return fx.road_edges(spark, d).withColumn("profile", F.array(half("u"), half("v")))


@query(sql("SELECT edge_id, k::BIGINT AS k, CASE k WHEN 0 THEN u ELSE v END AS region, w / 2 AS km, w * 30 AS dt_s, CASE k WHEN 0 THEN w * 15 ELSE w * 45 END AS mid_fwd_s, CASE k WHEN 0 THEN w * 45 ELSE w * 15 END AS mid_bwd_s FROM ed, range(2) x(k)", "ed"))
def edge_pieces(spark, d):
    return graph.pieces(_profiled(spark, d)).withColumn("k", F.col("k").cast("long"))


@query(sql("SELECT src, dst, edge_id, w FROM ar", "ar"))
def arcs(spark, d):
    return graph.arcs(fx.road_edges(spark, d)).select("src", "dst", "edge_id", "w")


@query(sql("SELECT edge_id, round(w / 60 + 16 * sum(w / 2 * p) / 100, 6) AS cost FROM (SELECT edge_id, w, unnest([u, v]) AS region FROM ed) e JOIN (SELECT region, avg(p) AS p FROM fm WHERE h = 480 AND lead BETWEEN 0 AND 7 GROUP BY 1) q USING (region) GROUP BY edge_id, w", "ed fm"))
def edge_risk_update(spark, d):
    e = fx.road_edges(spark, d)
    p = _mark(fx.presence(spark, d)).where(F.col("h") == fx.TEST).where("lead between 0 and 7").groupBy("region").agg(F.avg("p").alias("p"))
    risk = e.select("edge_id", "w", F.explode(F.array("u", "v")).alias("region")).join(p, "region").groupBy("edge_id").agg(F.sum(F.col("w") / 2 * F.col("p")).alias("risk"))
    return e.join(risk, "edge_id", "left").select("edge_id", r(F.col("w") / 60 + 16 * F.coalesce("risk", F.lit(0.0)) / 100).alias("cost"))


def _tau(spark, d) -> DataFrame:
    t = graph.single_source(graph.arcs(fx.road_edges(spark, d)), spark.range(1).select(F.col("id").alias("source")))
    return t.select("node", (F.col("dist") * 60).alias("tau_s"))


_TAU = "walk AS (SELECT 0::BIGINT AS node, 0::DOUBLE AS dist UNION SELECT ar.dst, walk.dist + ar.w FROM walk JOIN ar ON ar.src = walk.node WHERE walk.dist + ar.w <= 60), tau AS (SELECT node, min(dist) * 60 AS tau_s FROM walk GROUP BY 1)"
_LEAD = "lr AS (SELECT h, edge_id, sum(km * p) AS risk_km FROM (SELECT ed.edge_id, unnest([u, v]) AS region, w / 2 AS km, unnest([CASE WHEN a.tau_s <= b.tau_s THEN a.tau_s + w * 15 ELSE b.tau_s + w * 45 END, CASE WHEN a.tau_s <= b.tau_s THEN a.tau_s + w * 45 ELSE b.tau_s + w * 15 END]) AS t_s FROM ed JOIN tau a ON a.node = u JOIN tau b ON b.node = v) x JOIN fm ON fm.region = x.region AND fm.lead = least(floor(t_s / 3600), 18) GROUP BY 1, 2)"


@query(sql("SELECT h, edge_id, round(risk_km, 6) AS risk_km FROM lr", "ar fm", _TAU + ", " + _LEAD))
def edge_lead_risk(spark, d):
    e = _profiled(spark, d)
    return graph.lead_risk(graph.pieces(e), e, _tau(spark, d), _mark(fx.presence(spark, d))).select("h", "edge_id", r("risk_km"))


@query(sql("SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2", "ar", "walk AS (SELECT s.s AS source, s.s AS node, 0::DOUBLE AS dist FROM range(25) s(s) WHERE s.s IN (SELECT src FROM ar) UNION SELECT walk.source, ar.dst, walk.dist + ar.w FROM walk JOIN ar ON ar.src = walk.node WHERE walk.dist + ar.w <= 60)"))
def shortest_paths_single_source(spark, d):
    a = graph.arcs(fx.road_edges(spark, d))
    return graph.single_source(a, a.select(F.col("src").alias("source")).distinct())


@query()
def risk_weighted_paths(spark, d):
    e = _profiled(spark, d)
    risk = graph.lead_risk(graph.pieces(e), e, _tau(spark, d), _mark(fx.presence(spark, d)))
    cost = risk.join(e.select("edge_id", "u", "v", "w"), "edge_id").select("h", "u", "v", (F.col("w") / 60 + 4 * F.col("risk_km") / 100).alias("w"))
    asked = risk.select("h").distinct().select("h", F.lit(0).cast("long").alias("s"), F.explode(F.array(*(F.lit(t).cast("long") for t in (6, 12, 18, 24)))).alias("t"))
    return graph.shortest_paths(asked, graph.arcs(cost)).select("h", "s", "t", r("cost"), F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query(sql("SELECT source, count(DISTINCT node) FILTER (hops <= 3) AS k3, count(DISTINCT node) AS k6 FROM hop GROUP BY 1", "ar", "hop AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM ar UNION SELECT hop.source, ar.dst, hop.hops + 1 FROM hop JOIN ar ON ar.src = hop.node WHERE hops < 6)"))
def k_hop(spark, d):
    a = graph.arcs(fx.road_edges(spark, d))
    reached = graph.k_hop(a, a.select(F.col("src").alias("source")).distinct(), 6)
    return reached.groupBy("source").agg(F.count_if(F.col("hops") <= 3).alias("k3"), F.count("*").alias("k6"))


@query(sql("SELECT node, min(root) AS component FROM reach GROUP BY 1", "ed", "far AS (SELECT u, v FROM ed WHERE v - u = 3), nodes AS (SELECT u AS node FROM ed UNION SELECT v FROM ed), reach AS (SELECT node, node AS root FROM nodes UNION SELECT f.b, reach.root FROM reach JOIN (SELECT u AS a, v AS b FROM far UNION SELECT v, u FROM far) f ON f.a = reach.node)"))
def components(spark, d):
    e = fx.road_edges(spark, d)
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return graph.components(e.where("v - u = 3"), nodes)


def _od(spark, d) -> tuple[DataFrame, DataFrame]:
    a = graph.arcs(fx.road_edges(spark, d))
    n = a.select("src").distinct()
    return n.select(F.col("src").alias("s")).join(n.select(F.col("src").alias("t")), F.col("s") < F.col("t")).where("t - s >= 6"), a


def _paths(spark, d, method: str, k: int) -> DataFrame:
    od, a = _od(spark, d)
    return graph.candidate_paths(od, a, method, k)


def _shown(p: DataFrame) -> DataFrame:
    return p.select("s", "t", "pos", r("cost"), F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query()
def yen_paths(spark, d):
    return _shown(_paths(spark, d, "yen", 3))


@query()
def yen_limited_overlap(spark, d):
    return _shown(_paths(spark, d, "limited", 3))


@query()
def penalty_candidates(spark, d):
    return _shown(_paths(spark, d, "penalty", 3))


@query()
def path_overlap(spark, d):
    steps = graph.path_edges(_paths(spark, d, "limited", 3).drop("cost"), fx.road_edges(spark, d))
    return graph.overlap(steps, ["s", "t"]).select("s", "t", "i", "j", r("share"))


@query()
def path_to_route(spark, d):
    e = _profiled(spark, d)
    steps = graph.path_edges(_paths(spark, d, "limited", 3).drop("cost"), e)
    run = F.when(F.col("forward"), F.col("profile")).otherwise(F.reverse("profile"))
    seg = steps.select((F.col("s") * 100 + F.col("t")).alias("corridor"), F.col("pos").alias("route"), "seq", F.posexplode(run).alias("k", "x"))
    seg = seg.select("corridor", "route", F.col("x.region").alias("region"), (F.col("x.metres") / 1000).alias("km"), (F.col("x.seconds") / 3600).alias("t_h"), (F.col("seq") * 100 + F.col("k")).alias("place"))
    return routes.weights(routes.timed(seg, ["place"])).select("corridor", "route", "lead", "region", r("w"))


@query(sql("SELECT x, count(*) AS n FROM (SELECT least(u, v) * 100 + greatest(u, v) AS x FROM (SELECT DISTINCT src % 5 AS u, dst % 5 AS v FROM ar)) WHERE x % 100 <> x // 100 GROUP BY 1", "ar"))
def adjacency_rollup(spark, d):
    a = fx.adjacency(fx.road_edges(spark, d)).select((F.col("region") % 5).alias("a"), (F.col("other") % 5).alias("b")).where("a <> b").distinct()
    return a.groupBy((F.least("a", "b") * 100 + F.greatest("a", "b")).alias("x")).agg(F.count("*").alias("n"))


# --- geometry ----------------------------------------------------------------------------------


def _points(spark, d) -> DataFrame:
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(F.pmod("c_acctbal", F.lit(100)), 2).alias("x"), (F.col("c_custkey") * 37 % 1009 / 10.09).alias("y"))


_PTS = "pt AS (SELECT c_custkey AS id, round(((c_acctbal % 100) + 100) % 100, 2) AS x, c_custkey * 37 % 1009 / 10.09 AS y FROM customer), tn AS (SELECT s_suppkey AS id, round(((s_acctbal % 100) + 100) % 100, 2) AS x, s_suppkey * 53 % 997 / 9.97 AS y FROM supplier)"


def _towns(spark, d) -> DataFrame:
    s = fx.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.round(F.pmod("s_acctbal", F.lit(100)), 2).alias("x"), (F.col("s_suppkey") * 53 % 997 / 9.97).alias("y"))


@query(sql("SELECT floor(x / 7.5)::BIGINT AS cx, floor(y / 7.5)::BIGINT AS cy, count(*) AS n, round(median(x), 6) AS mid FROM pt GROUP BY 1, 2", "", _PTS))
def grid_cells(spark, d):
    return _points(spark, d).groupBy(geo.cell(F.col("x"), 7.5).alias("cx"), geo.cell(F.col("y"), 7.5).alias("cy")).agg(F.count("*").alias("n"), r(F.percentile("x", 0.5)).alias("mid"))


@query(sql("SELECT id, arg_min(other, (d, other)) AS other, round(min(d), 6) AS d FROM (SELECT pt.id, tn.id AS other, sqrt((pt.x - tn.x) ** 2 + (pt.y - tn.y) ** 2) AS d FROM pt, tn) WHERE d <= 8 GROUP BY 1", "", _PTS))
def city_attach(spark, d):
    return geo.nearest(_points(spark, d), _towns(spark, d), 8.0).select("id", "other", r("d"))


@query("SELECT c_custkey AS id, round(2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(la - 50) / 2), 2) + cos(radians(50)) * cos(radians(la)) * pow(sin(radians(lo - 30) / 2), 2), 1))), 3) AS m FROM (SELECT c_custkey, 22 + c_nationkey * 0.7 AS lo, 45 + c_acctbal / 2000 AS la FROM customer)")
def haversine(spark, d):
    c = fx.table(spark, d, "customer")
    m = geo.haversine(F.lit(30.0), F.lit(50.0), 22 + F.col("c_nationkey") * 0.7, 45 + F.col("c_acctbal") / 2000)
    return c.select(F.col("c_custkey").alias("id"), r(m, 3).alias("m"))


@query(sql("SELECT id, (i * 10 + j + CASE WHEN (i + j) % 2 = 1 AND x - 20 * i > 4 AND y - 20 * j > 4 AND x - 20 * i < 16 AND y - 20 * j < 16 THEN 1000 ELSE 0 END)::BIGINT AS label FROM (SELECT *, floor(x / 20)::BIGINT AS i, floor(y / 20)::BIGINT AS j FROM pt)", "", _PTS))
def point_in_polygon(spark, d):
    t = spark.range(25).select((F.col("id") / 5).cast("long").alias("i"), (F.col("id") % 5).alias("j"))
    ring = lambda x0, y0, x1, y1: F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))

    def boxes(inset: float, add: int) -> DataFrame:
        x0, y0, x1, y1 = F.col("i") * 20.0 + inset, F.col("j") * 20.0 + inset, F.col("i") * 20.0 + 20 - inset, F.col("j") * 20.0 + 20 - inset
        return t.where("(i + j) % 2 = 1" if inset else "true").select((F.col("i") * 10 + F.col("j") + add).alias("label"), F.lit((20 - 2 * inset) ** 2).alias("area"), F.lit(inset > 0).alias("open"), ring(x0, y0, x1, y1).alias("ring"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    return geo.locate(_points(spark, d), boxes(0.0, 0).unionByName(boxes(4.0, 1000)), 20.0)


@query("SELECT l_orderkey, count(*) FILTER (g > 5) + 1 AS n FROM (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS g FROM lineitem) GROUP BY 1")
def gap_merge_count(spark, d):
    return geo.merged_count(fx.table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", 5.0)


# --- learning and streaming --------------------------------------------------------------------


#: A model for each lead.
ALL_LEADS = range(1, 20)


@query()
def per_lead_gbt(spark, d):
    p = fx.presence(spark, d)
    lags = {f"lag{n}": ft.lag0(n) for n in (1, 2, 3, 6, 24)}
    f = p.select("region", "h", "a", *(c.alias(n) for n, c in lags.items()), ft.rolling(24)["mean"].alias("r24"), *(F.lead("a", k).over(ft.by_region()).alias(f"y_{k}") for k in ALL_LEADS))
    return learn.per_lead(f, ["a", *lags, "r24"], list(ALL_LEADS), 360, fx.TEST, trees=5, depth=3).select("region", "h", "k", r("p"))


@query()
def recalibrate(spark, d):
    return learn.recalibrate(_judged(spark, d).select("region", "h", "lead", "p", "y"), days=7).select("region", "h", "lead", r("p"))


@query()
def stacking(spark, d):
    j = _judged(spark, d).select("region", "h", "lead", F.col("p").alias("p1"), "y")
    both = j.join(_clim(presence(spark, d)).withColumnRenamed("p", "p2"), ["region", "h", "lead"])
    return learn.stack(both, days=7).select("region", "h", "lead", r("p"))
