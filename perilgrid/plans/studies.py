"""Queries on shapes of tables, assembled features, refitted forecasts, studies and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions
from ..operators import features as ft
from ..operators import forecast as fc
from ..operators import graph, learn, reshape, routes, stats, timegrid
from . import catalogue as c
from . import fixtures as fx
from .catalogue import _each, _values, query, r
from .fixtures import sql

# --- shapes ------------------------------------------------------------------------------------


@query(sql("SELECT h // 24 AS day, 'r' || region AS name, sum(a)::BIGINT AS n FROM pr GROUP BY 1, 2", "pr"))
def presence_stack(spark, d):
    wide = c.presence_pivot(spark, d)
    return reshape.long(wide, ["day"], [f"r{i}" for i in range(25)], "name", "n")


@query("SELECT c_custkey, " + ", ".join(f"(c_nationkey = {i})::INT AS c_nationkey_{i}" for i in range(25)) + " FROM customer")
def one_hot_nation(spark, d):
    t = fx.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return reshape.one_hot(t, "c_nationkey", list(range(25))).drop("c_nationkey")


@query(sql("SELECT (region % 5) || '|' || region AS unit, h, max(a) OVER (PARTITION BY region % 5, h) AS a FROM pr", "pr"))
def group_to_members(spark, d):
    p = fx.presence(spark, d)
    g = p.groupBy((F.col("region") % 5).cast("string").alias("grp"), "h").agg(F.max("a").alias("a"))
    units = p.select(reshape.compose(F.col("region") % 5, "region").alias("unit")).distinct()
    return reshape.to_members(g, units).select("unit", "h", "a")


@query(sql("SELECT region, sum(a * (h % 7)) AS total, count(*) AS n, max(h) FILTER (h = 100) AS at100 FROM pr GROUP BY 1", "pr"))
def nested_panel(spark, d):
    p = fx.presence(spark, d).withColumn("x", F.col("a").cast("double")).withColumn("y", (F.col("h") % 7).cast("double"))
    n = reshape.nested(p, ["region"], "h", ["h", "x", "y"])
    return n.select("region", reshape.folded_sum("x", "y").cast("long").alias("total"), F.size("h").cast("long").alias("n"), reshape.at_or(F.transform("h", lambda x: x.cast("double")), F.lit(100), -1.0).cast("long").alias("at100"))


@query(sql("SELECT h, region FROM pr WHERE region IN (SELECT min(region) FROM pr GROUP BY region % 5) AND h % 97 = 0 AND h < 485", "pr"))
def one_per_group_every_nth(spark, d):
    p = fx.presence(spark, d).withColumn("grp", F.col("region") % 5)
    return reshape.every_nth(reshape.one_per_group(p, "grp", "region"), ["region"], "h", 97, 5).select("h", "region")


@query("SELECT c_mktsegment, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1")
def largest_per_segment(spark, d):
    return reshape.largest_by_name(fx.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_acctbal", "c_custkey")


@query("SELECT p_brand, list_sort(list(DISTINCT p_size))::VARCHAR AS sizes FROM part GROUP BY 1")
def sorted_sizes(spark, d):
    s = reshape.sorted_set(fx.table(spark, d, "part").select("p_brand", "p_size"), ["p_brand"], "p_size")
    return s.select("p_brand", F.concat(F.lit("["), F.concat_ws(", ", F.col("values").cast("array<string>")), F.lit("]")).alias("sizes"))


@query("SELECT o_orderkey, date_diff('day', date_trunc('day', o_orderdate), date_trunc('day', o_orderdate + INTERVAL 75 HOUR)) + 1 AS n FROM orders")
def day_ranges(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    return o.select("o_orderkey", F.size(reshape.days(F.col("t"), F.col("t") + F.expr("interval 75 hours"))).cast("long").alias("n"))


@query("SELECT event_type, count(*) AS n, min(value) AS min, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_stats(spark, d):
    return stats.latency(fx.table(spark, d, "events").select("event_type", "value"), ["event_type"], "value").select("event_type", "n", "min", r("median"), r("p95"), "max", r("mean"))


@query("SELECT s_suppkey, printf('%+.2f', s_acctbal) || CASE WHEN abs(s_acctbal) / 1e6 < 0.001 THEN '***' WHEN abs(s_acctbal) / 1e6 < 0.01 THEN '**' WHEN abs(s_acctbal) / 1e6 < 0.05 THEN '*' ELSE '' END AS shown FROM supplier")
def signed_marks(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", reshape.signed(F.col("s_acctbal"), 2, F.abs("s_acctbal") / 1e6).alias("shown"))


@query(sql("SELECT a.corridor, a.h, a.e_km AS a, b.e_km AS b, abs(a.e_km - b.e_km) <= 1e-6 * greatest(1, abs(b.e_km)) AS close FROM (SELECT corridor, h, round(min(e_km), 6) AS e_km FROM em GROUP BY 1, 2) a JOIN (SELECT corridor, h, round(min(e_km), 6) AS e_km FROM ec GROUP BY 1, 2) b USING (corridor, h)", "em ec"))
def result_comparison(spark, d):
    low = lambda which: c._expected(spark, d, which).groupBy("corridor", "h").agg(r(F.min("e_km")).alias("e_km"))
    return reshape.compared(low(c._mark), low(c._clim), ["corridor", "h"], "e_km")


# --- features ----------------------------------------------------------------------------------


@query(sql("SELECT region, h, " + c._frames((168, 720), lambda n, w: f"round(avg(a) {w}, 6) AS mean{n}") + " FROM pr", "pr"))
def rolling_long(spark, d):
    return fx.presence(spark, d).select("region", "h", *(r(ft.rolling(n)["mean"]).alias(f"mean{n}") for n in (168, 720)))


@query(sql("SELECT region, week, count(*) AS n, round(avg(a), 6) AS share FROM (SELECT region, h // 168 AS week, a FROM pr WHERE h >= 480) GROUP BY ROLLUP (region, week) HAVING region IS NOT NULL", "pr"))
def presence_share(spark, d):
    p = fx.presence(spark, d).where(F.col("h") >= fx.TEST).withColumn("week", F.floor(F.col("h") / 168))
    return p.rollup("region", "week").agg(F.count("*").alias("n"), r(F.avg("a")).alias("share")).where("region is not null")


@query(sql("SELECT source AS region, node AS other, min(hops) AS hops FROM hop GROUP BY 1, 2", "ar", "hop AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM ar UNION SELECT hop.source, ar.dst, hop.hops + 1 FROM hop JOIN ar ON ar.src = hop.node WHERE hops < 8)"))
def hop_distance(spark, d):
    return ft.hop_distance(fx.adjacency(fx.road_edges(spark, d)))


def _instants_after(spark, d) -> DataFrame:
    """The state at the end of each hour."""
    i = c._instants(spark).withColumn("at", F.col("at") + 3_600_000_000).select("region", "at")
    s = timegrid.instant_state(i, timegrid.merge(fx.region_log(spark, d)))
    return s.withColumn("h", ((F.col("at") - fx.EPOCH_US) / 3_600_000_000).cast("long") - 1)


def _mates(spark) -> DataFrame:
    return spark.range(fx.REGIONS).select(F.col("id").alias("region"), (F.col("id") % 5).alias("grp"))


_GEN = """g0 AS (SELECT region, h, a, lag(a, 1) OVER w AS a1, lag(a, 5) OVER w AS a5, avg(a) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r6, avg(a) OVER (w ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS r168, least(coalesce(h - max(CASE WHEN a = 1 THEN h END) OVER w, 720), 720) AS since,
  (a = 1 AND coalesce(lag(a) OVER w, 0) = 0)::INT AS o, avg(a) OVER (PARTITION BY h) AS nat0, (max(a) OVER g > 0 AND min(a) OVER g < 1)::INT AS part FROM pr WINDOW w AS (PARTITION BY region ORDER BY h), g AS (PARTITION BY region % 5, h)),
g1 AS (SELECT *, sum(o) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS on3, avg(part) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 719 PRECEDING AND CURRENT ROW) AS regime FROM g0),
nn AS (SELECT src AS region, dst AS other, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ar),
n6 AS (SELECT nn.region, g1.h, sum(w * r6) AS nb6, sum(w * on3) AS nbon3 FROM nn JOIN g1 ON g1.region = nn.other GROUP BY 1, 2),
o6 AS (SELECT x.region, x.h, avg(y.r6) AS ob6 FROM g1 x JOIN g1 y ON y.h = x.h AND y.region % 5 = x.region % 5 AND y.region <> x.region GROUP BY 1, 2),
nt AS (SELECT h, avg(n) OVER (ORDER BY h ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS nat24, n - lag(n, 3) OVER (ORDER BY h) AS nat_d3 FROM (SELECT h, any_value(nat0) AS n FROM g0 GROUP BY 1)),
mk5 AS (SELECT region, h, a, lag(a) OVER (PARTITION BY region ORDER BY h) AS b FROM pr),
mk6 AS (SELECT region, h, CASE WHEN count(b) OVER w >= 24 THEN sum(b * a) OVER w / greatest(sum(b) OVER w, 1) END AS p11, CASE WHEN count(b) OVER w >= 24 THEN sum((1 - b) * a) OVER w / greatest(sum(1 - b) OVER w, 1) END AS p01, avg(a) OVER (PARTITION BY region ORDER BY h) AS so_far FROM mk5 WINDOW w AS (PARTITION BY region ORDER BY h ROWS BETWEEN 1007 PRECEDING AND CURRENT ROW))"""


@query(sql("SELECT region, h, a1, a5, round(r6, 6) AS r6, round(r168, 6) AS r168, since, on3, round(nat0, 6) AS nat0, round(nat24, 6) AS nat24, round(nat_d3, 6) + 0.0 AS nat_d3, round(regime, 6) AS regime, round(nb6, 6) AS nb6, round(nbon3, 6) AS nbon3, round(ob6, 6) AS ob6, round(coalesce(p11, 0), 6) AS m_p11, round(coalesce(p01 / greatest(1 - p11 + p01, 1e-6), so_far), 6) AS m_pi FROM g1 JOIN n6 USING (region, h) JOIN o6 USING (region, h) JOIN nt USING (h) JOIN mk6 USING (region, h)", "pr ar", _GEN))
def generic_features(spark, d):
    f = ft.generic(fx.presence(spark, d), fx.adjacency(fx.road_edges(spark, d)), _mates(spark), ft.GROUPS, _instants_after(spark, d))
    rounded = ("r6", "r168", "nat0", "nat24", "nat_d3", "regime", "nb6", "nbon3", "ob6", "m_p11", "m_pi")
    return f.select("region", "h", "a1", "a5", "since", "on3", *(r(x) for x in rounded))


_PROP = c._LIFT + """, q0 AS (SELECT region, h, a, (a = 1 AND lag(a) OVER w = 0)::INT::DOUBLE AS on1, avg(a) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r6 FROM pr WINDOW w AS (PARTITION BY region ORDER BY h)),
q1 AS (SELECT region, h, a, coalesce(on1, 0) AS on1, r6, sum(coalesce(on1, 0)) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS on3 FROM q0),
q2 AS (SELECT q1.*, (EXISTS (SELECT 1 FROM rl WHERE rl.region = q1.region AND rl.s <= (q1.h + 1) * 3600000000 + 1704067200000000 AND rl.f > (q1.h + 1) * 3600000000 + 1704067200000000))::INT AS act FROM q1),
one AS (SELECT src AS region, dst AS other, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ar),
m1 AS (SELECT one.region, h, sum(w * on3) AS nbon3 FROM one JOIN q2 ON q2.region = one.other GROUP BY 1, 2),
m2 AS (SELECT far.region, h, sum(w * r6) AS nb2_6, sum(w * act) AS i_nb2 FROM far JOIN q2 ON q2.region = far.other GROUP BY 1, 2),
m3 AS (SELECT lw.region, h, sum(w * on1) AS up_on1, sum(w * act * (1 - a)) AS up_new FROM lw JOIN q2 ON q2.region = lw.other GROUP BY 1, 2)"""


@query(sql("SELECT q2.region, q2.h, on1, on3, round(avg(on3) OVER (PARTITION BY q2.h), 6) AS naton3, round(nbon3, 6) AS nbon3, round(coalesce(nb2_6, 0), 6) AS nb2_6, round(coalesce(i_nb2, 0), 6) AS i_nb2, round(coalesce(up_on1, 0), 6) AS up_on1, round(coalesce(up_new, 0), 6) AS up_new FROM q2 JOIN m1 USING (region, h) LEFT JOIN m2 USING (region, h) LEFT JOIN m3 USING (region, h)", "pr ar rl", c._FAR + ", " + _PROP))
def propagation_features(spark, d):
    p = fx.presence(spark, d)
    f = ft.propagation(p, fx.adjacency(fx.road_edges(spark, d)), ft.upstream_lift(p).select("region", "other", "w"), _instants_after(spark, d))
    return f.select("region", "h", "on1", "on3", *(r(x) for x in ("naton3", "nbon3", "nb2_6", "i_nb2", "up_on1", "up_new")))


# --- forecasts ---------------------------------------------------------------------------------


@query()
def semi_markov_forecast(spark, d):
    """With windows of 14 days in place of 60, for the log spans 30."""
    s = timegrid.instant_state(c._instants(spark).select("region", "at"), timegrid.merge(fx.region_log(spark, d)))
    s = s.select("region", ((F.col("at") - fx.EPOCH_US) / 3_600_000_000).cast("long").alias("h"), "active", fc.state_bin(F.col("active"), F.col("elapsed_h"), F.col("since_end_h")).alias("bin"))
    p = fx.presence(spark, d)
    return fc.semi_markov(s, p, c._cells(p), 14).select("region", "h", "lead", r("p"))


@query()
def rolling_origin(spark, d):
    """Two windows, each trained anew, on the generic features without their optional groups."""
    p = fx.presence(spark, d)
    f = ft.generic(p, fx.adjacency(fx.road_edges(spark, d)), _mates(spark))
    f = f.withColumn("y_1", F.lead("a", 1).over(ft.by_region()))
    columns = ["a", "a1", "a2", "r3", "r24", "since", "nb0", "nb6", "ob0", "nat0", "nat24"]
    return learn.rolling_origin(f, columns, [1], [(300, 400, 500), (420, 520, 620)], trees=5, depth=3).select("window", "region", "h", "k", r("p"))


@query()
def anchored_training(spark, d):
    """The harness's form: thinned rows and the anchor group of features."""
    p = fx.presence(spark, d)
    f = ft.generic(p, fx.adjacency(fx.road_edges(spark, d)), _mates(spark), ("anchor",)).withColumn("y_6", F.lead("a", 6).over(ft.by_region()))
    train, rest = ft.thinned(f.where(F.col("h") < 360)), f.where(F.col("h") >= 360)
    return learn.per_lead(train.unionByName(rest), ["a", "r24", "m_pi", "m_p11", "m_p01", "rate28", "nb0"], [6], 360, fx.TEST, trees=5, depth=3).select("region", "h", "k", r("p"))


@query(sql("SELECT corridor, h, arg_min(route, (round(e, 9) + CASE WHEN route = pref THEN 0 ELSE 1e-9 END, route)) AS route FROM (SELECT s.corridor, s.route, fm.h, sum(s.w * fm.p) * any_value(d_km) AS e FROM (SELECT corridor, route, region, km / sum(km) OVER (PARTITION BY corridor, route) AS w FROM sg) s JOIN fm ON fm.region = s.region AND fm.lead = 6 JOIN rt ON rt.corridor = s.corridor AND rt.route = s.route GROUP BY 1, 2, 3) JOIN st USING (corridor) GROUP BY 1, 2", "sg fm rt st"))
def single_horizon_choice(spark, d):
    seg = c.segments(spark, d)
    p6 = c._mark(c.presence(spark, d)).where("lead = 6").select("region", "h", "p")
    s = routes.shares(seg).join(p6, "region").groupBy("corridor", "route", "h").agg(F.sum(F.col("w") * F.col("p")).alias("e"))
    s = s.join(routes.summary(seg), ["corridor", "route"]).withColumn("e_km", F.col("e") * F.col("d_km"))
    return routes.choose(s, c._static(spark, d))


@query(sql("SELECT corridor, h, arg_min(route, (round(share, 9) + CASE WHEN route = pref THEN 0 ELSE 1e-9 END, route)) AS route FROM (SELECT wt.corridor, wt.route, dh.h, sum(w * p.a) AS share FROM wt CROSS JOIN dh JOIN pr p ON p.region = wt.region AND p.h = dh.h + 3 GROUP BY 1, 2, 3) JOIN st USING (corridor) GROUP BY 1, 2", "wt dh pr st"))
def look_ahead_choice(spark, d):
    """An ablation that sees three hours ahead: the share in regions active then."""
    seg, p = c.segments(spark, d), c.presence(spark, d)
    ahead = p.select("region", (F.col("h") - 3).alias("h"), "a").where(F.col("h").between(fx.TEST, fx.DECISION_LAST))
    s = routes.weights(seg).join(ahead, "region").groupBy("corridor", "route", "h").agg(F.sum(F.col("w") * F.col("a")).alias("share"))
    return routes.choose(s, c._static(spark, d), "share")


_SEVEN = """q AS (SELECT corridor, route, count(*) AS s1, max(region) AS s2, sum(km * (region % 3)) AS s3, count(*) FILTER (region % 2 = 0) AS s4, min(region) AS s5 FROM sg GROUP BY 1, 2),
z AS (SELECT em.corridor, em.route, em.h, coalesce(em.e_km / nullif(sum(em.e_km) OVER w, 0), 0) AS ye, rt.t_h / sum(rt.t_h) OVER w AS yt, s1 / sum(s1) OVER w AS y1, coalesce(s2 / nullif(sum(s2) OVER w, 0), 0) AS y2, coalesce(s3 / nullif(sum(s3) OVER w, 0), 0) AS y3, coalesce(s4 / nullif(sum(s4) OVER w, 0), 0) AS y4, coalesce(s5 / nullif(sum(s5) OVER w, 0), 0) AS y5
  FROM em JOIN rt USING (corridor, route) JOIN q USING (corridor, route) WINDOW w AS (PARTITION BY em.corridor, em.h))"""


def _inv(y: str, g: str) -> str:
    return f"CASE WHEN 1 - {y} <= 0 THEN CASE WHEN {g} > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE {g} / (1 - {y}) END"


@query(sql("SELECT e, corridor, h, arg_min(route, (round(0.2 / (1 - yt) + " + _inv("ye", "(0.8 - e)") + " + " + " + ".join(_inv(f"y{i}", "(e / 5)") for i in range(1, 6)) + ", 9), route)) AS route FROM z, v GROUP BY 1, 2, 3", "em rt", _SEVEN + ", " + _values("v", (0.0, 0.2, 0.4))))
def seven_criteria(spark, d):
    seg = c.segments(spark, d)
    region = F.col("region")
    static = seg.groupBy("corridor", "route").agg(F.count("*").alias("s1"), F.max("region").alias("s2"), F.sum(F.col("km") * (region % 3)).alias("s3"), F.count_if(region % 2 == 0).alias("s4"), F.min("region").alias("s5"))
    s = c._expected(spark, d, c._mark).join(routes.summary(seg), ["corridor", "route"]).join(static, ["corridor", "route"]).select("*", _each((0.0, 0.2, 0.4)))
    s = routes.many_criteria(s, ["s1", "s2", "s3", "s4", "s5"], F.col("e"), by=("corridor", "h", "e"))
    return routes.choose(s, None, "value", ("e", "corridor", "h")).select("e", "corridor", "h", "route")


@query(c._pair_sql("SELECT corridor, list_sort(list(DISTINCT route))::VARCHAR AS routes_used, sum(m)::BIGINT AS changes FROM (SELECT *, coalesce((route <> lag(route) OVER (PARTITION BY corridor ORDER BY h))::INT, 0) AS m FROM pd) GROUP BY 1"))
def choice_churn(spark, d):
    t = routes.churn(c._paired(spark, d).select("corridor", "h", "route"))
    return t.select("corridor", F.concat(F.lit("["), F.concat_ws(", ", F.col("routes_used").cast("array<string>")), F.lit("]")).alias("routes_used"), "changes")


@query(sql("SELECT corridor, route, pos, round(d_km, 6) AS d_km, round(t_h, 6) AS t_h, n, round(w, 6) AS w FROM rt JOIN (SELECT corridor, route, count(DISTINCT region) AS n FROM sg GROUP BY 1, 2) USING (corridor, route) JOIN (SELECT corridor, route, sum(w) AS w FROM wt GROUP BY 1, 2) USING (corridor, route)", "rt sg wt"))
def corridor_assembly(spark, d):
    a = routes.assembled(c.segments(spark, d))
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x["w"])
    return a.select("corridor", "route", "pos", r("d_km"), r("t_h"), F.size("regions").cast("long").alias("n"), r(total).alias("w"))


@query(sql("SELECT corridor, k, arg_min(route, (pre, route)) AS pref, round(min(pre), 6) AS pre FROM (SELECT x.*, k FROM st0 x JOIN rt USING (corridor, route), (VALUES (1), (2), (3), (5)) v(k) WHERE pos < k) GROUP BY 1, 2", "rt st"))
def prefix_static(spark, d):
    """The static choice among the first k candidates."""
    seg, p = c.segments(spark, d), c.presence(spark, d)
    real = routes.realized(F.sequence(F.lit(0), F.lit(fx.PRE_LAST)).cast("array<long>"), routes.weights(seg), p, routes.summary(seg))
    pre = real.groupBy("corridor", "route").agg(F.round(F.avg("km"), 9).alias("pre")).join(routes.summary(seg).select("corridor", "route", "pos"), ["corridor", "route"])
    k = reshape.prefixes(pre, "pos", (1, 2, 3, 5))
    return k.groupBy("corridor", "k").agg(F.min_by("route", F.struct("pre", "route")).alias("pref"), r(F.min("pre")).alias("pre"))


# --- statistics and reports --------------------------------------------------------------------


@query(c._pair_sql("SELECT coalesce(corridor, -1) AS corridor, month, count(*) AS n, round(CASE WHEN sum(b) > 0 THEN 100 * (sum(b) - sum(x)) / sum(b) END, 6) AS reduction FROM (SELECT *, strftime(make_timestamp(h * 3600000000 + 1704067200000000), '%Y-%m') AS month FROM pd) GROUP BY ROLLUP (month, corridor) HAVING month IS NOT NULL AND count(*) >= 72"))
def monthly_improvement(spark, d):
    at = F.timestamp_micros(F.col("h") * 3_600_000_000 + fx.EPOCH_US)
    p = c._paired(spark, d).withColumn("month", F.date_format(F.date_trunc("month", at), "yyyy-MM"))
    out = p.rollup("month", "corridor").agg(F.count("*").alias("n"), r(F.try_divide(100 * (F.sum("b") - F.sum("x")), F.sum("b"))).alias("reduction"))
    return out.where("month is not null and n >= 72").select(F.coalesce("corridor", F.lit(-1)).alias("corridor"), "month", "n", "reduction")


@query(c._pair_sql("SELECT 1 AS one, round(100 * (sum(b) - sum(x)) / sum(b), 6) AS pooled, round(avg(i), 6) AS mean, round(median(i), 6) AS median, round(avg((i > 0)::INT), 6) AS better FROM (SELECT corridor, sum(b) AS b, sum(x) AS x, 100 * (sum(b) - sum(x)) / nullif(sum(b), 0) AS i FROM pd GROUP BY 1)"))
def pooled_reduction(spark, d):
    od = c._paired(spark, d).groupBy("corridor").agg(F.sum("b").alias("b"), F.sum("x").alias("x")).withColumn("one", F.lit(1))
    return stats.pooled(od, ["one"], "b", "x").select("one", r("pooled"), r("mean"), r("median"), r("better"))


@query(sql("SELECT corridor, h, round(any_value(b), 6) AS b, round(any_value(again), 6) AS again FROM (SELECT bs.corridor, bs.h, b, re.km AS again FROM bs JOIN st USING (corridor) JOIN re ON re.corridor = bs.corridor AND re.h = bs.h AND re.route = st.pref) GROUP BY 1, 2", "re st", c._BASE))
def baseline_consistency(spark, d):
    real, static = c._realized(spark, d), c._static(spark, d)
    base = real.join(static, "corridor").where("route = pref").select("corridor", "h", F.col("km").alias("b"))
    again = c._valued(static.select("corridor", F.explode(fx.decision_hours()).alias("h"), F.col("pref").alias("route")), real).select("corridor", "h", F.col("km").alias("again"))
    return reshape.consistent(base.join(again, ["corridor", "h"]), "b", "again").select("corridor", "h", r("b"), r("again"))


@query()
def masked_ci(spark, d):
    s = c._paired(spark, d).select("corridor", (F.col("h") - fx.TEST).alias("i"), "b", "x", ((F.col("h") % 24 >= 22) | (F.col("h") % 24 <= 5)).alias("keep"))
    return stats.masked_bootstrap(s, stats.block_starts(spark, 223, 24, 500, 7), ["corridor"]).select("corridor", r("lo"), r("hi"))


_CHOSEN = "(SELECT corridor, h, arg_min(route, (round(e_km, 9), route)) AS route FROM {0} GROUP BY 1, 2)"


@query(sql("SELECT corridor, round(max(km) FILTER (name = 'climatology'), 6) AS climatology, round(max(km) FILTER (name = 'markov'), 6) AS markov, round(max(km) FILTER (name = 'markov') - max(km) FILTER (name = 'climatology'), 5) + 0.0 AS change FROM (SELECT name, corridor, avg(km) AS km FROM (SELECT 'markov' AS name, * FROM " + _CHOSEN.format("em") + " UNION ALL SELECT 'climatology', * FROM " + _CHOSEN.format("ec") + ") JOIN re USING (corridor, h, route) GROUP BY 1, 2) GROUP BY 1", "em ec re"))
def run_report(spark, d):
    real = c._realized(spark, d)
    runs = fx.union([c._valued(routes.choose(c._expected(spark, d, f)), real).withColumn("run", F.lit(n)) for n, f in (("climatology", c._clim), ("markov", c._mark))])
    mean = runs.groupBy("run", "corridor").agg(F.avg("km").alias("km"))
    return reshape.report(mean, "run", ["climatology", "markov"], ["corridor"], "km").select("corridor", r("climatology"), r("markov"), r("change", 5))


@query(sql("SELECT lead, arg_min(name, (brier, name)) AS model, min(brier) AS brier FROM (SELECT 'markov' AS name, lead, round(avg((fm.p - a) ** 2), 6) AS brier FROM fm JOIN pr ON pr.region = fm.region AND pr.h = fm.h + fm.lead GROUP BY 2 UNION ALL SELECT 'climatology', lead, round(avg((fc.p - a) ** 2), 6) FROM fc JOIN pr ON pr.region = fc.region AND pr.h = fc.h + fc.lead GROUP BY 2) GROUP BY 1", "fm fc"))
def best_model(spark, d):
    one = lambda name, f: c._judged(spark, d, f).groupBy("lead").agg(r(stats.brier()).alias("brier")).withColumn("model", F.lit(name))
    return reshape.best_variant(one("markov", c._mark).unionByName(one("climatology", c._clim)), ["lead"], "model", "brier")


@query(sql("SELECT w.corridor, w.route, w.lead, w.district, round(w.w, 6) AS w FROM (SELECT corridor, route, lead, region % 5 AS district, sum(w) AS w FROM wt GROUP BY ALL) w", "wt"))
def district_routes(spark, d):
    """Candidates in the regions of another level."""
    w = routes.weights(fx.segments(spark, d)).withColumn("district", F.col("region") % 5)
    return w.groupBy("corridor", "route", "lead", "district").agg(r(F.sum("w")).alias("w"))


@query(sql("SELECT DISTINCT region, district FROM lg WHERE region NOT IN (3, 7) AND level <> 'community'", "lg"))
def region_dimension(spark, d):
    log = fx.alert_log(spark, d)
    gone = spark.createDataFrame([(3,), (7,)], "region long")
    return log.where("level <> 'community'").select("region", "district").distinct().join(F.broadcast(gone), "region", "left_anti")


@query(sql("SELECT DISTINCT region, unnest(generate_series((s - 1704067200000000) // 3600000000, least((f - 1000000 - 1704067200000000) // 3600000000, 720)))::BIGINT AS h FROM lg WHERE level IN ('region', 'district')", "lg"))
def presence_rolled_up(spark, d):
    """District alerts count for their region, too."""
    log = fx.alert_log(spark, d).where(F.col("level").isin("region", "district"))
    return timegrid.expand(log, "truth", fx.EPOCH_US, 0, fx.LAST)


@query(sql("SELECT d.unit, count(*) AS n, round(avg(pow(f.p - t.y, 2)), 6) AS brier FROM (SELECT DISTINCT region, district AS unit FROM lg) d JOIN fm f ON f.region = d.region AND f.lead = 0 JOIN (SELECT region, h, a AS y FROM pr) t ON t.region = d.region AND t.h = f.h GROUP BY 1", "lg fm pr"))
def district_control(spark, d):
    """The regions' forecast scored on their districts."""
    units = fx.alert_log(spark, d).select("region", F.col("district").alias("unit")).distinct()
    j = c._mark(c.presence(spark, d)).where("lead = 0").join(c.presence(spark, d).withColumnRenamed("a", "y"), ["region", "h"])
    return units.join(j, "region").groupBy("unit").agg(F.count("*").alias("n"), r(stats.brier()).alias("brier"))


@query(sql("SELECT st.corridor, rt.route, round(t_h, 6) AS t_h, round(d_km, 6) AS d_km, round(m.km, 6) AS test, round(m.share, 6) AS share FROM rt JOIN st USING (corridor) JOIN (SELECT corridor, route, avg(km) AS km, avg(share) AS share FROM re GROUP BY 1, 2) m ON m.corridor = rt.corridor AND m.route = rt.route", "re st"))
def candidate_table(spark, d):
    real = c._realized(spark, d).groupBy("corridor", "route").agg(F.avg("km").alias("km"), F.avg("share").alias("share"))
    return routes.summary(c.segments(spark, d)).join(real, ["corridor", "route"]).select("corridor", "route", r("t_h"), r("d_km"), r("km").alias("test"), r("share"))


_UNITED = "un AS (SELECT 'markov' AS model, region, h, lead, p FROM fm UNION ALL SELECT 'climatology', region, h, lead, p FROM fc UNION ALL SELECT 'blend', region, h, lead, (fm.p + fc.p) / 2 FROM fm JOIN fc USING (region, h, lead))"


@query(sql("SELECT model, lead + 1 AS k, count(*) AS n, round(avg(p), 6) AS p FROM un GROUP BY 1, 2", "fm fc", _UNITED))
def forecast_export(spark, d):
    """Forecasts in their common long form: the feature row's hour and the model's number."""
    p = c.presence(spark, d)
    m, k = c._mark(p), c._clim(p)
    every = fx.union([f.withColumn("model", F.lit(n)) for n, f in (("markov", m), ("climatology", k), ("blend", fc.blend(m, k)))])
    out = every.select("model", "region", (F.col("h") - 1).alias("row_h"), (F.col("lead") + 1).alias("k"), "p")
    return out.groupBy("model", "k").agg(F.count("*").alias("n"), r(F.avg("p")).alias("p"))


@query(sql("SELECT s.e, s.corridor, round(avg(re.km), 6) AS km FROM (SELECT v.e, x.corridor, x.h, CASE WHEN own - best > v.e * own + 1e-9 THEN route ELSE pref END AS route FROM (SELECT em.corridor, em.h, min(round(e_km, 9)) AS best, max(CASE WHEN em.route = pref THEN round(e_km, 9) END) AS own, arg_min(em.route, (round(e_km, 9), em.route)) AS route, any_value(pref) AS pref FROM em JOIN st USING (corridor) GROUP BY 1, 2) x, v) s JOIN re USING (corridor, h, route) GROUP BY 1, 2", "em st re", _values("v", c.MARGINS)))
def margin_matrix(spark, d):
    s, static = c._expected(spark, d, c._mark), c._static(spark, d)
    pick = routes.choose_with_margin(s.select("*", _each(c.MARGINS)), static, F.col("e"), by=("corridor", "h", "e"))
    return c._mean_by(pick, c._realized(spark, d), ["e", "corridor"])


# --- streams -----------------------------------------------------------------------------------


@query(sql("SELECT region, h, count(*) AS n FROM (SELECT region, unnest(generate_series((s - 1704067200000000) // 3600000000, greatest((f - 1000000 - 1704067200000000) // 3600000000, (s - 1704067200000000) // 3600000000))) AS h FROM (SELECT DISTINCT region, s, f FROM rl)) WHERE h < (SELECT max(s) - 7200000000 - 1704067200000000 FROM rl) // 3600000000 GROUP BY 1, 2", "rl"))
def stream_hourly_presence(spark, d):
    """The online presence, fed from the log as a stream of files, as far as hours are final."""
    import uuid

    from ..streaming import hourly

    folder = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    log = fx.region_log(spark, d).select("region", F.timestamp_micros("s_us").alias("started_at"), F.timestamp_micros("f_us").alias("finished_at"))
    log.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")
    q = hourly.hourly_presence(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").start(f"{folder}/out")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.schema("region long, hour timestamp, n long").parquet(f"{folder}/out")
    return out.select("region", F.floor((F.unix_micros("hour") - fx.EPOCH_US) / 3_600_000_000).alias("h"), "n")


# --- the same evaluation on other inputs -------------------------------------------------------


def on_inputs(segments: DataFrame, presence: DataFrame) -> None:
    """From here on the query being built reads these for its segments and its panel."""
    c._shared.get().update(segments=graph.checkpointed(segments), presence=graph.checkpointed(presence))


def _evaluated(spark, d) -> DataFrame:
    """(strategy, corridor, km, reduction, z): each strategy's mean km under alert, what it saves against
    the static choice, and the rank statistic of its hourly differences."""
    real, static = c._realized(spark, d), c._static(spark, d)
    base = real.join(static, "corridor").where("route = pref").select("corridor", "h", F.col("km").alias("b"))
    choices = {"markov": routes.choose(c._expected(spark, d, c._mark), static), "climatology": routes.choose(c._expected(spark, d, c._clim), static), "oracle": routes.choose(real, None, "km")}
    every = fx.union([c._valued(x, real).withColumn("strategy", F.lit(n)).select("strategy", "corridor", "h", "km") for n, x in choices.items()]).join(base, ["corridor", "h"])
    mean = every.groupBy("strategy", "corridor").agg(r(F.avg("km")).alias("km"), r(routes.improvement(F.col("b"), F.col("km"))).alias("reduction"))
    signed = stats.wilcoxon(every.select("strategy", "corridor", F.round(F.col("b") - F.col("km"), 6).alias("d")), ["strategy", "corridor"])
    return mean.join(signed.select("strategy", "corridor", r("z")), ["strategy", "corridor"], "left")


_EVALUATED = sql(
    """SELECT m.strategy, m.corridor, m.km, m.reduction, w.z FROM (SELECT strategy, corridor, round(avg(km), 6) AS km, round(CASE WHEN avg(b) > 0 THEN 100 * (avg(b) - avg(km)) / avg(b) END, 6) AS reduction FROM ev GROUP BY 1, 2) m LEFT JOIN
  (SELECT strategy, corridor, round((w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 0), 6) AS z FROM (SELECT strategy, corridor, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w_plus, sum((t * t - 1.0)) AS ties FROM (SELECT strategy, corridor, d, t, rank() OVER (PARTITION BY strategy, corridor ORDER BY abs(d)) + (t - 1) / 2.0 AS rk FROM (SELECT strategy, corridor, d, count(*) OVER (PARTITION BY strategy, corridor, abs(d)) AS t FROM (SELECT strategy, corridor, round(b - km, 6) AS d FROM ev) WHERE d <> 0)) GROUP BY 1, 2)) w USING (strategy, corridor)""",
    "em ec re st",
    c._BASE + ", " + c._ORACLE + ", " + ", ".join(f"{n} AS (SELECT s.corridor, s.h, arg_min(s.route, (round(s.e_km, 9) + CASE WHEN s.route = st.pref THEN 0 ELSE 1e-9 END, s.route)) AS route FROM {v} s JOIN st USING (corridor) GROUP BY 1, 2)" for n, v in (("cm", "em"), ("cc", "ec")))
    + ", ev AS (SELECT x.strategy, x.corridor, x.h, re.km, bs.b FROM (SELECT 'markov' AS strategy, * FROM cm UNION ALL SELECT 'climatology', * FROM cc UNION ALL SELECT 'oracle', * FROM orc) x JOIN re USING (corridor, h, route) JOIN bs ON bs.corridor = x.corridor AND bs.h = x.h)",
)
_PANEL = fx._SQL["pr"]
_DISTRICTS = _EVALUATED.replace(_PANEL, _PANEL.replace("pr AS", "pr0 AS", 1) + ", pr AS (SELECT region % 5 AS region, h, max(a) AS a FROM pr0 GROUP BY 1, 2)").replace("sg AS (SELECT *, exit_h", "sg AS (SELECT * REPLACE (region % 5 AS region), exit_h")


@query(_DISTRICTS)
def district_evaluation(spark, d):
    """On the districts of another level, active if any region of theirs is."""
    p = fx.presence(spark, d).groupBy((F.col("region") % 5).alias("region"), "h").agg(F.max("a").alias("a"))
    on_inputs(fx.segments(spark, d).withColumn("region", F.col("region") % 5), p)
    return _evaluated(spark, d)


@query(_EVALUATED.replace("WHERE level = 'region')", "WHERE level = 'community')"))
def second_hazard_evaluation(spark, d):
    """On another hazard's log."""
    log = fx.alert_log(spark, d).where("level = 'community'").select("region", "s_us", "f_us")
    p = timegrid.fill(timegrid.grid(spark, fx.REGIONS, 0, fx.LAST), timegrid.expand(log, "truth", fx.EPOCH_US, 0, fx.LAST))
    on_inputs(fx.segments(spark, d), p)
    return _evaluated(spark, d)


# --- scalar functions --------------------------------------------------------------------------


@query("""SELECT c_custkey, round(ln(p / (1 - p)), 6) AS z, round(greatest(least(ln(q / (1 - q)), 9), -9), 6) AS z9, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS s, CASE WHEN c_nationkey = 0 THEN 0 ELSE round(c_acctbal / c_nationkey, 6) END AS ratio,
  CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 1 THEN 0 WHEN c_acctbal < 300 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS bin, least(c_custkey * 977 // 3600, 18) AS lead,
  round(radians(22 + c_nationkey) * 6371000 * cos(radians(48.5)), 3) AS x, round(radians(45 + c_nationkey / 7.0) * 6371000, 3) AS y
  FROM (SELECT *, greatest(least(abs(c_acctbal) / 10000, 1 - 1e-4), 1e-4) AS p, greatest(least(abs(c_acctbal) / 10000, 1 - 1e-6), 1e-6) AS q FROM customer)""")
def scalar_functions(spark, d):
    x, n = F.col("c_acctbal"), F.col("c_nationkey")
    p = F.abs(x) / 10000
    east, north = functions.project(22 + n, 45 + n / 7.0)
    return fx.table(spark, d, "customer").select(
        "c_custkey", r(functions.logit(p)).alias("z"), r(functions.logit(p, 1e-6, 9.0)).alias("z9"), r(functions.sigmoid(x / 1000), 9).alias("s"), r(functions.safe_ratio(x, n.cast("double"))).alias("ratio"),
        functions.bin_of(x, [0.0, 1.0, 300.0, 5000.0]).alias("bin"), functions.lead_of(F.col("c_custkey") * 977).alias("lead"), r(east, 3).alias("x"), r(north, 3).alias("y"),
    )


@query("SELECT event_id, date_trunc('hour', ts) AS lo, date_trunc('hour', ts + INTERVAL 3599999999 MICROSECONDS) AS hi FROM events")
def hour_edges(spark, d):
    t = F.col("ts")
    return fx.table(spark, d, "events").select("event_id", functions.floor_hour(t).cast("timestamp_ntz").alias("lo"), functions.ceil_hour(t).cast("timestamp_ntz").alias("hi"))
