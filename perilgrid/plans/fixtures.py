"""Domain views over the star-schema tables, in Spark and, for the oracles, in SQL.

alert log: events, region = user_id % 25; the hour grid is 721 hours from 2024-01-01. Routes: the
corridor is a customer nation, its candidates are order priorities 1..5, a piece is a supplier
nation with the mean quantity as km, driven at 60 km/h. Roads join nations at most 3 apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routes, timegrid

EPOCH_US = 1_704_067_200_000_000
LAST, TEST, REGIONS = 720, 480, 25
DECISION_LAST, PRE_LAST = LAST - 18, TEST - 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timegrid.micros("ts")
    kind = F.when(F.col("event_type").isin("error", "purchase"), "region").when(F.col("event_type") == "signup", "district").otherwise("community")
    d = table(spark, sf_dir, "events").select(
        (F.col("user_id") % REGIONS).alias("region"), F.col("user_id").alias("district"), kind.alias("level"), s.alias("s_us"), (s + F.round(F.col("value") * 60).cast("long") * timegrid.SECOND).alias("f_us")
    )
    return timegrid.clean_log(d, ["region"], "s_us", "f_us")


def region_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_log(spark, sf_dir).where("level = 'region'").select("region", "s_us", "f_us")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = timegrid.expand(region_log(spark, sf_dir), "truth", EPOCH_US, 0, LAST)
    return timegrid.fill(timegrid.grid(spark, REGIONS, 0, LAST), hits)


def decision_hours() -> F.Column:
    return F.sequence(F.lit(TEST), F.lit(DECISION_LAST)).cast("array<long>")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("route"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("corridor"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("region"))
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.groupBy("corridor", "route", "region").agg((F.sum("l_quantity") / F.count("*")).alias("km"))
    d = d.withColumn("t_h", F.col("km") / 60).withColumn("place", (F.col("region") + 7 * F.col("route")) % REGIONS)
    return routes.timed(d, ["place"]).drop("place")


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    d = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "l_quantity").where("u < v and v - u <= 3")
    e = d.groupBy("u", "v").agg((F.min("l_quantity") + F.first(F.col("v") - F.col("u"))).alias("w"))
    return e.select((F.col("u") * 100 + F.col("v")).alias("edge_id"), "u", "v", "w")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("region"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("region"), F.col("u").alias("other")))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# The same views for the oracles.
_SQL = {
    "lg": """lg AS (SELECT DISTINCT user_id % 25 AS region, user_id AS district,
        CASE WHEN event_type IN ('error', 'purchase') THEN 'region' WHEN event_type = 'signup' THEN 'district' ELSE 'community' END AS level,
        epoch_us(ts) AS s, epoch_us(ts) + round(value * 60)::BIGINT * 1000000 AS f
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)""",
    "rl": "rl AS (SELECT region, s, f FROM lg WHERE level = 'region')",
    "hit": """hit AS (SELECT DISTINCT region, unnest(generate_series((s - 1704067200000000) // 3600000000, least((f - 1000000 - 1704067200000000) // 3600000000, 720))) AS h FROM rl)""",
    "pr": """pr AS (SELECT r.r AS region, g.h AS h, (hit.h IS NOT NULL)::BIGINT AS a FROM range(25) r(r) CROSS JOIN range(721) g(h) LEFT JOIN hit ON hit.region = r.r AND hit.h = g.h)""",
    "sg": """sg0 AS (SELECT c_nationkey::BIGINT AS corridor, substr(o_orderpriority, 1, 1)::BIGINT AS route, s_nationkey::BIGINT AS region, sum(l_quantity) / count(*) AS km
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
      sg1 AS (SELECT *, km / 60 AS t_h, row_number() OVER w AS seq, sum(km / 60) OVER (w ROWS UNBOUNDED PRECEDING) AS exit_h FROM sg0 WINDOW w AS (PARTITION BY corridor, route ORDER BY (region + 7 * route) % 25)),
      sg AS (SELECT *, exit_h - t_h AS enter_h FROM sg1)""",
    "rt": """rt AS (SELECT corridor, route, sum(km) AS d_km, sum(t_h) AS t_h, (row_number() OVER (PARTITION BY corridor ORDER BY route) - 1)::BIGINT AS pos FROM sg GROUP BY 1, 2)""",
    "wt": """wt0 AS (SELECT corridor, route, least(floor((enter_h + exit_h) / 2 + 1e-9), 18)::BIGINT AS lead, region, sum(km) AS km FROM sg GROUP BY ALL),
      wt AS (SELECT corridor, route, lead, region, km / sum(km) OVER (PARTITION BY corridor, route) AS w FROM wt0)""",
    "dh": "dh AS (SELECT h FROM range(480, 703) x(h))",
    "re": """re AS (SELECT rt.corridor, rt.route, dh.h, coalesce(sum(w) FILTER (a = 1), 0) AS share, coalesce(sum(w) FILTER (a = 1), 0) * any_value(d_km) AS km
        FROM rt CROSS JOIN dh JOIN wt USING (corridor, route) JOIN pr ON pr.region = wt.region AND pr.h = dh.h + wt.lead GROUP BY 1, 2, 3)""",
    "st": """st0 AS (SELECT rt.corridor, rt.route, round(sum(w * n) / 462 * any_value(d_km), 9) AS pre FROM rt JOIN wt USING (corridor, route)
        JOIN (SELECT region, lead, sum(a) AS n FROM pr, range(19) x(lead) WHERE pr.h - lead BETWEEN 0 AND 461 GROUP BY 1, 2) c USING (region, lead) GROUP BY 1, 2),
      st AS (SELECT corridor, arg_min(route, (pre, route)) AS pref FROM st0 GROUP BY 1)""",
    "cl": "cl AS (SELECT region, h % 168 AS slot, avg(a) AS p FROM pr WHERE h <= 461 GROUP BY 1, 2)",
    "mk": """mk0 AS (SELECT region, h, a, lag(a) OVER (PARTITION BY region ORDER BY h) AS b FROM pr WHERE h <= 461),
      mk1 AS (SELECT region, coalesce(sum(a * b), 0) / greatest(coalesce(sum(b), 0), 1)::DOUBLE AS p11, coalesce(sum((1 - b) * a), 0) / greatest(coalesce(sum(1 - b), 0), 1)::DOUBLE AS p01 FROM mk0 GROUP BY 1),
      mk AS (SELECT region, p11, p01, p01 / greatest(1 - p11 + p01, 1e-9) AS pi, p11 - p01 AS lam FROM mk1)""",
    "fm": """fm AS (SELECT pr.region, pr.h + 1 AS h, l.lead, pi + (a - pi) * pow(lam, l.lead + 1) AS p FROM pr JOIN mk USING (region), range(19) l(lead) WHERE pr.h BETWEEN 479 AND 701)""",
    "fc": "fc AS (SELECT r.region, dh.h, l.lead, coalesce(cl.p, 0) AS p FROM (SELECT DISTINCT region FROM pr) r, dh, range(19) l(lead) LEFT JOIN cl ON cl.region = r.region AND cl.slot = (dh.h + l.lead) % 168)",
    "em": "em AS (SELECT wt.corridor, wt.route, h, sum(w * p) * any_value(d_km) AS e_km FROM wt JOIN fm USING (region, lead) JOIN rt USING (corridor, route) GROUP BY 1, 2, 3)",
    "ec": "ec AS (SELECT wt.corridor, wt.route, h, sum(w * p) * any_value(d_km) AS e_km FROM wt JOIN fc USING (region, lead) JOIN rt USING (corridor, route) GROUP BY 1, 2, 3)",
    "ed": """ed0 AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v, min(l_quantity) AS q
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
      ed AS (SELECT u * 100 + v AS edge_id, u, v, q + (v - u) AS w FROM ed0 WHERE u < v AND v - u <= 3)""",
    "ar": "ar AS (SELECT u AS src, v AS dst, edge_id, w FROM ed UNION ALL SELECT v, u, edge_id, w FROM ed)",
}
_NEEDS = {"rl": "lg", "hit": "rl", "pr": "hit", "rt": "sg", "wt": "sg", "re": "rt wt pr dh", "st": "rt wt pr", "cl": "pr", "mk": "pr", "fm": "mk", "fc": "cl dh", "em": "wt fm rt", "ec": "wt fc rt", "ar": "ed"}


def sql(body: str, needs: str, more: str = "") -> str:
    """body with the views that it needs, in order, and more views of its own."""
    found: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, "").split():
            add(n)
        if name not in found:
            found.append(name)

    for n in needs.split():
        add(n)
    parts = [_SQL[n] for n in found] + ([more] if more else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
