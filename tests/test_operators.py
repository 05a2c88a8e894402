"""Edge semantics on hand-made frames."""

import math

import pytest

from perilgrid.operators import features, forecast, geo, graph, learn, routes, stats, timegrid

H = 3_600_000_000


def log(spark, *rows):
    return spark.createDataFrame([(r, int(s * H), int(f * H)) for r, s, f in rows], "region long, s_us long, f_us long")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_presence_variants(spark):
    one = log(spark, (1, 10, 11))
    assert pairs(timegrid.expand(one, "truth", 0, 0, 24), "h") == [(10,)]
    assert pairs(timegrid.expand(one, "feature", 0, 0, 24), "h") == [(10,), (11,)]
    point = log(spark, (1, 10, 10))
    assert pairs(timegrid.expand(point, "truth", 0, 0, 24), "h") == []
    assert pairs(timegrid.expand(point, "point", 0, 0, 24), "h") == [(10,)]


def test_presence_is_clipped_and_filled(spark):
    hits = timegrid.expand(log(spark, (0, 1, 50)), "truth", 0, 0, 3)
    got = pairs(timegrid.fill(timegrid.grid(spark, 2, 0, 3), hits), "region", "h", "a")
    assert [a for _, _, a in got] == [0, 1, 1, 1, 0, 0, 0, 0]


def test_nested_intervals_need_the_running_finish(spark):
    probes = spark.createDataFrame([(1, 5 * H), (1, 9 * H), (2, 0)], "region long, at long")
    got = timegrid.active_at(probes, log(spark, (1, 1, 9), (1, 2, 3)))
    assert pairs(got, "region", "at", "active") == [(1, 5 * H, 1), (1, 9 * H, 0), (2, 0, 0)]


def test_touching_intervals_merge(spark):
    got = timegrid.merge(log(spark, (1, 1, 2), (1, 2, 3), (1, 5, 6)))
    assert pairs(got, "s_us", "f_us") == [(H, 3 * H), (5 * H, 6 * H)]


def test_instant_state(spark):
    probes = spark.createDataFrame([(1, 3 * H), (1, 0), (1, 10 * H)], "region long, at long")
    got = timegrid.instant_state(probes, log(spark, (1, 1, 4)))
    assert pairs(got, "at", "active", "elapsed_h", "since_end_h") == [(0, 0, 0.0, 168.0), (3 * H, 1, 2.0, 0.0), (10 * H, 0, 0.0, 6.0)]


def panel(spark, *series):
    return spark.createDataFrame([(i, h, a) for i, s in enumerate(series) for h, a in enumerate(s)], "region long, h long, a long")


def test_runs_and_since(spark):
    p = panel(spark, [0, 0, 1, 1, 0], [1] * 5)
    assert [x[2] for x in pairs(features.with_runs(p), "region", "h", "run")] == [1, 2, 1, 2, 1, 1, 2, 3, 4, 5]
    got = pairs(p.select("region", "h", features.hours_since().alias("s")), "region", "h", "s")
    assert [x[2] for x in got] == [720, 720, 0, 0, 1, 0, 0, 0, 0, 0]


def test_markov_has_no_zero_division(spark):
    m = {r["region"]: r for r in forecast.markov(panel(spark, [0] * 5, [1] * 5, [0, 1, 0, 1, 0])).collect()}
    assert (m[0]["p11"], m[0]["p01"], m[0]["pi"]) == (0, 0, 0)
    assert (m[1]["p11"], m[1]["p01"]) == (1, 0)
    assert (m[2]["p11"], m[2]["p01"]) == (0, 1)


def test_forecast_is_causal(spark):
    a, b = panel(spark, [0, 1, 1, 0, 1, 0, 0, 1]), panel(spark, [0, 1, 1, 0, 1, 1, 1, 0])
    f = lambda p: pairs(p.select("h", features.lag0(1).alias("l"), features.rolling(3)["sum"].alias("s")).where("h <= 4"), "h", "l", "s")
    assert f(a) == f(b)


def seg(spark, *rows):
    d = spark.createDataFrame(rows, "corridor long, route long, place long, region long, km double, t_h double")
    return routes.timed(d, ["place"])


def test_long_routes_clamp_or_truncate(spark):
    s = seg(spark, (1, 1, 0, 5, 100.0, 15.0), (1, 1, 1, 6, 100.0, 15.0))
    assert math.isclose(sum(r["w"] for r in routes.weights(s).collect()), 1)
    assert max(r["lead"] for r in routes.weights(s).collect()) == 18
    assert math.isclose(sum(r["hours"] for r in routes.hours_in(s).collect()), 19)


def test_ties_go_to_the_preferred_route_then_the_first(spark):
    s = spark.createDataFrame([(1, 0, 10, 2.0), (1, 0, 20, 2.0)], "corridor long, h long, route long, e_km double")
    assert routes.choose(s).first()["route"] == 10
    assert routes.choose(s, spark.createDataFrame([(1, 20)], "corridor long, pref long")).first()["route"] == 20


def test_a_candidate_with_all_exposure_is_never_chosen(spark):
    s = spark.createDataFrame([(1, 0, 1, 5.0, 1.0), (1, 0, 2, 0.0, 9.0)], "corridor long, h long, route long, e_km double, t_h double")
    assert routes.choose(routes.trade_off(s, 0.5), None, "value").first()["route"] == 2


def test_near_equal_routes(spark):
    s = seg(spark, (1, 1, 0, 5, 10.0, 1.0), (1, 2, 0, 5, 10.04, 1.0), (1, 3, 0, 5, 11.0, 1.0), (1, 4, 0, 6, 10.0, 1.0))
    assert pairs(routes.near_equal(s, 0.05), "route") == [(1,), (3,), (4,)]


def test_hysteresis_stays(spark):
    e = [(1, h, r, x) for h, xs in enumerate([(0.1, 0.2), (0.15, 0.14), (0.3, 0.1)]) for r, x in enumerate(xs)]
    s = spark.createDataFrame(e, "corridor long, h long, route long, e double")
    got = learn.hysteresis(s, spark.createDataFrame([(1, 0)], "corridor long, pref long"), 0.02)
    assert pairs(got, "h", "route") == [(0, 0), (1, 0), (2, 1)]


def test_auc_ties_and_constant_groups(spark):
    f = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 0), ("a", 0.5, 1), ("a", 0.9, 1), ("b", 0.3, 1)], "g string, p double, y long")
    assert pairs(stats.auc(f, ["g"]), "g", "auc") == [("a", 0.875)]


def test_p_value(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(stats.two_sided(F.lit(1.959964)).alias("p")).first()["p"]
    assert abs(got - 0.05) < 1e-6


def test_bootstrap_of_equal_series_is_zero(spark):
    s = spark.createDataFrame([(1, i, float(i % 7 + 1), float(i % 7 + 1)) for i in range(50)], "c long, i long, b double, x double")
    r = stats.bootstrap(s, stats.block_starts(spark, 50, 8, 40, 1), ["c"]).first()
    assert abs(r["lo"]) < 1e-9 and abs(r["hi"]) < 1e-9


EDGES = [(1, 0, 1, 1.0), (2, 1, 3, 1.0), (3, 0, 2, 1.0), (4, 2, 3, 1.0), (5, 7, 8, 2.0)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "edge_id long, u long, v long, w double")
    a = graph.arcs(e)
    start = spark.createDataFrame([(0,)], "source long")
    assert pairs(graph.single_source(a, start), "node", "dist") == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)]
    assert pairs(graph.k_hop(a, start, 1), "node") == [(0,), (1,), (2,)]
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 7, 8, 9)], "node long")
    assert pairs(graph.components(e, nodes), "node", "component") == [(0, 0), (1, 0), (2, 0), (3, 0), (7, 7), (8, 7), (9, 9)]
def test_smallest_polygon_wins_and_outside_is_null(spark):
    from pyspark.sql import functions as F

    box = lambda n, s: (n, float(s * s), [(0.0, 0.0), (float(s), 0.0), (float(s), float(s)), (0.0, float(s))], 0.0, 0.0, float(s), float(s))
    p = spark.createDataFrame([box("big", 10), box("small", 3)], "label string, area double, ring array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 50.0, 5.0)], "id long, x double, y double")
    assert sorted(geo.locate(pts, p, 4.0).select("id", F.coalesce("label", F.lit("-")).alias("l")).collect()) == [(1, "small"), (2, "big"), (3, "-")]


def test_merged_stream(spark, tmp_path):
    from datetime import datetime

    from perilgrid.streaming import hourly

    rows = [(1, datetime(2024, 1, 1, 1, 30), datetime(2024, 1, 1, 3, 10)), (1, datetime(2024, 1, 1, 2, 0), datetime(2024, 1, 1, 2, 30)), (1, datetime(2024, 1, 2, 0, 0), datetime(2024, 1, 2, 0, 0))]
    spark.createDataFrame(rows, "region long, started_at timestamp, finished_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("region long, started_at timestamp, finished_at timestamp").parquet(str(tmp_path / "in"))
    q = hourly.merged_intervals(stream).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["started_at"].hour, r["finished_at"].hour) for r in spark.table("merged").collect()] == [(1, 3)]


def test_long_chain_with_ascending_ids_is_contracted(spark):
    e = spark.range(60).selectExpr("id as u", "id + 1 as v", "1.0D as metres", "1.0D as seconds", "array(named_struct('region', 'a', 'metres', 1.0D, 'seconds', 1.0D)) as profile")
    ends = spark.createDataFrame([(0,), (60,)], "node long")
    assert pairs(graph.contract(e, ends), "u", "v", "metres") == [(0, 60, 60.0)]
    with pytest.raises(RuntimeError):
        graph.contract(e, ends, rounds=1)


def test_pairs_within_are_all_pairs_found_by_several_tasks(spark, monkeypatch):
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, round(rng.uniform(-8, 8), 1), round(rng.uniform(-8, 8), 1)) for i in range(250)] + [(300 + i, 2.5, 5.0) for i in range(30)]
    rows += [(400, 1e300, 1.0), (401, 1e300, 2.0), (402, float("inf"), 1.0), (403, float("inf"), 1.0), (404, float("nan"), 1.0), (405, None, 1.0), (None, 1.0, 1.0), (7, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    known = [(i, x, y) for i, x, y in rows if i is not None and x is not None]
    want = sorted((i, j) for i, x, y in known for j, u, v in known if i < j and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 2.5)
    found = geo.pairs_within(points, 2.5)
    assert pairs(found, "id", "other") == want
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    names = points.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "x", "y")
    assert geo.pairs_within(names, 2.5).where("id < other").count() == len(want)
    monkeypatch.setattr(geo, "_SLICE", 5)
    t = pa.RecordBatch.from_pylist([{"cx": c, "cy": 0, "guest": int(k > 3), "id": 10 * c + k, "x": 0.1 * k, "y": 0.0} for c in range(5) for k in range(9)])
    for size in (2, 9, 13, 45):
        got = [(a, b) for r in geo._close((t.slice(k, size) for k in range(0, 45, size)), 0.35) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist())]
        assert sorted(got) == [(10 * c + a, 10 * c + b) for c in range(5) for a in range(4) for b in range(a + 1, 9) if b - a <= 3]
