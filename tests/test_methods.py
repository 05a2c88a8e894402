"""Searches, fits and streams against plain recomputation."""

import math
import random
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.operators import build, features, forecast, geo, graph, learn, paths, reshape, routes, stats
from perilgrid.sources import binary, readers, writers
from perilgrid.streaming import hourly


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


# --- searches ----------------------------------------------------------------------------------


def random_arcs(seed, nodes=7):
    """Arcs with parallel ones, one-way ones and weights of which no two sums are equal."""
    rnd, out = random.Random(seed), []
    for a in range(nodes):
        for b in range(nodes):
            if a != b and rnd.random() < 0.45:
                for _ in range(rnd.choice((1, 1, 2))):
                    out.append((a, b, rnd.randint(1, 9) + rnd.random(), float(rnd.randint(1, 20))))
    return out


def graph_of(arcs):
    return paths.Graph(*(np.array(x) for x in zip(*arcs)))


def every_path(arcs, s, t):
    best = {}
    for a, b, w, n in arcs:
        best[a, b] = min(best.get((a, b), (math.inf, 0)), (w, n))
    out = []

    def walk(path, cost):
        if path[-1] == t:
            out.append((cost, path))
            return
        for (a, b), (w, _) in best.items():
            if a == path[-1] and b not in path:
                walk([*path, b], cost + w)

    walk([s], 0.0)
    return best, sorted(out)


def shared(best, p, q):
    road = lambda x: {(min(a, b), max(a, b)): best[a, b][1] for a, b in zip(x, x[1:])}
    own, other = road(p), road(q)
    return sum(n for e, n in own.items() if e in other), sum(own.values())


@pytest.mark.parametrize("seed", range(12))
def test_loopless_and_limited_paths_against_enumeration(seed):
    arcs = random_arcs(seed)
    g = graph_of(arcs)
    if 0 not in g.place or 6 not in g.place:
        return
    s, t = g.place[0], g.place[6]
    best, want = every_path(arcs, 0, 6)
    got = [(c, g.named(p)) for c, p in paths.loopless(g, s, t)]
    assert [p for _, p in got] == [p for _, p in want] and np.allclose([c for c, _ in got], [c for c, _ in want])
    kept = []
    for cost, p in want[:400]:
        if len(kept) == 4 or cost > 1.5 * want[0][0]:
            break
        if all(shared(best, p, q)[0] < 0.7 * shared(best, p, q)[1] for q in kept):
            kept.append(p)
    assert [g.named(p) for _, p in paths.limited(g, s, t, 4)] == kept


@pytest.mark.parametrize("seed", range(12))
def test_penalty_method_against_a_plain_one(seed):
    arcs = random_arcs(seed)
    g = graph_of(arcs)
    if 0 not in g.place or 6 not in g.place:
        return
    best, every = every_path(arcs, 0, 6)
    dear, kept, least = {e: w for e, (w, _) in best.items()}, [], None
    for _ in range(120 if every else 0):
        p = min((sum(dear[e] for e in zip(x, x[1:])), x) for _, x in every)[1]
        cost = sum(best[e][0] for e in zip(p, p[1:]))
        least = cost if least is None else least
        for a, b in zip(p, p[1:]):
            for e in ((a, b), (b, a)):
                if e in dear:
                    dear[e] *= 1.2
        if cost <= 1.5 * least and all(shared(best, p, q)[0] < 0.7 * shared(best, p, q)[1] for q in kept):
            kept.append(p)
            if len(kept) == 4:
                break
    assert [g.named(p) for _, p in paths.penalised(g, g.place[0], g.place[6], 4)] == kept


def test_parallel_arcs_cost_the_least():
    g = graph_of([(0, 1, 5.0, 1.0), (0, 1, 1.0, 1.0), (1, 2, 2.0, 1.0), (0, 2, 9.0, 1.0)])
    assert [c for c, _ in paths.loopless(g, 0, 2)] == [3.0, 9.0]
    assert [c for c, _ in paths.penalised(g, 0, 2, 3, stretch=9.0)] == [3.0, 9.0]


def test_searches_in_tables(spark):
    arcs = spark.createDataFrame(random_arcs(3), "src long, dst long, w double, len double")
    g = graph_of(random_arcs(3))
    sources = spark.createDataFrame([(0,), (3,), (99,)], "source long")
    plain = {(s, int(g.ids[x])): d for s in (0, 3) for x, d in enumerate(paths.distances(g, g.place[s])) if d < math.inf} | {(99, 99): 0.0}
    for found in (graph.single_source(arcs, sources), graph.relaxed(arcs, sources)):
        got = {(r["source"], r["node"]): r["dist"] for r in found.collect()}
        assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in got)
    with pytest.raises(RuntimeError):
        graph.relaxed(arcs, sources, rounds=1)
    asked = spark.createDataFrame([(0, 6), (0, 5), (3, 1), (3, 99)], "s long, t long")
    got = {(r["s"], r["t"]): r["cost"] for r in graph.many_to_many(asked, arcs).collect()}
    assert got == pytest.approx({k: plain[k] for k in ((0, 6), (0, 5), (3, 1)) if k in plain})
    hourly_arcs = arcs.select(F.lit(1).alias("h"), "src", "dst", "w").unionByName(arcs.select(F.lit(2).alias("h"), "src", "dst", (F.col("w") * 2).alias("w")))
    p = {(r["h"], r["s"], r["t"]): r["cost"] for r in graph.shortest_paths(asked.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("h"), "s", "t"), hourly_arcs).collect()}
    assert p[2, 0, 6] == pytest.approx(2 * p[1, 0, 6]) and p[1, 3, 99] is None
    old, graph.MOST_SHIPPED = graph.MOST_SHIPPED, 10
    try:
        assert len(graph.single_source(arcs, sources).collect()) == len(plain)
        with pytest.raises(ValueError):
            graph.candidate_paths(asked, arcs, "yen", 2)
    finally:
        graph.MOST_SHIPPED = old


def test_steps_and_overlap(spark):
    e = spark.createDataFrame([(1, 0, 1, 4.0), (2, 0, 1, 3.0), (3, 1, 2, 5.0), (4, 0, 2, 9.0)], "edge_id long, u long, v long, w double")
    p = spark.createDataFrame([(7, 0, [2, 1, 0]), (7, 1, [0, 1, 2]), (7, 2, [0, 2])], "pair long, pos long, path array<long>")
    steps = graph.path_edges(p, e)
    assert rows(steps.where("pos = 0"), "seq", "edge_id", "forward") == [(0, 3, False), (1, 2, False)]
    assert rows(graph.overlap(steps, ["pair"]), "i", "j", "share") == [(0, 1, 1.0), (0, 2, 0.0), (1, 2, 0.0)]


# --- building ----------------------------------------------------------------------------------

EDGE = "u long, v long, metres double, seconds double, profile array<struct<region: string, metres: double, seconds: double>>"


def road(u, v, *pieces):
    return (u, v, sum(p[1] for p in pieces), sum(p[2] for p in pieces), list(pieces))


def test_profiles_split_and_fold(spark):
    d = spark.createDataFrame([road(0, 1, ("a", 100.0, 10.0), ("a", 100.0, 20.0), ("b", 200.0, 40.0))], EDGE)
    first, second = graph.split_profile("profile", 0.75)
    r = d.select(first.alias("x"), second.alias("y"), graph.folded("profile").alias("f"), graph.folded("profile", 10.0).alias("g"), graph.folded("profile", 30.0, joint=True).alias("j")).first()
    assert [tuple(x) for x in r["x"]] == [("a", 100.0, 10.0), ("a", 100.0, 20.0), ("b", 100.0, 20.0)]
    assert [tuple(x) for x in r["y"]] == [("b", 100.0, 20.0)]
    assert [tuple(x) for x in r["f"]] == [tuple(x) for x in r["j"]] == [("a", 200.0, 30.0), ("b", 200.0, 40.0)]
    assert len(r["g"]) == 3


def test_chains_join_their_profiles_in_driving_order(spark):
    e = spark.createDataFrame([road(0, 1, ("a", 10.0, 1.0)), road(2, 1, ("c", 5.0, 1.0), ("b", 10.0, 1.0)), road(2, 3, ("c", 10.0, 2.0)), road(3, 4, ("d", 1.0, 1.0)), road(3, 5, ("e", 1.0, 1.0))], EDGE)
    got = {(r["u"], r["v"]): r for r in graph.contract(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert set(got) == {(0, 3), (3, 4), (3, 5)}
    assert [tuple(x) for x in got[0, 3]["profile"]] == [("a", 10.0, 1.0), ("b", 10.0, 1.0), ("c", 15.0, 3.0)]


def test_parallel_roads(spark):
    e = spark.createDataFrame([road(0, 1, ("a", 10.0, 1000.0)), road(1, 0, ("b", 12.0, 1100.0)), road(1, 0, ("b", 12.0, 500.0), ("c", 12.0, 900.0))], EDGE)
    got = rows(graph.parallel_roads(e), "u", "v", "metres", "seconds")
    mid = got[0][0]
    assert mid < 0 and got == [(mid, 0, 12.0, 700.0), (mid, 1, 12.0, 700.0), (0, 1, 10.0, 1000.0)]
    p = {r["v"]: [x["region"] for x in r["profile"]] for r in graph.parallel_roads(e).where("u < 0").collect()}
    assert p == {0: ["c"], 1: ["b"]}


def test_micro_edges_go_and_kept_nodes_stay(spark):
    e = spark.createDataFrame([road(0, 1, ("a", 5000.0, 100.0)), road(1, 2, ("a", 50.0, 5.0)), road(2, 3, ("a", 7000.0, 200.0)), road(2, 4, ("a", 9000.0, 300.0))], EDGE)
    keep = spark.createDataFrame([(0,), (2,), (3,), (4,)], "node long")
    assert rows(graph.merge_micro(e, keep), "u", "v", "metres") == [(0, 2, 5000.0), (2, 3, 7000.0), (2, 4, 9000.0)]


def test_components_raise_at_their_bound(spark):
    e = spark.range(30).selectExpr("id as u", "id + 1 as v")
    nodes = spark.range(33).selectExpr("id as node")
    assert {tuple(r) for r in graph.components(e, nodes).collect()} == {(i, 0 if i <= 30 else i) for i in range(33)}
    with pytest.raises(RuntimeError):
        graph.components(e, nodes, rounds=1)
    assert graph.largest_component(e.where("u <> 20")).count() == 20


def test_border_flicker_joins_the_region_before(spark):
    s = [(1, i, r, m, 10.0) for i, (r, m) in enumerate([("a", 3000.0), ("b", 500.0), ("b", 400.0), ("a", 100.0), ("c", 2500.0), ("a", 1999.0), ("c", 2600.0)])]
    t = build.traversal(spark.createDataFrame(s, "route long, i long, region string, metres double, seconds double"))
    assert rows(t, "k", "region", "metres", "enter_s", "exit_s") == [(0, "a", 4000.0, 0.0, 40.0), (1, "c", 7099.0, 40.0, 70.0)]


def test_criteria_along_a_route(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1000.0, 0.0), (1, 2, 1000.0, 500.0)], "route long, i long, x double, y double")
    dense = geo.densified(line, 5.0)
    assert dense.count() == 300 and rows(dense.where("s = 1100"), "x", "y") == [(1000.0, 100.0)]
    marks = spark.createDataFrame([(1, 10.0, 5.0), (2, 60.0, 0.0), (3, 500.0, 3.0), (4, 500.0, 90.0)], "id long, x double, y double")
    assert rows(geo.events_along(dense, marks, 8.0, 100.0)) == [(1, 2)]
    bridge = spark.createDataFrame([(i, 100.0 + i, 0.0) for i in range(50)] + [(900, 1000.0, 400.0)], "id long, x double, y double")
    assert rows(geo.covered_km(dense, bridge, 4.0, 5.0), "passages") == [(2,)]
    p = spark.createDataFrame([(1, i, 0.0 if i == 0 else 100.0) for i in range(6)], "route long, i long, metres double")
    spans = spark.createDataFrame([(1, 0, 2, 3), (1, 2, 4, 9), (1, 4, 99, 9)], "route long, a long, b long, code long")
    assert rows(geo.coded_km(p, spans, (3,)), "km") == [(0.3,)]


def test_albers_keeps_areas_and_its_origin(spark):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    d = spark.createDataFrame([(-96.0, 23.0), (-96.0, 24.0), (-95.99, 24.0), (-95.99, 45.0), (-96.0, 45.0), (-95.99, 46.0), (-96.0, 46.0)], "lon double, lat double")
    p = {(r["lon"], r["lat"]): (r["x"], r["y"]) for r in d.select("lon", "lat", x.alias("x"), y.alias("y")).collect()}
    assert abs(p[-96.0, 23.0][0]) < 1e-6 and abs(p[-96.0, 23.0][1]) < 1e-6
    # along a standard parallel lengths are true, so a hundredth of a degree is its arc on the ellipsoid
    e2, phi = 0.0066943800229, math.radians(45.5)
    arc = 6_378_137 / math.sqrt(1 - e2 * math.sin(phi) ** 2) * math.cos(phi) * math.radians(0.01)
    assert abs((p[-95.99, 45.0][0] + p[-95.99, 46.0][0]) / 2 - arc) < 0.5


# --- fits --------------------------------------------------------------------------------------


def sig(z):
    return 1 / (1 + np.exp(-z))


def fit_table(spark, seed, regions=3, days=12, leads=(0, 5)):
    rng = np.random.default_rng(seed)
    y = rng.random((regions, days * 24 + 24)) < 0.3
    out = [(r, h, j, float(rng.uniform(0.01, 0.9)), float(rng.uniform(0.01, 0.9)), int(y[r, h + j])) for r in range(regions) for h in range(days * 24) for j in leads]
    return out, spark.createDataFrame(out, "region long, h long, lead long, p1 double, p2 double, y long")


def test_recalibration_against_a_plain_one(spark):
    data, df = fit_table(spark, 1)
    got = {(r["region"], r["h"], r["lead"]): r["p"] for r in learn.recalibrate(df.withColumnRenamed("p1", "p"), days=5, first_day=2).collect()}
    logit = lambda p: math.log(p / (1 - p))
    for reg, h, j, p, _, _ in data:
        day = h // 24
        if day < 2:
            assert got[reg, h, j] == p
            continue
        past = [(a, b, c) for r2, a, j2, b, _, c in data if r2 == reg and j2 == j and (day - 5) * 24 <= a - 1 < day * 24 and a + j < day * 24]
        if h % 24 == 7:
            x, y, b = np.array([logit(q) for _, q, _ in past]), np.array([c for *_, c in past]), 0.0
            for _ in range(6):
                q = sig(x + b)
                b = float(np.clip(b + (y - q).sum() / ((q * (1 - q)).sum() + 1e-6), -5, 5))
            n = len({(a - 1) // 24 for a, _, _ in past})
            assert abs(got[reg, h, j] - sig(logit(p) + np.clip(b * n / (n + 14), -1.5, 1.5))) < 1e-9


def test_stacking_against_a_plain_one(spark):
    data, df = fit_table(spark, 2)
    logit = lambda p: float(np.clip(math.log(p / (1 - p)), -9, 9))
    for block in (14, 3):
        got = {(r["region"], r["h"], r["lead"]): r["p"] for r in learn.stack(df, days=5, block=block).collect()}
        assert len(got) == len(data)
        for day in range(12):
            for j in (0, 5):
                past = [(logit(a), logit(b), y) for _, h, j2, a, b, y in data if j2 == j and (day - 5) * 24 <= h and h + j < day * 24]
                hours = {h for _, h, j2, *_ in data if j2 == j and (day - 5) * 24 <= h and h + j < day * 24}
                w, prior, pull = np.array([0.0, 0.5, 0.5]), np.array([0.0, 0.5, 0.5]), np.diag([0.0, 1.0, 1.0])
                if len(hours) > 48:
                    x, y = np.array([(1.0, a, b) for a, b, _ in past]), np.array([c for *_, c in past])
                    for _ in range(8):
                        q = sig(x @ w)
                        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pull + 1e-6 * np.eye(3), x.T @ (y - q) - pull @ (w - prior))
                for reg, h, j2, a, b, _ in data:
                    if j2 == j and h // 24 == day and h % 24 == 5:
                        assert abs(got[reg, h, j] - sig(w @ [1.0, logit(a), logit(b)])) < 1e-8


def test_semi_markov_against_a_plain_one(spark):
    rng, regions, hours, days = np.random.default_rng(3), 3, 24 * 9, 4
    a = (rng.random((regions, hours + 19)) < 0.4).astype(int)
    act, bins = rng.integers(0, 2, (regions, hours)), rng.integers(0, 4, (regions, hours))
    bins = np.where(act == 1, 4 + bins, bins)
    states = spark.createDataFrame([(r, h, int(act[r, h]), int(bins[r, h])) for r in range(regions) for h in range(hours)], "region long, h long, active long, bin long")
    panel = spark.createDataFrame([(r, h, int(a[r, h])) for r in range(regions) for h in range(hours + 19)], "region long, h long, a long")
    asked = states.where("h >= 144").select("region", "h")
    got = {(r["region"], r["h"], r["lead"]): r["p"] for r in forecast.semi_markov(states, panel, asked, days).collect()}
    assert len(got) == regions * (hours - 144) * 19
    for day in range(6, 9):
        t = np.arange((day - days) * 24, day * 24 - 18)
        rate = np.full((11, 19), np.nan)
        for b in range(11):
            m = bins[:, t] == b
            if m.any():
                rate[b] = [np.mean([a[r, t[i] + j] for r, i in zip(*np.nonzero(m))]) for j in range(19)]
        rate = np.where(np.isnan(rate), np.nanmean(rate, 0, keepdims=True), rate)
        for r in range(regions):
            idle = act[r, t] == 0
            level = np.clip((a[r, t + 6][idle].sum() + 0.5) / (rate[bins[r, t], 6][idle].sum() + 0.5), 0.2, 5)
            for h in range(day * 24, day * 24 + 24, 5):
                for j in (0, 6, 18):
                    p = rate[bins[r, h], j]
                    assert abs(got[r, h, j] - (np.clip(p * level, 0, 1) if act[r, h] == 0 else p)) < 1e-9


def test_paired_and_masked_intervals(spark):
    starts = stats.block_starts(spark, 12, 3, 60, 7)
    drawn = {}
    for r in starts.collect():
        drawn.setdefault(r["rep"], []).extend(range(r["start"], r["start"] + r["len"]))
    rng = np.random.default_rng(8)
    b, x1, x2 = (rng.uniform(1, 9, 12) for _ in range(3))
    keep = rng.random(12) < 0.7
    d = spark.createDataFrame([(1, i, float(b[i]), float(x1[i]), float(x2[i]), bool(keep[i])) for i in range(12)], "c long, i long, b double, x1 double, x2 double, keep boolean")
    got = stats.paired(d, starts, ["c"]).first()
    want = np.percentile([100 * (x1[at] - x2[at]).sum() / b[at].sum() for at in drawn.values()], [2.5, 97.5])
    assert np.allclose([got["lo"], got["hi"]], want)
    got = stats.masked_bootstrap(d.withColumnRenamed("x1", "x"), starts, ["c"]).first()
    kept = [np.array(at)[keep[at]] for at in drawn.values()]
    want = np.percentile([100 * (b[at] - x1[at]).sum() / b[at].sum() for at in kept if len(at)], [2.5, 97.5])
    assert np.allclose([got["lo"], got["hi"]], want)


def test_holm_within_families(spark):
    d = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("b", 1, None), ("b", 2, 0.2)], "f string, name long, p double")
    got = {(r["f"], r["name"]): r["p_holm"] for r in stats.holm(d, family=["f"]).collect()}
    assert got == pytest.approx({("a", 1): 0.03, ("a", 2): 0.06, ("a", 3): 0.06, ("b", 1): 1.0, ("b", 2): 0.4})


def test_sampled_pairs_have_different_ends(spark):
    got = stats.sample_pairs(spark, 5, 200).collect()
    assert len(got) == 200 and all(r["s"] != r["t"] and 0 <= r["t"] < 5 for r in got)
    assert got == stats.sample_pairs(spark, 5, 200).collect() != stats.sample_pairs(spark, 5, 200, salt=1).collect()


def test_many_criteria_never_choose_a_candidate_with_all_of_one(spark):
    s = spark.createDataFrame([(1, 0, 1, 5.0, 1.0, 2.0), (1, 0, 2, 0.0, 9.0, 2.0)], "corridor long, h long, route long, e_km double, t_h double, s1 double")
    got = {r["route"]: r["value"] for r in routes.many_criteria(s, ["s1"], F.lit(0.3)).collect()}
    assert got[1] == math.inf and abs(got[2] - (0.2 / 0.1 + 0.5 + 0.3 / 0.5)) < 1e-9


def test_generic_features_look_back_only(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2, (4, 40))
    b = a.copy()
    b[:, 30:] = 1 - b[:, 30:]
    adjacency = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "region long, other long")
    mates = spark.createDataFrame([(i, i % 2) for i in range(4)], "region long, grp long")

    def made(x):
        p = spark.createDataFrame([(r, h, int(x[r, h])) for r in range(4) for h in range(40)], "region long, h long, a long")
        f = features.generic(p, adjacency, mates, ("lags", "onset", "regime", "anchor")).where("h < 30")
        return rows(f.select(*(F.round(F.col(c).cast("double"), 9).alias(c) for c in sorted(f.columns))).fillna(-1.0))

    assert made(a) == made(b)


# --- shapes ------------------------------------------------------------------------------------


def test_inconsistent_rows_are_an_error(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5)], "a double, b double")
    assert reshape.consistent(d.where("a = 1"), "a", "b").count() == 1
    with pytest.raises(Exception, match="differ"):
        reshape.consistent(d, "a", "b").collect()


def test_keys_and_reports(spark):
    k = spark.createDataFrame([("a", "b|c")], "x string, y string").select(reshape.compose("x", "y", separator="||").alias("k"))
    assert k.select(reshape.part_of("k", 0, "||"), reshape.part_of("k", 1, "||"), reshape.part_of("k", 2, "||")).first() == ("a", "b|c", None)
    both = reshape.compared(spark.createDataFrame([(1, 1.0), (2, 5.0)], "k long, v double"), spark.createDataFrame([(1, 1.0000001), (3, 2.0)], "k long, v double"), ["k"], "v")
    assert rows(both, "k", "close") == [(1, True), (2, False), (3, False)]
    assert len(reshape.code_md5(__file__)) == 32


def test_tables_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert reshape.written_once(spark, f"file://{tmp_path}/once", make).count() == 3
    assert made == [1]
    asked = []

    def some(keys):
        asked.append(sorted(r["k"] for r in keys.collect()))
        return keys.where("k <> 2").selectExpr("k", "k * 10 as v")

    for wanted in ([1, 2], [1, 2], [2, 3]):
        got = reshape.only_missing(spark, f"file://{tmp_path}/kv", spark.createDataFrame([(k,) for k in wanted], "k long"), ["k"], some)
        assert rows(got) == [(k, k * 10) for k in wanted if k != 2]
    assert asked == [[1, 2], [3]]


# --- sources and sinks -------------------------------------------------------------------------


def test_alert_log_reader(spark, tmp_path):
    import gzip

    lines = ["oblast,raion,hromada,level,started_at,finished_at", "A oblast,R’x,,oblast,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z", "A oblast,R’x,,oblast,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z", "R'y,Old  oblast,,raion,2024-01-01 02:00:00,2024-01-01 03:00:00", "B oblast,,,oblast,never,2024-01-01 03:00:00"]
    (tmp_path / "log.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    got = rows(readers.alert_log(spark, str(tmp_path / "log.csv.gz"), {"Old oblast": "New oblast"}), "oblast", "raion")
    assert got == [("A oblast", "R’x"), ("New oblast", "R’y")]
    (tmp_path / "d.csv").write_text("id,day\n1,31.12.2024\n2,x\n")
    assert rows(readers.dated(spark, str(tmp_path / "d.csv"), "id int, day string", {"day": "dd.MM.yyyy"}).where("day is not null"), "day") == [(datetime(2024, 12, 31),)]


def test_storm_events_reader(spark, tmp_path):
    head = "EVENT_TYPE,STATE,CZ_TIMEZONE,BEGIN_YEARMONTH,BEGIN_DAY,BEGIN_TIME,END_YEARMONTH,END_DAY,END_TIME"
    (tmp_path / "e2023.csv").write_text(f"{head}\nHail,Iowa,CST-6,202312,31,2330,202401,1,15\nFlood,Iowa,CST-6,202312,31,2330,202401,1,15\n")
    (tmp_path / "e2024.csv").write_text(f"{head}\nHail,Ohio,EST-5,202402,29,5,202402,29,105\n")
    got = readers.storm_events(spark, f"{tmp_path}/e*.csv", ["Hail"])
    assert rows(got, "state", "started_at", "finished_at") == [("IOWA", datetime(2024, 1, 1, 5, 30), datetime(2024, 1, 1, 6, 15)), ("OHIO", datetime(2024, 2, 29, 5, 5), datetime(2024, 2, 29, 6, 5))]


def test_geojson_readers(spark, tmp_path):
    import json

    box = lambda s: [[[0, 0], [s, 0], [s, s], [0, s], [0, 0]]]
    f = lambda n, g, kind, c: {"properties": {"name": n, "region": g}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "p.json").write_text(json.dumps({"features": [f("big", "x", "Polygon", box(4)), f("two", "x", "MultiPolygon", [box(1), box(2)])]}))
    assert rows(readers.polygons(spark, str(tmp_path / "p.json"), "name", {"two": "pair"}), "label", "area") == [("big", 16.0), ("pair", 1.0), ("pair", 4.0)]
    d = readers.districts(spark, str(tmp_path / "p.json"), "name", "region").first()
    assert d["grp"] == "x" and [x["name"] for x in d["districts"]] == ["big", "two", "two"]
    route = {"metadata": {"engine": {"version": "9.0.1"}}, "features": [{"geometry": {"coordinates": [[30, 50], [30.1, 50], [30.2, 50]]}, "properties": {"summary": {"distance": 14000.0, "duration": 900.0}, "segments": [{"steps": [{"duration": 900.0, "way_points": [0, 2]}]}], "extras": {"surface": {"values": [[0, 1, 3], [1, 2, 9]]}}}}]}
    (tmp_path / "r.json").write_text(json.dumps(route))
    assert rows(readers.route_points(spark, str(tmp_path / "r.json"), "c"), "route", "i", "lon", "h_total") == [(0, 0, 30.0, 0.25), (0, 1, 30.1, 0.25), (0, 2, 30.2, 0.25)]
    assert rows(readers.route_steps(spark, str(tmp_path / "r.json"), "c"), "first", "last", "duration_s") == [(0, 2, 900.0)]
    assert rows(readers.route_extras(spark, str(tmp_path / "r.json"), "c"), "a", "b", "code") == [(0, 1, 3), (1, 2, 9)]


def test_graph_reader_and_sinks(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("node_id,lon,lat,city\n1,30.5,50.4,Kyiv\n2,24.0,49.8,\n")
    (tmp_path / "edges.csv").write_text('u,v,length_m,time_s,profile_json\n1,2,10,5,"[[""a"", 4, 2], [""b"", 6, 3]]"\n')
    nodes, edges = readers.graph(spark, str(tmp_path))
    assert nodes.count() == 2 and [tuple(x) for x in edges.first()["profile"]] == [("a", 4.0, 2.0), ("b", 6.0, 3.0)]
    f = spark.createDataFrame([(datetime(2024, 1, 1, h), "r", k, 0.5) for h in range(3) for k in (1, 2)], "hour timestamp, region string, k int, p double")
    writers.forecast(f, str(tmp_path / "f"))
    assert readers.forecasts(spark, str(tmp_path / "f"), "2024-01-01 01:00:00").where("k = 2").count() == 2
    small = spark.createDataFrame([("a_b", -1.25, None)], "name string, x double, y long")
    assert writers.markdown(small).splitlines()[-1] == "| a_b | -1.25 |  |"
    assert r"a\_b & -1.25 & " in writers.latex(small)
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), most=3)
    writers.documents(small, str(tmp_path / "docs"))
    writers.table(small, str(tmp_path / "table"))
    for _ in range(2):
        writers.log_line(small, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "table")).count() == 1
    assert readers.results(spark, str(tmp_path / "docs"), "name string, x double").first()["name"] == "a_b"
    folder = str(tmp_path)

    def send(batch):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.sent", "w") as out:
            out.write(str(len(batch)))

    writers.in_batches(spark.range(10).coalesce(1), send, 4)
    assert sorted(p.read_text() for p in tmp_path.glob("*.sent")) == ["2", "4", "4"]


def vint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(*pairs):
    return b"".join(vint(k << 3) + vint(v) if isinstance(v, int) else vint(k << 3 | 2) + vint(len(v)) + v for k, v in pairs)


def zig(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def differences(values):
    return b"".join(vint(zig(b - a)) for a, b in zip([0, *values], values))


def test_map_extract_reader(spark, tmp_path):
    strings = message(*((1, s.encode()) for s in ("", "highway", "primary", "maxspeed", "50 mph", "railway", "level_crossing", "bridge", "yes", "track")))
    dense = message((1, differences([10, 11, 7])), (8, differences([500000000, 501000000, -3])), (9, differences([300000000, 299000000, 4])), (10, b"\0" + vint(5) + vint(6) + b"\0" + b"\0"))
    way = message((1, 77), (2, vint(1) + vint(3) + vint(7)), (3, vint(2) + vint(4) + vint(8)), (8, differences([10, 11, 7])))
    other = message((1, 78), (2, vint(1)), (3, vint(9)), (8, differences([10, 11])))
    node = message((1, zig(99)), (2, b""), (3, b""), (8, zig(1)), (9, zig(-2)))
    block = message((1, strings), (2, message((2, dense))), (2, message((3, way), (3, other))), (2, message((1, node))))
    data = b""
    for kind, raw in (("OSMHeader", b"x"), ("OSMData", block)):
        blob = message((2, len(raw)), (3, zlib.compress(raw)))
        head = message((1, kind.encode()), (3, len(blob)))
        data += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.pbf").write_bytes(data)
    nodes, ways, marks = binary.roads(spark, str(tmp_path / "x.pbf"), ["primary"])
    assert {r["ref"]: (round(r["lon"], 6), round(r["lat"], 6)) for r in nodes.collect()} == {10: (30.0, 50.0), 11: (29.9, 50.1), 7: (0.0, 0.0), 99: (0.0, 0.0)}
    assert rows(ways) == [(77, [10, 11, 7], "primary", "50 mph", True)]
    assert rows(marks, "id", "kind") == [(11, "rail")]
    kmh = ways.select(build.speed(F.col("highway"), F.col("maxspeed")).alias("k")).first()["k"]
    assert kmh == 50.0


def test_shape_file_reader(spark, tmp_path):
    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    line = struct.pack("<i4d2i", 3, 0, 0, 1, 1, 2, 5) + struct.pack("<2i", 0, 3) + struct.pack("<10d", 0, 0, 1, 0, 1, 1, 5, 5, 6, 6)
    point = struct.pack("<i2d", 1, 7.0, 8.0)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, line) + record(2, point) + record(3, struct.pack("<i", 0)))
    field = lambda name, size: name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    head = struct.pack("<4BIHH", 3, 124, 1, 1, 3, 32 + 64 + 1, 1 + 6 + 3) + b"\0" * 20 + field("NAME", 6) + field("POP", 3) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" " + b"Kyiv  " + b" 12" + b" " + "Łódź".encode()[:6].ljust(6) + b"  3" + b" " + b"x     " + b"   ")
    got = {r["i"]: r for r in binary.shapes(spark, str(tmp_path / "a.shp")).collect()}
    assert [[tuple(x) for x in p] for p in got[0]["parts"]] == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 6)]]
    assert [[tuple(x) for x in p] for p in got[1]["parts"]] == [[(7.0, 8.0)]] and got[2]["parts"] == []
    assert got[0]["attributes"] == {"NAME": "Kyiv", "POP": "12"}


# --- streams -----------------------------------------------------------------------------------

T = datetime(2024, 1, 1)


def at(h):
    return T + timedelta(hours=h)


def streamed(spark, tmp_path, data, schema, make, name):
    """What make gives for a stream of the given batches, each a file of its own."""
    folder = tmp_path / name
    for i, batch in enumerate(data):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


EVENTS = "region long, started_at timestamp, finished_at timestamp"


def test_stream_has_one_row_per_region_and_hour(spark, tmp_path):
    batches = [[(1, at(1.5), at(3.2)), (1, at(2), at(2.5)), (2, at(2), at(2))], [(1, at(2), at(2.5)), (1, at(2.2), at(2.3))], [(3, at(30), at(30.5))], [(3, at(31), at(31.5))]]
    got = streamed(spark, tmp_path, batches, EVENTS, hourly.hourly_presence, "hours")
    want = [(1, 1, 1), (1, 2, 3), (1, 3, 1), (2, 2, 1)]
    assert rows(got.where("region < 3").selectExpr("region", "hour(hour) as h", "n")) == want


def test_stream_of_ended_trips(spark, tmp_path):
    batches = [[(1, 1, at(0.2), 5.0), (1, 1, at(0.5), 7.0), (1, 2, at(2), 1.0)], [(1, 1, at(19), 1.0)], [(1, 1, at(19.5), 1.0)]]
    got = streamed(spark, tmp_path, batches, "corridor long, route long, at timestamp, km double", hourly.ended_trips, "trips")
    assert rows(got, "route", "at", "km") == [(1, at(0), 12.0)]
    matured = streamed(spark, tmp_path, [[(1, at(0.5), 1), (1, at(0.7), 0)], [(1, at(30), 1)], [(1, at(31), 1)]], "region long, at timestamp, y long", hourly.matured, "matured")
    assert rows(matured, "at", "y") == [(at(0), 0.5)]


def test_stream_of_daily_refits(spark, tmp_path):
    pairs = [(1, at(h), h % 2, (h + 1) % 2) for h in range(48)]
    got = streamed(spark, tmp_path, [pairs, [(1, at(24 * 9), 0, 0)], [(1, at(24 * 9 + 1), 0, 0)]], "region long, at timestamp, before long, a long", lambda s: hourly.daily_refit(s, 2), "refits")
    by_day = {r["day"]: (r["p11"], r["p01"]) for r in got.collect()}
    assert by_day[at(48)] == (0.0, 1.0) and set(by_day) >= {at(24), at(48), at(72)}


def test_stream_of_sticky_choices(spark, tmp_path):
    score = [(0, [0.1, 0.2]), (2, [0.3, 0.1]), (1, [0.15, 0.14]), (3, [0.1, 0.1])]
    schema = "corridor long, at timestamp, pref long, routes array<long>, scores array<double>"
    batches = [[(1, at(h), 0, [0, 1], s) for h, s in score], [(2, at(20), 0, [0], [0.0])], [(2, at(40), 0, [0], [0.0])]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: hourly.sticky_choice(s, 0.02), "choices")
    assert rows(got.where("corridor = 1").selectExpr("hour(at) as h", "route")) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_stream_of_last_finishes(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, at(1), at(9)), (1, at(2), at(3))], [(1, at(4), at(5)), (1, at(8), at(12))]], EVENTS, hourly.last_finish, "finishes")
    assert rows(got, "started_at", "until") == [(at(1), at(9)), (at(2), at(9)), (at(4), at(9)), (at(8), at(12))]
