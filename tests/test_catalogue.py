"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from perilgrid.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=str)
    res = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=str)


#: Queries without an oracle: the columns that hold shares or probabilities, and what must not be empty.
OTHERS = {
    "yen_paths": (), "yen_limited_overlap": (), "penalty_candidates": (), "risk_weighted_paths": (), "path_overlap": ("share",), "path_to_route": ("w",),
    "hysteresis": (), "bootstrap_ci": (), "paired_ci": (), "masked_ci": (), "recalibrate": ("p",), "stacking": ("p",), "semi_markov_forecast": ("p",),
    "rolling_origin": ("p",), "anchored_training": ("p",), "network_evaluation": (), "network_pooled": (), "candidate_sweep": (), "rail_crossings": (), "bridges_and_slow_km": (),
    "fleet_1000_secondary": (), "yen_100_primary": (), "hops_100_secondary": (), "reroute_24h_corridor": (), "per_lead_gbt": ("p",),
}


def test_every_query_is_tested():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) | set(OTHERS)


@pytest.mark.parametrize("name", sorted(set(OTHERS) - {"per_lead_gbt"}))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    assert got and all(0 <= r[c] <= 1 + 1e-9 for r in got for c in OTHERS[name])


def test_networks_have_the_published_sizes(spark):
    from perilgrid.plans import network

    for size, (side, edges) in network.SIZES.items():
        e = network.network(spark, size)
        assert abs(e.count() - edges) <= max(10, 0.01 * edges)
        assert e.selectExpr("explode(array(u, v)) as n").distinct().count() == side * side


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def on_sides(spark, duck, folder, name, rows):
    """The rows of a query of points and of its SQL, for customers (key, balance) alone."""
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    con = duck.cursor()
    con.execute(f"create schema s; set schema = 's'; create view customer as select * from '{folder}/customer.parquet/*.parquet'; create view supplier as select * from '{SF}/supplier.parquet'")
    try:
        df = catalogue.QUERIES[name](spark, str(folder))
        res = con.execute(catalogue.ORACLES[name])
        at = [[c[0] for c in res.description].index(c) for c in df.columns]
        return sorted(tuple(r) for r in df.collect()), sorted(tuple(r[i] for i in at) for r in res.fetchall())
    finally:
        con.execute("set schema = 'main'; drop schema s cascade")


def test_points_on_sides_of_polygons(spark, duck, tmp_path):
    got, sql = on_sides(spark, duck, tmp_path, "point_in_polygon", [(1264, 3384.0), (5682, 804.0), (8921, 6924.0), (13271, 1896.0), (1, 20.0), (2, 2384.01)])
    assert got == sql and (1264, 41) in got and (5682, 1) in got


def test_points_just_as_far_from_a_side(spark, duck, tmp_path):
    rows = [(2199, 1423.1), (5751, -856.9), (13917, 7663.1)]
    rows += [(1009 * k + 500, b) for k, b in enumerate((3.1, 16.9, 23.1, 36.9, 43.1, 56.9, 63.1, 76.9, 83.1, 96.9, 17.1, 22.9, 40.1, 59.9, 10.0))]
    got, sql = on_sides(spark, duck, tmp_path, "nearest_side", rows)
    assert got == sql and 2199 not in {i for i, _ in got}
