"""Road graphs as edge(edge_id, u, v, w) and arc(edge_id, src, dst, w[, len]) tables.

Whole-graph operators (relaxation, k-hop, components, contraction) are loops of DataFrame joins whose
state is written to a checkpoint each round; each fails loudly at a bound of rounds. Path searches are
sequential by nature: they run per pair or per source in grouped functions over a graph in compact
arrays, which is shipped only below a checked size. Beyond it, only the relaxation serves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import paths

#: Bytes of arcs (32 each) that may be sent to every executor; a worker holds about five times as much.
MOST_SHIPPED = 64 << 20
ARC_BYTES = 32


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *rest).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), *rest))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names and all executors share; only a local session may leave it unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def single_source(arc: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, node, dist) of sources(source). A graph below MOST_SHIPPED is shipped and searched
    once per source; a larger one is relaxed."""
    if arc.count() * ARC_BYTES > MOST_SHIPPED:
        return relaxed(arc, sources, rounds)
    shared = _shipped(arc)

    def run(batches):
        g = _graph(shared)
        for b in batches:
            for s in b["source"].tolist():
                if s not in g.place:
                    yield pd.DataFrame({"source": [s], "node": [s], "dist": [0.0]})
                    continue
                d = np.array(paths.distances(g, g.place[s]))
                at = np.flatnonzero(d < np.inf)
                yield pd.DataFrame({"source": s, "node": g.ids[at], "dist": d[at]})

    return _dealt(sources.select(F.col("source").cast("long").alias("source")).distinct(), "source").mapInPandas(run, "source long, node long, dist double")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as there are cores, for searches cost far more than their rows weigh."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def relaxed(arc: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """As single_source, by relaxation: each round relaxes only nodes that improved, and only what
    improved is written. Raises if ``rounds`` aren't enough."""
    best = checkpointed(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist")))
    front = best
    for _ in range(rounds):
        step = front.join(arc, front["node"] == arc["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        step = step.groupBy("source", "node").agg(F.min("dist").alias("new"))
        better = step.join(best, ["source", "node"], "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12)).select("source", "node", F.col("new").alias("dist"))
        front = checkpointed(better)
        if not front.take(1):
            return best
        best = checkpointed(best.unionByName(front).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    raise RuntimeError(f"distances are not complete after {rounds} rounds")


def k_hop(arc: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(source, node, hops) reached within k arcs, the start included. Only each hop's front is written."""
    front = starts.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"))
    fronts = [front]
    step_of = arc.select("src", "dst").distinct()
    for i in range(1, k + 1):
        step = front.join(step_of, front["node"] == step_of["src"]).select("source", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, fronts).select("source", "node")
        front = checkpointed(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(i)))
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable. Stars are rewired in turn: every node's larger
    neighbours are tied to its least one, then its smaller ones are, until nothing changes. The least
    neighbours are aggregates that Spark combines before the shuffle; they are written before their
    join, whose hot keys can then be split, so a hub isn't one task. Raises at ``rounds``."""
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            tied = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        wide = checkpointed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = checkpointed(wide.groupBy("a").agg(F.min("b").alias("m")))
        tight = wide.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        e = checkpointed(tight.distinct())
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes, ties to that with the smallest node."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    of = components(edges, nodes)
    top = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = of.join(F.broadcast(top), "component").select(F.col("node").alias("u"))
    return edges.join(inside, "u", "left_semi")


def pieces(edges: DataFrame, profile: str = "profile") -> DataFrame:
    """(edge_id, k, region, km, dt_s, mid_fwd_s, mid_bwd_s): an edge's profile of (region, metres,
    seconds) with the times to each piece's middle from either end."""
    p = edges.select("edge_id", F.posexplode(profile).alias("k", "x")).select("edge_id", "k", F.col("x.region").alias("region"), (F.col("x.metres") / 1000).alias("km"), F.col("x.seconds").alias("dt_s"))
    w = Window.partitionBy("edge_id").orderBy("k")
    before = F.coalesce(F.sum("dt_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("dt_s").over(Window.partitionBy("edge_id"))
    return p.withColumn("mid_fwd_s", before + F.col("dt_s") / 2).withColumn("mid_bwd_s", total - before - F.col("dt_s") / 2)


def parse_profile(text: str | F.Column) -> F.Column:
    """A JSON list of [region, metres, seconds] as an array of structs."""
    rows = F.from_json(text, "array<array<string>>")
    return F.transform(rows, lambda r: F.struct(r[0].alias("region"), r[1].cast("double").alias("metres"), r[2].cast("double").alias("seconds")))


def lead_risk(piece: DataFrame, edges: DataFrame, tau: DataFrame, forecast: DataFrame, most_lead: int = 18) -> DataFrame:
    """(h, edge_id, risk_km): km expected under alert on each edge if it is driven from its end that
    is reached first; tau(node, tau_s), forecast(region, h, lead, p)."""
    ends = edges.join(tau.select(F.col("node").alias("u"), F.col("tau_s").alias("tu")), "u").join(tau.select(F.col("node").alias("v"), F.col("tau_s").alias("tv")), "v")
    at = F.when(F.col("tu") <= F.col("tv"), F.col("tu") + F.col("mid_fwd_s")).otherwise(F.col("tv") + F.col("mid_bwd_s"))
    p = piece.join(ends.select("edge_id", "tu", "tv"), "edge_id").withColumn("lead", F.least(F.floor(at / 3600), F.lit(most_lead)).cast("long"))
    return p.join(forecast, ["region", "lead"]).groupBy("h", "edge_id").agg(F.sum(F.col("km") * F.col("p")).alias("risk_km"))


# --- searches over a shipped graph -------------------------------------------------------------


def _shipped(arc: DataFrame):
    """The arcs as a broadcast of plain arrays, least weight per pair; refuses graphs over MOST_SHIPPED."""
    length = "len" if "len" in arc.columns else "w"
    least = arc.groupBy("src", "dst").agg(F.min(F.struct("w", F.col(length).alias("len"))).alias("x"))
    least = least.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("x.w").cast("double").alias("w"), F.col("x.len").cast("double").alias("len"))
    n = arc.count()
    if n * ARC_BYTES > MOST_SHIPPED:
        raise ValueError(f"{n} arcs are too many to ship; use relaxed")
    t = least.toArrow()
    return arc.sparkSession.sparkContext.broadcast({c: t.column(c).to_numpy() for c in ("src", "dst", "w", "len")})


_built: dict[int, tuple[object, paths.Graph]] = {}


def _graph(shared) -> paths.Graph:
    """The graph of a broadcast; a worker keeps the one that it used last."""
    arrays = shared.value
    held = _built.get(0)
    if held is None or held[0] is not arrays:
        held = _built[0] = (arrays, paths.Graph(arrays["src"], arrays["dst"], arrays["w"], arrays["len"]))
    return held[1]


_METHODS: dict[str, Callable] = {"yen": paths.ranked, "limited": paths.limited, "penalty": paths.penalised}


def candidate_paths(pairs: DataFrame, arc: DataFrame, method: str, k: int, **options) -> DataFrame:
    """(s, t, pos, cost, path) for pairs(s, t); method: 'yen', 'limited' or 'penalty'. arc(src, dst, w[,
    len]): costs add up w, overlap compares len (w without it)."""
    shared, search = _shipped(arc), _METHODS[method]

    def run(batches):
        g = _graph(shared)
        for b in batches:
            for s, t in zip(b["s"].tolist(), b["t"].tolist()):
                if s in g.place and t in g.place:
                    found = search(g, g.place[s], g.place[t], k, **options)
                    yield pd.DataFrame({"s": s, "t": t, "pos": range(len(found)), "cost": [c for c, _ in found], "path": [g.named(p) for _, p in found]})

    asked = pairs.select(F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t")).distinct()
    dealt = asked.repartition(4 * asked.sparkSession.sparkContext.defaultParallelism, "s", "t")
    return dealt.mapInPandas(run, "s long, t long, pos long, cost double, path array<long>")


def many_to_many(requests: DataFrame, arc: DataFrame, with_path: bool = False) -> DataFrame:
    """(s, t, cost[, path]) of the cheapest path for each of requests(s, t); pairs that aren't
    connected are left out. One search per source serves all its targets."""
    shared = _shipped(arc)

    def run(batches):
        g = _graph(shared)
        for b in batches:
            rows = []
            for s, targets in zip(b["s"].tolist(), b["targets"].tolist()):
                targets = [t for t in targets if t in g.place]
                if s not in g.place or not targets:
                    continue
                if with_path:
                    for t in targets:
                        found = paths.shortest(g, g.place[s], g.place[t])
                        if found:
                            rows.append((s, t, found[0], g.named(found[1])))
                else:
                    d = paths.distances(g, g.place[s], until=[g.place[t] for t in targets])
                    rows += [(s, t, d[g.place[t]], None) for t in targets if d[g.place[t]] < np.inf]
            out = pd.DataFrame(rows, columns=["s", "t", "cost", "path"])
            yield out if with_path else out.drop(columns="path")

    asked = requests.groupBy(F.col("s").cast("long").alias("s")).agg(F.collect_set(F.col("t").cast("long")).alias("targets"))
    return _dealt(asked, "s").mapInPandas(run, "s long, t long, cost double" + ", path array<long>" * with_path)


def shortest_paths(requests: DataFrame, arc: DataFrame) -> DataFrame:
    """(h, s, t, cost, path) for requests(h, s, t) on hourly weights arc(h, src, dst, w). An hour's
    weights meet its requests in one group, an hour's graph has to be below MOST_SHIPPED; nulls where
    there is no path."""
    top = arc.groupBy("h").count().agg(F.max("count")).first()[0] or 0
    if top * ARC_BYTES > MOST_SHIPPED:
        raise ValueError(f"an hour has {top} arcs, too many for one group")
    schema = "h long, s long, t long, cost double, path array<long>"

    def run(key, req: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        g = paths.Graph(*(weights[c].to_numpy() for c in ("src", "dst", "w")))
        rows = []
        for s, t in req[["s", "t"]].itertuples(index=False):
            found = paths.shortest(g, g.place[s], g.place[t]) if s in g.place and t in g.place else None
            rows.append((int(key[0]), int(s), int(t), *((found[0], g.named(found[1])) if found else (None, None))))
        return pd.DataFrame(rows, columns=["h", "s", "t", "cost", "path"])

    asked = requests.select(F.col("h").alias("_h"), "s", "t")
    return asked.groupBy("_h").cogroup(arc.groupBy("h")).applyInPandas(run, schema)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(key columns, seq, forward, edge_id, w, ...) of each step of paths(..., path); of parallel edges
    the one with the least w is driven. forward: from the smaller node to the larger."""
    keys = [c for c in paths.columns if c != "path"]
    step = paths.where(F.size("path") > 1).select(*keys, F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("seq", "x"))
    step = step.select(*keys, "seq", F.least("x.a", "x.b").alias("u"), F.greatest("x.a", "x.b").alias("v"), (F.col("x.a") < F.col("x.b")).alias("forward"))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    own = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min_by(F.struct(*rest), F.struct("w", "edge_id")).alias("e"))
    return step.join(own, ["u", "v"]).select(*keys, "seq", "forward", *(F.col(f"e.{c}").alias(c) for c in rest))


def overlap(steps: DataFrame, pair: list[str]) -> DataFrame:
    """(pair, i, j, share): shared length over the shorter path's, for candidates i < j of a pair;
    steps(pair, pos, edge_id, w)."""
    total = steps.groupBy(*pair, "pos").agg(F.sum("w").alias("len"))
    a, b = (steps.select(*pair, "edge_id", F.col("pos").alias(n), "w" if n == "i" else F.lit(0).alias("_")) for n in ("i", "j"))
    both = a.join(b, [*pair, "edge_id"]).where("i < j").groupBy(*pair, "i", "j").agg(F.sum("w").alias("shared"))
    li, lj = (total.select(*pair, F.col("pos").alias(n), F.col("len").alias(f"l{n}")) for n in ("i", "j"))
    every = li.join(lj, pair).where("i < j").join(both, [*pair, "i", "j"], "left")
    return every.select(*pair, "i", "j", F.try_divide(F.coalesce("shared", F.lit(0.0)), F.least("li", "lj")).alias("share"))


# --- contraction -------------------------------------------------------------------------------

#: A chain's neighbouring pieces of one region are one while the first lasts less than so many seconds.
PIECE_S = 300.0


def turned(profile: Column | str) -> Column:
    """A profile as it is met from the edge's other end."""
    return F.reverse(profile)


def folded(profile: Column | str, least_s: float = PIECE_S, joint: bool = False) -> Column:
    """A profile (an array of structs region, metres, seconds) with a piece added to the one before it
    if both are of one region and that one lasts less than ``least_s`` so far; joint: if both together
    last at most that long."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["region"].alias("region"), (last["metres"] + x["metres"]).alias("metres"), (last["seconds"] + x["seconds"]).alias("seconds"))
        same = (last["region"] == x["region"]) & ((last["seconds"] + x["seconds"] <= least_s) if joint else (last["seconds"] < least_s))
        return F.when(F.size(done) == 0, F.array(x)).when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    p = F.col(profile) if isinstance(profile, str) else profile
    return F.aggregate(p, F.slice(p, 1, 0), add)


def split_profile(profile: Column | str, share: float) -> tuple[Column, Column]:
    """A profile's parts before and after ``share`` of its length; a piece across the cut is divided."""
    p = F.col(profile) if isinstance(profile, str) else profile
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x["metres"])

    def from_to(lo: Column, hi: Column) -> Column:
        start = F.transform(p, lambda x, i: F.aggregate(F.slice(p, 1, i), F.lit(0.0), lambda s, y: s + y["metres"]))
        placed = F.zip_with(p, start, lambda x, at: F.struct(x.alias("x"), F.greatest(at, lo).alias("a"), F.least(at + x["metres"], hi).alias("b")))
        part = lambda z: F.coalesce(F.try_divide(z["b"] - z["a"], z["x"]["metres"]), F.lit(0.0))
        cut = F.transform(F.filter(placed, lambda z: z["b"] > z["a"]), lambda z: F.struct(z["x"]["region"].alias("region"), (z["x"]["metres"] * part(z)).alias("metres"), (z["x"]["seconds"] * part(z)).alias("seconds")))
        return cut

    return from_to(F.lit(0.0), total * share), from_to(total * share, total)


def parallel_roads(edges: DataFrame, least_s: float = 120.0, share: float = 0.05) -> DataFrame:
    """Of edges(u, v, metres, seconds, profile) with the same ends the fastest stays. Another one is the
    same road if it is slower by less than least_s or ``share`` of the faster time, and goes; else it is
    a road of its own and stays in two halves, through a node in its middle with a negative id. u < v."""
    ahead = F.col("u") < F.col("v")
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "metres", "seconds", F.when(ahead, F.col("profile")).otherwise(turned("profile")).alias("profile"))
    w = Window.partitionBy("u", "v").orderBy("seconds", "metres", F.to_json("profile"))
    e = e.withColumn("k", F.row_number().over(w)).withColumn("best", F.min("seconds").over(Window.partitionBy("u", "v")))
    own = F.col("seconds") - F.col("best") >= F.greatest(F.lit(least_s), share * F.col("best"))
    kept = e.where("k = 1").select("u", "v", "metres", "seconds", "profile")
    middle = (-1 - F.abs(F.xxhash64("u", "v", "k") % (1 << 53))).alias("m")
    first, second = split_profile("profile", 0.5)
    rest = e.where((F.col("k") > 1) & own).select("u", "v", middle, (F.col("metres") / 2).alias("metres"), (F.col("seconds") / 2).alias("seconds"), first.alias("p1"), second.alias("p2"))
    # the middle's id is the smaller one, so both halves are turned to begin there
    halves = rest.select(F.col("m").alias("u"), F.col("u").alias("v"), "metres", "seconds", turned("p1").alias("profile"))
    halves = halves.unionByName(rest.select(F.col("m").alias("u"), "v", "metres", "seconds", F.col("p2").alias("profile")))
    return kept.unionByName(halves)


def contract(edges: DataFrame, keep: DataFrame, rounds: int = 300) -> DataFrame:
    """(u, v, metres, seconds, profile), u < v: chains through nodes of degree two that aren't in
    keep(node) become single edges, of edges(u, v, metres, seconds, profile). Profiles are joined in
    driving order and folded at the end; parallel edges follow parallel_roads, so an edge that would
    double another one as the same road goes.

    Each round contracts, of every such chain, the nodes whose hash of this round is smaller than
    their free neighbours', about a third of a chain in whatever order its ids are, so rounds grow
    with the logarithm of chains. Raises if nodes are left after ``rounds``."""
    e = checkpointed(parallel_roads(edges.select("u", "v", "metres", "seconds", "profile")))
    keep = keep.select("node").distinct()
    for k in range(rounds + 1):
        turn = lambda node: F.struct(F.xxhash64(node, F.lit(k)), node)  # noqa: B023, E731
        out = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "metres", "seconds", "profile")
        both = out.unionByName(e.select(F.col("v").alias("src"), F.col("u").alias("dst"), "metres", "seconds", turned("profile").alias("profile")))
        free = both.groupBy("src").agg(F.count("*").alias("deg"), F.min("dst").alias("a"), F.max("dst").alias("b")).where("deg = 2 and a <> b and src >= 0")
        free = free.join(keep, free["src"] == keep["node"], "left_anti").select("src", "a", "b")
        names = free.select(F.col("src").alias("other"))
        rival = free.select("src", F.explode(F.array("a", "b")).alias("other")).join(names, "other").where(turn("other") < turn("src")).select("src").distinct()
        go = checkpointed(free.join(rival, "src", "left_anti"))
        if not go.take(1):
            return e.select("u", "v", "metres", "seconds", folded("profile").alias("profile"))
        if k == rounds:
            raise RuntimeError(f"chains are not contracted after {rounds} rounds")
        a = both.select("src", F.col("dst").alias("a"), F.col("metres").alias("ma"), F.col("seconds").alias("sa"), turned("profile").alias("pa"))
        b = both.select("src", F.col("dst").alias("b"), F.col("metres").alias("mb"), F.col("seconds").alias("sb"), F.col("profile").alias("pb"))
        merged = go.join(a, ["src", "a"]).join(b, ["src", "b"]).select(
            F.col("a").alias("u"), F.col("b").alias("v"), (F.col("ma") + F.col("mb")).alias("metres"), (F.col("sa") + F.col("sb")).alias("seconds"), F.concat("pa", "pb").alias("profile")
        )
        gone = go.select(F.col("src").alias("x"))
        rest = e.join(gone, e["u"] == gone["x"], "left_anti").join(gone, e["v"] == gone["x"], "left_anti")
        e = checkpointed(parallel_roads(rest.unionByName(merged)))


def merge_micro(edges: DataFrame, keep: DataFrame, least_m: float = 1000.0) -> DataFrame:
    """edges(u, v, metres, seconds, profile) without those shorter than least_m: the nodes that such
    edges join become one, the smallest of them in keep(node) or else the smallest; then chains are
    contracted. The dropped edges' length and time are lost, as interchanges' should be."""
    short = edges.where(F.col("metres") < least_m).select("u", "v")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    of = components(short, nodes)
    known = keep.select("node").distinct().withColumn("kept", F.lit(True))
    name = F.coalesce(F.min(F.when(F.col("kept"), F.col("node"))), F.min("node"))
    names = of.join(known, "node", "left").groupBy("component").agg(name.alias("name"))
    to = checkpointed(of.join(names, "component").select("node", "name"))
    e = edges.where(F.col("metres") >= least_m)
    for c in ("u", "v"):
        e = e.join(to.select(F.col("node").alias(c), F.col("name").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return contract(e, keep)
