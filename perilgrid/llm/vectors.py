"""Near-duplicates and nearest neighbours of embedding vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop, release, save, sorted_groups

BLOCK = 4096
MOST_PIVOTS = 2048
_BIN, _ALL = np.float32, np.float64


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that can be compared: not null, not zero, all components finite."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def dimensions(vecs: DataFrame) -> list[int]:
    """The dimensions that two vectors or more have. Only vectors of one dimension are compared, so
    each of these is a job of its own (a table has one, as a rule)."""
    return [r["dim"] for r in vecs.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect()]


def matrix(col: pa.Array, kind: type = _ALL) -> np.ndarray:
    """A list column without nulls as rows of unit length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(_ALL, copy=False)
    x = flat.reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind, copy=False)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def pivots(vecs: DataFrame, k: int, salt: int = 0) -> np.ndarray:
    """k vectors (at most MOST_PIVOTS, 1 MB at 64 dimensions) picked by a hash of their ids."""
    rows = vecs.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(min(k, MOST_PIVOTS)).select("v").collect()
    return matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, 1))


# --- exact range join ------------------------------------------------------------------------


def _homes(vecs: DataFrame, shared, radius: float) -> DataFrame:
    """(cell, home, vec_id, copies, v): each vector in the cell of its nearest pivot, and in each
    other that may hold a vector within radius. By the triangle inequality, a vector is at least
    (d(v,p)^2 - d(v,h)^2) / 2 d(p,h) from the cell of p if h is its own pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                near = matrix(part.column(2)) @ p.T
                own = near.argmax(1)
                margin = near[np.arange(len(own)), own][:, None] - near
                reach = margin <= radius * apart[own] + 1e-9
                i, cell = np.nonzero(reach)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(cell == own[i]), *(part.column(c).take(take) for c in range(3))], ["cell", "home", "vec_id", "copies", "v"]
                )

    kind = vecs.schema["vec_id"].dataType.simpleString()
    return vecs.select("vec_id", "copies", "v").mapInArrow(run, f"cell int, home boolean, vec_id {kind}, copies bigint, v array<double>")


class _Roots:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _join_block(home_ids: np.ndarray, home: np.ndarray, targets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of home rows and a stream of targets (ids, copies, vectors): the number of linked
    targets of each home row, copies counted, itself not; and edges (a, b) that connect all linked."""
    single, slack = home.astype(_BIN), 1e-5
    count, roots = np.zeros(len(home), np.int64), _Roots(len(home))
    edge_a, edge_b = [], []
    for ids, copies, v in targets:
        v32 = v.astype(_BIN)
        for lo in range(0, len(home), 512):
            s = single[lo : lo + 512] @ v32.T
            linked = s >= least + slack
            for i, j in np.argwhere((s >= least - slack) & ~linked):  # near the threshold: in double precision
                linked[i, j] = _exact(home[lo + i], v[j]) >= least
            linked &= home_ids[lo : lo + 512, None] != ids[None, :]
            some = np.flatnonzero(linked.any(0))
            if not len(some):
                continue
            linked = linked[:, some]
            count[lo : lo + 512] += linked @ copies[some]
            first = linked.argmax(0)
            edge_a.append(ids[some])
            edge_b.append(home_ids[lo + first])
            i, j = np.nonzero(linked)
            for pair in np.unique(i * len(linked) + first[j]).tolist():
                a, b = divmod(pair, len(linked))
                roots.join(lo + a, lo + b)
    top = np.array([roots.find(i) for i in range(len(home))], np.int64)
    moved = np.flatnonzero(top != np.arange(len(home)))
    edge_a.append(home_ids[moved])
    edge_b.append(home_ids[top[moved]])
    return count, np.concatenate(edge_a), np.concatenate(edge_b)


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its home rows first; targets are streamed, never held together."""
        rows = iter(_pieces(batches))
        piece = next(rows, None)
        while piece is not None:
            block, ids, vecs = piece[0], [], []
            held: list = []
            while piece is not None and piece[0] == block and piece[1]:
                ids.append(piece[2])
                vecs.append(piece[4])
                held.append(piece)
                piece = next(rows, None)

            def targets() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                nonlocal piece
                while piece is not None and piece[0] == block:
                    yield piece[2], piece[3], piece[4]
                    piece = next(rows, None)

            if not ids:
                for _ in targets():
                    pass
                continue
            home_ids = np.concatenate(ids)
            count, a, b = _join_block(home_ids, np.concatenate(vecs), targets(), least)
            none = pa.nulls(len(count), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(home_ids), pa.array(count), none], ["a", "n", "b"])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], ["a", "n", "b"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            block, role = part.column(0).to_numpy(), part.column(1).to_numpy()
            key = block * 2 + role
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            ids, copies, v = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4))
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield int(block[s]), role[s] == 0, ids[s:e], copies[s:e], v[s:e]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Links are all pairs with cosine >= least, in double precision: on the unit sphere, Euclidean
    distance at most sqrt(2 - 2 * least). An exact metric range join finds them. Vectors go to the
    cell of their nearest pivot and are replicated to the cells that may hold a partner; each cell
    finds the partners of its own vectors. Cells are cut into blocks of about 4096 own vectors that
    the cell's other vectors stream past, so memory is bounded whatever a cell holds. Equal vectors
    are joined once. A block emits counts and a spanning forest of its links, not the pairs.

    n_links: other vectors linked directly; component_id: the smallest vec_id reachable, itself
    included; kept: vec_id = component_id. Null vectors, zero ones and those with null or non-finite
    components link with nothing; vectors of different dimensions aren't linked. Null vec_id: no
    links, component_id null, kept true. Rows with one vec_id are one vector if equal; if they
    differ, each links by its own components and they share a component. Other columns aren't read;
    an empty table gives an empty result. vec_id is a whole number."""
    spark = vectors.sparkSession
    fine, _ = save(usable(vectors, id_col, vec_col), "vectors")
    classes = fine.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes, _ = save(classes, "classes")
    found = None
    for dim in dimensions(classes):
        part = _linked(classes.where(F.size("v") == dim), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, n bigint, b bigint")
    counts = found.where("n is not null").select(F.col("a").alias("rep"), "n")
    roots = connected_components(found.where("b is not null").select("a", "b"))
    of = counts.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", F.coalesce("root", "rep").alias("root"))
    of = classes.select("v", F.col("vec_id").cast("long").alias("rep"), "copies").join(of, "rep", "left")
    links = fine.join(of, "v").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    links = links.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("root").alias("root"))
    out = vectors.select(F.col(id_col).alias("vec_id")).join(links, "vec_id", "left")
    component = F.coalesce(F.col("root").cast(vectors.schema[id_col].dataType), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _linked(classes: DataFrame, least: float) -> DataFrame:
    """Of distinct vectors of one dimension, classes(vec_id, copies, v): rows (a, n) with the number
    of vectors linked with a, copies counted, and rows (a, b), a spanning forest of the links."""
    spark = classes.sparkSession
    n = classes.count()
    shared = spark.sparkContext.broadcast(pivots(classes, math.ceil(n / BLOCK)))
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    placed, placed_path = save(_homes(classes, shared, radius), "cells")
    sizes = {r["cell"]: math.ceil(r["n"] / BLOCK) for r in placed.where("home").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_PIVOTS rows
    split = [x for c in sorted(sizes) for x in (F.lit(c), F.lit(sizes[c]))]
    blocks = F.coalesce(F.try_element_at(F.create_map(*split), F.col("cell")), F.lit(0)) if split else F.lit(0)
    own = F.pmod(F.xxhash64("vec_id"), F.greatest(blocks, F.lit(1)))
    base = F.col("cell").cast("long") * 1_000_000
    homes = placed.where("home").select((base + own).alias("block"), F.lit(0).alias("role"), "vec_id", "copies", "v")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: base + k)
    others = placed.where(blocks > 0).select(F.explode(every).alias("block"), F.lit(1).alias("role"), "vec_id", "copies", "v")
    dealt = homes.unionByName(others).withColumn("vec_id", F.col("vec_id").cast("long"))
    found, _ = save(dealt.repartition("block").sortWithinPartitions("block", "role").mapInArrow(_cells(least), "a bigint, n bigint, b bigint"), "links")
    drop(spark, placed_path)
    return found


# --- neighbour graph -------------------------------------------------------------------------


def _codes(vecs: DataFrame) -> DataFrame:
    """vecs(node, v) with code: the unit vector in single precision, for building the graph; the
    search scores the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = matrix(b.column("v"), _BIN)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "v", "code"])

    return vecs.select("node", "v").mapInArrow(run, "node bigint, v array<double>, code binary")


def _decoded(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), _BIN).reshape(len(col), -1)


def _nearest(u: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None, out: list) -> None:
    """Adds to out the k nearest others of each row among all rows, of those above its floor."""
    s = x @ x.T
    s[u[:, None] == u[None, :]] = -2
    k = min(k, len(u) - 1)
    if k < 1:
        return
    j = np.argpartition(-s, k - 1, axis=1)[:, :k]
    top = np.take_along_axis(s, j, 1)
    good = top > (-1.5 if floor is None else np.maximum(floor, -1.5)[:, None])
    out.append((np.repeat(u, k)[good.ravel()], u[j].ravel()[good.ravel()], top.ravel()[good.ravel()]))


def _local_joins(k: int, largest: int):
    """Of rows (group, node, code, floor) sorted by group: for each node of a group its k nearest
    others there. Groups of over ``largest`` rows, which only the first cells can be, are taken in
    slices of that size: they are a start, and the rounds after it join across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "grp"):
            group, node, floor = (t.column(c).to_numpy() for c in ("grp", "node", "floor"))
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            out: list = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for lo in range(s, e, largest):
                    hi = min(e, lo + largest)
                    _nearest(node[lo:hi], _decoded(_column(t.slice(lo, hi - lo), "code")), k, floor[lo:hi], out)
                if len(out) > 200:
                    yield _edges(out)
                    out = []
            if out:
                yield _edges(out)

    return run


def _edges(out: list) -> pa.RecordBatch:
    u, w, s = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(s.astype(_BIN))], ["u", "w", "s"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return edges.groupBy("u", "w").agg(F.max("s").alias("s")).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _both_ways(graph: DataFrame, k: int) -> DataFrame:
    return _best(graph.unionByName(graph.select(F.col("w").alias("u"), F.col("u").alias("w"), "s")), k)


def neighbour_graph(coded: DataFrame, k: int = 40, reach: int = 12, rounds: int = 4, starts: int = 2, cell: int = 600, enough: float = 0.02) -> tuple[DataFrame, str]:
    """(u, w, s) and its path: about the k nearest neighbours w of each node u, by NN-descent.

    It starts from the neighbours within cells around random pivots, ``starts`` times. Each round
    joins every node's neighbours, of either direction, with one another: of each, the ``reach``
    nearest found there that improve on its list are sent to it. Rounds end when fewer than the
    share ``enough`` of all lists' entries changed, or after ``rounds``."""
    spark = coded.sparkSession
    n = coded.count()
    floorless = F.lit(-2.0).cast("float").alias("floor")
    edges = None
    for t in range(starts):
        shared = spark.sparkContext.broadcast(pivots(coded.select(F.col("node").alias("vec_id"), "v"), math.ceil(n / cell), 101 + t))
        grouped = _assigned(coded, shared).select("grp", "node", "code", floorless)
        found = grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_local_joins(k, 2000), "u bigint, w bigint, s float")
        edges = found if edges is None else edges.unionByName(found)
    graph, path = save(_best(edges, k), "graph") if edges is not None else (None, "")
    for _ in range(rounds):
        floor = graph.groupBy("u").agg(F.min("s").alias("s"), F.count("*").alias("n")).select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("s")).otherwise(-2.0).cast("float").alias("floor"))
        ready = coded.select("node", "code").join(floor, "node")
        near = _both_ways(graph, 2 * k).select(F.col("u").alias("grp"), F.col("w").alias("node"))
        grouped = near.join(ready, "node").select("grp", "node", "code", "floor")
        found = grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_local_joins(reach, 4 * k), "u bigint, w bigint, s float")
        new, new_path = save(_best(graph.unionByName(found), k), "graph")
        changed = new.join(graph, ["u", "w"], "left_anti").count()
        drop(spark, path)
        graph, path = new, new_path
        release(spark)
        if changed < enough * n * k:
            break
    return graph, path


def _assigned(coded: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value.astype(_BIN)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                own = (_decoded(part.column("code")) @ p.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), part.column("node"), part.column("code")], ["grp", "node", "code"])

    return coded.select("node", "code").mapInArrow(run, "grp bigint, node bigint, code binary")


def _scores(pairs: DataFrame) -> DataFrame:
    """(q, node, s) of pairs(q, node, q_v, v), in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", matrix(b.column("q_v")), matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(s)], ["q", "node", "s"])

    return pairs.select("q", "node", "q_v", "v").mapInArrow(run, "q bigint, node bigint, s double")


def graph_search(coded: DataFrame, graph: DataFrame, queries: DataFrame, width: int = 128, step: int = 32, degree: int = 40) -> DataFrame:
    """(q, node, s): the ``width`` nearest nodes that a greedy search finds for each query q of
    queries(q), itself a node of the graph, where the search starts. Each round expands the nearest
    ``step`` nodes not yet expanded of each query's beam, its ``width`` nearest known nodes, for all
    queries at once, until all are. s is the cosine of the original vectors in double precision.

    The beams are all that is kept between rounds. A node that has left a beam may be met and scored
    again, but can't come back, for a beam's least score only rises; so no node is expanded twice
    and the rounds end."""
    spark = coded.sparkSession
    around, around_path = save(_both_ways(graph, degree).groupBy("u").agg(F.collect_list("w").alias("next")), "adjacency")
    q_vecs, _ = save(queries.join(coded.select(F.col("node").alias("q"), F.col("v").alias("q_v")), "q"), "queries")
    vecs = coded.select("node", "v")

    def beams(rows: DataFrame) -> tuple[DataFrame, str]:
        """Of rows(q, node, s, done) the nearest, those to be expanded next marked with go."""
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
        top = rows.withColumn("rank", rank).where(F.col("rank") <= width)
        turn = F.row_number().over(Window.partitionBy("q").orderBy("done", "rank"))
        return save(top.select("q", "node", "s", "done", (~F.col("done") & (turn <= step)).alias("go")), "beams")

    beam, path = beams(queries.select("q", F.col("q").alias("node"), F.lit(1.0).alias("s"), F.lit(False).alias("done")))
    while beam.where("go").take(1):
        found = beam.where("go").select("q", F.col("node").alias("u")).join(around, "u").select("q", F.explode("next").alias("node")).distinct()
        found = found.join(beam.select("q", "node"), ["q", "node"], "left_anti")
        scored = _scores(found.join(vecs, "node").join(q_vecs, "q")).withColumn("done", F.lit(False))
        old = beam.select("q", "node", "s", (F.col("done") | F.col("go")).alias("done"))
        new, new_path = beams(old.unionByName(scored))
        drop(spark, path)
        beam, path = new, new_path
        release(spark)
    drop(spark, around_path)
    return beam.select("q", "node", "s")


def cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 5, every: int = 50, **graph) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each row whose id is
    divisible by ``every``, among all other rows, by cosine; nearest first, ties to the smaller id.

    Every vector is indexed, in a neighbour graph made by NN-descent in single precision; queries
    search it greedily, by scores of the original vectors in double precision. Equal vectors are one
    node of the graph: of its rows the top + 1 smallest ids take part in results, which is all that
    ties can bring in.

    Vectors null, zero or with null or non-finite components take no part, nor does a null vec_id;
    vectors of different dimensions aren't compared. Repeated rows count once. Fewer candidates give
    fewer rows; an empty table gives an empty result. Other columns aren't read. vec_id is a whole
    number."""
    kind = vectors.schema[id_col].dataType
    fine, _ = save(usable(vectors, id_col, vec_col).withColumn("vec_id", F.col("vec_id").cast("long")).distinct(), "vectors")
    out = None
    for dim in dimensions(fine):
        found = _nearest_of(fine.where(F.size("v") == dim), top, every, graph)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = fine.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")


def _nearest_of(fine: DataFrame, top: int, every: int, graph: dict) -> DataFrame:
    """As nearest, of distinct rows fine(vec_id, v) of one dimension."""
    classes = fine.groupBy("v").agg(F.min("vec_id").alias("node"))
    classes, _ = save(classes, "classes")
    coded, _ = save(_codes(classes), "codes")
    named = fine.join(classes, "v").select("vec_id", "node")
    named, _ = save(named, "named")
    asked = named.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    links, _ = neighbour_graph(coded, **graph)
    found = graph_search(coded, links, asked.select("q").distinct())
    order = Window.partitionBy("node").orderBy("vec_id")
    members = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).select("node", "vec_id")
    vec = coded.select("node", "v")
    scored = found.join(vec, "node").join(vec.select(F.col("node").alias("q"), F.col("v").alias("q_v")), "q").select("q", "node", cosine("v", "q_v").alias("score"))
    rows = asked.join(scored, "q").join(members, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
