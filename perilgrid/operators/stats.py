"""Forecast quality, paired and rank statistics, resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def reliability(forecast: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_p, mean_y) of forecast(by, p, y)."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return forecast.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def ece(table: DataFrame, by: list[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y")))
    return table.groupBy(*by).agg((gap / F.sum("n")).alias("ece"))


def mid_ranks(frame: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """frame with the mean rank of ties."""
    w = Window.partitionBy(*by)
    first = F.rank().over(w.orderBy(value))
    return frame.withColumn(name, first + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def auc(forecast: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): from counts per distinct score, so only those are sorted; groups with one class go."""
    s = forecast.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = s.withColumn("_u", F.col("pos") * (below + F.col("neg") / 2))
    g = pairs.groupBy(*by).agg(F.sum("_u").alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return g.where("pos > 0 and neg > 0").select(*by, (F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"))


def tails(frame: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, mean, p90, p95, over100, cvar95): quantiles interpolate; over100 is the share above 100, cvar95
    the mean from the 95 % quantile up."""
    over = F.avg((F.col(x) > 100).cast("int"))
    q = frame.groupBy(*by).agg(F.avg(x).alias("mean"), F.percentile(x, 0.9).alias("p90"), F.percentile(x, 0.95).alias("p95"), over.alias("over100"))
    top = frame.join(q.select(*by, "p95"), by).where(F.col(x) >= F.col("p95")).groupBy(*by).agg(F.avg(x).alias("cvar95"))
    return q.join(top, by)


def wilcoxon(pairs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """(by, n, w_plus, z, p): signed ranks of non-zero differences, normal with tie correction."""
    r = mid_ranks(pairs.where(F.col(d) != 0).withColumn("_m", F.abs(d)), by, "_m")
    ties = r.groupBy(*by, "_m").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = r.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col(d) > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var))
    return s.join(ties, by).select(*by, "n", "w_plus", z.alias("z"), two_sided(z).alias("p"))


def two_sided(z: Column) -> Column:
    """The two-sided normal p-value. Spark SQL has no error function, so it is fitted."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Chebyshev fit of erfc with a relative error below 1.2e-7 (Numerical Recipes)
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return F.when(z.isNotNull(), t * F.exp(-x * x + fit))


def holm(tests: DataFrame, p: str = "p", family: list[str] | None = None) -> DataFrame:
    """tests(family, name, p) with p_holm, the step-down adjusted value within a family of tests; a
    missing p counts as 1. Tests are adjusted together by definition, so a family is one group."""
    by = Window.partitionBy(*(family or []))
    w = by.orderBy("_p", "name")
    scaled = F.least((F.count("*").over(by) - F.row_number().over(w) + 1) * F.col("_p"), F.lit(1.0))
    t = tests.withColumn("_p", F.coalesce(p, F.lit(1.0))).withColumn("_s", scaled)
    return t.withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_s")


def pooled(frame: DataFrame, by: list[str], base: str, x: str) -> DataFrame:
    """(by, pooled, mean, median, better): the reduction of all rows' sums, and of the rows' own
    reductions the mean, the median and the share above 0. A row without a base has none."""
    own = F.try_divide(100 * (F.col(base) - F.col(x)), F.col(base))
    total = F.try_divide(100 * (F.sum(base) - F.sum(x)), F.sum(base))
    return frame.withColumn("_r", own).groupBy(*by).agg(total.alias("pooled"), F.avg("_r").alias("mean"), F.percentile("_r", 0.5).alias("median"), F.avg((F.col("_r") > 0).cast("int")).alias("better"))


def latency(frame: DataFrame, by: list[str], ms: str) -> DataFrame:
    """(by, n, min, median, p95, max, mean)."""
    return frame.groupBy(*by).agg(F.count(ms).alias("n"), F.min(ms).alias("min"), F.percentile(ms, 0.5).alias("median"), F.percentile(ms, 0.95).alias("p95"), F.max(ms).alias("max"), F.avg(ms).alias("mean"))


def sample_pairs(spark, nodes: int, q: int, seed: int = 42, salt: int = 0) -> DataFrame:
    """(i, s, t): q pairs of different nodes below ``nodes``, drawn uniformly with a PCG64 seed."""
    rng = np.random.default_rng(seed + 7919 * salt + q)
    s, t = rng.integers(0, nodes, q), rng.integers(0, nodes, q)
    t = np.where(t == s, (t + 1) % nodes, t)
    return spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(s, t))], "i long, s long, t long")


def spearman(frame: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    r = mid_ranks(mid_ranks(frame, by, x, "_x"), by, y, "_y")
    return r.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def block_starts(spark, hours: int, block: int, reps: int, seed: int) -> DataFrame:
    """(rep, start, len): moving blocks that make up so many hours, drawn uniformly with a PCG64 seed."""
    rng = np.random.default_rng(seed)
    k = math.ceil(hours / block)
    starts = rng.integers(0, hours - block + 1, size=(reps, k))
    lens = np.full((reps, k), block)
    lens[:, -1] = hours - block * (k - 1)
    rows = [(r, int(s), int(n)) for r in range(reps) for s, n in zip(starts[r], lens[r])]
    return spark.createDataFrame(rows, "rep int, start long, len long")


def bootstrap(series: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): 95 % interval of 100 (sum b - sum x) / sum b of series(by, i, b, x), i from 0.
    Prefix sums turn each block into two look-ups."""
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = series.select(*by, (F.col("i") + 1).alias("at"), F.sum("b").over(w).alias("sb"), F.sum("x").over(w).alias("sx"))
    zero = series.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("sb"), F.lit(0.0).alias("sx"))
    c = c.unionByName(zero)
    ends = starts.select("rep", F.explode(F.array(F.struct((F.col("start") + F.col("len")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")))).alias("e"))
    ends = ends.select("rep", "e.at", "e.sign")
    rep = c.join(ends, "at").groupBy(*by, "rep").agg(F.sum(F.col("sb") * F.col("sign")).alias("b"), F.sum(F.col("sx") * F.col("sign")).alias("x"))
    rep = rep.withColumn("impr", F.try_divide(100 * (F.col("b") - F.col("x")), F.col("b")))
    return rep.groupBy(*by).agg(F.percentile("impr", 0.025).alias("lo"), F.percentile("impr", 0.975).alias("hi"))


def masked_bootstrap(series: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """As bootstrap, over the rows of series(by, i, b, x, keep) that are kept; the others keep their
    places in the blocks but count nothing, and draws without a base have no say."""
    part = lambda c: F.when(F.col("keep") & F.col("b").isNotNull() & F.col("x").isNotNull(), F.col(c)).otherwise(0.0).alias(c)
    return bootstrap(series.select(*by, "i", part("b"), part("x")), starts, by)


def paired(days: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): 95 % interval of the difference of two reductions, of days(by, i, b, x1, x2)."""
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(w).alias(c) for c in ("b", "x1", "x2")]
    c = days.select(*by, (F.col("i") + 1).alias("at"), *sums)
    c = c.unionByName(days.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("at"), *(F.lit(0.0).alias(k) for k in ("b", "x1", "x2"))))
    ends = starts.select("rep", (F.col("start") + F.col("len")).alias("at"), F.lit(1).alias("sign")).unionByName(starts.select("rep", F.col("start").alias("at"), F.lit(-1).alias("sign")))
    rep = c.join(ends, "at").groupBy(*by, "rep").agg(*(F.sum(F.col(k) * F.col("sign")).alias(k) for k in ("b", "x1", "x2")))
    rep = rep.withColumn("d", F.try_divide(100 * (F.col("x1") - F.col("x2")), F.col("b")))
    return rep.groupBy(*by).agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"))


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(b))
