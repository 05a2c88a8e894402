"""Learned forecasts: boosted trees per lead with isotonic calibration, and daily refits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def per_lead(features: DataFrame, columns: list[str], leads: list[int], calibrate_from: int, test_from: int, trees: int = 10, depth: int = 4) -> DataFrame:
    """(region, h, k, p) for rows from test_from on. features(region, h, columns, y_k for each k).
    Rows whose target hour h + k lies beyond the next boundary are left out of training and
    calibration, so no model sees the period that it is judged on. A missing feature counts as -1, below
    all others. The assembled features are written once, for every model reads them many times."""
    full = features.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns})
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(full)
    ready = checkpointed(ready.select("region", "h", "x", *(f"y_{k}" for k in leads)))
    out = None
    for k in leads:
        y = F.col(f"y_{k}").cast("double")
        rows = ready.where(y.isNotNull()).withColumn("label", y)
        train = rows.where(F.col("h") + k < calibrate_from)
        model = GBTClassifier(featuresCol="x", maxIter=trees, maxDepth=depth, seed=42).fit(train)
        score = lambda d: model.transform(d).withColumn("raw", vector_to_array("probability")[1])  # noqa: E731, B023
        held = score(rows.where((F.col("h") >= calibrate_from) & (F.col("h") + k < test_from)))
        iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
        p = iso.transform(score(ready.where(F.col("h") >= test_from))).select("region", "h", F.lit(k).alias("k"), F.col("calibrated").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def rolling_origin(features: DataFrame, columns: list[str], leads: list[int], windows: list[tuple[int, int, int]], trees: int = 10, depth: int = 4) -> DataFrame:
    """(window, region, h, k, p): per_lead trained anew for each window (calibrate_from, test_from,
    end), judged on its own hours only."""
    out = None
    for i, (calibrate_from, test_from, end) in enumerate(windows):
        p = per_lead(features.where(F.col("h") < end), columns, leads, calibrate_from, test_from, trees, depth).withColumn("window", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.select("window", "region", "h", "k", "p")


def _logit(p: np.ndarray, edge: float) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def recalibrate(forecast: DataFrame, days: int = 42, shrink: float = 14.0, most: float = 1.5, first_day: int | None = None) -> DataFrame:
    """(region, h, lead, p) of forecast(region, h, lead, p, y): for each day, region and lead the
    logit is shifted by the offset that fits best the forecasts whose feature row (the hour before
    departure) lies in the ``days`` days before and whose target hour is over when the day begins;
    shrunk by d / (d + shrink) over the d days that have data, and at most ``most``. Days before
    first_day stay as they are. A region's lead is one group: its length is the time span, and
    regions add groups."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h").reset_index(drop=True)
        p, y, h = (g[c].to_numpy(float) for c in ("p", "y", "h"))
        z, day, target, out = _logit(p, 1e-4), h // 24, h + g["lead"].to_numpy(), p.copy()
        for d in np.unique(day):
            if first_day is not None and d < first_day:
                continue
            lo, hi = np.searchsorted(h, [(d - days) * 24 + 1, d * 24])
            past = np.arange(lo, hi)[(target[lo:hi] < d * 24) & ~np.isnan(y[lo:hi])]
            if not len(past):
                continue
            x, seen, offset = z[past], y[past], 0.0
            for _ in range(6):
                q = _sigmoid(x + offset)
                offset = float(np.clip(offset + (seen - q).sum() / ((q * (1 - q)).sum() + 1e-6), -5, 5))
            n = len(np.unique((h[past] - 1) // 24))
            now = day == d
            out[now] = _sigmoid(z[now] + np.clip(offset * n / (n + shrink), -most, most))
        return g.assign(p=out)[["region", "h", "lead", "p"]]

    return forecast.groupBy("region", "lead").applyInPandas(run, "region long, h long, lead long, p double")


def stack(forecast: DataFrame, days: int = 42, ridge: float = 1.0, start: int = 0, least: int = 48, block: int = 14) -> DataFrame:
    """(region, h, lead, p) of forecast(region, h, lead, p1, p2, y): per lead and day a logistic mix of
    two forecasts, fitted over all regions to departures of the ``days`` days before (not before the
    hour ``start``) whose target hour is over; the two slopes, not the intercept, are ridged toward a
    half each. With ``least`` hours or fewer the prior stands.

    A fit needs its window's rows of all regions, so a group is a lead and ``block`` days with the
    days before them: no group grows with the history."""
    day = F.floor(F.col("h") / 24)
    blocks = F.sequence(F.floor(day / block), F.floor((day + days) / block))
    rows = forecast.select("region", "h", "lead", "p1", "p2", "y", F.explode(blocks).alias("block"))

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "region"]).reset_index(drop=True)
        x = np.column_stack([np.ones(len(g)), *(np.clip(_logit(g[c].to_numpy(float), 1e-6), -9, 9) for c in ("p1", "p2"))])
        y, h = g["y"].to_numpy(float), g["h"].to_numpy()
        target, prior, pull = h + g["lead"].to_numpy(), np.array([0.0, 0.5, 0.5]), ridge * np.array([0.0, 1.0, 1.0])
        first = int(key[1]) * block
        out, now = np.full(len(g), np.nan), np.zeros(len(g), bool)
        for d in range(first, first + block):
            lo, hi = np.searchsorted(h, [d * 24, d * 24 + 24])
            if lo == hi:
                continue
            a = np.searchsorted(h, max((d - days) * 24, start))
            past = np.arange(a, lo)[(target[a:lo] < d * 24) & ~np.isnan(y[a:lo])] if a < lo else np.zeros(0, int)
            w = prior.copy()
            if len(np.unique(h[past])) > least:
                xs, ys = x[past], y[past]
                for _ in range(8):
                    q = _sigmoid(xs @ w)
                    slope = xs.T @ (ys - q) - pull * (w - prior)
                    w = w + np.linalg.solve((xs * (q * (1 - q))[:, None]).T @ xs + np.diag(pull + 1e-6), slope)
            out[lo:hi] = _sigmoid(x[lo:hi] @ w)
            now[lo:hi] = True
        return g.assign(p=out)[["region", "h", "lead", "p"]][now]

    return rows.groupBy("lead", "block").applyInPandas(run, "region long, h long, lead long, p double")


def hysteresis(scores: DataFrame, prefer: DataFrame, theta: float) -> DataFrame:
    """(corridor, h, route): stays on the last choice unless the best is better by more than theta;
    depends on the choice before, so a corridor's hours are one sequence."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="h", columns="route", values="e", aggfunc="min").sort_index()
        own, rows = g["pref"].iloc[0], []
        for h, e in wide.iterrows():
            best = e.idxmin()
            if own not in e.index or not e[best] >= e[own] - theta - 1e-9:
                own = best
            rows.append((g["corridor"].iloc[0], h, own))
        return pd.DataFrame(rows, columns=["corridor", "h", "route"])

    return scores.join(prefer, "corridor").groupBy("corridor").applyInPandas(run, "corridor long, h long, route long")
