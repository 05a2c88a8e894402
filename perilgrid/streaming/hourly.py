"""The online mode: presence by hour, merged intervals, daily refits, ended trips and sticky choices from
streams. Everything is emitted once, when the watermark says that nothing earlier can come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_MS = 3_600_000


def _ms(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def _kind(stream: DataFrame, c: str) -> str:
    return stream.schema[c].dataType.simpleString()


def hourly_presence(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(region, hour, n): how many events of a stream (region, started_at, finished_at) lie in each
    hour, a row per region and hour. An event lies in the hours from its start to a second before its
    finish, at least in the one that it starts in. An hour is final once the watermark on starts has
    passed it; the state of a region is its hours that aren't. Repeated log rows count once."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for b in batches:
            first = _ms(b["started_at"]) // HOUR_MS
            last = ((_ms(b["finished_at"]) - 1000) // HOUR_MS).clip(lower=first)
            for lo, hi in zip(first.tolist(), last.tolist()):
                for h in range(lo, hi + 1):
                    held[h] = held.get(h, 0) + 1
        passed = state.getCurrentWatermarkMs()
        done = sorted(h for h in held if (h + 1) * HOUR_MS <= passed)
        rows = [(key[0], pd.Timestamp(h * HOUR_MS, unit="ms"), held.pop(h)) for h in done]
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max((min(held) + 1) * HOUR_MS, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["region", "hour", "n"])

    each = events.select("region", "started_at", "finished_at").withWatermark("started_at", late).dropDuplicatesWithinWatermark(["region", "started_at", "finished_at"])
    schema = f"region {_kind(events, 'region')}, hour timestamp, n long"
    return each.groupBy("region").applyInPandasWithState(run, schema, "hours array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merged_intervals(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(region, started_at, finished_at): overlapping and touching events are one session."""
    gap = F.concat(F.timestamp_diff("SECOND", "started_at", "finished_at").cast("string"), F.lit(" seconds"))
    w = F.session_window("started_at", gap)
    return events.withWatermark("started_at", late).where("finished_at > started_at").groupBy("region", w.alias("w")).count().select("region", F.col("w.start").alias("started_at"), F.col("w.end").alias("finished_at"))


def daily_refit(pairs: DataFrame, days: int = 42, late: str = "1 hour") -> DataFrame:
    """(region, day, p11, p01): transition rates for each day from the ``days`` days before it, of a
    stream (region, at, before, a) of hourly transitions; a sliding window that is final once the
    watermark has passed the day's beginning."""
    w = F.window("at", f"{days} days", "1 day")
    p = pairs.withWatermark("at", late).withColumn("_n0", 1 - F.col("before"))
    s = p.groupBy("region", w.alias("w")).agg(F.sum(F.col("before") * F.col("a")).alias("aa"), F.sum("before").alias("n1"), F.sum(F.col("_n0") * F.col("a")).alias("ba"), F.sum("_n0").alias("n0"))
    rate = lambda a, n: F.col(a) / F.greatest(F.col(n), F.lit(1))
    return s.select("region", F.col("w.end").alias("day"), rate("aa", "n1").alias("p11"), rate("ba", "n0").alias("p01"))


def matured(targets: DataFrame, lead_h: int = 19) -> DataFrame:
    """The rows of a stream (region, at, y, ...) that may be learned from: only those whose last target
    hour, lead_h hours on, is over; as hourly means by region."""
    w = F.window("at", "1 hour")
    return targets.withWatermark("at", f"{lead_h - 1} hours").groupBy("region", w.alias("w")).agg(F.avg("y").alias("y")).select("region", F.col("w.start").alias("at"), "y")


def ended_trips(trips: DataFrame, most_h: int = 19) -> DataFrame:
    """(corridor, route, at, km) of a stream (corridor, route, at, km) of departures, each hour's sum
    emitted only when its trips have ended, most_h hours after departure."""
    w = F.window("at", "1 hour")
    d = trips.withWatermark("at", f"{most_h - 1} hours").groupBy("corridor", "route", w.alias("w")).agg(F.sum("km").alias("km"))
    return d.select("corridor", "route", F.col("w.start").alias("at"), "km")


def sticky_choice(scores: DataFrame, theta: float, late: str = "1 hour") -> DataFrame:
    """(corridor, at, route) of a stream (corridor, at, pref, routes, scores), a row per corridor and
    hour with its candidates' scores: the route stays the last one (at first the preferred) unless the
    best is better by more than theta. Hours wait for the watermark, so they are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting = state.get if state.exists else (None, "[]")
        hours = json.loads(waiting)
        for b in batches:
            for r in b.itertuples():
                own = int(r.pref) if own is None else own
                hours.append([int(r.at.value // 1_000_000), [int(x) for x in r.routes], [float(x) for x in r.scores]])
        passed, rows = state.getCurrentWatermarkMs(), []
        for at, routes, values in sorted(h for h in hours if h[0] < passed):
            score = dict(zip(routes, values))
            best = min(score, key=lambda x: (score[x], x))
            if own not in score or score[best] < score[own] - theta - 1e-9:
                own = best
            rows.append((key[0], pd.Timestamp(at, unit="ms"), own))
        left = [h for h in hours if h[0] >= passed]
        state.update((own, json.dumps(left)))
        if left:
            state.setTimeoutTimestamp(max(min(left)[0] + 1, passed + 1))
        yield pd.DataFrame(rows, columns=["corridor", "at", "route"])

    d = scores.select("corridor", "at", F.col("pref").cast("long").alias("pref"), F.col("routes").cast("array<long>").alias("routes"), F.col("scores").cast("array<double>").alias("scores")).withWatermark("at", late)
    schema = f"corridor {_kind(scores, 'corridor')}, at timestamp, route long"
    return d.groupBy("corridor").applyInPandasWithState(run, schema, "own long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def last_finish(events: DataFrame) -> DataFrame:
    """(region, started_at, until) of a stream (region, started_at, finished_at): the latest finish seen
    so far in the region, so that an instant is active while it is before ``until``. Events of a batch
    are taken in order of their starts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).sort_values("started_at")
        seen = _ms(b["finished_at"]).cummax()
        if state.exists:
            seen = seen.clip(lower=state.get[0])
        state.update((int(seen.iloc[-1]),))
        yield pd.DataFrame({"region": key[0], "started_at": b["started_at"].to_numpy(), "until": pd.to_datetime(seen.to_numpy(), unit="ms")})

    schema = f"region {_kind(events, 'region')}, started_at timestamp, until timestamp"
    return events.select("region", "started_at", "finished_at").groupBy("region").applyInPandasWithState(run, schema, "until long", "append", GroupStateTimeout.NoTimeout)
