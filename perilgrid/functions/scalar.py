"""Numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, lo: float, hi: float) -> Column:
    """x within bounds; null stays null, which least and greatest alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def logit(p: Column, edge: float = 1e-4, most: float | None = None) -> Column:
    """The log odds of a probability kept ``edge`` away from 0 and 1, and within ``most`` of 0."""
    q = clipped(p, edge, 1 - edge)
    z = F.log(q / (1 - q))
    return z if most is None else clipped(z, -most, most)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b == 0, F.lit(default)).otherwise(F.try_divide(a, b))


def bin_of(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges x has reached, less one: the bin [edge, next edge) that holds it."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) - 1


def lead_of(seconds: Column, most: int = 18) -> Column:
    """The hour after departure in which an instant lies, late ones in the last."""
    return F.least(F.floor(seconds / 3600), F.lit(most)).cast("long")


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def ceil_hour(ts: Column) -> Column:
    """The first full hour that isn't before ts."""
    return F.date_trunc("hour", ts + F.expr("interval 3599999999 microseconds"))
