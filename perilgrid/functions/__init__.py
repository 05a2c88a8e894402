"""Scalar functions on columns: those of their own here, and those that operators define, in one place."""

from ..operators.geo import albers, cell, haversine, in_polygon, project, segment_distance
from ..operators.graph import folded, parse_profile, split_profile, turned
from ..operators.reshape import at_or, compose, days, folded_sum, part_of, signed
from ..operators.stats import close, two_sided
from ..operators.timegrid import hour_of, micros
from .scalar import bin_of, ceil_hour, clipped, floor_hour, lead_of, logit, safe_ratio, sigmoid

__all__ = [
    "albers", "at_or", "bin_of", "ceil_hour", "cell", "clipped", "close", "compose", "days", "floor_hour", "folded", "folded_sum", "haversine", "hour_of",
    "in_polygon", "lead_of", "logit", "micros", "parse_profile", "part_of", "project", "safe_ratio", "segment_distance", "sigmoid", "signed", "split_profile",
    "turned", "two_sided",
]
