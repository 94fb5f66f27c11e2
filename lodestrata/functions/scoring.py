"""Parts of the relevance of a frame, as Catalyst expressions; ``now`` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import fixed


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def temporal(at: Column, now: Column) -> Column:
    """1 up to seven days and in the future, then half every thirty days."""
    days = age_days(at, now)
    return F.when(days <= fixed.FLAT_DAYS, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), days / fixed.HALF_LIFE_DAYS))


def popularity(count: Column) -> Column:
    return 1 + 0.1 * F.log10(1 + F.coalesce(count, F.lit(0)))


def contextual(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.7).when(distance == 2, 0.4).when(distance == 3, 0.2).otherwise(0.0)


def importance(kind: Column) -> Column:
    pairs = [F.lit(x) for item in fixed.IMPORTANCE_WEIGHTS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(1.0))


def relevance(profile: str, at: Column, now: Column, count: Column, distance: Column, kind: Column) -> Column:
    t, p, c, i = fixed.PROFILES[profile]
    return t * temporal(at, now) + p * popularity(count) + c * contextual(distance) + i * importance(kind)
