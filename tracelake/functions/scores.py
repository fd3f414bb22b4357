"""Column arithmetic shared by the jobs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS, Q_WEIGHTS


def weighted(prefix: str = "q_", weights: dict[str, float] = Q_WEIGHTS) -> Column:
    """Weighted sum of the five dimensions; a null dimension counts 0."""
    return reduce(add, (w * F.coalesce(F.col(f"{prefix}{d}"), F.lit(0.0)) for d, w in weights.items()))


def learned(prefix: str = "q_") -> Column:
    """Whether Q was ever learned: an update was counted, or Q is not 0."""
    return (F.coalesce(F.col("q_update_count"), F.lit(0)) > 0) | (F.abs(weighted(prefix)) > 1e-9)


def q_or_score(prefix: str = "q_") -> Column:
    """Q, or the trajectory score as long as Q was never learned."""
    return F.when(learned(prefix), weighted(prefix)).otherwise(F.coalesce(F.col("trajectory_score"), F.lit(0.0)))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """``c`` within ``lo`` and ``hi``; null stays null, which ``least`` and ``greatest`` alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def dims(prefix: str) -> list[str]:
    return [f"{prefix}{d}" for d in DIMS]


def sign_class(c: Column) -> Column:
    """-1, 0 or 1; null is 0."""
    return F.coalesce(F.signum(c), F.lit(0.0)).cast("int")


def valid_reward(c: Column) -> Column:
    """A judge's integer reward: unreadable is 0, else clipped to -1..1."""
    return clamp(F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("int"), -1, 1).cast("int")


def valid_confidence(c: Column) -> Column:
    return clamp(F.coalesce(c.try_cast("double"), F.lit(0.5)), 0.0, 1.0)


def exploration(total_visits: Column, visits: Column, c: float) -> Column:
    return c * F.sqrt(F.log(total_visits + 1) / F.greatest(visits, F.lit(1)))
