"""Column expressions on circular quantities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def circular_error(estimate: Column, truth: Column, period: float) -> Column:
    """Signed error wrapped to [-period/2, period/2)."""
    return F.pmod(estimate - truth + F.lit(period / 2), F.lit(float(period))) - F.lit(period / 2)


def circular_mean(value: Column, period: float) -> Column:
    """Aggregate: mean direction on a circle of length ``period``, in (-period/2, period/2]."""
    angle = value * F.lit(2 * math.pi / period)
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * F.lit(period / (2 * math.pi))


def circular_distance(a: Column, b: Column, period: float) -> Column:
    """Unsigned distance on a circle."""
    d = F.pmod(F.abs(a - b), F.lit(float(period)))
    return F.least(d, F.lit(float(period)) - d)
