"""Small numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def interp(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear interpolation in fixed knots, constant beyond the ends."""
    out = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(xs, xs[1:], ys, ys[1:]))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def day_seconds(ts: Column) -> Column:
    """Seconds since midnight, fraction included; reads the fields of the timestamp, so no time zone is involved."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def whole_seconds_since(ts: Column, day: str) -> Column:
    """Whole seconds since midnight of ``day`` (yyyy-mm-dd), no time zone involved."""
    return F.datediff(F.to_date(ts), F.to_date(F.lit(day))).cast("long") * 86400 + F.floor(day_seconds(ts))
