"""Two-sided p values as column expressions, from series with positive terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(first: Column, last: Column, ratio) -> Column:
    """Sum of terms 0 to last, the next one being ratio(k) times term k - 1; 0 where last < 0."""
    step = lambda s, k: F.struct((s["term"] * ratio(k + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.struct(first.alias("term"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
    return F.when(last >= 0, total).otherwise(0.0)


def normal_p(z: Column) -> Column:
    """P(|Z| >= |z|); terms of the error function up to where they vanish for |z| <= 12, beyond that 0."""
    x = F.abs(z) / math.sqrt(2)
    erf = _series(x * F.exp(-x * x) * (2 / math.sqrt(math.pi)), F.lit(400), lambda k: x * x / (k + 0.5))
    return F.when(F.abs(z) > 12, 0.0).otherwise(F.greatest(1 - erf, F.lit(0.0)))


def student_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for whole degrees of freedom from 1 on, null below."""
    df = df.cast("int")
    angle = F.atan2(F.abs(t), F.sqrt(df.cast("double")))
    s, c = F.sin(angle), F.cos(angle)
    even = s * _series(F.lit(1.0), F.floor(df / 2).cast("int") - 1, lambda k: c * c * (2 * k - 1) / (2 * k))
    odd = (angle + s * _series(c, F.floor((df - 3) / 2).cast("int"), lambda k: c * c * (2 * k) / (2 * k + 1))) * (2 / math.pi)
    return F.when(df >= 1, F.greatest(1 - F.when(df % 2 == 0, even).otherwise(odd), F.lit(0.0)))
