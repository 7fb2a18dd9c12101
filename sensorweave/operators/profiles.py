"""Profiles by time of day, week and season, their shapes and harmonics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import phase_hour, tidy
from ..functions.timefn import local


def by(panel: DataFrame, name: str, part: Column, *keys: str) -> DataFrame:
    """Mean value by keys and a part of the local time."""
    return panel.groupBy(*keys, part.alias(name)).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def diurnal(panel: DataFrame) -> DataFrame:
    return by(panel, "hour", F.hour(local(F.col("ts"))), "station_id")


def shape(profile: DataFrame) -> DataFrame:
    """Each profile less its mean, over its population deviation; a flat one is only centred."""
    w = W.partitionBy("station_id")
    sd = F.stddev_pop("mean").over(w)
    return profile.withColumn("z", F.round((F.col("mean") - F.avg("mean").over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0), 6)).select("station_id", "hour", "z")


def summary(profile: DataFrame) -> DataFrame:
    """Peak and trough hour (earliest at a tie), swing in per cent of the mean, morning less evening."""
    m = F.col("mean")
    agg = profile.groupBy("station_id").agg(
        F.min_by("hour", F.struct(-m, F.col("hour"))).alias("peak"), F.min_by("hour", F.struct(m, F.col("hour"))).alias("trough"),
        F.round(100 * (F.max(m) - F.min(m)) / F.nullif(F.avg(m), F.lit(0.0)), 6).alias("swing_pct"),
        F.round(F.avg(F.when(F.col("hour").between(6, 10), m)) - F.avg(F.when(F.col("hour").between(18, 22), m)), 6).alias("balance"),
    )
    return agg


def harmonics(profile: DataFrame) -> DataFrame:
    """Amplitude and phase of the 24 and 12 hour waves of complete profiles, by projection."""
    m, h = F.col("mean"), F.col("hour")
    part = lambda f, k: F.sum(m * f(h * (2 * math.pi * k / 24))) / 12
    out = profile.groupBy("station_id").agg(F.count(F.lit(1)).alias("hours"), *(part(f, k).alias(f"{n}{k}") for k in (1, 2) for n, f in (("a", F.cos), ("b", F.sin)))).where("hours = 24")
    return out.select("station_id", *(F.round(F.hypot(f"a{k}", f"b{k}"), 6).alias(f"amp{k}") for k in (1, 2)), F.round(phase_hour(F.col("a1"), F.col("b1")), 5).alias("phase"))


def residuals(panel: DataFrame) -> DataFrame:
    """Value less the station's mean of that local hour."""
    return panel.withColumn("hour", F.hour(local(F.col("ts")))).withColumn("residual", tidy(F.col("value") - F.avg("value").over(W.partitionBy("station_id", "hour")))).select("station_id", "ts", "residual")


def seasonal_residuals(panel: DataFrame) -> DataFrame:
    """Value less the station's mean of that local month and hour."""
    t = local(F.col("ts"))
    own = W.partitionBy("station_id", F.month(t), F.hour(t))
    return panel.select("station_id", "ts", tidy(F.col("value") - F.avg("value").over(own)).alias("residual"))


def anomalies(panel: DataFrame, least: int = 10) -> DataFrame:
    """Value less the hour's mean over stations, and its score; hours with fewer stations are left out."""
    w = W.partitionBy("ts")
    sd = F.stddev_pop("value").over(w)
    out = panel.withColumns({"n": F.count(F.lit(1)).over(w), "anomaly": F.col("value") - F.avg("value").over(w), "sd": sd}).where(F.col("n") >= least)
    return out.select("station_id", "ts", tidy(F.col("anomaly")).alias("anomaly"), F.round(F.when(F.col("sd") > 1e-9, F.col("anomaly") / F.col("sd")), 6).alias("z"))


def pairwise(profile: DataFrame, x: str = "mean", key: str = "hour") -> DataFrame:
    """Pearson correlation of all pairs of stations over shared keys; null where one is constant."""
    a, b = profile.select(F.col("station_id").alias("a"), key, F.col(x).alias("x")), profile.select(F.col("station_id").alias("b"), key, F.col(x).alias("y"))
    g = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    den = F.col("sx") * F.col("sy")
    return g.select("a", "b", F.round(F.col("c") / F.when(den > 1e-12, den), 6).alias("r"), "n")


def average_rank(x: Column, *keys: str) -> Column:
    """Rank with ties at their mean."""
    p = W.partitionBy(*keys)
    return F.rank().over(p.orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, x)) - 1) / 2


def pearson(x: Column, y: Column) -> Column:
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(den, F.lit(0.0)))


def wide(panel: DataFrame, stations: list[int]) -> DataFrame:
    """Hours by stations, for presentation; readings of one station and hour are averaged."""
    return panel.groupBy("ts").pivot("station_id", stations).agg(F.avg("value")).select("ts", *(F.col(str(s)).alias(f"s{s}") for s in stations))


def bounds(features: DataFrame, names: list[str]) -> DataFrame:
    """Least, greatest, 1st and 99th percentile, median, spread and distinct values of each feature."""
    long = features.unpivot([], names, "feature", "x")
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    return long.groupBy("feature").agg(
        F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max"), q(0.01).alias("p01"), q(0.99).alias("p99"), q(0.5).alias("median"),
        F.round(F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25)), 6).alias("iqr"), F.round(F.stddev_samp("x") / F.nullif(F.avg("x"), F.lit(0.0)), 6).alias("cv"),
        F.count_distinct("x").alias("n_unique"), F.sum((F.col("x") == 0).cast("long")).alias("n_zero"),
    )
