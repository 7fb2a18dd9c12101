"""Checks of a finding: left-out units, blocks of time, alternative panels, weights, and power."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.indices import phase_hour, tidy
from ..functions.timefn import epoch_hour, local
from ..session import ship
from .interpolation import scores
from .profiles import pearson
from .resampling import multiplicities


def outages(panel: DataFrame, least_h: int = 48) -> DataFrame:
    """Stations with a gap of so many hours."""
    w = W.partitionBy("station_id").orderBy("ts")
    h = epoch_hour(F.col("ts"))
    gap = panel.withColumn("gap_h", h - F.lag(h).over(w) - 1)
    return gap.groupBy("station_id").agg(F.max("gap_h").alias("longest_gap_h")).where(F.col("longest_gap_h") >= least_h)


def half_of(days: DataFrame, rep: int, seed: int = 1) -> DataFrame:
    """Half of the days of a small table (day), by md5 rank."""
    rank = F.row_number().over(W.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit(rep), F.col("day").cast("string"))), "day"))
    return days.withColumn("rank", rank).withColumn("n", F.count(F.lit(1)).over(W.partitionBy())).where(F.col("rank") <= F.floor(F.col("n") / 2)).select("day")


def common_window(rows: DataFrame, key: str) -> DataFrame:
    """Rows from the latest first to the earliest last time of the series."""
    each = rows.groupBy(key).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = each.agg(F.max("a").alias("lo"), F.min("b").alias("hi"))
    return rows.crossJoin(F.broadcast(span)).where(F.col("ts").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def time_blocks(predicted: DataFrame, blocks: int = 4, least: int = 24) -> DataFrame:
    """Scores of each group in each block of days, for those with enough rows."""
    day = F.floor(epoch_hour(F.col("ts")) / 24)
    return scores(predicted.withColumn("block", F.pmod(day, F.lit(blocks)).cast("long")), "g", "block").where(F.col("n") >= least)


def variants(panel: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Mean and count under each of several row masks, in one pass."""
    parts = [F.struct(F.lit(k).alias("variant"), F.round(F.avg(F.when(c, F.col("value"))), 6).alias("mean"), F.count(F.when(c, 1)).alias("n")) for k, c in sorted(named.items())]
    return panel.agg(F.array(*parts).alias("v")).select(F.explode("v").alias("v")).select("v.*")


def without_groups(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Pearson correlation with each group left out, from the groups' sums."""
    X, Y = F.col(x), F.col(y)
    s = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(Y * Y).alias("syy"), F.sum(X * Y).alias("sxy"))
    rest = {c: F.sum(c).over(W.partitionBy()) - F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    r = s.select(group, *(e.alias(c) for c, e in rest.items()))
    den = F.sqrt(F.greatest((F.col("n") * F.col("sxx") - F.pow("sx", F.lit(2))) * (F.col("n") * F.col("syy") - F.pow("sy", F.lit(2))), F.lit(0.0)))
    return r.select(group, F.round((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(den, F.lit(0.0)), 6).alias("r"))


def day_block_bootstrap(panel: DataFrame, days: int = 7, n: int = 400, seed: int = 1) -> DataFrame:
    """Mean over resampled blocks of days: its 95 % interval."""
    block = F.floor(epoch_hour(F.col("ts")) / (24 * days)).cast("long")
    sums = panel.groupBy(block.alias("cluster")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("m"))
    means = multiplicities(sums.select(F.col("cluster").alias("id")), n, seed).join(sums, "cluster").groupBy("rep").agg(F.round(F.sum(F.col("s") * F.col("mult")) / F.sum(F.col("m") * F.col("mult")), 8).alias("mean"))
    return means.agg(F.round(F.percentile("mean", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("mean", F.lit(0.975)), 5).alias("hi"), F.count(F.lit(1)).alias("n"))


def reweighted(panel: DataFrame, part: Column) -> DataFrame:
    """Hourly profile of each station with each part of the record weighing the same."""
    by_part = panel.groupBy("station_id", F.hour(local(F.col("ts"))).alias("hour"), part.alias("part")).agg(F.avg("value").alias("m"))
    return by_part.groupBy("station_id", "hour").agg(tidy(F.avg("m")).alias("mean"), F.count(F.lit(1)).alias("parts"))


def conditional_difference(panel: DataFrame, one: Column, other: Column, least: int = 50) -> DataFrame:
    """Mean residual in one class less that in another over the station's deviation; residuals are from hourly means."""
    x = F.col("value") - F.avg("value").over(W.partitionBy("station_id", "hour"))
    r = panel.withColumn("hour", F.hour(local(F.col("ts")))).withColumns({"x": x, "one": one, "other": other})
    g = r.groupBy("station_id").agg(F.avg(F.when(F.col("one"), F.col("x"))).alias("a"), F.avg(F.when(F.col("other"), F.col("x"))).alias("b"), F.stddev_pop("value").alias("sd"), F.count(F.when(F.col("one"), 1)).alias("n_one"), F.count(F.when(F.col("other"), 1)).alias("n_other"))
    return g.where((F.col("n_one") >= least) & (F.col("n_other") >= least)).select("station_id", F.round((F.col("a") - F.col("b")) / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("effect"), "n_one", "n_other")


def share_below(rows: DataFrame, x: str, at: float) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(x) < at).cast("double")), 6).alias("share"), F.count(F.lit(1)).alias("n"))


def incomplete_harmonics(profile: DataFrame) -> DataFrame:
    """24 and 12 hour waves of profiles with missing hours, by least squares; a row a station with six hours or more.

    The five normal equations are sums over a station's hours, solved in expressions.
    """
    t = F.col("hour") * (2 * np.pi / 24)
    terms = [F.lit(1.0), F.cos(t), F.sin(t), F.cos(2 * t), F.sin(2 * t)]
    rows = profile.select("station_id", "mean", *[x.alias(f"t{k}") for k, x in enumerate(terms)])
    sums = {f"a{i}_{j}": F.col(f"t{i}") * F.col(f"t{j}") for i in range(5) for j in range(i, 5)} | {f"b{i}": F.col(f"t{i}") * F.col("mean") for i in range(5)}
    g = rows.groupBy("station_id").agg(F.count(F.lit(1)).alias("hours"), *[F.sum(x).alias(k) for k, x in sums.items()]).where("hours >= 6")
    out = linear.solved(g, 5)
    return out.select("station_id", F.round(F.hypot("xb1", "xb2"), 6).alias("amp1"), F.round(F.hypot("xb3", "xb4"), 6).alias("amp2"), F.round(phase_hour(F.col("xb1"), F.col("xb2")), 5).alias("phase"))


def _critical_rank_r(n: int, alpha: float = 0.05) -> float:
    """The least |rho| of n units that is significant by Student's distribution, two-sided."""
    theta = np.linspace(0, np.pi / 2, 200_001)
    mass = np.concatenate([[0], np.cumsum((np.cos(theta[1:]) ** (n - 3) + np.cos(theta[:-1]) ** (n - 3)) / 2)])
    return float(np.sin(np.interp((1 - alpha) * mass[-1], mass, theta)))  # rho = sin(theta) where t / sqrt(n - 2) = tan(theta)


def correlation_power(units: DataFrame, rhos: tuple[float, ...], trials: int = 3000, seed: int = 1) -> DataFrame:
    """(rho, units, power, trials): share of simulated samples of as many normal pairs as there are units whose Spearman correlation is significant at 5 %, for each true correlation.

    Each trial has a seed of its own and trials spread over tasks.
    """
    spark, n = units.sparkSession, units.count()
    ship(spark)
    if n < 4:
        return spark.createDataFrame([], "rho double, units long, power double, trials long")
    least = _critical_rank_r(n)

    def run(batches):
        for b in batches:
            hit = []
            for rho, i in zip(b["rho"], b["trial"], strict=True):
                rng = np.random.default_rng([seed, int(round(rho * 1e6)) % (1 << 32), int(i)])
                x, e = rng.normal(size=n), rng.normal(size=n)
                rx, ry = x.argsort().argsort(), (rho * x + np.sqrt(1 - rho * rho) * e).argsort().argsort()
                hit.append(abs(np.corrcoef(rx, ry)[0, 1]) >= least)
            yield pd.DataFrame({"rho": b["rho"], "hit": np.array(hit, float)})

    grid = spark.range(trials).select(F.col("id").alias("trial"), F.explode(F.array(*[F.lit(float(r)) for r in rhos])).alias("rho"))
    return grid.select("rho", "trial").mapInPandas(run, "rho double, hit double").groupBy("rho").agg(F.lit(n).cast("long").alias("units"), F.round(F.avg("hit"), 6).alias("power"), F.count(F.lit(1)).alias("trials"))


def split_half_phase(panel: DataFrame) -> DataFrame:
    """Agreement of stations' daily phase between odd and even days: mean resultant of the differences, median gap."""
    from .profiles import harmonics

    def phases(parity: int) -> DataFrame:
        part = panel.where(F.pmod(F.dayofyear(local(F.col("ts"))), F.lit(2)) == parity)
        prof = part.groupBy("station_id", F.hour(local(F.col("ts"))).alias("hour")).agg(F.avg("value").alias("mean"))
        return harmonics(prof).select("station_id", F.col("phase").alias(f"p{parity}"))

    d = (F.col("p0") - F.col("p1")) * (2 * np.pi / 24)
    both = phases(0).join(phases(1), "station_id")
    gap = F.abs(F.pmod(F.col("p0") - F.col("p1") + 12, F.lit(24.0)) - 12)
    return both.agg(F.round(F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d))), 4).alias("agreement"), F.round(F.percentile(gap, F.lit(0.5)), 3).alias("median_gap_h"), F.count(F.lit(1)).alias("n"))
