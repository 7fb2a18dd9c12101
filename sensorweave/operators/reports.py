"""Summaries of days, pools of scores, tests by resampling and the tables that reports are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import phase_hour
from . import resampling
from .profiles import average_rank, pearson

#: Hours of the morning and the evening, first and last.
MORNING, EVENING = (6, 10), (18, 22)


def waves(profile: DataFrame, *keys: str) -> DataFrame:
    """Coefficients a1, b1, a2, b2 of the 24 and 12 hour waves of complete profiles, least and greatest mean, balance of the normalised shape."""
    m, h, w = F.col("mean"), F.col("hour"), W.partitionBy(*keys)
    part = lambda f, k: F.sum(m * f(h * (2 * math.pi * k / 24))) / 12
    sd = F.stddev_pop("mean").over(w)
    shaped = profile.withColumn("z", (m - F.avg("mean").over(w)) / F.when(sd > 1e-9, sd).otherwise(1.0))
    during = lambda span: F.avg(F.when(h.between(*span), F.col("z")))
    each = [part(f, k).alias(f"{n}{k}") for k in (1, 2) for n, f in (("a", F.cos), ("b", F.sin))]
    return shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("hours"), *each, F.max(m).alias("top"), F.min(m).alias("low"), (during(MORNING) - during(EVENING)).alias("balance")).where("hours = 24")


def five_summaries(profile: DataFrame, *keys: str) -> DataFrame:
    """Morning less evening of the shape, phase of the 24 hour wave and its opposite, absolute swing, 12 hour amplitude over the 24 hour one."""
    amp = lambda k: F.hypot(f"a{k}", f"b{k}")
    peak = phase_hour(F.col("a1"), F.col("b1"))
    return waves(profile, *keys).select(
        *keys, F.round("balance", 6).alias("balance"), F.round(peak, 5).alias("peak"), F.round(F.pmod(peak + 12, F.lit(24.0)), 5).alias("trough"),
        F.round(F.col("top") - F.col("low"), 6).alias("swing"), F.round(amp(2) / F.nullif(amp(1), F.lit(0.0)), 6).alias("bimodality"),
    )


def trough_of_two_waves(profile: DataFrame, *keys: str) -> DataFrame:
    """Clock time, to 0.01 h, at which the sum of both waves is least; the first of equal ones."""
    grid = waves(profile, *keys).select(*keys, "a1", "b1", "a2", "b2", F.explode(F.sequence(F.lit(0), F.lit(2399))).alias("k")).withColumn("t", F.col("k") / 100.0)
    y = sum(F.col(f"a{k}") * F.cos(F.col("t") * (2 * math.pi * k / 24)) + F.col(f"b{k}") * F.sin(F.col("t") * (2 * math.pi * k / 24)) for k in (1, 2))
    return grid.groupBy(*keys).agg(F.min(F.struct(F.round(y, 9).alias("y"), "t"))["t"].alias("trough"))


def circular_circular(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two clock times: sines of their deviations from their circular means."""
    angle = lambda c: F.col(c) * (2 * math.pi / 24)
    mean = lambda c: F.atan2(F.avg(F.sin(angle(c))), F.avg(F.cos(angle(c))))
    centre = rows.agg(mean(x).alias("mx"), mean(y).alias("my"))
    s = rows.crossJoin(F.broadcast(centre)).select(F.sin(angle(x) - F.col("mx")).alias("p"), F.sin(angle(y) - F.col("my")).alias("q"))
    return s.agg(F.round(F.sum(F.col("p") * F.col("q")) / F.nullif(F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q"))), F.lit(0.0)), 6).alias("r"), F.count(F.lit(1)).alias("n"))


def of_own_mean(profile: DataFrame) -> DataFrame:
    """Each profile in per cent of its mean."""
    return profile.select("station_id", "hour", F.round(100 * F.col("mean") / F.nullif(F.avg("mean").over(W.partitionBy("station_id")), F.lit(0.0)), 6).alias("pct"))


def swing(profile: DataFrame, *keys: str) -> DataFrame:
    """Largest less least mean, also in per cent of the mean where that is positive."""
    d, m = F.max("mean") - F.min("mean"), F.avg("mean")
    return profile.groupBy(*keys).agg(F.round(d, 6).alias("swing"), F.round(100 * d / F.when(m > 0, m), 6).alias("swing_pct"))


def pooled(scores: DataFrame, *keys: str) -> DataFrame:
    """Scores of stations (n, mae, rmse) pooled by their hours, with the worst and the best."""
    n = F.col("n")
    return scores.groupBy(*keys).agg(
        F.round(F.sum(n * F.col("mae")) / F.sum(n), 6).alias("mae"), F.round(F.sqrt(F.sum(n * F.col("rmse") * F.col("rmse")) / F.sum(n)), 6).alias("rmse"),
        F.max("rmse").alias("worst"), F.min("rmse").alias("best"), F.sum(n).alias("hours"),
    )


def pooled_similarity(z: DataFrame, unit: str = "station_id", window: str = "win", x: str = "z", weight: str | None = None) -> DataFrame:
    """1 less the semivariance of each pair of units, pooled over the windows they share; units are a dimension."""
    side = lambda k: z.select(F.col(unit).alias(k), window, F.col(x).alias(f"x{k}"), *([F.col(weight).alias(f"w{k}")] if weight else []))
    w, d = F.col("wa") if weight else F.lit(1.0), F.col("xa") - F.col("xb")
    return side("a").join(side("b"), window).where("a < b").groupBy("a", "b").agg(F.round(1 - F.sum(w * 0.5 * d * d) / F.sum(w), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


def near_minus_far(pairs: DataFrame, near: float, far: float, x: str = "corr", *keys: str) -> DataFrame:
    """Mean over near pairs less mean over far ones."""
    some = lambda c: F.avg(F.when(c, F.col(x)))
    return pairs.groupBy(*keys).agg((some(F.col("km") < near) - some(F.col("km") >= far)).alias("gap"))


def mantel_near_far(sim: DataFrame, dist: DataFrame, near: float, far: float, n: int, seed: int = 1) -> DataFrame:
    """The gap between near and far pairs and the share of permutations of units over places that reach it."""
    ids = dist.select(F.col("a").alias("id")).union(dist.select("b")).distinct()
    moves = resampling.permutations(ids, n, seed).unionByName(ids.select(F.lit(0).cast("long").alias("rep"), "id", F.col("id").alias("to")))
    both = dist.select("a", "b", "km").union(dist.select("b", "a", "km"))
    to = lambda k: moves.select("rep", F.col("id").alias(k), F.col("to").alias(f"t{k}"))
    moved = sim.select("a", "b", "corr").join(to("a"), "a").join(to("b"), ["rep", "b"]).join(both.toDF("ta", "tb", "km"), ["ta", "tb"])
    gaps = near_minus_far(moved, near, far, "corr", "rep").withColumn("gap", F.round("gap", 9))
    own = gaps.where("rep = 0").select(F.col("gap").alias("own"))
    return gaps.crossJoin(F.broadcast(own)).agg(F.round(F.max("own"), 6).alias("gap"), F.round((F.sum(((F.col("rep") > 0) & (F.col("gap") >= F.col("own"))).cast("long")) + 1) / (n + 1.0), 6).alias("p"))


def permuted_spearman(rows: DataFrame, key: str, x: str, y: str, n: int, seed: int = 1) -> DataFrame:
    """Rank correlation of two columns of a table of units with its two-sided p by permutations of the second."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("id"), average_rank(F.col(x)).alias("rx"), average_rank(F.col(y)).alias("ry"))
    ids = own.select("id")
    moves = resampling.permutations(ids, n, seed).unionByName(ids.select(F.lit(0).cast("long").alias("rep"), "id", F.col("id").alias("to")))
    r = moves.join(own.select("id", "rx"), "id").join(own.select(F.col("id").alias("to"), "ry"), "to").groupBy("rep").agg(F.round(pearson(F.col("rx"), F.col("ry")), 9).alias("r"), F.count(F.lit(1)).alias("n"))
    seen = r.where("rep = 0").select(F.col("r").alias("own"))
    hits = F.sum(((F.col("rep") > 0) & (F.abs("r") >= F.abs("own"))).cast("long"))
    return r.crossJoin(F.broadcast(seen)).agg(F.round(F.max("own"), 6).alias("rho"), F.round((hits + 1) / (n + 1.0), 6).alias("p"), F.max("n").alias("n"))


def paired_cluster_bootstrap(sums: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Interval of the difference of two means over the same draws of clusters; sums: cluster, and n and s of each of two sets (na, sa, nb, sb)."""
    draws = resampling.multiplicities(sums.select(F.col("cluster").alias("id")), n, seed)
    of = lambda k, m: F.sum(F.col(f"s{k}") * m) / F.nullif(F.sum(F.col(f"n{k}") * m), F.lit(0))
    d = draws.join(sums, "cluster").groupBy("rep").agg(F.round(of("a", F.col("mult")) - of("b", F.col("mult")), 9).alias("d"))
    point = sums.agg(F.round(of("a", F.lit(1)) - of("b", F.lit(1)), 6).alias("point"))
    q = lambda p: F.when(F.count("d") >= 10, F.round(F.percentile("d", F.lit(p)), 6))
    return d.agg(q(0.025).alias("lo"), q(0.975).alias("hi"), F.count("d").alias("draws")).crossJoin(point)


def calendar_windows(rows: DataFrame, ts: Column, value: str, *keys: str) -> DataFrame:
    """Means by calendar month, with the month's nominal hours and end."""
    start = F.date_trunc("month", ts)
    hours = F.dayofmonth(F.last_day(ts)) * 24
    out = rows.groupBy(*keys, start.cast("timestamp_ntz").alias("start_ts"), hours.alias("nominal_hours")).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("end_ts", F.expr("start_ts + make_dt_interval(0, nominal_hours)"))


def counts_per_window(means: DataFrame) -> DataFrame:
    """Windows, and the median of stations and of readings in one."""
    each = means.groupBy("win").agg(F.count(F.lit(1)).alias("stations"), F.sum("n").alias("readings"))
    return each.agg(F.count(F.lit(1)).alias("windows"), F.median("stations").alias("median_stations"), F.median("readings").alias("median_readings"))


def correlated(features: DataFrame, key: str, names: list[str], least: float = 0.8) -> DataFrame:
    """Pairs of features whose correlation is at least `least`, by size; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = features.agg(*(pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], one.columns, "pair", "r").where(F.abs("r") >= least)
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), F.round("r", 6).alias("r"))


def greedy_deletion(rows: DataFrame, key: str, x: str, y: str, steps: int) -> DataFrame:
    """(step, removed, r): again and again the row goes without which the correlation is least. Each step is one job over sums and rows."""
    spark, left, out = rows.sparkSession, rows.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), []
    gone: list = []
    for step in range(1, steps + 1):
        now = left.where(~F.col("k").isin(gone)) if gone else left
        r = resampling.without_each(now, "x", "y", "k")
        best = r.orderBy(F.asc_nulls_last("r"), "k").first()
        gone.append(best["k"])
        out.append((step, best["k"], best["r"]))
    return spark.createDataFrame(out, "step int, removed long, r double")


def ring(points: Column) -> Column:
    """An array of (x, y) as a closed ring, counter-clockwise; null where fewer than four points."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), points).otherwise(F.concat(points, F.array(first)))
    n = F.size(closed)
    turn = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + (F.element_at(closed, i + 1)["x"] - F.element_at(closed, i)["x"]) * (F.element_at(closed, i + 1)["y"] + F.element_at(closed, i)["y"]))
    return F.when(F.size(points) >= 4, F.when(turn > 0, F.reverse(closed)).otherwise(closed))


def edge_distance(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Distance to the nearest edge of a box; a nearest feature is certain only within it."""
    return F.least(x - box[0], F.lit(box[2]) - x, y - box[1], F.lit(box[3]) - y)


def cell_polygon(i: Column, j: Column, box: tuple[float, float, float, float], n: int) -> Column:
    """Corners of a grid's cell, counter-clockwise from the lower left, as text."""
    lat, lon = (box[3] - box[1]) / n, (box[2] - box[0]) / n
    at = lambda a, b: F.format_string("%.4f %.4f", F.lit(box[0]) + (j + b) * lon, F.lit(box[1]) + (i + a) * lat)
    return F.concat_ws(", ", at(0, 0), at(0, 1), at(1, 1), at(1, 0))


def cleared(mask: DataFrame, occupied: DataFrame) -> DataFrame:
    """A mask (i, j, flags) without flags where a station stands."""
    return mask.join(occupied.select("i", "j").distinct().withColumn("here", F.lit(True)), ["i", "j"], "left").select("i", "j", F.when(F.col("here"), 0).otherwise(F.col("flags")).cast("int").alias("flags"))


def reason_totals(mask: DataFrame, names: list[str]) -> DataFrame:
    """How many rows each bit of `flags` marks."""
    bit = lambda k: F.sum((F.shiftright("flags", k).bitwiseAND(1)).cast("long"))
    one = mask.agg(*(bit(k).alias(x) for k, x in enumerate(names)))
    return one.unpivot([], names, "feature", "n")


def card(scores: DataFrame, power: DataFrame) -> DataFrame:
    """One row that describes a model: its power and pooled scores, also as JSON."""
    both = pooled(scores).crossJoin(F.broadcast(power))
    return both.select("power", "mae", "rmse", "hours").withColumn("card", F.to_json(F.struct(F.lit("idw").alias("model"), "power", "hours")))

