"""Windows of time: tumbling, calendar and sliding, coverage rules, episodes, variance between stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import tidy
from ..functions.timefn import epoch_hour, local, season
from .profiles import pearson


def tumbling(panel: DataFrame, hours: int) -> DataFrame:
    """Mean and count by station and window of so many hours from the record's first local midnight."""
    first = panel.agg(F.date_trunc("day", local(F.min("ts"))).cast("timestamp_ntz").alias("origin"))
    k = F.floor((F.unix_timestamp(local(F.col("ts")).cast("timestamp")) - F.unix_timestamp(F.col("origin").cast("timestamp"))) / (3600 * hours))
    out = panel.crossJoin(F.broadcast(first)).groupBy("station_id", k.cast("long").alias("win"))
    return out.agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def covered(means: DataFrame, hours: int, coverage: float, stations: int) -> DataFrame:
    """Windows with enough of their hours at a station, and enough such stations."""
    enough = means.where(F.col("n") >= F.ceil(F.lit(coverage * hours - 1e-9)))
    return enough.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("win"))).where(F.col("k") >= stations).drop("k")


def seasons(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return rows.groupBy(key, season(F.col(ts)).alias("season")).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def city(panel: DataFrame, least: int = 10) -> DataFrame:
    """Mean over stations of hours that enough of them report."""
    return panel.groupBy("ts").agg(tidy(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def rolling(series: DataFrame, hours: int = 24) -> DataFrame:
    """Mean of the hours up to and with each one; partitioned by day blocks so that no task holds the series.

    Every reading goes to its own block and the next, and each block reports its own hours only.
    """
    h = epoch_hour(F.col("ts"))
    block = F.floor(h / hours)
    both = series.withColumn("eh", h).withColumn("block", F.explode(F.array(block, block + 1)))
    w = W.partitionBy("block").orderBy("eh").rangeBetween(-(hours - 1), 0)
    return both.withColumn("rolling", tidy(F.avg("mean").over(w))).where(F.floor(F.col("eh") / hours) == F.col("block")).select("ts", "rolling")


def episodes(hours: DataFrame, bridge_h: int = 6) -> DataFrame:
    """Sessions of qualifying hours (ts): a new one after a gap of more than bridge_h hours."""
    s = hours.groupBy(F.session_window(F.col("ts").cast("timestamp"), f"{bridge_h} hours").alias("w")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_hours"))
    return s.select("start_ts", "end_ts", "n_hours")


def top_hours(series: DataFrame, per_cent: float) -> DataFrame:
    """Hours at or over the (100 - per_cent)th percentile."""
    edge = series.agg(F.percentile("mean", F.lit(1 - per_cent / 100)).alias("edge"))
    return series.crossJoin(F.broadcast(edge)).where(F.col("mean") >= F.col("edge")).select("ts", "mean")


def spatial_share(means: DataFrame) -> DataFrame:
    """Variance between stations over windows: variance of station means over that of all values, and intraclass correlation with unequal counts."""
    w = means.withColumn("x", F.col("mean") - F.avg("mean").over(W.partitionBy("win")))
    g = w.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    t = g.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.var_pop("m").alias("vm"))
    ssb, ssw = F.col("b") - F.col("s") * F.col("s") / F.col("t"), F.col("ss") - F.col("b")
    msb, msw = ssb / (F.col("k") - 1), ssw / F.nullif(F.col("t") - F.col("k"), F.lit(0))
    n0 = (F.col("t") - F.col("nn") / F.col("t")) / (F.col("k") - 1)
    out = t.where("k > 1").select(F.col("k").alias("stations"), F.round(F.col("vm") / F.nullif((F.col("ss") - F.col("s") * F.col("s") / F.col("t")) / F.col("t"), F.lit(0.0)), 6).alias("share"), F.round((msb - msw) / F.nullif(msb + (n0 - 1) * msw, F.lit(0.0)), 6).alias("icc"))
    return out


def split_half(means: DataFrame) -> DataFrame:
    """Correlation over stations of their mean anomalies in odd and in even windows, with its Spearman-Brown step."""
    x = F.col("mean") - F.avg("mean").over(W.partitionBy("win"))
    half = means.withColumn("x", x).groupBy("station_id").agg(F.avg(F.when(F.col("win") % 2 == 0, F.col("x"))).alias("even"), F.avg(F.when(F.col("win") % 2 != 0, F.col("x"))).alias("odd"))
    r = half.where("even is not null and odd is not null").agg(pearson(F.col("even"), F.col("odd")).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.select("n", F.round("r", 6).alias("r"), F.round(2 * F.col("r") / F.nullif(1 + F.col("r"), F.lit(0.0)), 6).alias("reliability"))


def window_pairs(means: DataFrame, gap: int, least: int = 10) -> DataFrame:
    """Correlation over stations of each two windows at least `gap` windows apart."""
    x = means.withColumn("x", F.col("mean") - F.avg("mean").over(W.partitionBy("win")))
    a, b = x.select("station_id", F.col("win").alias("a"), "x"), x.select("station_id", F.col("win").alias("b"), F.col("x").alias("y"))
    g = a.join(b, "station_id").where(F.col("a") + gap <= F.col("b")).groupBy("a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).select("a", "b", F.round("r", 6).alias("r"), "n")


def sliding(rows: DataFrame, days: int, step: int, value: str = "value", ts: str = "ts") -> DataFrame:
    """Mean and count of overlapping windows."""
    w = F.window(F.col(ts).cast("timestamp"), f"{days} days", f"{step} days")
    return rows.groupBy(w.alias("w")).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "mean", "n")
