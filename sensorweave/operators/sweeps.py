"""Daily profiles of many windows and masks of hours in one plan, and how their likeness falls with distance."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.indices import phase_hour, wrap12
from ..functions.timefn import local
from ..session import ship
from .crossval import Network
from .profiles import pearson
from .resampling import _draw


def running_sums(panel: DataFrame, *parts: Column) -> DataFrame:
    """(station_id, hour, parts, day, s, n): sums and counts of a station's local hour from the first day of the panel to each day, on every day.

    Any window of days is then the difference of two rows.
    """
    t = local(F.col("ts"))
    keys = ["station_id", "hour", *[f"part{k}" for k in range(len(parts))]]
    daily = panel.where("value is not null").select("station_id", F.hour(t).alias("hour"), *[p.alias(f"part{k}") for k, p in enumerate(parts)], F.to_date(t).alias("day"), "value")
    daily = daily.groupBy(*keys, "day").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = daily.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    full = every.join(daily, [*keys, "day"], "left")
    upto = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return full.select(*keys, "day", F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))


def window_profiles(sums: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, the keys of the sums, mean, n) of windows (win, lo, hi) of local days, hi not included."""
    keys = [c for c in sums.columns if c not in ("day", "s", "n")]
    last = sums.agg(F.max("day").alias("last"))
    bounds = windows.crossJoin(F.broadcast(last)).select("win", F.least(F.date_sub("hi", 1), "last").alias("day"), F.least(F.date_sub("lo", 1), "last").alias("before"))
    # windows are a handful of rows beside the sums
    ends = sums.join(F.broadcast(bounds), "day").select("win", *keys, "s", "n")
    starts = sums.join(F.broadcast(bounds.drop("day")), F.col("day") == F.col("before")).select("win", *keys, F.col("s").alias("s0"), F.col("n").alias("n0"))
    d = ends.join(starts, ["win", *keys], "left").select("win", *keys, (F.col("s") - F.coalesce("s0", F.lit(0.0))).alias("s"), (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"))
    return d.where("n > 0").select("win", *keys, F.round(F.col("s") / F.col("n"), 6).alias("mean"), "n")


def mask_profiles(panel: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """(win, station_id, hour, mean, n) of named masks of hours, in one pass; a mask is a condition on ts."""
    names = sorted(masks)
    g = panel.where("value is not null").groupBy("station_id", F.hour(local(F.col("ts"))).alias("hour"))
    g = g.agg(*[f(F.when(masks[k], F.col("value"))).alias(f"{x}{i}") for i, k in enumerate(names) for x, f in (("m", F.avg), ("n", F.count))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("win"), F.round(f"m{i}", 6).alias("mean"), F.col(f"n{i}").alias("n")) for i, k in enumerate(names)]))
    return g.select("station_id", "hour", each.alias("e")).select("e.win", "station_id", "hour", "e.mean", "e.n").where("n > 0")


def complete(profiles: DataFrame, least: int = 15) -> DataFrame:
    """Profiles of all 24 hours, in windows with so many of them at least; partial ones are another statistic."""
    full = profiles.select("*", F.count(F.lit(1)).over(W.partitionBy("win", "station_id")).alias("hours")).where("hours = 24")
    ids = full.groupBy("win").agg(F.count_distinct("station_id").alias("stations")).where(F.col("stations") >= least)
    return full.join(ids, "win").drop("hours")


def _ranks(seed: int, rep: int, ids: list) -> np.ndarray:
    """A random order of ids: places sorted by md5 of seed, number and id, as SQL would."""
    return np.array(sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"{seed}:{rep}:{ids[k]}".encode()).hexdigest(), ids[k])))


def shape_mantel(profiles: DataFrame, net: Network, n: int = 2000, seed: int = 1, least: int = 15, chunk: int = 250) -> DataFrame:
    """(win, readings, stations, r, n_pairs, p): correlation of likeness (Pearson's of two profiles) with distance over pairs of stations of different groups.

    Stations are permuted among those with a complete profile in the window; a pair of one group, or with a flat profile, has no likeness.
    A task takes a window's profiles (a dimension of stations) and a chunk of permutations, so windows and permutations spread over tasks.
    """
    ship(profiles.sparkSession)
    full = complete(profiles, least).select("win", "station_id", "hour", "mean", "n").persist()
    chunks = full.sparkSession.range((n + chunk) // chunk).select(F.col("id").alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        win, first = pdf["win"].iloc[0], int(pdf["chunk"].iloc[0]) * chunk
        wide = pdf.pivot(index="station_id", columns="hour", values="mean").sort_index()
        ids, x = wide.index.to_list(), wide.to_numpy(float)
        x = x - x.mean(1, keepdims=True)
        size = np.sqrt((x * x).mean(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.round((x @ x.T) / 24 / (size[:, None] * size[None]), 6)
        at = np.searchsorted(net.ids, ids)
        km, kept = net.km[np.ix_(at, at)], (net.gid[at][:, None] != net.gid[at][None]) & np.isfinite(sim)
        a, b = np.triu_indices(len(ids), 1)
        out = []
        for rep in range(first, min(first + chunk, n + 1)):
            to = np.arange(len(ids)) if rep == 0 else _ranks(seed, rep, ids)
            some = kept[to[a], to[b]]
            y, d = sim[to[a], to[b]][some], km[a, b][some]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = ((y * d).mean() - y.mean() * d.mean()) / (y.std() * d.std()) if len(y) else np.nan
            out.append((win, rep, round(float(r), 9) if np.isfinite(r) else None, int(some.sum())))
        return pd.DataFrame(out, columns=["win", "rep", "r", "n"])

    spread = full.crossJoin(F.broadcast(chunks)).repartition(max(8, (n + chunk) // chunk), "win", "chunk")
    r = spread.groupBy("win", "chunk").applyInPandas(run, "win string, rep long, r double, n long")
    own = F.max(F.when(F.col("rep") == 0, F.col("r"))).over(W.partitionBy("win"))
    out = r.withColumn("own", own).groupBy("win").agg(F.max("own").alias("r"), F.max(F.when(F.col("rep") == 0, F.col("n"))).alias("n_pairs"), F.sum(((F.col("rep") > 0) & (F.abs("r") >= F.abs("own"))).cast("long")).alias("k"))
    seen = full.groupBy("win").agg(F.sum("n").alias("readings"), F.count_distinct("station_id").alias("stations"))
    return seen.join(out, "win").select("win", "readings", "stations", F.round("r", 6).alias("r"), "n_pairs", F.round((F.col("k") + 1) / (n + 1.0), 6).alias("p"))


def phase_reliability(profiles: DataFrame, weak: float = 1.5, least: int = 15) -> DataFrame:
    """(win, n, r, median_gap, weak): agreement of the phases of the 24-hour wave in two parts (part0: 0 or 1) of each window.

    r is the correlation of two clock times (sines of the deviations from their circular means); weak counts stations whose mean amplitude is below `weak`.
    """
    wave = lambda f: F.sum(F.col("mean") * f(F.col("hour") * (2 * math.pi / 24))) / 12
    ab = profiles.groupBy("win", "station_id", "part0").agg(F.count(F.lit(1)).alias("hours"), wave(F.cos).alias("a"), wave(F.sin).alias("b")).where("hours = 24")
    side = lambda k: ab.where(F.col("part0") == k).select("win", "station_id", F.round(phase_hour(F.col("a"), F.col("b")), 5).alias(f"p{k}"), F.round(F.hypot("a", "b"), 6).alias(f"amp{k}"))
    both = side(0).join(side(1), ["win", "station_id"])
    w = W.partitionBy("win")
    angle = lambda c: F.col(c) * (2 * math.pi / 24)
    centred = lambda c: F.sin(angle(c) - F.atan2(F.avg(F.sin(angle(c))).over(w), F.avg(F.cos(angle(c))).over(w)))
    both = both.withColumns({"u": centred("p0"), "v": centred("p1"), "gap": F.abs(wrap12(F.col("p0") - F.col("p1")))})
    r = F.sum(F.col("u") * F.col("v")) / F.nullif(F.sqrt(F.sum(F.col("u") * F.col("u")) * F.sum(F.col("v") * F.col("v"))), F.lit(0.0))
    out = both.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.round(r, 6).alias("r"), F.round(F.percentile("gap", F.lit(0.5)), 5).alias("median_gap"), F.sum(((F.col("amp0") + F.col("amp1")) / 2 < weak).cast("long")).alias("weak"))
    return out.where(F.col("n") >= least)


def eligible_pairs(windows: DataFrame, gap: int, most: int = 50_000, seed: int = 1) -> DataFrame:
    """(i, j): windows (win, lo, hi) of which j begins `gap` seconds after i ends or later; lo and hi are seconds, hi not included.

    Windows are sorted by start, so the partners of one are a range of numbers and pairs have numbers too. Up to `most` pairs are
    all taken; of more, one is drawn from each of `most` equal strata of these numbers, by md5. So work grows with windows
    and pairs taken, never with the square of windows.
    """
    order = W.orderBy("lo", "win")
    numbered = windows.select("win", "lo", "hi", F.row_number().over(order).alias("k"))
    # how many windows begin before each one's earliest partner: starts and such times in one order
    marks = numbered.select(F.col("lo").alias("t"), F.lit(1).alias("start"), F.lit(None).cast("int").alias("k")).union(numbered.select((F.col("hi") + gap).alias("t"), F.lit(0).alias("start"), "k"))
    before = F.sum("start").over(W.orderBy("t", "start").rowsBetween(W.unboundedPreceding, 0))
    first = marks.select("k", before.alias("before")).where("k is not null")
    total = F.count(F.lit(1)).over(W.partitionBy())
    ranged = numbered.join(first, "k").select("win", "k", F.greatest("before", "k").alias("before"), total.alias("windows")).withColumn("partners", F.col("windows") - F.col("before")).where("partners > 0")
    ends = ranged.select("win", "before", (F.sum("partners").over(W.orderBy("k")) - F.col("partners")).alias("from"), "partners")
    all_ = ends.agg(F.sum("partners").alias("pairs"))
    spark = windows.sparkSession
    unit = F.conv(F.substring(_draw(F.lit(seed), F.col("id")), 1, 8), 16, 10).cast("double") / 2.0**32
    picks = spark.range(most).crossJoin(F.broadcast(all_)).where("id < pairs")
    picks = picks.select(F.when(F.col("pairs") <= most, F.col("id")).otherwise(F.floor((F.col("id") + unit) * F.col("pairs") / most)).alias("at"))
    marks = ends.select(F.col("from").alias("at"), F.lit(0).alias("kind"), "win", "before", "from").unionByName(picks.select("at", F.lit(1).alias("kind")), allowMissingColumns=True)
    back = W.orderBy("at", "kind", F.col("from")).rowsBetween(W.unboundedPreceding, 0)
    owner = lambda c: F.last(c, ignorenulls=True).over(back).alias(c)
    found = marks.select("at", "kind", owner("win"), owner("before"), owner("from")).where("kind = 1")
    return found.select(F.col("win").alias("i"), (F.col("before") + F.col("at") - F.col("from") + 1).alias("k")).join(numbered.select("k", F.col("win").alias("j")), "k").select("i", "j")


def pattern_pairs(patterns: DataFrame, pairs: DataFrame, least: int = 10) -> DataFrame:
    """(i, j, r, n): Pearson correlation over groups of two windows' patterns (win, g, x), with so many groups in common."""
    a, b = patterns.where("x is not null").select(F.col("win").alias("i"), "g", "x"), patterns.where("x is not null").select(F.col("win").alias("j"), "g", F.col("x").alias("y"))
    out = pairs.join(a, "i").join(b, ["j", "g"]).groupBy("i", "j").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("r").isNotNull()).select("i", "j", F.round("r", 6).alias("r"), "n")


def pair_summary(correlations: DataFrame) -> DataFrame:
    """Mean and median correlation and number of pairs."""
    return correlations.agg(F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"), F.count(F.lit(1)).alias("pairs"))
