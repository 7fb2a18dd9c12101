"""Cross-validation of five models over held-out groups of stations, and over held-out blocks of time too.

An hour's readings are one row, so hours are what tasks share out; what is known of stations (places, distances) is a small
dimension that goes to every task. All that a fold is fitted on is a sum over hours, made for every fold and block of
time in one pass: squared errors of each power, and squared differences of each pair of stations. A fold that may not see a block takes
the block's sums off. Powers and variograms then come from those sums. Trees of a fold are fitted in a task, on a
bounded number of hours; estimates of all models are made by hour.

Models: `regional_mean` (mean of the sources that report), `idw`, `kriging` (on values standardised by hour), `trees` and `trees+idw` (which
see the inverse-distance estimate too). Sources of a held-out station are those of other groups. A row of training is a
source seen from the other sources. Hours without a source of another group give no estimate. Null readings are no readings; readings of
stations that aren't listed don't count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.timefn import local
from ..session import ship
from . import trees
from .interpolation import POWERS, fit_variogram, krige_weights

MODELS = ("regional_mean", "idw", "kriging", "trees", "trees+idw")
#: Hours a kernel works on at a time; hours that trees are fitted on at most (those of smallest hash).
CHUNK, MOST_HOURS = 512, 50_000
#: Nugget, sill and range where a fold has no pair of stations.
NO_PAIRS = (0.2, 0.8, 15.0)


@dataclass
class Network:
    """Stations by ascending id, their groups, distances in km, and features of each (nan for null)."""

    ids: np.ndarray
    gid: np.ndarray
    at: np.ndarray
    features: np.ndarray
    km: np.ndarray = field(init=False)

    def __post_init__(self):
        a = np.radians(self.at)
        d = a[:, None] - a[None]
        h = np.sin(d[..., 0] / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(a[None, :, 0]) * np.sin(d[..., 1] / 2) ** 2
        self.km = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))

    @property
    def folds(self) -> list[int]:
        return sorted(set(self.gid.tolist()))

    def weights(self, power: float) -> np.ndarray:
        return np.maximum(self.km, 0.05) ** -power

    def dense(self, rows: pd.DataFrame) -> np.ndarray:
        """Hours by stations, nan where one doesn't report."""
        n = rows["ids"].str.len().to_numpy()
        ids, values = np.concatenate(rows["ids"].to_numpy()), np.concatenate(rows["vs"].to_numpy()).astype(float)
        k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[k] == ids
        v = np.full((len(rows), len(self.ids)), np.nan)
        v[np.repeat(np.arange(len(rows)), n)[known], k[known]] = values[known]
        return v


def network(stations: DataFrame, features: tuple[str, ...] = ()) -> Network:
    """The dimension of stations, held by the driver: thousands of rows at most."""
    rows = stations.select("station_id", "gid", "lat", "lon", *features).orderBy("station_id").collect()
    nan = lambda x: np.nan if x is None else float(x)
    return Network(np.array([r.station_id for r in rows]), np.array([r.gid for r in rows]), np.array([[r.lat, r.lon] for r in rows], float).reshape(-1, 2), np.array([[nan(r[f]) for f in features] for r in rows], float).reshape(len(rows), -1))


def hours(panel: DataFrame, block: Column | None = None) -> DataFrame:
    """A row for each hour: ts, block (the local month by default), local hour, weekday and month, ids and values of the stations that report."""
    t = local(F.col("ts"))
    rows = panel.where("value is not null").groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("station_id", "value"))).alias("obs"))
    get = lambda k: F.transform("obs", lambda o: o[k])
    return rows.select("ts", (F.date_format(t, "yyyy-MM") if block is None else block.cast("string")).alias("block"), F.hour(t).alias("hour"), F.weekday(t).alias("dow"), F.month(t).alias("month"), get("station_id").alias("ids"), get("value").alias("vs"))


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    for pdf in batches:
        for block, part in pdf.groupby("block", sort=False):
            for k in range(0, len(part), CHUNK):
                yield block, part.iloc[k : k + CHUNK]


def power_errors(rows: DataFrame, net: Network, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """(fold, block, power, n, squares): errors at the stations outside a fold, each seen from other groups outside the fold; fold null: from all groups."""
    ship(rows.sparkSession)
    folds = [net.gid == g for g in net.folds]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        other = (net.gid[:, None] != net.gid[None]).astype(float)
        weights = [net.weights(p) * other for p in powers]
        for block, part in _chunks(batches):
            v = net.dense(part)
            seen = np.isfinite(v)
            v, a = np.where(seen, v, 0.0), seen.astype(float)
            count = a @ other
            for p, w in zip(powers, weights, strict=True):
                n, d = v @ w, a @ w
                for g, out in [(None, np.zeros(len(net.ids), bool)), *zip(net.folds, folds, strict=True)]:
                    ok = seen & (count - a[:, out] @ other[out] > 0.5) & ~out
                    e = ((n - v[:, out] @ w[out])[ok] / (d - a[:, out] @ w[out])[ok]) - v[ok]
                    found[g, block, p] = found.get((g, block, p), 0) + np.array([len(e), e @ e])
        if found:
            keys = pd.DataFrame(list(found), columns=["fold", "block", "power"]).astype({"fold": "Int64"})
            yield keys.assign(n=[int(s[0]) for s in found.values()], squares=[float(s[1]) for s in found.values()])

    made = rows.select("block", "ids", "vs").mapInPandas(run, "fold long, block string, power double, n long, squares double")
    return made.groupBy("fold", "block", "power").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))


def pair_errors(rows: DataFrame, net: Network) -> DataFrame:
    """(fold, block, a, b, n, squares): squared differences of the stations outside a fold, on values in standard deviations of an hour's readings there.

    A deviation of at most 1e-6 counts as 1. Differences don't depend on the mean, so an hour's own is taken off first.
    """
    ship(rows.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, np.ndarray] = {}
        for block, part in _chunks(batches):
            v = net.dense(part)
            a = np.isfinite(v).astype(float)
            v = np.where(a > 0, v, 0.0)
            v = np.where(a > 0, v - v.sum(1, keepdims=True) / np.maximum(a.sum(1, keepdims=True), 1), 0.0)
            for g in net.folds:
                use = np.flatnonzero(net.gid != g)
                x, m = v[:, use], a[:, use]
                k = np.maximum(m.sum(1), 1)
                var = (x * x).sum(1) / k - (x.sum(1) / k) ** 2
                w = np.where(var > 1e-12, 1 / np.maximum(var, 1e-300), 1.0)[:, None]
                squares = (w * x * x).T @ m
                found[g, block] = found.get((g, block), 0) + np.stack([m.T @ m, squares + squares.T - 2 * (w * x).T @ x])
        for (g, block), (n, s) in found.items():
            use = np.flatnonzero(net.gid != g)
            i, j = np.triu_indices(len(use), 1)
            some = n[i, j] > 0
            yield pd.DataFrame({"fold": g, "block": block, "a": net.ids[use[i[some]]], "b": net.ids[use[j[some]]], "n": n[i, j][some].astype(int), "squares": s[i, j][some]})

    made = rows.select("block", "ids", "vs").mapInPandas(run, "fold long, block string, a long, b long, n long, squares double")
    return made.groupBy("fold", "block", "a", "b").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))


def _hidden(sums: DataFrame, held: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """The sums of all blocks but one, for each block of `held`, and of all (held '')."""
    names = F.explode(F.array(*[F.lit(h) for h in ["", *held]])).alias("held")
    sees = F.when(F.col("block") != F.col("held"), 1).otherwise(0)
    return sums.select("*", names).groupBy("held", *keys).agg(*[F.sum(F.col(v) * sees).alias(v) for v in values])


def by_error(errors: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(held, fold, power, rmse): errors of each power over all blocks (held ''), and without each of `held`."""
    sums = _hidden(errors, held or [], ["fold", "power"], ["n", "squares"]).where("n > 0")
    return sums.select("held", "fold", "power", F.round(F.sqrt(F.col("squares") / F.col("n")), 6).alias("rmse"))


def best_powers(errors: DataFrame, held: list[str] | None = None) -> DataFrame:
    """(held, fold, power, rmse): of least error, the lowest power at a tie."""
    return by_error(errors, held).groupBy("held", "fold").agg(F.min(F.struct("rmse", "power")).alias("m")).select("held", "fold", "m.power", "m.rmse")


def fold_clouds(pairs: DataFrame, stations: DataFrame, least: int = 100) -> DataFrame:
    """(fold, a, b, n, km, gamma): half the mean squared difference of each pair of a fold's sources with enough shared hours."""
    sums = pairs.groupBy("fold", "a", "b").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")).where(F.col("n") >= least)
    at = lambda k: stations.select(F.col("station_id").alias(k), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    km = haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb"))
    return sums.join(at("a"), "a").join(at("b"), "b").select("fold", "a", "b", "n", F.round(km, 6).alias("km"), F.round(F.col("squares") / F.col("n") / 2, 6).alias("gamma"))


def variograms(pairs: DataFrame, net: Network, held: list[str] | None = None, least: int = 100, bins: int = 15) -> dict[tuple[str, int], tuple[float, float, float]]:
    """(held, fold) -> nugget, sill and range, fitted to equal bins of distance of the pairs with enough hours. A pair's sums reach the driver, not readings."""
    sums = _hidden(pairs, held or [], ["fold", "a", "b"], ["n", "squares"]).where(F.col("n") >= least)
    at = {int(i): k for k, i in enumerate(net.ids)}
    found = {(h, g): NO_PAIRS for h in ["", *(held or [])] for g in net.folds}
    for (h, g), own in sums.toPandas().groupby(["held", "fold"]):
        km = np.round(net.km[own["a"].map(at), own["b"].map(at)], 6)
        gamma = np.round(own["squares"].to_numpy() / own["n"].to_numpy() / 2, 6)
        k = np.floor(km / (km.max() * 1.001 / bins)).astype(int) if km.max() > 0 else np.zeros(len(km), int)
        n = np.bincount(k)
        some = n > 0
        found[h, int(g)] = fit_variogram(np.bincount(k, km)[some] / n[some], np.bincount(k, gamma)[some] / n[some], n[some].astype(float))
    return found


def _design(v: np.ndarray, rows: pd.DataFrame, net: Network, targets: np.ndarray, sources: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hour, target) places of the readings that have a source, and their features; no station is its own source."""
    seen = np.isfinite(v)
    x, a = np.where(seen, v, 0.0)[:, sources], seen[:, sources].astype(float)
    apart = (sources[:, None] != targets[None]).astype(float)
    w = net.weights(power)[np.ix_(sources, targets)] * apart
    count = a @ apart
    h, t = np.nonzero(seen[:, targets] & (count > 0.5))
    mean, est = (x @ apart)[h, t] / count[h, t], (x @ w)[h, t] / (a @ w)[h, t]
    near = np.where(apart > 0, net.km[np.ix_(sources, targets)], np.inf).min(axis=0)
    times = rows[["hour", "dow", "month"]].to_numpy(float)[h]
    return h, targets[t], np.column_stack([net.features[targets[t]], near[t], times, mean, est])


def forests(rows: DataFrame, net: Network, powers: dict[tuple[str, int], float], shape: trees.Shape = trees.Shape(), most: int = MOST_HOURS) -> dict[tuple[str, int], tuple[trees.Boosted, trees.Boosted]]:
    """(held, fold) -> plain and hybrid trees, for each fold and held-out block of `powers`, a task each.

    Fitted on all hours, or on the `most` with the smallest hashes; without those of the held-out block.
    """
    ship(rows.sparkSession)
    jobs = rows.sparkSession.createDataFrame([(h, int(g)) for h, g in powers], "held string, fold long")
    sample = rows.orderBy(F.xxhash64("ts"), "ts").limit(most)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        held, g = pdf["held"].iloc[0], int(pdf["fold"].iloc[0])
        pdf = pdf.sort_values("ts", ignore_index=True)
        sources, v = np.flatnonzero(net.gid != g), net.dense(pdf)
        h, t, x = _design(v, pdf, net, sources, sources, powers[held, g])
        y = v[h, t]
        return pd.DataFrame({"held": [held], "fold": [g], "model": [pickle.dumps((trees.fit(x[:, :-1], y, shape), trees.fit(x, y, shape)))]})

    # a number of partitions of its own: by bytes, adaptive execution would put all fits into one task
    met = sample.crossJoin(F.broadcast(jobs)).where("block != held").repartition(len(powers), "held", "fold")
    found = met.groupBy("held", "fold").applyInPandas(grow, "held string, fold long, model binary")
    return {(r.held, r.fold): pickle.loads(r.model) for r in found.collect()}


def estimates(rows: DataFrame, net: Network, powers: dict[tuple[str, int], float], variogram: dict | None = None, grown: dict | None = None) -> DataFrame:
    """(held, model, station_id, g, ts, block, observed, estimate) of every reading with a source, by each fit of its group; a fit that held a block out estimates that block alone.

    Kriging and trees are made where their fits are given. Hours are dealt by the stations that report, so that kriging weights are solved once for each pattern in a task.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps((net, powers, variogram, grown)))
    dealt = rows.withColumn("pattern", F.array_join("ids", ","))
    if variogram is not None:
        dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "pattern", "ts").sortWithinPartitions("pattern", "ts")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, powers, variogram, grown = pickle.loads(shared.value)
        known: dict[tuple, np.ndarray] = {}
        last = None
        for block, part in _chunks(batches):
            v = net.dense(part)
            for held, g in powers:
                if held not in ("", block):
                    continue
                targets, sources = np.flatnonzero(net.gid == g), np.flatnonzero(net.gid != g)
                h, t, x = _design(v, part, net, targets, sources, powers[held, g])
                if not len(h):
                    continue
                found = {"regional_mean": x[:, -2], "idw": x[:, -1]}
                if variogram is not None:
                    found["kriging"] = np.full(len(h), np.nan)
                    patterns = part["pattern"].to_numpy()
                    for k in np.unique(h):
                        if patterns[k] != last:
                            last = patterns[k]
                            known.clear()
                        src = sources[np.isfinite(v[k, sources])]
                        if (held, g) not in known:
                            known[held, g] = krige_weights(net.at[src], net.at[targets], variogram[held, g])
                        here = h == k
                        level = v[k, src].mean()
                        w = known[held, g][np.searchsorted(targets, t[here])]
                        found["kriging"][here] = level + w @ (v[k, src] - level) if len(src) > 1 else level
                if grown is not None:
                    plain, hybrid = grown[held, g]
                    found |= {"trees": plain.predict(x[:, :-1]), "trees+idw": hybrid.predict(x)}
                one = pd.DataFrame({"station_id": net.ids[t], "g": g, "ts": part["ts"].to_numpy()[h], "block": block, "observed": v[h, t]})
                yield pd.concat([one.assign(held=held, model=name, estimate=e) for name, e in found.items()])[["held", "model", *one.columns, "estimate"]]

    return dealt.mapInPandas(run, "held string, model string, station_id long, g long, ts timestamp_ntz, block string, observed double, estimate double")


def station_scores(estimated: DataFrame, *keys: str) -> DataFrame:
    """Errors of each model by station (and keys): n, mae, rmse."""
    e = F.col("estimate") - F.col("observed")
    return estimated.groupBy("model", *keys, "station_id", "g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def comparison(scores: DataFrame) -> DataFrame:
    """A row for each model: errors pooled over stations by their hours, the worst and best station, hours, stations and folds."""
    n = F.col("n")
    return scores.groupBy("model").agg(
        F.round(F.sum(n * F.col("mae")) / F.sum(n), 6).alias("mae"), F.round(F.sqrt(F.sum(n * F.col("rmse") * F.col("rmse")) / F.sum(n)), 6).alias("rmse"), F.max("rmse").alias("worst"),
        F.min("rmse").alias("best"), F.sum(n).alias("hours"), F.count(F.lit(1)).alias("stations"), F.count_distinct("g").alias("folds"),
    )


def as_fits(powers: DataFrame) -> dict[tuple[str, int], float]:
    """The chosen powers of folds (a row each), without that of the production model."""
    return {(r.held, r.fold): r.power for r in powers.where("fold is not null").orderBy("held", "fold").collect()}


def sampled_blocks(rows: DataFrame, n: int, seed: int = 1) -> list[str]:
    """So many blocks, those with the smallest md5 of seed and name."""
    found = rows.select("block").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("block"))), "block").limit(n)
    return sorted(r.block for r in found.collect())


def time_block_scores(estimated: DataFrame, held: list[str], least: int = 24) -> DataFrame:
    """(scheme, block, model, g, station_id, n, rmse) on held-out blocks, for fits that saw them (spatial_only) and fits that didn't (spatial_time); stations with at least so many hours of one."""
    some = estimated.where(F.col("block").isin(held)).withColumn("scheme", F.when(F.col("held") == "", "spatial_only").otherwise("spatial_time"))
    return station_scores(some, "scheme", "block").where(F.col("n") >= least).drop("mae")
