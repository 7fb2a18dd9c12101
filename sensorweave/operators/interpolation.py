"""Leave-one-group-out interpolation: inverse distance, variogram, kriging, error bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, idw_weight
from ..session import ship

#: Powers that cross-validation chooses among.
POWERS = (0.1, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0)


def pairs(stations: DataFrame) -> DataFrame:
    """(target, source, g, sg, km) of stations in different groups: a small dimension."""
    t = stations.select(F.col("station_id").alias("station_id"), F.col("gid").alias("g"), "lat", "lon")
    s = stations.select(F.col("station_id").alias("source"), F.col("gid").alias("sg"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return t.crossJoin(s).where("g != sg").select("station_id", "g", "source", "sg", haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("km"))


def _met(panel: DataFrame, stations: DataFrame, weights: dict[str, float], most: int = 1_000_000) -> DataFrame:
    """Readings beside each target they may estimate (weights by name) and beside their own (sg null, no weight), dealt by hour.

    The readings are shuffled once, by hour; sums by hour, target and group need no further shuffle. The number of
    partitions is set, as each row becomes one a target and sizes before that would merge them. The pairs of stations
    are broadcast up to `most`; beyond that the join is left to the planner.
    """
    own = stations.select("station_id", F.col("gid").alias("g"), F.col("station_id").alias("source"), F.lit(None).cast("long").alias("sg"), F.lit(None).cast("double").alias("km"))
    p = pairs(stations).unionByName(own)
    p = p.select("station_id", "g", "source", "sg", *(F.when(F.col("km").isNotNull(), idw_weight(F.col("km"), x)).alias(k) for k, x in weights.items()))
    src = panel.where("value is not null").select(F.col("station_id").alias("source"), "ts", "value")
    src = src.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ts")
    return src.join(F.broadcast(p) if stations.count() ** 2 <= most else p, "source")


def _own() -> Column:
    return F.max(F.when(F.col("sg").isNull(), F.col("value")))


def held_out(panel: DataFrame, stations: DataFrame, power: float = 0.5) -> DataFrame:
    """(station_id, g, ts, observed, idw, city): each reading, one a station and hour, estimated from the other groups' readings of its hour."""
    v, w = F.col("value"), F.col("w")
    sums = _met(panel, stations, {"w": power}).groupBy("ts", "station_id", "g").agg(
        _own().alias("observed"), F.sum(w * v).alias("n"), F.sum(w).alias("d"), F.avg(F.when(F.col("sg").isNotNull(), v)).alias("city")
    )
    return sums.where("observed is not null and city is not null").select("station_id", "g", "ts", "observed", (F.col("n") / F.col("d")).alias("idw"), "city")


def scores(predicted: DataFrame, *keys: str) -> DataFrame:
    e, c = F.col("idw") - F.col("observed"), F.col("city") - F.col("observed")
    rms = lambda x: F.sqrt(F.avg(x * x))
    return predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae_idw"), F.round(rms(e), 6).alias("rmse_idw"),
        F.round(F.avg(F.abs(c)), 6).alias("mae_city"), F.round(rms(c), 6).alias("rmse_city"), F.round(rms(e) - rms(c), 6).alias("gap"),
    )


def skill_summary(predicted: DataFrame) -> DataFrame:
    """Pooled errors of the estimate and of the mean, the gap in per cent of the mean's, and how many groups the estimate wins."""
    overall = scores(predicted).select("n", "rmse_idw", "rmse_city", F.round(100 * (F.col("rmse_idw") - F.col("rmse_city")) / F.nullif(F.col("rmse_city"), F.lit(0.0)), 4).alias("gap_pct"))
    won = scores(predicted, "g").agg(F.sum((F.col("gap") < 0).cast("long")).alias("groups_won"), F.count(F.lit(1)).alias("groups"))
    return overall.crossJoin(F.broadcast(won))


def cloud(panel: DataFrame, stations: DataFrame, least: int = 100) -> DataFrame:
    """Half the mean squared difference of each pair of stations over hours both report."""
    side = lambda k: panel.select("ts", F.col("station_id").alias(k), F.col("value").alias(f"v{k}"))
    d = F.col("va") - F.col("vb")
    g = side("a").join(side("b"), "ts").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.avg(d * d) / 2).alias("gamma")).where(F.col("n") >= least)
    at = lambda k: stations.select(F.col("station_id").alias(k), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    g = g.join(F.broadcast(at("a")), "a").join(F.broadcast(at("b")), "b")
    return g.select("a", "b", "n", F.round(haversine_km(F.col("lata"), F.col("lona"), F.col("latb"), F.col("lonb")), 6).alias("km"), F.round("gamma", 6).alias("gamma"))


def cloud_bins(pairs_: DataFrame, bins: int = 15) -> DataFrame:
    """Equal bins of distance: mean distance, mean semivariance, pairs."""
    far = pairs_.agg((F.max("km") * 1.001 / bins).alias("width"))
    b = F.floor(F.col("km") / F.col("width")).cast("long")
    return pairs_.crossJoin(F.broadcast(far)).groupBy(b.alias("bin")).agg(F.round(F.avg("km"), 6).alias("km"), F.round(F.avg("gamma"), 6).alias("gamma"), F.count(F.lit(1)).alias("n"))


def fit_variogram(km: np.ndarray, gamma: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Nugget in [0, 3], sill in [0.001, 10] and range in [1, 300] of least weighted squares; separable: for a range the rest is linear."""

    def best(reach: float) -> tuple[float, float, float]:
        f = 1 - np.exp(-3 * km / reach)
        top = None
        sw, sf, sff = n.sum(), (n * f).sum(), (n * f * f).sum()
        sy, sfy = (n * gamma).sum(), (n * f * gamma).sum()
        det = sw * sff - sf * sf
        tries = [((sff * sy - sf * sfy) / det, (sw * sfy - sf * sy) / det)] if det > 1e-12 else []
        tries += [(c, (sfy - c * sf) / max(sff, 1e-12)) for c in (0.0, 3.0)] + [((sy - s * sf) / sw, s) for s in (1e-3, 10.0)]
        for c, s in tries:
            c, s = min(max(c, 0.0), 3.0), min(max(s, 1e-3), 10.0)
            e = (n * (c + s * f - gamma) ** 2).sum()
            if top is None or e < top[0]:
                top = (e, c, s)
        return top

    grid = np.geomspace(1, 300, 120)
    for _ in range(4):
        at = min(range(len(grid)), key=lambda i: best(grid[i])[0])
        grid = np.geomspace(grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)], 40)
    reach = min(grid, key=lambda r: best(r)[0])
    _, c, s = best(reach)
    return float(c), float(s), float(reach)


def krige_weights(known: np.ndarray, target: np.ndarray, model: tuple[float, float, float]) -> np.ndarray:
    """Ordinary kriging weights of targets (rows) from known points (columns), both lat and lon."""
    nugget, sill, reach = model

    def gamma(a, b):
        d = np.radians(a[:, None] - b[None])
        h = np.sin(d[..., 0] / 2) ** 2 + np.cos(np.radians(a[:, None, 0])) * np.cos(np.radians(b[None, :, 0])) * np.sin(d[..., 1] / 2) ** 2
        km = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        return np.where(km > 0, nugget + sill * (1 - np.exp(-3 * km / reach)), 0.0)

    k = len(known)
    left, right = np.ones((k + 1, k + 1)), np.ones((k + 1, len(target)))
    left[:k, :k], left[k, k], right[:k] = gamma(known, known), 0.0, gamma(known, target)
    try:
        out = np.linalg.solve(left, right)
    except np.linalg.LinAlgError:
        out = np.linalg.lstsq(left, right, rcond=None)[0]
    return out[:k].T


def kriged(panel: DataFrame, stations: DataFrame, model: tuple[float, float, float] | dict[int, tuple[float, float, float]]) -> DataFrame:
    """(station_id, g, ts, observed, idw, city) like held_out, `idw` being the kriged estimate, by one model or each held-out group's own.

    Weights depend on which stations report. Hours are dealt in ranges of that pattern and time, so a task solves
    each of its patterns once and a frequent pattern is split over tasks. Values are taken off the sources' mean
    of the hour; a single source gives that mean. As weights sum to 1, dividing by the hour's deviation first and multiplying after would change nothing.
    """
    ship(panel.sparkSession)
    place = {r.station_id: (r.lat, r.lon, r.gid) for r in stations.select("station_id", "lat", "lon", "gid").toLocalIterator()}
    hours = panel.where("value is not null").groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("station_id", "value"))).alias("obs"))
    hours = hours.select("ts", F.transform("obs", lambda o: o.station_id).alias("ids"), F.transform("obs", lambda o: o.value).alias("vs"))
    hours = hours.withColumn("pattern", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))
    dealt = hours.repartitionByRange(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pattern", "ts").sortWithinPartitions("pattern", "ts")

    def solve(batches):
        seen, folds, ids = None, [], None
        for pdf in batches:
            for pattern, rows in pdf.groupby("pattern", sort=False):
                if pattern != seen:
                    ids = [int(i) for i in pattern.split(",")]
                    at, gid = np.array([place[i][:2] for i in ids]), np.array([place[i][2] for i in ids])
                    seen, folds = pattern, []
                    for g in sorted(set(gid.tolist())):
                        src, tgt = np.flatnonzero(gid != g), np.flatnonzero(gid == g)
                        if len(src):
                            folds.append((g, src, tgt, krige_weights(at[src], at[tgt], model[g] if isinstance(model, dict) else model)))
                v, ids = np.stack(rows["vs"].to_numpy()).astype(float), np.array(ids)
                for g, src, tgt, w in folds:
                    city = v[:, src].mean(1, keepdims=True)
                    est = city + (v[:, src] - city) @ w.T if len(src) > 1 else np.repeat(city, len(tgt), 1)
                    k = len(tgt)
                    yield pd.DataFrame({"station_id": np.tile(ids[tgt], len(rows)), "g": g, "ts": np.repeat(rows["ts"].to_numpy(), k), "observed": v[:, tgt].ravel(), "idw": est.ravel(), "city": np.repeat(city.ravel(), k)})

    return dealt.mapInPandas(solve, "station_id long, g long, ts timestamp_ntz, observed double, idw double, city double")


def _errors_by_level(predicted: DataFrame, bins: int, least: int) -> DataFrame:
    """Quantile bins of the estimate, equal edges once, of at least so many rows: mean, RMSE and count of each."""
    edges = predicted.agg(F.array_distinct(F.percentile("idw", F.lit([k / bins for k in range(bins + 1)]))).alias("edges"))
    k = F.greatest(F.lit(0), F.least(F.size("edges") - 2, F.size(F.filter("edges", lambda e: e <= F.col("idw"))) - 1))
    e = F.col("idw") - F.col("observed")
    out = predicted.crossJoin(F.broadcast(edges)).groupBy(k.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("idw").alias("mean"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.where(F.col("n") >= least)


def calibration(predicted: DataFrame, bins: int = 20, least: int = 50) -> DataFrame:
    """Quantile bins of the estimate: mean, RMSE and count of each."""
    return _errors_by_level(predicted, bins, least).select("bin", "n", F.round("mean", 5).alias("mean"), F.round("rmse", 5).alias("rmse"))


def error_bars(predicted: DataFrame, bins: int = 20, least: int = 50) -> DataFrame:
    """(a, b, floor, rmse): the error of an estimate is max(floor, a + b * estimate), a line through the bins' errors weighted by rows.

    The floor is the least error of a bin, rmse that of all rows. Bins at one level give no line (a and b null), no bin nulls.
    """
    n, x, y = F.col("n"), F.col("mean"), F.col("rmse")
    sums = _errors_by_level(predicted, bins, least).agg(F.sum(n).alias("w"), F.sum(n * x).alias("wx"), F.sum(n * y).alias("wy"), F.min(y).alias("floor"), F.sum(n * x * x).alias("wxx"), F.sum(n * x * y).alias("wxy"))
    b = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    e = F.col("idw") - F.col("observed")
    return sums.crossJoin(predicted.agg(F.sqrt(F.avg(e * e)).alias("all"))).select(F.round((F.col("wy") - b * F.col("wx")) / F.col("w"), 5).alias("a"), F.round(b, 5).alias("b"), F.round("floor", 5).alias("floor"), F.round("all", 5).alias("rmse"))
