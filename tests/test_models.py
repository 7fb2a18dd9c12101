"""Folds, error bars, regressions and p values against plain computations."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.functions import linear, stats
from sensorweave.functions.geo import haversine_km
from sensorweave.functions.timefn import local
from sensorweave.operators import crossval, interpolation, regression, spatial, sweeps, trees

T0 = dt.datetime(2024, 1, 1)


def places(spark, gids):
    rows = [(i, g, 19.0 + 0.03 * (i * i % 7), 72.8 + 0.02 * (i * 3 % 5)) for i, g in enumerate(gids, 1)]
    return spark.createDataFrame(rows, "station_id long, gid long, lat double, lon double")


def readings(spark, stations, hours, drop=lambda s, h: False, scale=lambda s: 1.0):
    draw = np.random.default_rng(5)
    rows = [(s, T0 + dt.timedelta(hours=h), float(v) * scale(s)) for h in range(hours) for s, v in zip(range(1, stations + 1), draw.gamma(4, 12, stations), strict=True) if not drop(s, h)]
    return spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, value double")


def test_cloud_of_each_fold(spark):
    gids = [1, 1, 2, 3, 4]
    st, p = places(spark, gids), readings(spark, 5, 40, lambda s, h: (s * 7 + h) % 6 == 0)
    got = {(r.fold, r.a, r.b): (r.n, r.gamma) for r in crossval.fold_clouds(crossval.pair_errors(crossval.hours(p), crossval.network(st)), st, 5).collect()}
    at = {}
    for r in p.collect():
        at.setdefault(r.ts, {})[r.station_id] = r.value
    want = {}
    for fold in set(gids):
        src = [i for i, g in enumerate(gids, 1) if g != fold]
        for a, b in combinations(src, 2):
            squares = []
            for seen in at.values():
                if a in seen and b in seen:
                    sd = float(np.std([seen[i] for i in src if i in seen]))
                    squares.append(((seen[a] - seen[b]) / (sd if sd > 1e-6 else 1)) ** 2)
            if len(squares) >= 5:
                want[fold, a, b] = (len(squares), np.mean(squares) / 2)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def _variograms(spark, st, p):
    net = crossval.network(st)
    return crossval.variograms(crossval.pair_errors(crossval.hours(p), net), net, least=5)


def test_fold_variograms_see_no_held_out_reading(spark):
    st = places(spark, [1, 2, 3, 4, 5])
    fits = [_variograms(spark, st, readings(spark, 5, 30, scale=lambda s: k if s == 3 else 1.0))["", 3] for k in (1.0, 9.0)]  # noqa: B023
    assert fits[0] == fits[1]
    assert set(_variograms(spark, st, readings(spark, 5, 3)).values()) == {crossval.NO_PAIRS}


def _by_hand(panel, st, powers, fold=None):
    """Squared errors of each power over stations outside the fold, each from other groups outside it."""
    at = {r.station_id: r for r in st.collect()}
    km = lambda a, b: 2 * 6371 * np.arcsin(np.sqrt(np.sin(np.radians(b.lat - a.lat) / 2) ** 2 + np.cos(np.radians(a.lat)) * np.cos(np.radians(b.lat)) * np.sin(np.radians(b.lon - a.lon) / 2) ** 2))
    seen, out = {}, {p: [] for p in powers}
    for r in panel.collect():
        seen.setdefault(r.ts, {})[r.station_id] = r.value
    for hour in seen.values():
        for t, v in hour.items():
            src = [s for s in hour if at[s].gid not in (at[t].gid, fold)]
            if at[t].gid != fold and src:
                for p in powers:
                    w = [max(km(at[s], at[t]), 0.05) ** -p for s in src]
                    out[p].append((sum(a * hour[s] for a, s in zip(w, src, strict=True)) / sum(w) - v) ** 2)
    return {p: np.sqrt(np.mean(x)) for p, x in out.items() if x}


def test_powers_of_folds_and_without_a_block(spark):
    st, p = places(spark, [1, 1, 2, 3, 4]), readings(spark, 5, 40, lambda s, h: (s * 7 + h) % 5 == 0)
    block = F.when(F.col("ts") < F.lit(T0 + dt.timedelta(hours=20)), "a").otherwise("b")
    errors = crossval.power_errors(crossval.hours(p, block), crossval.network(st), (0.5, 2.0))
    got = {(r.held, r.fold, r.power): r.rmse for r in crossval.by_error(errors, ["b"]).collect()}
    for held, part in (("", p), ("b", p.where(block == "a"))):
        for fold in (None, 1, 2, 3, 4):
            for power, want in _by_hand(part, st, (0.5, 2.0), fold).items():
                assert got[held, fold, power] == pytest.approx(want, abs=2e-6)
    best = {(r.held, r.fold): r.power for r in crossval.best_powers(errors, ["b"]).collect()}
    assert all(got[h, g, p] == min(got[h, g, x] for x in (0.5, 2.0)) for (h, g), p in best.items()) and len(best) == 10


SMALL = trees.Shape(rounds=5, least=2, leaves=4)


def test_estimates_see_no_held_out_reading(spark):
    st, runs = places(spark, [0, 1, 2, 2]), []
    for k in (1.0, 9.0):
        rows, net = crossval.hours(readings(spark, 4, 24, scale=lambda s: k if s == 2 else 1.0)), crossval.network(st)  # noqa: B023
        powers = {("", g): 0.5 for g in net.folds}
        out = crossval.estimates(rows, net, powers, _variograms(spark, st, readings(spark, 4, 24)), crossval.forests(rows, net, powers, SMALL))
        own = out.where("station_id = 2").select("model", "ts", F.round("estimate", 9)).collect()
        assert {r.model for r in own} == set(crossval.MODELS) and len(own) == 5 * 24
        runs.append(sorted(own))
    assert runs[0] == runs[1]
    scored = crossval.station_scores(out)
    assert crossval.comparison(scored).count() == 5 and crossval.comparison(scored).where("hours != 96 or stations != 4 or folds != 3").count() == 0


def test_a_held_out_block_is_not_seen(spark):
    st, runs = places(spark, [0, 1, 2, 3]), []
    net = crossval.network(st)
    for k in (1.0, 5.0):
        p = readings(spark, 4, 48).withColumn("value", F.when(F.col("ts") >= F.lit(T0 + dt.timedelta(hours=24)), F.col("value") * k).otherwise(F.col("value")))
        rows = crossval.hours(p, F.to_date("ts"))
        powers = {(h, g): 0.5 for h in ("", "2024-01-02") for g in net.folds}
        grown = crossval.forests(rows, net, powers, SMALL)
        x = np.array([[1.0, h, 0, 1, 40.0] for h in range(24)])
        runs.append([grown["2024-01-02", g][0].predict(x).tolist() for g in net.folds])
        out = crossval.estimates(rows, net, powers, None, grown)
        assert {r.block for r in out.where("held != ''").select("block").distinct().collect()} == {"2024-01-02"}
    assert runs[0] == runs[1]
    scored = crossval.time_block_scores(out, ["2024-01-02"])
    assert {r.scheme for r in scored.select("scheme").distinct().collect()} == {"spatial_only", "spatial_time"} and scored.where("n != 24").count() == 0


def test_trees_split_where_the_error_is_least():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 400), rng.normal(size=400), np.where(rng.random(400) < 0.2, np.nan, rng.normal(size=400))]).astype(float)
    y = 3 * x[:, 0] + np.where(np.isnan(x[:, 2]), 9.0, 0.0) + rng.normal(size=400)
    one = trees.fit(x, y, trees.Shape(rounds=1, rate=1.0, leaves=2, least=5, ridge=0.0))
    best = min(sum(((y[m] - y[m].mean()) ** 2).sum() for m in (low, ~low)) for f in range(3) for e in [*one.edges[f], np.inf] for low in [x[:, f] <= e] if 5 <= low.sum() <= 395)
    assert ((y - one.predict(x)) ** 2).sum() == pytest.approx(best)
    many = trees.fit(x, y, trees.Shape(rounds=60, least=10))
    assert np.std(y - many.predict(x)) < 0.4 * np.std(y) and len(many.trees) == 60
    assert trees.fit(x[:0], y[:0]).predict(x[:3]).tolist() == [0, 0, 0]
    assert trees.fit(x[:10], y[:10]).predict(x[:2]) == pytest.approx([y[:10].mean()] * 2)


def test_small_systems_solved_in_expressions(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(9, 5))
    a, b = m.T @ m, rng.normal(size=5)
    row = spark.createDataFrame([tuple(float(a[i, j]) for i in range(5) for j in range(i, 5)) + tuple(map(float, b))], [f"a{i}_{j}" for i in range(5) for j in range(i, 5)] + [f"b{i}" for i in range(5)])
    got = linear.solved(row, 5).first()
    np.testing.assert_allclose([got[f"xb{i}"] for i in range(5)], np.linalg.solve(a, b), rtol=1e-9)


def test_skill_of_six_features_equals_refits(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 6))
    y = x @ [1, 0.5, 0, 0, 0, 0] + rng.normal(size=30)
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(30)] + [(99, None, *[0.0] * 6)], ["id", "y", *names])
    z, e, base = np.column_stack([np.ones(30), x]), [], []
    for i in range(30):
        k = np.arange(30) != i
        e.append(y[i] - z[i] @ np.linalg.lstsq(z[k], y[k], rcond=None)[0])
        base.append(y[i] - y[k].mean())
    got = regression.held_out_skill_of(df, "id", "y", names, 200).first()
    assert got.r2 == pytest.approx(1 - np.dot(e, e) / np.dot(base, base), abs=2e-6) and got.units == 30 and 0 < got.p < 0.2


def test_window_profiles_are_differences_of_sums(spark):
    p = readings(spark, 3, 24 * 12, lambda s, h: (s * 5 + h) % 7 == 0)
    named = [("w1", "2024-01-02", "2024-01-06"), ("w2", "2023-12-01", "2024-03-01"), ("w3", "2024-01-05", "2024-01-06"), ("none", "2025-01-01", "2025-02-01")]
    windows = spark.createDataFrame(named, "win string, lo string, hi string").select("win", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    got = {(r.win, r.station_id, r.hour): (r.mean, r.n) for r in sweeps.window_profiles(sweeps.running_sums(p), windows).collect()}
    t = local(F.col("ts"))
    for w, lo, hi in named:
        want = p.where((F.to_date(t) >= lo) & (F.to_date(t) < hi)).groupBy("station_id", F.hour(t).alias("hour")).agg(F.avg("value").alias("m"), F.count("value").alias("n")).collect()
        assert {k[1:] for k in got if k[0] == w} == {(r.station_id, r.hour) for r in want}
        assert all(got[w, r.station_id, r.hour] == (pytest.approx(r.m, abs=1e-6), r.n) for r in want)


def test_pairs_of_windows_all_or_one_a_stratum(spark):
    rng = np.random.default_rng(1)
    lo = np.sort(rng.integers(0, 400, 60))
    rows = [(k, int(a), int(a + rng.integers(1, 30))) for k, a in enumerate(lo)]
    df = spark.createDataFrame(rows, "win long, lo long, hi long")
    every = {(i, j) for i, a, b in rows for j, c, _ in rows if c >= b + 20 and (c, j) > (a, i)}
    assert {(r.i, r.j) for r in sweeps.eligible_pairs(df, 20).collect()} == every
    some = [(r.i, r.j) for r in sweeps.eligible_pairs(df, 20, 100).collect()]
    assert len(some) == len(set(some)) == 100 and set(some) <= every
    assert sweeps.eligible_pairs(df, 10_000).collect() == []


def test_error_bars(spark):
    rows = [(i, float(i), float(i) + (-1) ** i * (2 + 0.1 * (10 * (i // 10)))) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, idw double, observed double")
    x, e = np.array([r[1] for r in rows]), np.array([r[2] - r[1] for r in rows])
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 11)))
    at = np.clip(np.digitize(x, edges[1:-1]), 0, len(edges) - 2)
    m, r, n = (np.array([f(at == b) for b in range(10)]) for f in (lambda i: x[i].mean(), lambda i: np.sqrt((e[i] ** 2).mean()), lambda i: i.sum()))
    w = np.sqrt(n)
    a, b = np.linalg.lstsq(np.column_stack([w, w * m]), w * r, rcond=None)[0]
    got = interpolation.error_bars(df, 10, 5).first()
    assert (got.a, got.b, got.floor) == (pytest.approx(a, abs=1e-5), pytest.approx(b, abs=1e-5), pytest.approx(r.min(), abs=1e-5))
    level = interpolation.error_bars(df.withColumn("idw", F.lit(3.0)), 10, 5).first()
    assert level.a is None and level.b is None and level.rmse is not None
    assert interpolation.error_bars(df.limit(0), 10, 5).first().asDict() == {"a": None, "b": None, "floor": None, "rmse": None}


def test_skill_with_copies(spark):
    draw = np.random.default_rng(2)
    x, w = draw.normal(size=(9, 2)), np.array([1, 2, 1, 3, 1, 1, 2, 1, 1])
    y = x @ [1.0, -2.0] + draw.normal(size=9)
    sse = base = 0.0
    for i in range(9):
        left = np.array([j for j in range(9) if j != i for _ in range(w[j])])
        fit = np.linalg.lstsq(np.column_stack([np.ones(len(left)), x[left]]), y[left], rcond=None)[0]
        sse += w[i] * (y[i] - fit @ [1, *x[i]]) ** 2
        base += w[i] * (y[i] - y[left].mean()) ** 2
    rows = [(1, float(w[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(9)] + [(2, 1.0, float(i), 2.0 * i, 1.0 * i * i) for i in range(5)]
    got = regression.copies_skill(spark.createDataFrame(rows, "rep long, w double, x1 double, x2 double, y double"), "rep").collect()
    assert [(r.rep, r.r2) for r in got] == [(1, pytest.approx(1 - sse / base, abs=1e-8))]


def test_slopes(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(12, 2))
    y = 1 + x @ [2.0, -0.5] + draw.normal(size=12)
    full = np.column_stack([np.ones(12), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    se = np.sqrt(np.diag(((y - full @ beta) ** 2).sum() / 9 * np.linalg.inv(full.T @ full)))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "p double, q double, y double")
    got = {r.term: (r.beta, r.se, r.t) for r in regression.slopes(df, "y", "p", "q").collect()}
    assert got == {n: (pytest.approx(beta[k], abs=1e-6), pytest.approx(se[k], abs=1e-6), pytest.approx(beta[k] / se[k], abs=1e-5)) for k, n in ((1, "p"), (2, "q"))}
    assert [r.beta for r in regression.slopes(df, "y", "p", "p").collect()] == [None, None]


def test_p_values(spark):
    z = [0.0, 0.3, 1.959964, -4.2, 15.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(math.erfc(abs(v) / math.sqrt(2)), abs=1e-12) for v in z]
    critical = [(12.706205, 1), (4.302653, 2), (3.182446, 3), (2.776445, 4), (-2.228139, 10), (2.024394, 38), (2.026192, 37)]
    got = spark.createDataFrame(critical, "t double, df long").select(stats.student_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in got] == [pytest.approx(0.05, abs=1e-6)] * len(critical)


def test_rank_tests(spark):
    d = lambda *v: spark.createDataFrame([(float(x),) for x in v], "d double")
    assert tuple(regression.signed_rank_test(d(1, 2, 3, 4, 5, 0), "d").first()) == (15.0, 5, 0.0625)
    assert tuple(regression.signed_rank_test(d(0, 0), "d").first())[1:] == (0, None)
    signs = [-3, 1, 2, -5, 4, 6]
    low = min(sum(abs(x) for x in signs if x > 0), sum(abs(x) for x in signs if x < 0))
    ways = sum(sum(k for k in range(1, 7) if m >> (k - 1) & 1) <= low for m in range(64))
    assert regression.signed_rank_test(d(*signs), "d").first().p == pytest.approx(min(1, 2 * ways / 64), abs=1e-6)
    tied = regression.signed_rank_test(d(1, 1, 2, -3, 4), "d").first()
    sd = math.sqrt((5 * 6 * 11 - (8 - 2) / 2) / 24)
    assert tied.p == pytest.approx(math.erfc((7.5 - 4) / sd / math.sqrt(2)), abs=1e-6)
    two = spark.createDataFrame([(float(v), v % 2 == 0) for v in (1, 2, 3, 5, 7, 8, 8, 9)], "x double, e boolean")
    got = regression.rank_sum_test(two, "x", F.col("e")).first()
    sd = math.sqrt(3 * 5 / 12 * (9 - 6 / 56))
    ranks = {1: 1, 2: 2, 3: 3, 5: 4, 7: 5, 8: 6.5, 9: 8}
    u = ranks[2] + 2 * ranks[8] - 6
    assert (got.u, got.n1, got.n2) == (u, 3, 5) and got.p == pytest.approx(math.erfc((max(u, 15 - u) - 8) / sd / math.sqrt(2)), abs=1e-6)
    line = spark.createDataFrame([(float(k), float(k * k)) for k in range(5)], "x double, y double")
    assert tuple(regression.rank_correlation_test(line, "x", "y").first()) == (1.0, 5, 0.0)


def test_distance_of_pairs_is_the_great_circle(spark):
    one = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km")).first().km
    assert one == pytest.approx(math.pi * 6371 / 180)


def test_features_of_points(spark):
    xy = lambda *rows: spark.createDataFrame(rows, "x double, y double")
    q = spark.createDataFrame([(1, 50.0, 50.0), (2, 130.0, 50.0), (3, None, 5.0)], "id long, x double, y double")
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    edges = spark.createDataFrame([(k, 0, *a, *b) for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))], "id long, k long, x1 double, y1 double, x2 double, y2 double")
    roads = xy((50.0, 650.0), (130.0, 350.0), (130.0, 1000.0))
    out = spatial.features_for(q, xy((130.0, 54.0)), roads, xy().limit(0), edges, xy((0.0, 0.0), (0.0, 0.0)))
    got = {r.id: r for r in out.collect()}
    assert [got[i].dist_industrial_m for i in (1, 2, 3)] == [0.0, pytest.approx(30.4, abs=0.05), None]
    assert got[1].dist_major_road_m == pytest.approx(80.1) and got[2].dist_major_road_m == 4.0
    assert got[1].dist_coast_m is None and got[1].building_density_500m == pytest.approx(2 / (math.pi / 4), abs=0.06)
    assert got[2].road_density_500m == round(0.01 / (math.pi / 4), 2) and got[2].road_density_1km == round(0.03 / math.pi, 2)
