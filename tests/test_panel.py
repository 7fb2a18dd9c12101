"""Known answers by construction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorweave.functions import geo, indices, timefn
from sensorweave.operators import cleaning, interpolation, profiles, resampling, spatial, windows

T0 = dt.datetime(2024, 1, 1)


def panel(spark, series, start=T0):
    rows = [(s, start + dt.timedelta(hours=h), float(v)) for s, vs in series.items() for h, v in (vs.items() if isinstance(vs, dict) else enumerate(vs)) if v is not None]
    return spark.createDataFrame(rows, "station_id long, ts timestamp_ntz, value double")


def test_run_lengths(spark):
    one = cleaning.runs(panel(spark, {1: [12.5] * 4 + [63, 63, 7]})).orderBy("ts")
    assert [r.run_len for r in one.collect()] == [4, 4, 4, 4, 2, 2, 1]
    gap = cleaning.runs(panel(spark, {1: {0: 9, 1: 9, 2: 9, 60: 9, 61: 9}}))
    assert sorted(r.run_len for r in gap.collect()) == [2, 2, 3, 3, 3]
    assert cleaning.stuck(panel(spark, {1: [7] * 24, 2: [7] * 23})).select("station_id").distinct().collect()[0][0] == 1


def test_lone_spikes(spark):
    hit = lambda *v: [r.value for r in cleaning.lone_spikes(panel(spark, {i: [x] for i, x in enumerate(v)})).collect()]
    assert hit(212, 31, 18, 44, 27) == [212.0]
    assert hit(212, 131, 118, 144, 127) == [] and hit(212) == []


def test_sudden_spikes(spark):
    base = [33 + i * i % 6 for i in range(150)]
    one, plume = list(base), list(base)
    one[77] = 260
    plume[70:77] = [255 + k for k in range(7)]
    assert cleaning.sudden_spikes(panel(spark, {1: one})).count() == 1
    assert cleaning.sudden_spikes(panel(spark, {1: plume})).count() == 0


def test_shared_maxima_matched_and_reasons(spark):
    assert [r.value for r in cleaning.shared_maxima(panel(spark, {1: [500], 2: [500], 3: [500], 4: [80]})).collect()] == [500.0]
    assert cleaning.shared_maxima(panel(spark, {1: [500], 2: [500], 4: [80]})).count() == 0
    a, b = panel(spark, {1: [1, 2, 3], 2: [1, None, 3]}), panel(spark, {1: [1, 2, None], 2: [1, 2, 3]})
    assert cleaning.matched(a, b).count() == 4
    raw = spark.createDataFrame([(True, 5.0), (False, None), (False, 0.0), (False, 1000.0), (False, 1000.1)], "flagged boolean, value double")
    assert {r.reason: r.n for r in cleaning.reason_counts(raw).collect()} == {"flagged": 1, "null": 1, "range": 2, "kept": 1}


def test_as_of(spark):
    q = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5)), (1, T0 - dt.timedelta(hours=1)), (1, T0)], "station_id long, at timestamp_ntz")
    got = {r["at"]: r.value for r in cleaning.as_of(q, panel(spark, {1: {0: 4, 3: 9}})).collect()}
    assert list(got.values()) == [None, 4.0, 9.0] or got == {T0 - dt.timedelta(hours=1): None, T0: 4.0, T0 + dt.timedelta(hours=5): 9.0}


@pytest.mark.parametrize(("aqi", "want"), [(0, 0), (50, 12), (51, 12.1), (100, 35.4), (101, 35.5), (150, 55.4), (151, 55.5), (200, 150.4), (201, 150.5), (300, 250.4), (301, 250.5), (400, 350.4), (401, 350.5), (500, 500.4), (-1, None)])
def test_index_inverse(spark, aqi, want):
    assert spark.range(1).select(indices.concentration_of(F.lit(float(aqi)))).first()[0] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geo.haversine_km(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(11.0))) == pytest.approx(111.195, abs=0.01)
    for name, want in (("North - Gate - ABC", ("North - Gate", "ABC")), ("Harbour", ("Harbour", "")), ("  Mill  ", ("Mill", ""))):
        assert tuple(spark.range(1).select(*indices.site_and_agency(F.lit(name))).first()) == want
    for d, s, want in ((270, 3, "onshore"), (50, 3, "offshore"), (180, 3, "unclassified"), (270, 0.5, "unclassified"), (None, 3, "unclassified")):
        assert one(indices.wind_sector(F.lit(d).cast("double"), F.lit(float(s)))) == want
    assert one(timefn.season(F.lit(dt.datetime(2025, 12, 15)))) == "2026-DJF"
    assert one(indices.index_of(F.lit(30.0))) == 50 and one(indices.index_of(F.lit(999.0))) == 500


def test_windows(spark):
    p = panel(spark, {s: [1] * 17 for s in range(10)} | {20: [1] * 18}, T0 + dt.timedelta(hours=18, minutes=30))
    days = windows.tumbling(p, 24)
    assert windows.covered(days, 24, 0.75, 1).count() == 1
    hours = lambda *hs: spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in hs], "ts timestamp_ntz")
    assert windows.episodes(hours(*range(10), 15)).count() == 1
    assert windows.episodes(hours(*range(10), 16)).count() == 2
    rolled = windows.rolling(panel(spark, {1: list(range(60))}).withColumnRenamed("value", "mean"))
    assert {r.rolling for r in rolled.where(F.col("ts") == T0 + dt.timedelta(hours=50)).collect()} == {sum(range(27, 51)) / 24}


def test_spatial_joins_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for i in range(300)] + [(900, 5000.0, 5000.0)]
    qs = [(i, rnd.uniform(-1500, 1500), rnd.uniform(-1500, 1500)) for i in range(60)] + [(99, 5000.0, 5000.0)]
    P, Q = (spark.createDataFrame(x, "id long, x double, y double") for x in (pts, qs))
    d = {q[0]: sorted(((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2) ** 0.5 for p in pts) for q in qs}
    assert {r.id: pytest.approx(r.distance) for r in spatial.nearest(Q, P, 40.0).collect()} == {k: v[0] for k, v in d.items()}
    assert {r.id: r.n for r in spatial.radius_count(Q, P, 250.0).collect()} == {k: sum(x <= 250 for x in v) for k, v in d.items()}


def test_resample_and_polygon(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (2, 0, 0.0, 0.0, 2.0, 0.0)], "id long, k int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.resample(s).orderBy("id", "j").collect()
    assert [r.x for r in got if r.id == 1] == [5.0 + 10 * i for i in range(10)] and [r.x for r in got if r.id == 2] == [1.0]
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    edges = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], "x1 double, y1 double, x2 double, y2 double")
    q = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, -1.0, 5.0)], "id long, x double, y double")
    assert {r.id: r.inside for r in spatial.inside(q, edges, 3.0).collect()} == {1: True, 2: False, 3: False}


def test_interpolation_invariants(spark):
    import numpy as np

    where = [(1, 1, 19.0, 72.82), (2, 2, 19.05, 72.88), (3, 3, 19.12, 72.85), (4, 3, 19.2, 72.9)]
    st = spark.createDataFrame([(s, g, a, b, str(g)) for s, g, a, b in where], "station_id long, gid long, lat double, lon double, cv_group string")
    p = panel(spark, {s: [40 + s + h % 5 for h in range(30)] for s in (1, 2, 3, 4)})
    out = interpolation.held_out(p, st).collect()
    assert len(out) == 120 and all(40 <= r.idw <= 49 for r in out)
    w = interpolation.krige_weights(np.array([x[2:] for x in where[:3]]), np.array([where[3][2:]]), (0.2, 0.8, 15.0))
    assert w.sum() == pytest.approx(1)
    assert interpolation.kriged(p, st, (0.2, 0.8, 15.0)).count() == 120
    km = np.linspace(1, 40, 15)
    got = interpolation.fit_variogram(km, 0.3 + 0.7 * (1 - np.exp(-3 * km / 20)), np.ones(15))
    assert got == pytest.approx((0.3, 0.7, 20), rel=0.05)
    assert interpolation.fit_variogram(km, 1.6 + 2.5 * (1 - np.exp(-3 * km / 2)), np.ones(15)) == pytest.approx((1.6, 2.5, 2), rel=0.1)


def test_rank_tests(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, -2.0, 3.0, 4.0, 0.0)], "d double")
    assert tuple(resampling.signed_ranks(d, "d").first()) == (8.0, 4)
    assert resampling.signed_rank_p(10, 4) == pytest.approx(0.125)
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: r.p_adj for r in resampling.adjusted(t).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_residuals_of_one_daily_cycle(spark):
    p = panel(spark, {1: [h % 24 for h in range(240)]})
    assert {abs(r.residual) for r in profiles.residuals(p).collect()} == {0.0}


def test_a_held_out_group_has_no_part_in_its_variogram(spark, monkeypatch):
    from sensorweave.plans import queries

    places = {k: (19.0 + 0.03 * (k % 3), 72.8 + 0.05 * (k // 3), k // 2) for k in range(8)}
    st = spark.createDataFrame([(k, *v) for k, v in places.items()], "station_id long, lat double, lon double, gid long")
    base = {k: [50 + 10 * ((h * 7 + k * k) % 11) + k * (h % 5) for h in range(40)] for k in places}
    # readings of group 0 change its own estimate in no other hour: they are wild in even hours, scored in odd ones
    wild = base | {k: [v * 9 if h % 2 == 0 else v for h, v in enumerate(base[k])] for k in (0, 1)}

    def estimates(series):
        p, got = panel(spark, series), []
        monkeypatch.setattr(queries, "panel", lambda *_: p)
        monkeypatch.setattr(queries, "stations", lambda *_: st)
        monkeypatch.setattr(interpolation, "scores", lambda predicted, _: got.append(predicted) or predicted)
        queries.kriging_cv(spark, "")
        return {(r.station_id, r.ts): round(r.idw, 9) for r in got[0].where("g = 0 and hour(ts) % 2 = 1").collect()}

    assert estimates(base) == estimates(wild) != {}


def test_correlation_power_has_all_its_trials(spark):
    from sensorweave.operators import validation
    from sensorweave.plans import queries

    units = spark.range(35)
    got = {r.rho: r for r in validation.correlation_power(units, (0.0, 0.5)).collect()}
    assert {r.trials for r in got.values()} == {3000} and got[0.0].units == 35 and 0.03 < got[0.0].power < 0.07 and 0.8 < got[0.5].power < 0.92
    assert validation.correlation_power(spark.range(3), (0.5,)).collect() == []


def test_greedy_deletion_equals_brute_force(spark):
    import random

    import numpy as np

    from sensorweave.operators import reports

    rnd = random.Random(5)
    rows = [(i, float(x := rnd.gauss(0, 1)), x + rnd.gauss(0, 1)) for i in range(12)]
    left, want = dict((i, (x, y)) for i, x, y in rows), []
    for _ in range(4):
        without = {i: np.corrcoef(np.array([v for k, v in left.items() if k != i]).T)[0, 1] for i in left}
        worst = min(without, key=without.get)
        want.append((worst, round(without[worst], 6)))
        left.pop(worst)
    got = reports.greedy_deletion(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 4).orderBy("step").collect()
    assert [(r.removed, r.r) for r in got] == want


def test_rings_are_closed_and_counter_clockwise(spark):
    from sensorweave.operators import reports

    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    rows = [(1, square), (2, square[::-1]), (3, [*square, square[0]]), (4, square[:3])]
    df = spark.createDataFrame(rows, "id int, p array<struct<x: double, y: double>>")
    got = {r.id: r.r for r in df.select("id", reports.ring(F.col("p")).alias("r")).collect()}
    area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:], strict=False)) / 2
    assert got[4] is None and all(len(got[k]) == 5 and got[k][0] == got[k][-1] and area(got[k]) == 4 for k in (1, 2, 3))
