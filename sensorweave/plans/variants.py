"""Queries over many windows, masks, predictors and pairs of windows at once, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, indices
from ..functions.linear import solved_sql
from ..functions.timefn import local
from ..operators import cleaning, crossval, decisions, interpolation, profiles, regression, spatial, sweeps, windows
from ..session import table
from .models import ORACLES as MODEL_SQL
from .models import map_features
from .oracles import _KM, _R, _q
from .panel import BOX, panel, places, raw, sites, stations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Permutations of each window's test (the operator has 2,000; SQL takes minutes for those of eight windows), and of the six-feature tests.
SWEEP_DRAWS, FEATURE_DRAWS = 500, 2000
#: Starts and ends swept, and windows rolled, over the panel's month.
SWEEPS = [(f"start {d:02d}", f"2024-01-{d:02d}", "2024-01-31") for d in (1, 6, 11)] + [(f"end {d:02d}", "2024-01-01", f"2024-01-{d:02d}") for d in (16, 21)] + [(f"rolled {d:02d}", f"2024-01-{d:02d}", f"2024-01-{d + 15:02d}") for d in (4, 9, 14)]
LENGTHS = [(f"{n} days from {d:02d}", f"2024-01-{d:02d}", f"2024-01-{d + n:02d}") for n, starts in ((20, (1, 6)), (25, (1, 4)), (29, (1,))) for d in starts]
FEATURES = ("log_major", "road_density_500m", "road_density_1km", "log_coast", "log_industrial", "building_density_500m")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _windows(spark, named):
    return spark.createDataFrame(named, "win string, lo string, hi string").select("win", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))


def _values(named) -> str:
    return "ws(win, lo, hi) as (values " + ", ".join(f"('{w}', date '{a}', date '{b}')" for w, a, b in named) + ")"


_WP = "wp as (select win, station_id, hour(lt)::int as hour, round(avg(value), 6) as mean, count(*) as n from loc join ws on lt::date >= lo and lt::date < hi group by 1, 2, 3)"
_SHAPES = f"""full0 as (select * from (select *, count(*) over (partition by win, station_id) as hours from wp) where hours = 24), f2 as (select * from full0 where win in (select win from full0 group by win having count(distinct station_id) >= 15)),
sim as (select p.win, p.station_id as a, q.station_id as b, round({_R.format('p.mean', 'q.mean')}, 6) as x from f2 p join f2 q on p.win = q.win and p.hour = q.hour and p.station_id < q.station_id group by 1, 2, 3),
s2 as (select sim.* from sim join pairs using (a, b) where g_a <> g_b and x is not null), b2 as (select win, a, b, x from s2 union all select win, b, a, x from s2), ids as (select win, station_id as id, sum(n)::bigint as n from f2 group by 1, 2),
num as (select win, id, row_number() over (partition by win order by id) as k from ids), perm as (select win, rep, id as tgt, row_number() over (partition by win, rep order by md5('1:' || rep || ':' || id), id) as k from ids, (select unnest(range(1, {SWEEP_DRAWS + 1})) as rep)),
pm as (select win, rep, num.id, tgt from perm join num using (win, k) union all select win, 0, id, id from ids),
mv as (select p.win, p.rep, x, km from pairs join pm p on p.id = a join pm q on q.id = b and q.rep = p.rep and q.win = p.win join b2 s on s.win = p.win and s.a = p.tgt and s.b = q.tgt),
rr as (select win, rep, round({_R.format('x', 'km')}, 9) as r, count(*) as n from mv group by 1, 2), r0 as (select win, r as own, n as n_pairs from rr where rep = 0),
res as (select win, max(own) as r, max(n_pairs) as n_pairs, count(*) filter (rep > 0 and abs(r) >= abs(own)) as k from rr join r0 using (win) group by 1)"""
_MANTELS = f"select win, readings, stations, round(r, 6) as r, n_pairs, round((k + 1) / {SWEEP_DRAWS + 1}.0::double, 6) as p from (select win, sum(n)::bigint as readings, count(*) as stations from ids group by 1) join res using (win)"


@query(_q(_MANTELS, _values(SWEEPS), _WP, _SHAPES))
def window_sweep(spark, sf):
    """The fall of likeness with distance for swept starts, swept ends and rolled windows, from one table of running sums."""
    found = sweeps.window_profiles(sweeps.running_sums(panel(spark, sf)), _windows(spark, SWEEPS))
    return sweeps.shape_mantel(found, crossval.network(stations(spark)), SWEEP_DRAWS)


@query(_q(_MANTELS, "ms(win, m) as (values ('odd days', 0), ('weekdays', 1), ('first half', 2))",
          "wp as (select win, station_id, hour(lt)::int as hour, round(avg(value), 6) as mean, count(*) as n from loc, ms where case m when 0 then day(lt) % 2 = 1 when 1 then isodow(lt) <= 5 else day(lt) <= 15 end group by 1, 2, 3)", _SHAPES))
def mask_mantel(spark, sf):
    """The same over masks of hours."""
    t = local(F.col("ts"))
    masks = {"odd days": F.day(t) % 2 == 1, "weekdays": F.weekday(t) < 5, "first half": F.day(t) <= 15}
    return sweeps.shape_mantel(sweeps.mask_profiles(panel(spark, sf), masks), crossval.network(stations(spark)), SWEEP_DRAWS)


@query(_q("select win, count(*) as n, round(sum(u * v) / nullif(sqrt(sum(u * u) * sum(v * v)), 0), 6) as r, round(quantile_cont(gap, 0.5), 5) as median_gap, count(*) filter ((amp0 + amp1) / 2 < 1.5) as weak from uv group by win having count(*) >= 15", _values(LENGTHS),
          "pp as (select win, (day(lt) % 2)::int as part, station_id, hour(lt)::int as hour, round(avg(value), 6) as mean from loc join ws on lt::date >= lo and lt::date < hi group by all)",
          "ab as (select win, part, station_id, sum(mean * cos(hour * 2 * pi() / 24)) / 12 as a, sum(mean * sin(hour * 2 * pi() / 24)) / 12 as b from pp group by all having count(*) = 24)",
          "ph as (select win, station_id, part, round((atan2(b, a) / (2 * pi()) * 24 + 24) % 24, 5) as p, round(sqrt(a * a + b * b), 6) as amp from ab)",
          "bo as (select x.win, x.station_id, x.p as p0, y.p as p1, x.amp as amp0, y.amp as amp1, abs((x.p - y.p + 12 + 24) % 24 - 12) as gap, x.p * pi() / 12 as t0, y.p * pi() / 12 as t1 from ph x join ph y on x.win = y.win and x.station_id = y.station_id and x.part = 0 and y.part = 1)",
          "uv as (select *, sin(t0 - atan2(avg(sin(t0)) over w, avg(cos(t0)) over w)) as u, sin(t1 - atan2(avg(sin(t1)) over w, avg(cos(t1)) over w)) as v from bo window w as (partition by win))"))
def phase_by_length(spark, sf):
    """Split-half reliability of the daily phase (odd against even days) for windows of several lengths, slid over the record."""
    sums = sweeps.running_sums(panel(spark, sf), F.day(local(F.col("ts"))) % 2)
    return sweeps.phase_reliability(sweeps.window_profiles(sums, _windows(spark, LENGTHS)))


@query(_q(f"select round(avg(r), 6) as mean_r, round(quantile_cont(r, 0.5), 6) as median_r, count(*) as pairs from (select p.win as i, q.win as j, round({_R.format('p.x', 'q.x')}, 6) as r from gx p join gx q on p.g = q.g and q.win >= p.win + 1 + 7 group by 1, 2 having count(*) >= 10 and {_R.format('p.x', 'q.x')} is not null)",
          "gx as (select win, gid as g, round(avg(x), 6) as x from cx join stations using (station_id) group by 1, 2)"))
def window_pair_groups(spark, sf):
    """Do groups keep their pattern? Correlations of daily patterns of groups, a week or more between the end of one day and the start of the other."""
    days = windows.covered(windows.tumbling(panel(spark, sf), 24), 24, 0.25, 10)
    from pyspark.sql import Window as W

    x = days.withColumn("x", F.col("mean") - F.avg("mean").over(W.partitionBy("win"))).join(stations(spark).select("station_id", "gid"), "station_id")
    patterns = x.groupBy("win", F.col("gid").alias("g")).agg(F.round(F.avg("x"), 6).alias("x"))
    at = patterns.select("win").distinct().select("win", (F.col("win") * 86400).alias("lo"), ((F.col("win") + 1) * 86400).alias("hi"))
    return sweeps.pair_summary(sweeps.pattern_pairs(patterns, sweeps.eligible_pairs(at, 7 * 86400)))


_T = ["1.0::double", "cos(hour * 2 * pi() / 24)", "sin(hour * 2 * pi() / 24)", "cos(2 * hour * 2 * pi() / 24)", "sin(2 * hour * 2 * pi() / 24)"]
_NORMAL = ", ".join([f"sum({_T[i]} * {_T[j]}) as a{i}_{j}" for i in range(5) for j in range(i, 5)] + [f"sum({_T[i]} * mean) as b{i}" for i in range(5)])
ORACLES["incomplete_harmonics"] = _q(f"select station_id, round(sqrt(xb1 * xb1 + xb2 * xb2), 6) as amp1, round(sqrt(xb3 * xb3 + xb4 * xb4), 6) as amp2, round((atan2(xb2, xb1) / (2 * pi()) * 24 + 24) % 24, 5) as phase from {solved_sql('ne', 5)}", f"ne as (select station_id, {_NORMAL} from prof where hour % 7 <> 3 group by 1 having count(*) >= 6)")


def _units(spark, sf):
    """Sites (suppliers) with their six features, distances as logarithms, and an outcome (the account balance)."""
    f = map_features(spark, sf, sites(spark, sf))
    log = lambda x: F.round(F.log10(F.col(x) + 10.0), 6)
    f = f.select("id", log("dist_major_road_m").alias("log_major"), "road_density_500m", "road_density_1km", log("dist_coast_m").alias("log_coast"), log("dist_industrial_m").alias("log_industrial"), "building_density_500m")
    return f.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("y")), "id").persist()  # a row a site, read several times


_SITES = f"ft as (select * from ({MODEL_SQL['features_for']})), un as (select id, round(log10(dist_major_road_m + 10), 6) as log_major, road_density_500m, road_density_1km, round(log10(dist_coast_m + 10), 6) as log_coast, round(log10(dist_industrial_m + 10), 6) as log_industrial, building_density_500m, s_acctbal as y from ft join supplier on s_suppkey = id)"
_MOVES = f"nu as (select id, row_number() over (order by id) as k from un), pr as (select rep, id as tgt, row_number() over (partition by rep order by md5('1:' || rep || ':' || id), id) as k from un, (select unnest(range(1, {FEATURE_DRAWS + 1})) as rep)), pm as (select rep, nu.id, tgt from pr join nu using (k) union all select 0, id, id from un)"
_M = len(FEATURES) + 1
_Z = "zz as (select id, y, avg(y) over () as my, count(*) over () as units, 1.0::double as z0, " + ", ".join(f"({x} - avg({x}) over ()) / nullif(stddev_pop({x}) over (), 0) as z{i + 1}" for i, x in enumerate(FEATURES)) + " from un where y is not null and " + " and ".join(f"{x} is not null" for x in FEATURES) + ")"
_SQUARE = "sq as (select " + ", ".join(f"sum(z{i} * z{j}) as a{i}_{j}" for i in range(_M) for j in range(i, _M)) + " from zz)"
_LEFT = f"lf as (select id, my, units, {', '.join(f'z{i}' for i in range(_M))}, 1 - ({' + '.join(f'z{i} * xb{i}' for i in range(_M))}) as lft from {solved_sql('(select zz.*, sq.*, ' + ', '.join(f'z{i} as b{i}' for i in range(_M)) + ' from zz, sq)', _M)})"
_SLOPES = f"sl as (select rep, {', '.join(f'xb{i}' for i in range(_M))} from {solved_sql('(select * from (select rep, ' + ', '.join(f'sum(u.z{i} * v.y) as b{i}' for i in range(_M)) + ' from pm join zz u on u.id = pm.id join zz v on v.id = tgt group by 1), sq)', _M)})"
_SKILLS = f"sk as (select rep, round(1 - sum(pow((v.y - ({' + '.join(f'u.z{i} * xb{i}' for i in range(_M))})) / nullif(lft, 0), 2)) / nullif(sum(pow((v.y - u.my) * u.units / (u.units - 1), 2)), 0), 9) as r2, count(*) as units from pm join lf u on u.id = pm.id join zz v on v.id = tgt join sl using (rep) group by 1)"


@query(_q(f"select round(max(r2) filter (rep = 0), 6) as r2, round((count(*) filter (rep > 0 and r2 >= (select r2 from sk where rep = 0)) + 1) / {FEATURE_DRAWS + 1}.0::double, 6) as p, max(units) as units from sk", _SITES, _MOVES, _Z, _SQUARE, _LEFT, _SLOPES, _SKILLS))
def six_feature_skill(spark, sf):
    return regression.held_out_skill_of(_units(spark, sf), "id", "y", list(FEATURES), FEATURE_DRAWS)


_LONG = "lg as (" + " union all ".join(f"select id, y, '{x}' as feature, {x}::double as x from un where {x} is not null and y is not null" for x in FEATURES) + "), rk as (select id, feature, " + f"rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from lg)"


@query(_q(f"select feature, round(max(own), 6) as rho, round((count(*) filter (rep > 0 and abs(r) >= abs(own)) + 1) / {FEATURE_DRAWS + 1}.0::double, 6) as p from ra join (select feature, r as own from ra where rep = 0) using (feature) group by 1", _SITES, _MOVES, _LONG,
          f"ra as (select u.feature, rep, round({_R.format('u.rx', 'v.ry')}, 9) as r from pm join rk u on u.id = pm.id join rk v on v.id = tgt and v.feature = u.feature group by 1, 2)"))
def feature_permutations(spark, sf):
    return regression.permuted_rank_correlations(_units(spark, sf), "id", "y", list(FEATURES), FEATURE_DRAWS)


_NAMES = ["dist_major_road_m", "road_density_500m", "road_density_1km", "dist_coast_m", "dist_industrial_m", "building_density_500m"]
_FLAGS = " + ".join(f"(case when {x} < {x}_0 then 1 when {x} > {x}_1 then 2 else 0 end) * {4**k}" for k, x in enumerate(_NAMES))
_KIND = "case when (flags >> 10) & 1 = 1 and ((flags >> 2) & 1 = 1 or (flags >> 4) & 1 = 1) then 'empty' when (flags >> 1) & 1 = 1 or (flags >> 7) & 1 = 1 or (flags >> 9) & 1 = 1 then 'remote' when flags <> 0 then 'other' else 'none' end"
_MASKED = f"bd as (select {', '.join(f'round(quantile_cont({x}, 0.01), 6) as {x}_0, round(quantile_cont({x}, 0.99), 6) as {x}_1' for x in _NAMES)} from ft where id <= 39), fl as (select id, ({_FLAGS})::int as flags from ft, bd), mk as (select id, flags, {_KIND} as kind from fl)"


def _masked(spark, sf):
    """All sites against the 1st to 99th percentile of the first 39, as cells of a map stand against those of its stations."""
    f = map_features(spark, sf, sites(spark, sf)).persist()  # a row a site, read for the percentiles and the flags
    out = spatial.mask(f, profiles.bounds(f.where("id <= 39"), _NAMES), ["id"], _NAMES, ("p01", "p99"))
    kind = spatial.mask_kind(F.col("flags"), _NAMES, "building_density_500m", ["road_density_500m", "road_density_1km"], ["dist_major_road_m", "dist_coast_m", "dist_industrial_m"])
    return out.select("id", "flags", kind.alias("kind"))


_FT = f"ft as (select * from ({MODEL_SQL['features_for']}))"


@query(_q("select * from mk", _FT, _MASKED))
def mask_kinds(spark, sf):
    return _masked(spark, sf)


@query(_q("select * from (" + " union all ".join([f"select '{x}' as reason, count(*) filter ((flags >> {2 * k}) & 3 <> 0) as n from mk" for k, x in enumerate(_NAMES)] + [f"select '_below_band', count(*) filter (flags & {sum(1 << 2 * k for k in range(6))} <> 0) from mk", f"select '_above_band', count(*) filter (flags & {sum(2 << 2 * k for k in range(6))} <> 0) from mk"] + [f"select '_{k}', count(*) filter (kind = '{k}') from mk" for k in ("empty", "remote", "other")]) + ")", _FT, _MASKED))
def mask_kind_totals(spark, sf):
    return spatial.mask_totals(_masked(spark, sf), _NAMES)


_U = {k: f"((p_partkey * {m} % 1009) / 1009.0::double - {c}::double)" for k, m, c in (("a", 7919, 0.3), ("b", 104729, 0.6), ("c", 3571, 0.2), ("d", 1299709, 0.1), ("e", 15485863, 0.3), ("f", 611953, 0.5), ("g", 350377, 0.5), ("h", 86028121, 0.5))}
_PV = {k: f"((p_partkey * {m} % 97) / 970.0::double)" for k, m in (("p", 31), ("q", 57))}


@query("with t as (select p_partkey, " + ", ".join(f"{e} as {k}" for k, e in (_U | _PV).items()) + " from part) select p_partkey, case when a <= 0 or e < 0.2 then '1: noise all the way down' when c >= 0.3 and d > 0 and p < 0.05 and b < 0 then '3: stable and smooth' when c >= 0.3 and not (d > 0 and p < 0.05) and b >= 0 then '2: stable but local' else 'mixed' end as averaging, case when a > 0 and b > 0 and c > 0 then 'R1: full pass' when a > 0 and b > 0 then 'R3: partial pass (G)' when a > 0 and c > 0 then 'R3: partial pass (P)' when a > 0 then 'R2: stability only' when b > 0 or c > 0 then 'mixed' else 'R4: control fails' end as control, (sign(f) = 1 or sign(g) = -1) and not (sign(f) = -1 and abs(4 * h) > 2) and not (sign(g) = 1 and abs(4 * h) > 2) as right_sign, "
       "case when p < 0.05 and a > 0 and f > 0 and b > 0 then 'L1: land use explains NO2 more' when p < 0.05 and a > 0 and f > 0 and b <= 0 and b + 0.3 >= 0 and not (q < 0.05 and c > 0) then 'L2: NO2 signal, contrast unresolved' when p >= 0.05 and q >= 0.05 and b + 0.3 < 0 then 'L3/L4 overlap: described cell by cell' when p >= 0.05 and q >= 0.05 then 'L3: no detectable land-use signal' when (p < 0.05 and not f > 0) or (q < 0.05 and not g > 0) then 'L5: signal, but not the road signal' when b + 0.3 < 0 or (q < 0.05 and p >= 0.05) then 'L4: PM2.5 more than NO2' else 'unlabelled: described cell by cell' end as land_use from t")
def decision_rules(spark, sf):
    """The sets of rules over numbers made of the parts' keys, so that every verdict comes up."""
    t = table(spark, sf, "part")
    n = lambda k, m, d: (F.col("p_partkey") * m % k) / F.lit(float(d))
    u = {k: n(1009, m, 1009) - c for k, m, c in (("a", 7919, 0.3), ("b", 104729, 0.6), ("c", 3571, 0.2), ("d", 1299709, 0.1), ("e", 15485863, 0.3), ("f", 611953, 0.5), ("g", 350377, 0.5), ("h", 86028121, 0.5))}
    t = t.select("p_partkey", *[e.alias(k) for k, e in u.items()], n(97, 31, 970).alias("p"), n(97, 57, 970).alias("q"))
    a, b, c, d, e, f, g, h, p, q = (F.col(k) for k in "abcdefghpq")
    slopes = {"major": f, "density": g}, {"major": 4 * h, "density": 4 * h}
    return t.select(
        "p_partkey", decisions.averaging(a, b, c, e, d, p).alias("averaging"), decisions.control(a > 0, b > 0, c > 0).alias("control"),
        decisions.right_sign({"major": 1, "density": -1}, *slopes).alias("right_sign"), decisions.land_use(a, p, f > 0, c, q, g > 0, b, b + 0.3).alias("land_use"),
    )


@query(_q("select o.n, o.rmse_idw, o.rmse_city, round(100 * (rmse_idw - rmse_city) / nullif(rmse_city, 0), 4) as gap_pct, groups_won, groups from (select count(*) as n, round(sqrt(avg(pow(idw - observed, 2))), 6) as rmse_idw, round(sqrt(avg(pow(city - observed, 2))), 6) as rmse_city from logo) o, (select count(*) filter (gap < 0) as groups_won, count(*) as groups from (select round(sqrt(avg(pow(idw - observed, 2))) - sqrt(avg(pow(city - observed, 2))), 6) as gap from logo group by g))"))
def skill_summary(spark, sf):
    return interpolation.skill_summary(interpolation.held_out(panel(spark, sf), stations(spark)))


@query(_q("select station_id, count(*) as n, round(avg(value), 6) as mean from raw where event_type = 'purchase' and value is not null and station_id in (select station_id from panel) and ts between (select min(ts) from panel) and (select max(ts) from panel) group by 1"))
def second_quantity(spark, sf):
    """Another quantity (events of one type) at the panel's stations and within its span."""
    other = raw(spark, sf).where("event_type = 'purchase' and value is not null").select("station_id", "ts", "value")
    own = cleaning.restricted(other, panel(spark, sf))
    return own.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(_q("select station_id, ts, round(value - avg(value) over (partition by station_id, month(lt), hour(lt)) + 1e-9, 6) as residual from loc"))
def seasonal_residuals(spark, sf):
    return profiles.seasonal_residuals(panel(spark, sf))


@query(_q(f"select case when g_a = g_b then 'one group' when km < 5 then 'near' when km < 15 then 'middle' else 'far' end as class, count(*) as n_pairs, round(avg(km), 5) as km, round(avg(r), 5) as corr from (select p.station_id as a, q.station_id as b, round({_R.format('p.mean', 'q.mean')}, 6) as r from prof p join prof q on p.hour = q.hour and p.station_id < q.station_id group by 1, 2) join pairs using (a, b) where r is not null group by 1"))
def likeness_by_distance_class(spark, sf):
    """Likeness of daily profiles by distance, pairs of one group in a row of their own."""
    s = stations(spark).select("station_id", "cv_group")
    both = profiles.pairwise(profiles.diurnal(panel(spark, sf))).where("r is not null").join(spatial.distances(stations(spark)).select("a", "b", "km"), ["a", "b"]).join(s.toDF("a", "ga"), "a").join(s.toDF("b", "gb"), "b")
    name = F.when(F.col("ga") == F.col("gb"), "one group").when(F.col("km") < 5, "near").when(F.col("km") < 15, "middle").otherwise("far")
    return both.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("km"), 5).alias("km"), F.round(F.avg("r"), 5).alias("corr"))


_LAT0, _LON0 = (BOX[1] + BOX[3]) / 2, (BOX[0] + BOX[2]) / 2


@query(_q(f"select id, round(6371008.8::double * cos(radians({_LAT0}::double)) * radians(lon - {_LON0}::double) + 1e-9, 3) as x, round(6371008.8::double * radians(lat - {_LAT0}::double) + 1e-9, 3) as y, round(0.2::double + 0.8::double * (1 - exp(-3 * km / 15)), 6) as gamma from (select *, {_KM.format(a='lat', b='lon', c=f'{_LAT0}::double', d=f'{_LON0}::double')} as km from places)"))
def projected_places(spark, sf):
    """Places in metres around the box's centre, and the variogram at their distance from it."""
    x, y = geo.project_m(F.col("lat"), F.col("lon"), BOX)
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(_LAT0), F.lit(_LON0))
    return places(spark, sf).select("id", F.round(x + 1e-9, 3).alias("x"), F.round(y + 1e-9, 3).alias("y"), F.round(geo.exponential_variogram(km, 0.2, 0.8, 15.0), 6).alias("gamma"))


@query(_q("select station_id, hour, round(greatest(2.0::double + 0.6::double * mean, 30.0::double), 6) as sigma, round((hour - 9.5::double + 12 + 24) % 24 - 12, 6) as from_peak from prof"))
def profile_error_bars(spark, sf):
    """Error of each profile's means by a line with a floor, and hours from half past nine on the circle of a day."""
    p = profiles.diurnal(panel(spark, sf))
    return p.select("station_id", "hour", F.round(indices.sigma(F.col("mean"), 2.0, 0.6, 30.0), 6).alias("sigma"), F.round(indices.wrap12(F.col("hour") - F.lit(9.5)), 6).alias("from_peak"))
