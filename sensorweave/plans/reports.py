"""Queries of summaries, tests and report tables, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, indices, timefn
from ..operators import interpolation, profiles, reports, spatial, windows
from ..session import table
from .oracles import _cell_of, _R, _SEASON, _SIM, _q
from .panel import BOX, panel, places, raw, reporting, sites, stations
from .queries import MANTEL_DRAWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Draws of the bootstrap and permutations of the rank correlation below, in both engines.
DRAWS, PERMUTATIONS = 2000, 20000


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _profile(spark, sf):
    return profiles.diurnal(panel(spark, sf))


_AB = ", ".join(f"sum(mean * {f}(hour * {k} * pi() / 12)) / 12 as {n}{k}" for k in (1, 2) for n, f in (("a", "cos"), ("b", "sin")))
_WAVES = f"zz as (select *, (mean - avg(mean) over w) / case when stddev_pop(mean) over w > 1e-9 then stddev_pop(mean) over w else 1 end as z from prof window w as (partition by station_id)), wv as (select station_id, {_AB}, max(mean) as top, min(mean) as low, avg(z) filter (hour between 6 and 10) - avg(z) filter (hour between 18 and 22) as balance from zz group by 1 having count(*) = 24)"
_PHASE = "(((atan2({1}, {0}) / (2 * pi()) * 24) % 24) + 24) % 24"


@query(_q(f"select station_id, round(balance, 6) as balance, round({_PHASE.format('a1', 'b1')}, 5) as peak, round(({_PHASE.format('a1', 'b1')} + 12) % 24, 5) as trough, round(top - low, 6) as swing, round(sqrt(a2 * a2 + b2 * b2) / nullif(sqrt(a1 * a1 + b1 * b1), 0), 6) as bimodality from wv", _WAVES))
def five_summaries(spark, sf):
    return reports.five_summaries(_profile(spark, sf), "station_id")


@query(_q("select station_id, min_by(t, (y, t)) as trough from (select station_id, t, round(a1 * cos(t * pi() / 12) + b1 * sin(t * pi() / 12) + a2 * cos(t * pi() / 6) + b2 * sin(t * pi() / 6), 9) as y from wv, (select unnest(range(0, 2400)) / 100.0::double as t)) group by 1", _WAVES))
def trough_of_two_waves(spark, sf):
    return reports.trough_of_two_waves(_profile(spark, sf), "station_id")


_HALVES = f"hp as (select station_id, (date_diff('day', date '1970-01-01', lt::date) % 2)::int as half, hour(lt)::int as hour, avg(value) as mean from loc group by all), hw as (select station_id, half, {_AB} from hp group by 1, 2 having count(*) = 24), ph as (select station_id, max({_PHASE.format('a1', 'b1')}) filter (half = 0) as x, max({_PHASE.format('a1', 'b1')}) filter (half = 1) as y from hw group by 1), ok as (select x * pi() / 12 as x, y * pi() / 12 as y from ph where x is not null and y is not null), sn as (select sin(x - (select atan2(avg(sin(x)), avg(cos(x))) from ok)) as p, sin(y - (select atan2(avg(sin(y)), avg(cos(y))) from ok)) as q from ok)"


@query(_q("select round(sum(p * q) / nullif(sqrt(sum(p * p) * sum(q * q)), 0), 6) as r, count(*) as n from sn", _HALVES))
def phase_reliability(spark, sf):
    """Circular correlation of the phases of even and odd days."""
    t = timefn.local(F.col("ts"))
    half = panel(spark, sf).groupBy("station_id", F.pmod(F.datediff(t, F.lit("1970-01-01")), F.lit(2)).alias("half"), F.hour(t).alias("hour")).agg(F.avg("value").alias("mean"))
    w = reports.waves(half, "station_id", "half").withColumn("phase", indices.phase_hour(F.col("a1"), F.col("b1")))
    both = w.groupBy("station_id").agg(F.max(F.when(F.col("half") == 0, F.col("phase"))).alias("x"), F.max(F.when(F.col("half") == 1, F.col("phase"))).alias("y"))
    return reports.circular_circular(both.where("x is not null and y is not null"), "x", "y")


@query(_q("select station_id, hour, round(100 * mean / nullif(avg(mean) over (partition by station_id), 0), 6) as pct from prof"))
def profile_pct_of_mean(spark, sf):
    return reports.of_own_mean(_profile(spark, sf))


@query(_q("select station_id, round(max(mean) - min(mean), 6) as swing, round(case when avg(mean) > 0 then 100 * (max(mean) - min(mean)) / avg(mean) end, 6) as swing_pct from prof group by 1"))
def profile_swing(spark, sf):
    return reports.swing(_profile(spark, sf), "station_id")


_ST = "ss as (select station_id, g, count(*) as n, round(avg(abs(idw - observed)), 6) as mae, round(sqrt(avg(pow(idw - observed, 2))), 6) as rmse from logo group by 1, 2)"


def _station_scores(spark, sf):
    s = interpolation.scores(interpolation.held_out(panel(spark, sf), stations(spark)), "station_id", "g")
    return s.select("station_id", "g", "n", F.col("mae_idw").alias("mae"), F.col("rmse_idw").alias("rmse"))


@query(_q("select round(sum(n * mae) / sum(n), 6) as mae, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) as rmse, max(rmse) as worst, min(rmse) as best, sum(n)::bigint as hours from ss", _ST))
def pooled_scores(spark, sf):
    return reports.pooled(_station_scores(spark, sf))


@query(_q("select station_id, count(*) as windows, round(round(avg(abs(idw - observed)), 6), 5) as mae, round(round(sqrt(avg(pow(idw - observed, 2))), 6), 5) as rmse from wl group by 1",
          "wl as (select t.station_id, t.win, any_value(t.mean) as observed, sum(s.mean / pow(greatest(km, 0.05), 0.5)) / sum(1 / pow(greatest(km, 0.05), 0.5)) as idw from cov t join stations gt using (station_id) join cov s on s.win = t.win join stations gs on gs.station_id = s.station_id and gs.gid <> gt.gid join links on links.a = t.station_id and links.b = s.station_id group by 1, 2)"))
def window_cv(spark, sf):
    """Leave-one-group-out errors of daily means instead of hours."""
    days = windows.covered(windows.tumbling(panel(spark, sf), 24), 24, 0.25, 10)
    p = interpolation.held_out(days.select("station_id", F.timestamp_seconds(F.col("win") * 86400).cast("timestamp_ntz").alias("ts"), F.col("mean").alias("value")), stations(spark))
    s = interpolation.scores(p, "station_id")
    return s.select("station_id", F.col("n").alias("windows"), F.round("mae_idw", 5).alias("mae"), F.round("rmse_idw", 5).alias("rmse"))


_Z = "zw as (select station_id, win, (mean - avg(mean) over w) / nullif(stddev_pop(mean) over w, 0) as z from cov window w as (partition by win)), pc as (select p.station_id as a, q.station_id as b, round(1 - sum(0.5::double * pow(p.z - q.z, 2)) / count(*), 6) as corr, count(*) as n from zw p join zw q on p.win = q.win and p.station_id < q.station_id group by 1, 2)"


def _pooled_similarity(spark, sf):
    days = windows.covered(windows.tumbling(panel(spark, sf), 24), 24, 0.25, 10)
    w = W.partitionBy("win")
    z = days.select("station_id", "win", ((F.col("mean") - F.avg("mean").over(w)) / F.nullif(F.stddev_pop("mean").over(w), F.lit(0.0))).alias("z"))
    return reports.pooled_similarity(z)


@query(_q("select * from pc", _Z))
def pooled_similarity(spark, sf):
    return _pooled_similarity(spark, sf)


def _md5_moves(n: int) -> str:
    return f"""ids as (select distinct id from (select a as id from pairs union all select b from pairs)), num as (select id, row_number() over (order by id) as k from ids),
pr as (select rep, id as tgt, row_number() over (partition by rep order by md5('1:' || rep || ':' || id), id) as k from ids, (select unnest(range(1, {n + 1})) as rep)),
pm as (select rep, num.id, tgt from pr join num using (k) union all select 0, id, id from ids)"""


@query(_q("select round(max(gap) filter (rep = 0), 6) as gap, round((count(*) filter (rep > 0 and gap >= (select gap from gg where rep = 0)) + 1) / " + f"{MANTEL_DRAWS + 1}.0" + "::double, 6) as p from gg", _Z, _md5_moves(MANTEL_DRAWS),
          "gg as (select p.rep, round(avg(corr) filter (km < 5) - avg(corr) filter (km >= 15), 9) as gap from pc join pm p on p.id = a join pm q on q.id = b and q.rep = p.rep join links on links.a = p.tgt and links.b = q.tgt group by 1)"))
def mantel_near_far(spark, sf):
    return reports.mantel_near_far(_pooled_similarity(spark, sf), spatial.distances(stations(spark)), 5.0, 15.0, MANTEL_DRAWS)


_UN = "un as (select station_id as id, round(avg(value), 6) as level, any_value(lat) as lat from panel join stations using (station_id) group by 1), rk as (select id, rank() over (order by level) + (count(*) over (partition by level) - 1) / 2.0 as rx, rank() over (order by lat) + (count(*) over (partition by lat) - 1) / 2.0 as ry from un)"


@query(_q(f"select round(max(r) filter (rep = 0), 6) as rho, round((count(*) filter (rep > 0 and abs(r) >= abs((select r from rr where rep = 0))) + 1) / {PERMUTATIONS + 1}.0::double, 6) as p, max(n) as n from rr", _UN,
          f"num as (select id, row_number() over (order by id) as k from un), pr as (select rep, id as tgt, row_number() over (partition by rep order by md5('1:' || rep || ':' || id), id) as k from un, (select unnest(range(1, {PERMUTATIONS + 1})) as rep)), pm as (select rep, num.id, tgt from pr join num using (k) union all select 0, id, id from un)",
          f"rr as (select rep, round({_R.format('u.rx', 'v.ry')}, 9) as r, count(*) as n from pm join rk u on u.id = pm.id join rk v on v.id = tgt group by rep)"))
def permuted_spearman(spark, sf):
    u = panel(spark, sf).groupBy("station_id").agg(F.round(F.avg("value"), 6).alias("level")).join(stations(spark).select("station_id", "lat"), "station_id")
    return reports.permuted_spearman(u, "station_id", "level", "lat", PERMUTATIONS)


_CL = "cl as (select (date_diff('day', date '1970-01-01', ts::date) // 7)::bigint as cluster, count(*) filter (station_id <= 20) as na, sum(value) filter (station_id <= 20) as sa, count(*) filter (station_id > 20) as nb, sum(value) filter (station_id > 20) as sb from panel group by 1), nu as (select cluster, row_number() over (order by cluster) - 1 as k, count(*) over () as size from cl)"


@query(_q("select case when count(d) >= 10 then round(quantile_cont(d, 0.025), 6) end as lo, case when count(d) >= 10 then round(quantile_cont(d, 0.975), 6) end as hi, count(d) as draws, (select round(sum(sa) / sum(na) - sum(sb) / sum(nb), 6) from cl) as point from dd", _CL,
          f"sl as (select rep, slot, (('0x' || substr(md5('1:' || rep || ':' || slot), 1, 8))::bigint % (select count(*) from cl))::bigint as k from (select unnest(range(1, {DRAWS + 1})) as rep), (select unnest(range(0, (select count(*) from cl))) as slot))",
          "dd as (select rep, round(sum(sa) / nullif(sum(na), 0) - sum(sb) / nullif(sum(nb), 0), 9) as d from sl join nu using (k) join cl using (cluster) group by rep)"))
def paired_cluster_bootstrap(spark, sf):
    """Difference of two sets of stations over the same draws of weeks."""
    one, two = F.col("station_id") <= 20, F.col("station_id") > 20
    n, s = (lambda c: F.sum(c.cast("long"))), (lambda c: F.sum(F.when(c, F.col("value"))))
    sums = panel(spark, sf).groupBy(F.floor(F.datediff("ts", F.lit("1970-01-01")) / 7).alias("cluster")).agg(n(one).alias("na"), s(one).alias("sa"), n(two).alias("nb"), s(two).alias("sb"))
    return reports.paired_cluster_bootstrap(sums, DRAWS)


@query("select date_trunc('month', l_shipdate)::timestamp as start_ts, (day(last_day(l_shipdate)) * 24)::int as nominal_hours, round(avg(l_quantity), 6) as mean, count(*) as n, (date_trunc('month', l_shipdate) + interval 1 month)::timestamp as end_ts from lineitem group by all")
def calendar_months(spark, sf):
    return reports.calendar_windows(table(spark, sf, "lineitem"), F.col("l_shipdate").cast("timestamp"), "l_quantity")


@query(_q("select count(*) as windows, median(k) as median_stations, median(r) as median_readings from (select win, count(*) as k, sum(n) as r from cov group by 1)"))
def counts_per_window(spark, sf):
    return reports.counts_per_window(windows.covered(windows.tumbling(panel(spark, sf), 24), 24, 0.25, 10))


_FEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round({_R.format(a, b)}, 6) as r from lineitem" for i, a in enumerate(_FEAT) for b in _FEAT[i + 1 :]) + ") where abs(r) >= 0.001")
def correlated_features(spark, sf):
    return reports.correlated(table(spark, sf, "lineitem").select("l_orderkey", *(F.col(c).cast("double").alias(c) for c in _FEAT)), "l_orderkey", _FEAT, 0.001)


@query(_q("select station_id, ts, value from panel where floor(value / 50) <> 9"))
def without_saturation(spark, sf):
    return panel(spark, sf).where(F.floor(F.col("value") / 50) != 9)


@query(_q("select station_id, ts, value from loc where lt >= timestamp '2024-01-05' and not (lt >= timestamp '2024-01-10' and lt < timestamp '2024-01-12')"))
def local_window_mask(spark, sf):
    """From a common start on, without a window of local days."""
    t = timefn.local(F.col("ts"))
    on = lambda d: F.lit(d).cast("timestamp_ntz")
    return panel(spark, sf).where((t.cast("timestamp_ntz") >= on("2024-01-05")) & ~((t.cast("timestamp_ntz") >= on("2024-01-10")) & (t.cast("timestamp_ntz") < on("2024-01-12"))))


@query(_q("select station_id, count(*) as hours, case when count(*) >= 240 then round(avg(value), 6) end as level from panel group by 1"))
def outcome_with_hours(spark, sf):
    """A station's level, null below 240 hours."""
    n = F.count(F.lit(1))
    return panel(spark, sf).groupBy("station_id").agg(n.alias("hours"), F.when(n >= 240, F.round(F.avg("value"), 6)).alias("level"))


@query(_q("select s.station_id, s.cv_group, coalesce(h.hours, 0)::bigint as hours, f.first_type from stations s left join (select station_id, count(*) as hours from panel group by 1) h using (station_id) left join (select station_id, arg_min(event_type, (ts, event_id)) as first_type from raw group by 1) f using (station_id)"))
def station_lookups(spark, sf):
    """Lookups by id: group with a default, hours, and the first row's type (first wins)."""
    hours = panel(spark, sf).groupBy("station_id").agg(F.count(F.lit(1)).alias("hours"))
    first = raw(spark, sf).groupBy("station_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    out = stations(spark).select("station_id", "cv_group").join(hours, "station_id", "left").join(first, "station_id", "left")
    return out.select("station_id", "cv_group", F.coalesce("hours", F.lit(0)).alias("hours"), "first_type")


_EP = "hh as (select distinct ts from panel where value > 200), br as (select ts, case when epoch(ts) - epoch(lag(ts) over (order by ts)) <= 21600 then 0 else 1 end as b from hh), ep as (select ts, sum(b) over (order by ts) as k from br), es as (select min(ts) as start_ts, max(ts) as end_ts from ep group by k)"


@query(_q("select p.station_id, start_ts, count(*) as hours, round(avg(value), 6) as mean from panel p join es on p.ts between start_ts and end_ts group by 1, 2", _EP))
def episode_members(spark, sf):
    """Readings by the episode that their hour falls in; other hours are dropped. An episode is spelled out as its hours, so the join is on equal hours."""
    p = panel(spark, sf)
    e = windows.episodes(p.where("value > 200").select("ts").distinct()).select("start_ts", F.explode(F.sequence("start_ts", "end_ts", F.expr("interval 1 hour"))).alias("ts"))
    return p.join(e.select(F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("ts").cast("timestamp_ntz").alias("ts")), "ts").groupBy("station_id", "start_ts").agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg("value"), 6).alias("mean"))


@query(_q("select p.ts, coalesce(w.sector, 'unclassified') as sector, count(*) as n, round(avg(value) + 1e-9, 6) as mean from panel p left join (select ts, case when sp >= 1 and d between 225 and 315 then 'onshore' when sp >= 1 and d between 45 and 135 then 'offshore' else 'unclassified' end as sector from wn) w using (ts) group by 1, 2",
          "wn as (select timestamp '2024-01-01' + to_hours((o_orderkey * 2)::int) as ts, (o_custkey % 360)::int as d, (o_custkey % 7)::int as sp from orders)"))
def wind_aligned(spark, sf):
    """Hours with the sector of their wind; hours without wind are unclassified."""
    o = table(spark, sf, "orders")
    wind = o.select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") * 2).cast("int"))).alias("ts"), indices.wind_sector(F.col("o_custkey") % 360, F.col("o_custkey") % 7).alias("sector"))
    return panel(spark, sf).join(wind, "ts", "left").groupBy("ts", F.coalesce("sector", F.lit("unclassified")).alias("sector")).agg(F.count(F.lit(1)).alias("n"), indices.tidy(F.avg("value")).alias("mean"))


@query(_q("select t.station_id, count(*) as n, round(avg(abs(o - t.value)), 6) as mae from (select p.*, (s - value) / (n - 1) as o from panel p join (select ts, sum(value) as s, count(*) as n from panel group by 1) using (ts) where n > 1) t group by 1"))
def left_self_out(spark, sf):
    """Each reading against the mean of all others of its hour, from the hour's sums less its own."""
    p = panel(spark, sf)
    sums = p.groupBy("ts").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = (F.col("s") - F.col("value")) / (F.col("n") - 1)
    return p.join(sums, "ts").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(other - F.col("value"))), 6).alias("mae"))


@query(_q("select *, round(100.0::double * n / sum(n) over (partition by hour), 6) as pct from (select event_type, hour(ts + interval '5 hours 30 minutes')::int as hour, count(*) as n from raw group by 1, 2)"))
def class_share_by_hour(spark, sf):
    hour = F.hour(timefn.local(F.col("ts")))
    n = raw(spark, sf).groupBy("event_type", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("hour")), 6))


@query(_q("select lo, round(regr_slope(r, km), 9) as slope, count(*) as n from simil join (select unnest([0, 10, 20]) as lo) on km >= lo and km < lo + 10 group by lo", _SIM))
def slope_by_distance(spark, sf):
    s = profiles.pairwise(_profile(spark, sf)).where("r is not null").join(spatial.distances(stations(spark)), ["a", "b"]).where("g_a <> g_b and km < 30")
    return s.groupBy((F.floor(F.col("km") / 10) * 10).cast("int").alias("lo")).agg(F.round(F.regr_slope("r", "km"), 9).alias("slope"), F.count(F.lit(1)).alias("n"))


_SP = f"sp as (select l_suppkey % 20 as k, {_SEASON.format('l_shipdate')} as season, day(l_shipdate) as d, avg(l_quantity) as m from lineitem group by all), fp as (select l_suppkey % 20 as k, day(l_shipdate) as d, avg(l_quantity) as m from lineitem group by all)"


@query("with " + _SP + f" select sp.k::int as k, season, round({_R.format('sp.m', 'fp.m')}, 6) as r, count(*) as n, round(max(sp.m) - min(sp.m), 6) as amplitude from sp join fp using (k, d) group by 1, 2")
def season_against_all(spark, sf):
    """A season's profile against that of the whole record, and its amplitude."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("k"), timefn.season(F.col("l_shipdate")).alias("season"), F.dayofmonth("l_shipdate").alias("d"), F.col("l_quantity").cast("double").alias("v"))
    parts = rows.groupBy("k", "season", "d").agg(F.avg("v").alias("m"))
    whole = rows.groupBy("k", "d").agg(F.avg("v").alias("f"))
    return parts.join(whole, ["k", "d"]).groupBy("k", "season").agg(F.round(profiles.pearson(F.col("m"), F.col("f")), 6).alias("r"), F.count(F.lit(1)).alias("n"), F.round(F.max("m") - F.min("m"), 6).alias("amplitude"))


@query(_q("select station_id, imbalance from (select station_id, round(avg(value) filter (hour(lt) < 12) - avg(value) filter (hour(lt) >= 12), 6) as imbalance from loc group by 1) order by abs(imbalance) desc, station_id limit 6"))
def most_imbalanced(spark, sf):
    """The six stations whose halves of the day differ most (a report's top-k)."""
    h = F.hour(timefn.local(F.col("ts")))
    d = F.avg(F.when(h < 12, F.col("value"))) - F.avg(F.when(h >= 12, F.col("value")))
    return panel(spark, sf).groupBy("station_id").agg(F.round(d, 6).alias("imbalance")).orderBy(F.abs("imbalance").desc(), "station_id").limit(6)


_GRID1 = " union all ".join(f"select {h}::int as hours, {c}::double as coverage, count(*) as windows, round(avg(mean), 6) as mean from (select station_id, floor((epoch(lt) - epoch((select date_trunc('day', min(lt))::timestamp from loc))) / {h * 3600})::bigint as win, round(avg(value), 6) as mean, count(*) as n from loc group by 1, 2) where n >= {c} * {h} having count(*) > 0" for h in (24, 168) for c in (0.25, 0.5))


@query(_q(_GRID1))
def configuration_grid(spark, sf):
    """Windows by length and coverage, every combination."""
    out = None
    for hours in (24, 168):
        w = windows.tumbling(panel(spark, sf), hours)
        grid = spark.createDataFrame([(hours, 0.25), (hours, 0.5)], "hours int, coverage double")
        part = w.crossJoin(F.broadcast(grid)).where(F.col("n") >= F.col("coverage") * F.col("hours")).groupBy("hours", "coverage").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("mean"), 6).alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_q("select id, round(least(x - 0, 10007 - x, y - 0, 10009 - y), 6) as edge_m, round(log10(x + 10), 9) as log_x from sites"))
def edge_distance(spark, sf):
    s = sites(spark, sf)
    return s.select("id", F.round(reports.edge_distance(F.col("x"), F.col("y"), (0.0, 0.0, 10007.0, 10009.0)), 6).alias("edge_m"), F.round(F.log10(F.col("x") + 10), 9).alias("log_x"))


_CELL = f"oc as (select distinct {_cell_of('lat', BOX[1], BOX[3], 10)} as i, {_cell_of('lon', BOX[0], BOX[2], 10)} as j from stations where station_id in (select station_id from raw where value is not null)), mk as (select {_cell_of('lat', BOX[1], BOX[3], 10)} as i, {_cell_of('lon', BOX[0], BOX[2], 10)} as j, (count(*) % 4)::int as flags from places group by 1, 2)"


def _mask(spark, sf):
    """Cells with places, flagged by their number of places, cleared where a station reports."""
    at = lambda df: df.select(geo.cell(F.col("lat"), BOX[1], BOX[3], 10).alias("i"), geo.cell(F.col("lon"), BOX[0], BOX[2], 10).alias("j"))
    grid = at(places(spark, sf)).groupBy("i", "j").agg((F.count(F.lit(1)) % 4).cast("int").alias("flags"))
    return reports.cleared(grid, at(reporting(spark, sf)))


@query(_q("select mk.i, mk.j, case when oc.i is null then flags else 0 end as flags from mk left join oc using (i, j)", _CELL))
def cleared_station_cells(spark, sf):
    return _mask(spark, sf)


@query(_q("select 'low' as feature, sum(f & 1)::bigint as n from cl union all select 'high', sum((f >> 1) & 1)::bigint from cl", _CELL, "cl as (select case when oc.i is null then flags else 0 end as f from mk left join oc using (i, j))"))
def mask_reason_totals(spark, sf):
    return reports.reason_totals(_mask(spark, sf), ["low", "high"])


def _corner(a: int, b: int) -> str:
    lat, lon = (BOX[3] - BOX[1]) / 10, (BOX[2] - BOX[0]) / 10
    return f"printf('%.4f %.4f', {BOX[0]}::double + (j + {b}) * {lon}::double, {BOX[1]}::double + (i + {a}) * {lat}::double)"


@query(_q(f"select i, j, {_corner(0, 0)} || ', ' || {_corner(0, 1)} || ', ' || {_corner(1, 1)} || ', ' || {_corner(1, 0)} as polygon, n from (select {_cell_of('lat', BOX[1], BOX[3], 10)} as i, {_cell_of('lon', BOX[0], BOX[2], 10)} as j, count(*) as n from places group by 1, 2)"))
def cell_polygons(spark, sf):
    """Polygons of the cells that hold places."""
    held = places(spark, sf).groupBy(geo.cell(F.col("lat"), BOX[1], BOX[3], 10).alias("i"), geo.cell(F.col("lon"), BOX[0], BOX[2], 10).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return held.select("i", "j", reports.cell_polygon(F.col("i"), F.col("j"), BOX, 10).alias("polygon"), "n")


@query("with t as (select o_orderkey, case when o_orderkey % 5 = 0 then strftime(o_orderdate, '%Y/%m/%d 08:30:00') else strftime(o_orderdate, '%d-%m-%Y 08:30:00') end as s, case when o_orderkey % 3 = 0 then '-' || o_custkey else o_custkey::varchar end as v, 'pm_2.' || (o_orderkey % 7)::varchar as c from orders) select o_orderkey, try_strptime(s, '%d-%m-%Y %H:%M:%S') - interval '5 hours 30 minutes' as ts, case when v::double >= 0 then v::double end as value, upper(replace(replace(c, '.', ''), '_', '')) = 'PM25' as is_pm25, coalesce(case when o_orderkey % 5 = 0 then null else s end, v) as alias from t")
def feed_fields(spark, sf):
    """A feed's fields: local stamps to UTC (bad ones null), numbers that can't be negative, codes without case and marks, the first alias that is there."""
    odd = F.col("o_orderkey") % 5 == 0
    t = table(spark, sf, "orders").select(
        "o_orderkey", F.when(odd, F.date_format("o_orderdate", "yyyy/MM/dd 08:30:00")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy 08:30:00")).alias("s"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.col("o_custkey").cast("string")).alias("v"), F.concat(F.lit("pm_2."), (F.col("o_orderkey") % 7).cast("string")).alias("c"),
    )
    ts = F.to_utc_timestamp(F.try_to_timestamp("s", F.lit("dd-MM-yyyy HH:mm:ss")), "Asia/Kolkata").cast("timestamp_ntz")
    return t.select("o_orderkey", ts.alias("ts"), indices.number(F.col("v")).alias("value"), (indices.code(F.col("c")) == "PM25").alias("is_pm25"), F.coalesce(F.when(~odd, F.col("s")), F.col("v")).alias("alias"))


@query(_q("select 1 as step, arg_min(id, (r, id)) as removed, min(r) as r from w", _UN.split(", rk as")[0],
          "t as (select count(*) - 1 as m, sum(level) as sx, sum(lat) as sy, sum(level * level) as sxx, sum(lat * lat) as syy, sum(level * lat) as sxy from un)",
          "d as (select id, m, sx - level as sx, sy - lat as sy, sxx - level * level as sxx, syy - lat * lat as syy, sxy - level * lat as sxy from un, t)",
          "w as (select id, round((m * sxy - sx * sy) / nullif(sqrt(greatest((m * sxx - sx * sx) * (m * syy - sy * sy), 0)), 0), 6) as r from d)"))
def greedy_deletion(spark, sf):
    """The first step of the adversarial deletion (more steps are tested against brute force)."""
    u = panel(spark, sf).groupBy("station_id").agg(F.round(F.avg("value"), 6).alias("level")).join(stations(spark).select("station_id", "lat"), "station_id")
    return reports.greedy_deletion(u, "station_id", "level", "lat", 1)


@query(_q("select ts, round(median(value), 6) as median, count(*) as n from panel group by ts having count(*) >= 10"))
def city_median(spark, sf):
    return panel(spark, sf).groupBy("ts").agg(F.round(F.median("value"), 6).alias("median"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query(_q("select station_id, ts, round((value - avg(value) over w) / case when stddev_pop(value) over w > 1e-6 then stddev_pop(value) over w else 1 end + 1e-9, 6) as z from panel window w as (partition by ts) qualify count(*) over w >= 10"))
def scores_by_hour(spark, sf):
    w = W.partitionBy("ts")
    sd = F.stddev_pop("value").over(w)
    z = (F.col("value") - F.avg("value").over(w)) / F.when(sd > 1e-6, sd).otherwise(1.0)
    return panel(spark, sf).withColumns({"z": indices.tidy(z), "n": F.count(F.lit(1)).over(w)}).where("n >= 10").select("station_id", "ts", "z")


@query(_q("select station_id, round(case when count(*) >= 2 then covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0) end, 6) as r, round(sqrt(greatest(2 * covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0) / nullif(1 + covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0), 0), 0)), 6) as ceiling, round(24 * covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0) / nullif(1 + 23 * covar_pop(e, o) / nullif(stddev_pop(e) * stddev_pop(o), 0), 0), 6) as r24 from (select station_id, hour, max(mean) filter (half = 0) as e, max(mean) filter (half = 1) as o from hp group by 1, 2) where e is not null and o is not null group by 1", _HALVES.split(", hw as")[0]))
def reliability_forms(spark, sf):
    """Split-half correlation of a station's profile, the ceiling it sets, and the reliability of 24 hours."""
    t = timefn.local(F.col("ts"))
    half = F.pmod(F.datediff(t, F.lit("1970-01-01")), F.lit(2))
    side = lambda k: F.avg(F.when(half == k, F.col("value")))
    r = panel(spark, sf).groupBy("station_id", F.hour(t).alias("hour")).agg(side(0).alias("e"), side(1).alias("o")).where("e is not null and o is not null").groupBy("station_id").agg(profiles.pearson(F.col("e"), F.col("o")).alias("r"))
    brown = 2 * F.col("r") / F.nullif(1 + F.col("r"), F.lit(0.0))
    return r.select("station_id", F.round("r", 6).alias("r"), F.round(F.sqrt(F.greatest(brown, F.lit(0.0))), 6).alias("ceiling"), F.round(24 * F.col("r") / F.nullif(1 + 23 * F.col("r"), F.lit(0.0)), 6).alias("r24"))
