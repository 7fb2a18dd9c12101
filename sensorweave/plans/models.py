"""Queries of folds, error bars, regressions of groups and tests with p values, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossval, interpolation, regression, spatial
from ..session import table
from .oracles import _EDGES, _R, _RANK, _UNITS, _q
from .panel import panel, points, sites, stations
from .queries import _RING, _logo, _units

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Permutations and samples of groups, in both engines.
DRAWS = 2000


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query(_q("select fold, x.station_id as a, y.station_id as b, count(*) as n, round(any_value(km), 6) as km, round(avg(pow((x.value - y.value) / sd, 2)) / 2, 6) as gamma from panel x join panel y on x.ts = y.ts and x.station_id < y.station_id join pairs p on p.a = x.station_id and p.b = y.station_id join stations sa on sa.station_id = p.a join stations sb on sb.station_id = p.b join fs on fs.ts = x.ts and fold <> sa.gid and fold <> sb.gid group by 1, 2, 3 having count(*) >= 30",
          "fs as (select f.gid as fold, p.ts, case when stddev_pop(value) > 1e-6 then stddev_pop(value) else 1 end as sd from (select distinct gid from stations) f, panel p join stations s using (station_id) where s.gid <> f.gid group by 1, 2)"))
def variogram_cloud_by_fold(spark, sf):
    """Pairs of each fold's sources, on values standardised by their hour."""
    return crossval.fold_clouds(crossval.pair_errors(crossval.hours(panel(spark, sf)), crossval.network(stations(spark))), stations(spark), 30)


@query(_q("select round((wy - b * wx) / w, 5) as a, round(b, 5) as b, round(floor, 5) as floor, round(r, 5) as rmse from (select *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) as b from (select sum(n) as w, sum(n * m) as wx, sum(n * e) as wy, sum(n * m * m) as wxx, sum(n * m * e) as wxy, min(e) as floor from bn)), (select sqrt(avg(pow(idw - observed, 2))) as r from l)",
          "l as (select station_id, ts, observed, round(idw, 7) as idw from logo)", "ed as (select list_sort(list_distinct(quantile_cont(idw, [" + ", ".join(f"{k}/20.0::double" for k in range(21)) + "]))) as e from l)",
          "bn as (select greatest(0, least(len(e) - 2, len(list_filter(e, lambda q: q <= idw)) - 1)) as bin, count(*)::double as n, avg(idw) as m, sqrt(avg(pow(idw - observed, 2))) as e from l, ed group by 1 having count(*) >= 50)"))
def error_bars(spark, sf):
    return interpolation.error_bars(_logo(spark, sf).withColumn("idw", F.round("idw", 7)))


_GROUPS = "gu as (select gid as id, round(avg(level), 6) as y, round(avg(spread), 6) as z, round(avg(u.lat), 6) as x1, round(avg(u.lon), 6) as x2 from units u join stations s using (station_id) group by 1), num as (select id, row_number() over (order by id) as k from gu)"


def _groups(spark, sf):
    """Means of each group's stations: two outcomes and two predictors."""
    return _units(spark, sf).groupBy("gid").agg(F.round(F.avg("level"), 6).alias("y"), F.round(F.avg("spread"), 6).alias("z"), F.round(F.avg("lat"), 6).alias("x1"), F.round(F.avg("lon"), 6).alias("x2"))


def _skill(source: str, keys: str) -> str:
    k = f"window k as (partition by {keys})"
    away = ", ".join(f"{x} - sum(w * {x}) over k / sum(w) over k as {d}" for d, x in (("d1", "x1"), ("d2", "x2"), ("dy", "y")))
    sums = ", ".join(f"sum(w * d{a} * d{b}) over k as s{a}{b}" for a, b in ("11", "22", "12", "1y", "2y"))
    return f"""k1 as (select *, {away}, sum(w) over k as sw from {source} {k}), k2 as (select *, {sums} from k1 {k}), k3 as (select *, s11 * s22 - s12 * s12 as det from k2),
k4 as (select *, (s22 * s1y - s12 * s2y) / det as b1, (s11 * s2y - s12 * s1y) / det as b2, 1 / sw + (d1 * d1 * s22 - 2 * d1 * d2 * s12 + d2 * d2 * s11) / det as h from k3 where det > 1e-9 * s11 * s22),
sk as (select {keys}, round(1 - sum(w * pow((dy - b1 * d1 - b2 * d2) / (1 - w * h), 2)) / sum(w * pow(dy / (1 - w / sw), 2)), 9) as r2 from k4 group by {keys})"""


@query(_q(f"select round(max(r2) filter (rep = 0), 6) as r2, round((count(*) filter (rep > 0 and r2 >= (select r2 from sk where rep = 0)) + 1) / {DRAWS + 1}.0::double, 6) as p from sk", _UNITS, _GROUPS,
          f"pr as (select rep, id as tgt, row_number() over (partition by rep order by md5('1:' || rep || ':' || id), id) as k from gu, (select unnest(range(1, {DRAWS + 1})) as rep)), pm as (select rep, num.id, tgt from pr join num using (k) union all select 0, id, id from gu)",
          "rw as (select rep, 1.0::double as w, u.x1, u.x2, v.y from pm join gu u on u.id = pm.id join gu v on v.id = tgt)", _skill("rw", "rep")))
def permuted_skill(spark, sf):
    return regression.permuted_skill(_groups(spark, sf), "gid", "y", "x1", "x2", DRAWS)


@query(_q("select what, round(quantile_cont(r2, 0.025), 5) as lo, round(quantile_cont(r2, 0.975), 5) as hi, count(r2) as draws from (select rep, 'a' as what, a as r2 from pd union all select rep, 'b', b from pd union all select rep, 'a-b', a - b from pd) group by 1", _UNITS, _GROUPS,
          f"sl as (select rep, (('0x' || substr(md5('1:' || rep || ':' || slot), 1, 8))::bigint % (select count(*) from gu))::bigint + 1 as k from (select unnest(range(1, {DRAWS + 1})) as rep), (select unnest(range(0, (select count(*) from gu))) as slot))",
          "ml as (select rep, id, count(*)::double as w from sl join num using (k) group by 1, 2)", "rw as (select rep, 'a' as of, w, x1, x2, y from ml join gu using (id) union all select rep, 'b', w, x1, x2, z from ml join gu using (id))", _skill("rw", "rep, of"),
          "pd as (select rep, max(r2) filter (of = 'a') as a, max(r2) filter (of = 'b') as b from sk group by 1)"))
def paired_skill(spark, sf):
    return regression.paired_skill(_groups(spark, sf), "gid", "y", "z", "x1", "x2", DRAWS)


@query(_q("select term, round(beta, 6) as beta, round(se, 6) as se, round(beta / nullif(se, 0), 6) as t from (select 'x1' as term, b1 as beta, sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) as se from m2 union all select 'x2', b2, sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s11 / det) from m2)", _UNITS, _GROUPS,
          "m1 as (select var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as s1y, covar_pop(x2, y) as s2y, var_pop(y) as syy, count(*) as n, var_pop(x1) * var_pop(x2) - covar_pop(x1, x2) * covar_pop(x1, x2) as det from gu)",
          "m2 as (select *, (s22 * s1y - s12 * s2y) / det as b1, (s11 * s2y - s12 * s1y) / det as b2 from m1)"))
def regression_slopes(spark, sf):
    return regression.slopes(_groups(spark, sf), "y", "x1", "x2")


_ODD = "2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k + 1))))"
_EVEN = "sin(th) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k)))"


@query(_q(f"select rho, n, round(greatest(1 - case when n % 2 = 0 then {_EVEN} else {_ODD} end, 0), 6) as p from (select *, atan(abs(rho) / sqrt(1 - rho * rho)) as th from rr)", _UNITS, f"rr as (select round({_R.format('rx', 'ry')}, 6) as rho, count(*) as n from (select {_RANK.format('level')} as rx, {_RANK.format('spread')} as ry from units))"))
def rank_correlation_test(spark, sf):
    return regression.rank_correlation_test(_units(spark, sf), "level", "spread")


def _normal(z: str) -> str:
    return f"greatest(1 - list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({z} / sqrt(2)) - {z} * {z} / 2 - lgamma(k + 1.5)))), 0)"


@query(_q(f"select round(u, 6) as u, n1, n2, round(case when z <= 0 then 1 else {_normal('greatest(z, 1e-9)')} end, 6) as p from (select *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) as z from mw)", _UNITS,
          f"mw as (select (sum(rk) filter (one) - count(*) filter (one) * (count(*) filter (one) + 1) / 2.0)::double as u, count(*) filter (one) as n1, count(*) filter (not one) as n2, sum(t * t - 1)::double as ties from (select station_id <= 8 as one, {_RANK.format('level')} as rk, count(*) over (partition by level) as t from units))"))
def rank_sum_test(spark, sf):
    return regression.rank_sum_test(_units(spark, sf), "level", F.col("station_id") <= 8)


@query(_q("select round(w, 6) as w_plus, n, round(least(1, 2 * list_sum(c[1:least(w, n * (n + 1) / 2.0 - w)::bigint + 1])), 6) as p from sr, dp where k = n", "sc as (select g, round(sqrt(avg(pow(idw - observed, 2))) - sqrt(avg(pow(city - observed, 2))), 6) as gap from logo group by 1)",
          f"sr as (select sum(case when gap > 0 then rk else 0 end)::double as w, count(*) as n from (select gap, {_RANK.format('abs(gap)')} as rk from sc where gap <> 0))",
          "dp as (with recursive d(k, c) as (select 0::bigint, list_transform(range(0, (select n * (n + 1) // 2 + 1 from sr)), lambda i: case when i = 0 then 1.0::double else 0 end) union all select k + 1, list_transform(range(0, len(c)), lambda i: (c[i + 1] + case when i >= k + 1 then c[i - k] else 0 end) / 2) from d where k < (select n from sr)) select * from d)"))
def signed_rank_test(spark, sf):
    """Exact where no gaps are tied, as here."""
    return regression.signed_rank_test(interpolation.scores(_logo(spark, sf), "g"), "gap")


def _least(layer: str, name: str) -> str:
    return f"(select s.id, round(min(sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))) + 1e-9, 1) as {name} from sites s, {layer} p group by 1)"


def _dense(layer: str, metres: int, each: str, name: str, places: int) -> str:
    return f"(select s.id, round(count(p.x) * ({each} / (pi() * pow({metres} / 1000.0, 2))), {places}) as {name} from sites s left join {layer} p on pow(s.x - p.x, 2) + pow(s.y - p.y, 2) <= {metres * metres} group by 1)"


@query(_q("select id, dist_major_road_m, road_density_500m, road_density_1km, dist_coast_m, case when inside then 0 else rim end as dist_industrial_m, building_density_500m from " + " join ".join([
              _least("mj", "dist_major_road_m"), _dense("points", 500, "0.01", "road_density_500m", 2) + " using (id)", _dense("points", 1000, "0.01", "road_density_1km", 2) + " using (id)", _least("co", "dist_coast_m") + " using (id)",
              _least("rm", "rim") + " using (id)", "(select s.id, count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 as inside from sites s, ed group by 1) using (id)", _dense("bl", 500, "1", "building_density_500m", 1) + " using (id)"]),
          f"ed(x1, y1, x2, y2) as (values {_EDGES})", "el as (select *, greatest(1, round_even(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 10, 0))::int as n from ed)", "rm as (select x1 + (j + 0.5::double) / n * (x2 - x1) as x, y1 + (j + 0.5::double) / n * (y2 - y1) as y from (select *, unnest(range(n)) as j from el))",
          "mj as (select (c_custkey * 7919 % 10007)::double as x, (c_custkey * 3571 % 10009)::double as y from customer)", "co as (select -50.0::double as x, 5.0::double + 10 * k as y from (select unnest(range(1000)) as k))", "bl as (select (p_partkey * 104729 % 10007)::double as x, (p_partkey * 7321 % 10009)::double as y from part)"))
def features_for(spark, sf):
    """Features of the sites: customers stand in for points of major roads, orders for those of all roads, parts for buildings."""
    return map_features(spark, sf, sites(spark, sf))


def map_features(spark, sf, places):
    at = lambda name, key, a, b: table(spark, sf, name).select((F.col(key) * a % 10007).cast("double").alias("x"), (F.col(key) * b % 10009).cast("double").alias("y"))
    coast = spark.range(1000).select(F.lit(-50.0).alias("x"), (5.0 + 10 * F.col("id")).alias("y"))
    edges = spark.createDataFrame([(k, 0, *a, *b) for k, (a, b) in enumerate(zip(_RING, [*_RING[1:], _RING[0]], strict=True))], "id long, k long, x1 double, y1 double, x2 double, y2 double")
    return spatial.features_for(places, at("customer", "c_custkey", 7919, 3571), points(spark, sf).select("x", "y"), coast, edges, at("part", "p_partkey", 104729, 7321))
