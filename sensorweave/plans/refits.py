"""Queries of models refitted by fold and by block of time, with the SQL of those that SQL can fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefn import local
from ..operators import crossval, interpolation, trees
from .models import map_features
from .oracles import _POWERS, _WSUMS, _q
from .panel import panel, sites, stations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Held-out blocks of time, and hours that a station must have in one.
HELD, LEAST = 3, 24
FEATURES = ("dist_major_road_m", "road_density_500m", "road_density_1km", "dist_coast_m", "dist_industrial_m", "building_density_500m")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _fits(spark, sf, block=None):
    """Hours, stations, sums of errors of powers."""
    rows, net = crossval.hours(panel(spark, sf), block), crossval.network(stations(spark))
    return rows, net, crossval.power_errors(rows, net)


def _with_features(spark, sf):
    """Stations by their places on the map of sites, as far as there are such sites."""
    s = stations(spark)
    at = map_features(spark, sf, sites(spark, sf).join(s.select(F.col("station_id").alias("id")), "id", "left_semi"))
    return crossval.network(s.join(at.withColumnRenamed("id", "station_id"), "station_id", "left"), FEATURES)


_EST = _WSUMS.format(powers=_POWERS).replace("select f.fold, tot.power,", "select f.fold, tot.power, tot.ts,")
_IDW = "select {held} t.station_id, t.ts, any_value(t.value) as observed, sum(s.value * pow(greatest(km, 0.05), -cp.power)) / sum(pow(greatest(km, 0.05), -cp.power)) as idw, avg(s.value) as city, any_value(gt.gid) as g from panel t join stations gt using (station_id) join cp on cp.fold = gt.gid {where} join panel s on s.ts = t.ts join stations gs on gs.station_id = s.station_id and gs.gid <> gt.gid join links on links.a = t.station_id and links.b = s.station_id group by all"

_CARD = f"""select model, power, mae, rmse, worst, best, hours, stations, folds, a, b, floor, overall, '{{"model":"' || model || '",' || case when power is null then '' else '"power":' || power || ',' end || '"hours":' || hours || ',"folds":' || folds || '}}' as card
from (select model, round(sum(n * mae) / sum(n), 6) as mae, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) as rmse, max(rmse) as worst, min(rmse) as best, sum(n)::bigint as hours, count(*) as stations, count(distinct g) as folds from sc group by 1)
left join (select 'idw' as model, min({{'rmse': rmse, 'power': power}}).power as power from (select power, round(sqrt(avg(pow(tn / td - obs, 2))), 6) as rmse from tot group by 1)) using (model)
left join (select 'idw' as model, round((wy - b * wx) / w, 5) as a, round(b, 5) as b, round(floor, 5) as floor, round(r, 5) as overall from (select *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) as b from (select sum(n) as w, sum(n * m) as wx, sum(n * e) as wy, sum(n * m * m) as wxx, sum(n * m * e) as wxy, min(e) as floor from bn)), (select sqrt(avg(pow(idw - observed, 2))) as r from l)) using (model)"""


@query(_q(_CARD, _EST, "cp as (select fold, min({'rmse': rmse, 'power': power}).power as power from byfold group by 1)", f"lf as ({_IDW.format(held='', where='')})",
          "sc as (select 'idw' as model, station_id, g, count(*) as n, round(avg(abs(idw - observed)), 6) as mae, round(sqrt(avg(pow(idw - observed, 2))), 6) as rmse from lf group by 2, 3 union all select 'regional_mean', station_id, g, count(*), round(avg(abs(city - observed)), 6), round(sqrt(avg(pow(city - observed, 2))), 6) from lf group by 2, 3)",
          "l as (select station_id, ts, observed, round(idw, 7) as idw from lf)", "ed as (select list_sort(list_distinct(quantile_cont(idw, [" + ", ".join(f"{k}/20.0::double" for k in range(21)) + "]))) as e from l)",
          "bn as (select greatest(0, least(len(e) - 2, len(list_filter(e, lambda q: q <= idw)) - 1)) as bin, count(*)::double as n, avg(idw) as m, sqrt(avg(pow(idw - observed, 2))) as e from l, ed group by 1 having count(*) >= 50)"))
def model_card(spark, sf):
    """The mean of the sources and inverse distance, each fold with the power that its sources chose; the production power, and its error bars."""
    rows, net, errors = _fits(spark, sf)
    chosen = crossval.best_powers(errors).persist()
    out = crossval.estimates(rows, net, crossval.as_fits(chosen))
    return _card(out, chosen)


def _card(out, chosen):
    bars = interpolation.error_bars(out.where("model = 'idw'").select(F.round("estimate", 7).alias("idw"), "observed"))
    own = chosen.where("fold is null").select(F.lit("idw").alias("model"), "power")
    bars = bars.select(F.lit("idw").alias("model"), "a", "b", "floor", F.col("rmse").alias("overall"))
    rows = crossval.comparison(crossval.station_scores(out)).join(own, "model", "left").join(bars, "model", "left")
    card = F.to_json(F.struct("model", "power", "hours", "folds"))
    return rows.select("model", "power", "mae", "rmse", "worst", "best", "hours", "stations", "folds", "a", "b", "floor", "overall", card.alias("card"))


@query()
def model_comparison(spark, sf):
    """The card of all five models, trees of 200 rounds with the six map features, a fold for each group."""
    rows, _, errors = _fits(spark, sf)
    net, chosen = _with_features(spark, sf), crossval.best_powers(errors).persist()
    powers = crossval.as_fits(chosen)
    variogram = crossval.variograms(crossval.pair_errors(rows, net), net, least=30)
    return _card(crossval.estimates(rows, net, powers, variogram, crossval.forests(rows, net, powers)), chosen)


@query()
def gbt_cv(spark, sf):
    """Plain and hybrid trees: 200 rounds, a fold for each group, the six map features."""
    rows, _, errors = _fits(spark, sf)
    net, powers = _with_features(spark, sf), crossval.as_fits(crossval.best_powers(errors))
    out = crossval.estimates(rows, net, powers, None, crossval.forests(rows, net, powers))
    return crossval.comparison(crossval.station_scores(out))


def _week():
    """Weeks stand in for months: the events span one month."""
    return F.floor(F.datediff(local(F.col("ts")), F.lit("2024-01-01")) / 7).cast("string")


_WEEK = "floor(date_diff('day', date '2024-01-01', (ts + interval '5 hours 30 minutes')::date) / 7)::bigint::varchar"
_CELL = "select case when held = '' then 'spatial_only' else 'spatial_time' end as scheme, block, '{model}' as model, g, station_id, count(*) as n, round(sqrt(avg(pow({x} - observed, 2))), 6) as rmse from lf join bl using (ts) group by all having count(*) >= " + str(LEAST)


@query(_q(f"{_CELL.format(model='idw', x='idw')} union all {_CELL.format(model='regional_mean', x='city')}", _EST, f"bl as (select distinct ts, {_WEEK} as block from panel)", f"tb as (select block from (select distinct block from bl) order by md5('1:' || block), block limit {HELD})",
          "hb as (select held, fold, power, round(sqrt(avg(e * e)), 6) as rmse from est join bl using (ts), (select '' as held union all select block from tb) where block <> held group by all)", "cp as (select held, fold, min({'rmse': rmse, 'power': power}).power as power from hb group by all)",
          f"lf as ({_IDW.format(held='cp.held,', where=f'join bl tb1 on tb1.ts = t.ts and tb1.block in (select block from tb) and (cp.held = tb1.block or cp.held = {chr(39) * 2})')})"))
def time_block_refit(spark, sf):
    """Errors on held-out weeks, with powers fitted on all hours or without the week."""
    rows, net, errors = _fits(spark, sf, _week())
    held = crossval.sampled_blocks(rows, HELD)
    powers = crossval.as_fits(crossval.best_powers(errors, held))
    return crossval.time_block_scores(crossval.estimates(rows, net, powers), held, LEAST)


@query()
def time_block_models(spark, sf):
    """The same for all five models, in means over stations; 60 rounds of trees, as each fold is fitted four times."""
    rows, _, errors = _fits(spark, sf, _week())
    net, held = _with_features(spark, sf), crossval.sampled_blocks(rows, HELD)
    powers = crossval.as_fits(crossval.best_powers(errors, held))
    variogram = crossval.variograms(crossval.pair_errors(rows, net), net, held, 30)
    grown = crossval.forests(rows, net, powers, trees.Shape(rounds=60))
    out = crossval.time_block_scores(crossval.estimates(rows, net, powers, variogram, grown), held, LEAST)
    return out.groupBy("scheme", "block", "model").agg(F.count(F.lit(1)).alias("stations"), F.round(F.avg("rmse"), 6).alias("rmse"))
