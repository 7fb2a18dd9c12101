"""DuckDB SQL of the queries; all begin with the panel's common table expressions."""

from .panel import BOX, SQL
from .queries import _RING, BLOCK_DRAWS, GAP_DRAWS, MANTEL_DRAWS

_SCORES = """count(*) as n, round(avg(abs(idw - observed)), 6) as mae_idw, round(sqrt(avg(pow(idw - observed, 2))), 6) as rmse_idw, round(avg(abs(city - observed)), 6) as mae_city,
 round(sqrt(avg(pow(city - observed, 2))), 6) as rmse_city, round(sqrt(avg(pow(idw - observed, 2))) - sqrt(avg(pow(city - observed, 2))), 6) as gap"""
_COARSE = "coarse as (select station_id, ts, floor(value / 50) as value from panel)"
_RUNS = (
    _COARSE
    + """, brk as (select *, case when lag(value) over w = value and epoch(ts) - epoch(lag(ts) over w) = 3600 then 0 else 1 end as b from coarse window w as (partition by station_id order by ts)),
isl as (select *, sum(b) over (partition by station_id order by ts) as run_id from brk), runs as (select *, count(*) over (partition by station_id, run_id) as run_len from isl)"""
)
_KM = "2 * 6371.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
_R = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_SIM = f"""corrs as (select p.station_id as a, q.station_id as b, round({_R.format('p.mean', 'q.mean')}, 6) as r, count(*) as n from prof p join prof q on p.hour = q.hour and p.station_id < q.station_id group by 1, 2),
simil as (select c.a, c.b, c.r, km from corrs c join pairs using (a, b) where r is not null and g_a <> g_b)"""
_UNITS = "units as (select station_id, round(avg(value), 6) as level, round(stddev_pop(value), 6) as spread, any_value(lat) as lat, any_value(lon) as lon from panel join stations using (station_id) group by station_id)"
_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_SESS = """e as (select ts, case when epoch(ts) - epoch(lag(ts) over (order by ts)) <= {gap} * 3600 then 0 else 1 end as b from (select distinct ts from panel where value > {least})),
k as (select ts, sum(b) over (order by ts) as id from e), s as (select min(ts) as start_ts, max(ts) as end_ts, count(*) as n_hours from k group by id)"""
_GRID = "cells as (select i::int as i, j::int as j, {1}::double + (i + 0.5::double) * ({3}::double - {1}::double) / {n} as lat, {0}::double + (j + 0.5::double) * ({2}::double - {0}::double) / {n} as lon from (select unnest(range({n})) as i), (select unnest(range({n})) as j))"
_HOUR = "cur as (select station_id, lat, lon, value from panel join stations using (station_id) where ts = (select max(ts) from panel))"
_CW = f"cw as (select i, j, station_id, value, 1 / pow(greatest({_KM.format(a='cells.lat', b='cells.lon', c='cur.lat', d='cur.lon')}, 0.05), 0.5) as w from cells, cur)"
_SEASON = "(year({0}) + (month({0}) = 12)::int)::varchar || '-' || case when month({0}) in (12, 1, 2) then 'DJF' when month({0}) <= 5 then 'MAM' when month({0}) <= 9 then 'JJAS' else 'ON' end"
_BANDS = "case {0} end"
_MANTEL = f"""ids as (select distinct id from (select a as id from pairs union all select b from pairs)), num as (select id, row_number() over (order by id) as k from ids),
perm as (select rep, id as tgt, row_number() over (partition by rep order by md5('1:' || rep || ':' || id), id) as k from ids, (select unnest(range(1, {MANTEL_DRAWS + 1})) as rep)),
pm as (select rep, num.id, tgt from perm join num using (k) union all select 0, id, id from ids), both2 as (select a, b, r as x from simil union all select b, a, r from simil),
mv as (select p.rep, x, km from pairs join pm p on p.id = a join pm q on q.id = b and q.rep = p.rep join both2 s on s.a = p.tgt and s.b = q.tgt),
rr as (select rep, round(covar_pop(x, km) / nullif(stddev_pop(x) * stddev_pop(km), 0), 9) as r, count(*) as n from mv group by rep),
mantel as (select round(max(r) filter (rep = 0), 6) as r, max(n) filter (rep = 0) as n_pairs, round((count(*) filter (rep > 0 and abs(r) >= abs((select r from rr where rep = 0))) + 1) / {MANTEL_DRAWS + 1}.0::double, 6) as p from rr)"""
_POWERS = "[0.1, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0]::double[]"
_WSUMS = """ps as (select t.station_id, gt.gid as g, t.ts, gs.gid as sg, any_value(t.value) as obs, count(*) as c, sum(pow(greatest(km, 0.05), -p.power)) as d, sum(pow(greatest(km, 0.05), -p.power) * s.value) as n, p.power
 from panel t join stations gt using (station_id) join panel s on s.ts = t.ts join stations gs on gs.station_id = s.station_id and gs.gid <> gt.gid join links on links.a = t.station_id and links.b = s.station_id, (select unnest({powers}) as power) p group by t.station_id, gt.gid, t.ts, gs.gid, p.power),
tot as (select station_id, g, ts, power, sum(c) as tc, sum(d) as td, sum(n) as tn, any_value(obs) as obs from ps group by all),
folds as (select distinct sg as fold from ps),
est as (select f.fold, tot.power, (tn - coalesce(x.n, 0)) / (td - coalesce(x.d, 0)) - tot.obs as e from tot join folds f on f.fold <> tot.g left join ps x on x.station_id = tot.station_id and x.ts = tot.ts and x.power = tot.power and x.sg = f.fold where tc - coalesce(x.c, 0) > 0),
byfold as (select fold, power, round(sqrt(avg(e * e)), 6) as rmse from est group by 1, 2)"""


def _in(x: str, bands, value) -> str:
    return " ".join(f"when {x} <= {b[1]} then {value(b)}" for b in bands)


def _q(select: str, *ctes: str) -> str:
    return "with " + ", ".join([SQL.strip(), *ctes]) + " " + select


def _aqi() -> str:
    from ..functions.indices import PM25_BANDS as B

    x = "greatest(round(value, 1), 0.0::double)"
    band = _in(x, B, lambda b: f"round_even({b[2]}::double + {b[3] - b[2]} * ({x} - {b[0]}::double) / {b[1] - b[0]}::double, 0)::int")
    return f"select station_id, ts, (case {band} else 500 end)::int as aqi, case {_in(x, B, lambda b: repr(b[4]))} else '{B[-1][4]}' end as category from panel"


def _cell_of(x: str, low: float, high: float, n: int) -> str:
    return f"greatest(0, least({n - 1}, ceil(({x} - {low}::double) / (({high}::double - {low}::double) / {n})) - 1))::int"


def _inverse() -> str:
    from ..functions.indices import INDEX_BANDS as B

    band = _in("x", B, lambda b: f"round_even({b[2]}::double + (x - {b[0]}::double) * {b[3] - b[2]!r}::double / {b[1] - b[0]}::double, 1)")
    return f"select x::bigint as aqi, case {band} else {B[-1][3]}::double end as conc, n from (select floor(value)::double as x, count(*) as n from events where value is not null group by 1)"


_STATS = " union all ".join(
    f"select '{c}' as feature, round(min({c}), 6) as min, round(max({c}), 6) as max, round(quantile_cont({c}, 0.01), 6) as p01, round(quantile_cont({c}, 0.99), 6) as p99, round(quantile_cont({c}, 0.5), 6) as median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) as iqr, round(stddev_samp({c}) / nullif(avg({c}), 0), 6) as cv, count(distinct {c}) as n_unique, count(*) filter ({c} = 0) as n_zero from lineitem"
    for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
)
_EDGES = ", ".join(f"({x1}::double, {y1}::double, {x2}::double, {y2}::double)" for (x1, y1), (x2, y2) in zip(_RING, [*_RING[1:], _RING[0]], strict=True))

ORACLES: dict[str, str] = {
    "city_vs_idw_logo": _q(f"select station_id, {_SCORES} from logo group by station_id"),
    "skill_overall": _q(f"select {_SCORES} from logo"),
    "skill_by_group": _q(f"select g, {_SCORES} from logo group by g"),
    "clean_reason_counts": _q("select case when flagged then 'flagged' when value is null then 'null' when value <= 0 or value > 400 then 'range' else 'kept' end as reason, count(*) as n from raw group by 1"),
    "dedupe_hours": _q("select count(*) as cells, (sum(n) - count(*))::bigint as duplicates from (select count(*) as n from raw group by station_id, date_trunc('hour', ts))"),
    "hourly_panel": _q("select station_id, ts, value from panel"),
    "lone_spike_spatial": _q("select t.station_id, t.ts, any_value(t.value) as value, round(median(o.value), 6) as others from panel t join panel o on o.ts = t.ts and o.station_id <> t.station_id where t.value > 150 group by 1, 2 having median(o.value) < 50"),
    "lone_spike_temporal": _q("select t.station_id, t.ts, t.value, round(median(o.value), 6) as near_median from panel t join panel o on o.station_id = t.station_id and o.ts <> t.ts and abs(epoch(o.ts) - epoch(t.ts)) <= 10800 join (select station_id, quantile_cont(value, 0.9) as q from panel group by 1) z on z.station_id = t.station_id group by t.station_id, t.ts, t.value, q having count(*) >= 3 and t.value > 1.5 * median(o.value) and t.value > q"),
    "stuck_runs": _q("select station_id, ts, value, run_len from runs where run_len >= 3", _RUNS),
    "stuck_cost": _q("select station_id, count(*) filter (run_len >= 3) as masked_h, max(run_len) filter (run_len >= 3) as longest, count(*) as of_obs, round(100.0::double * count(*) filter (run_len >= 3) / count(*), 6) as pct from runs group by 1 having count(*) filter (run_len >= 3) > 0", _RUNS),
    "saturation_values": _q("select value, count(*) as n_stations from (select station_id, max(value) as value from coarse group by 1) group by 1 having count(*) >= 3", _COARSE),
    "station_quality": _q("select station_id, count(*) as n_obs, min(ts) as first_ts, max(ts) as last_ts, coalesce(max(gap), 0)::bigint as max_gap_h, round(100.0::double * count(*) / (select date_diff('hour', min(ts), max(ts)) + 1 from panel), 6) as coverage_pct from (select *, date_diff('hour', lag(ts) over (partition by station_id order by ts), ts) - 1 as gap from panel) group by 1"),
    "availability_by_type": _q("select station_id, string_agg(distinct event_type, ',' order by event_type) as kinds, count(distinct date_trunc('hour', ts)) filter (event_type = 'click') as hours_click, count(distinct date_trunc('hour', ts)) filter (event_type = 'view') as hours_view from raw group by 1"),
    "matched_panels": _q("select station_id, ts, a.value as value_a, b.value as value_b from one a join one b using (station_id, ts) where a.event_type = 'click' and b.event_type = 'view'", "one as (select event_type, station_id, date_trunc('hour', ts)::timestamp as ts, round(avg(value), 6) as value from raw group by all)"),
    "flat_sensors": _q("select station_id, round(cv, 6) as cv, cv < 0.9 * (select median(cv) from c) as flat from c", "c as (select station_id, stddev_samp(value) / nullif(avg(value), 0) as cv from panel group by 1)"),
    "complete_hours": _q("select s.station_id, h.ts, p.value from (select unnest(generate_series((select min(ts) from panel), (select max(ts) from panel), interval 1 hour)) as ts) h cross join (select distinct station_id from panel) s left join panel p on p.station_id = s.station_id and p.ts = h.ts"),
    "as_of_reading": _q("select q.station_id, q.\"at\", p.ts as as_of, p.value from q asof left join panel p on p.station_id = q.station_id and p.ts <= q.\"at\"", "q as (select distinct o_custkey % 39 + 1 as station_id, timestamp '2024-01-01' + to_hours(o_orderkey % 720) as \"at\" from orders)"),
    "proximity_pairs": _q("select a, b, round(km, 6) as km from seen where km < 6.0 and g_a <> g_b"),
    "distance_matrix": _q("select a, b, round(km, 6) as km from seen"),
    "diurnal_profile": _q("select * from prof"),
    "weekday_profile": _q("select station_id, (isodow(lt) - 1)::int as dow, round(avg(value), 6) as mean, count(*) as n from loc group by 1, 2"),
    "month_profile": "select month(l_shipdate)::int as month, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem group by 1",
    "profile_shape": _q("select station_id, hour, round((mean - avg(mean) over w) / case when stddev_pop(mean) over w > 1e-9 then stddev_pop(mean) over w else 1 end, 6) as z from prof window w as (partition by station_id)"),
    "profile_summary": _q("select station_id, min_by(hour, -mean * 1000 + hour * 1e-9) as peak, min_by(hour, mean * 1000 + hour * 1e-9) as trough, round(100 * (max(mean) - min(mean)) / nullif(avg(mean), 0), 6) as swing_pct, round(avg(mean) filter (hour between 6 and 10) - avg(mean) filter (hour between 18 and 22), 6) as balance from prof group by 1"),
    "profile_harmonics": _q("select station_id, round(sqrt(pow(sum(mean * cos(hour * pi() / 12)) / 12, 2) + pow(sum(mean * sin(hour * pi() / 12)) / 12, 2)), 6) as amp1, round(sqrt(pow(sum(mean * cos(hour * pi() / 6)) / 12, 2) + pow(sum(mean * sin(hour * pi() / 6)) / 12, 2)), 6) as amp2 from prof group by 1 having count(*) = 24"),
    "residualised_by_hour": _q("select station_id, ts, round(value - avg(value) over (partition by station_id, hour(lt)) + 1e-9, 6) as residual from loc"),
    "anomalies_by_hour": _q("select station_id, ts, round(a + 1e-9, 6) as anomaly from (select *, value - avg(value) over w as a, count(*) over w as n from panel window w as (partition by ts)) where n >= 10"),
    "profile_correlation_pairs": _q("select a, b, r, n from corrs", _SIM),
    "wide_pivot": _q("select ts, " + ", ".join(f"max(value) filter (station_id = {k}) as s{k}" for k in range(1, 40)) + " from panel group by ts"),
    "unpivot_bounds": _STATS,
    "season_windows": f"select l_returnflag, {_SEASON.format('l_shipdate')} as season, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem group by 1, 2",
    "tumbling_window_means": _q("select * from wins"),
    "coverage_filtered_windows": _q("select * from cov"),
    "city_hours": _q("select * from citywide"),
    "rolling_24h_city": _q("select ts, round(avg(mean) over (order by ts range between interval 23 hours preceding and current row) + 1e-9, 6) as rolling from c", "c as (select ts, round(avg(value) + 1e-9, 6) as mean from panel group by ts)"),
    "episodes": _q("select start_ts::timestamp as start_ts, end_ts, n_hours from s", _SESS.format(gap=6, least=200)),
    "top_pct_hours": _q("select ts, mean from c where mean >= (select quantile_cont(mean, 0.95) from c)", "c as (select ts, round(avg(value) + 1e-9, 6) as mean from panel group by ts)"),
    "sustained_spells": _q("select * from s where n_hours >= 5", _SESS.format(gap=3, least=150)),
    "sliding_windows": "with w as (select l_quantity as v, timestamp '1970-01-01' + to_days((15 * (floor(epoch(l_shipdate) / 86400 / 15) - k))::int) as start_ts from lineitem, (select unnest(range(0, 12)) as k)) select start_ts, round(avg(v), 6) as mean, count(*) as n from w group by 1",
    "icc_spatial_share": _q("select k as stations, round((select var_pop(m) from gg) / nullif((select var_pop(x) from cx), 0), 6) as share, round((ssb / (k - 1) - ssw / (t - k)) / nullif(ssb / (k - 1) + (n0 - 1) * ssw / (t - k), 0), 6) as icc from v", "gg as (select station_id, count(*) as n, avg(x) as m, sum(x) as s, sum(x * x) as ss from cx group by 1)", "v as (select count(*) as k, sum(n) as t, sum(n * m * m) - pow(sum(s), 2) / sum(n) as ssb, sum(ss) - sum(n * m * m) as ssw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) as n0 from gg having count(*) > 1)"),
    "split_half": _q("select n, round(r, 6) as r, round(2 * r / nullif(1 + r, 0), 6) as reliability from v", "h as (select station_id, avg(x) filter (win % 2 = 0) as e, avg(x) filter (win % 2 <> 0) as o from cx group by 1)", f"v as (select count(*) as n, {_R.format('e', 'o')} as r from h where e is not null and o is not null)"),
    "window_pair_reliability": _q(f"select p.win as a, q.win as b, round({_R.format('p.x', 'q.x')}, 6) as r, count(*) as n from cx p join cx q on p.station_id = q.station_id and p.win + 7 <= q.win group by 1, 2 having count(*) >= 10"),
    "sector_class": _q("select case when value / 10 < 1 then 'unclassified' when event_id * 37 % 360 between 225 and 315 then 'onshore' when event_id * 37 % 360 between 45 and 135 then 'offshore' else 'unclassified' end as sector, count(*) as n from raw group by 1"),
    "aqi_class": _q(_aqi()),
    "aqi_inverse": _inverse(),
    "split_name": "select p_partkey, trim(regexp_extract(x, '^(.*) - (.*)$', 1)) as site, trim(regexp_extract(x, '^(.*) - (.*)$', 2)) as agency from (select p_partkey, p_name || ' - ' || p_brand as x from part)",
    "clock_labels": _q("select h as hour, ((h + 11) % 12 + 1)::varchar || case when h < 12 then ' am' else ' pm' end as label, case when n // 30 >= 30 then 'interpretable' when n // 30 >= 8 then 'thin' else 'too thin' end as thin from (select hour(lt) as h, count(*) as n from loc group by 1)"),
    "json_property": "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
    "nearest_station": _q("select id, case when m.km <= 2 then m.s end as station_id, case when m.km <= 2 then m.km end as km from (select id, min({'km': round(" + _KM.format(a="q.lat", b="q.lon", c="s.lat", d="s.lon") + ", 6), 's': s.station_id}) as m from q, stations s group by id)", "q as (select c_custkey as id, 18.85::double + 0.55::double * (c_custkey * 31 % 997) / 997.0::double as lat, 72.70::double + 0.5::double * (c_custkey * 17 % 991) / 991.0::double as lon from customer)"),
    "radius_count": _q("select s.id, count(p.id) as n from sites s left join points p on pow(s.x - p.x, 2) + pow(s.y - p.y, 2) <= 250000 group by s.id"),
    "nearest_point": _q("select s.id, round(min(sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))), 6) as distance from sites s, points p group by s.id"),
    "point_in_polygon": _q("select p.id, count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 as inside from points p, ed group by p.id", f"ed(x1, y1, x2, y2) as (values {_EDGES})"),
    "polyline_resample": _q("select id, k, j::int as j, round(x1 + (j + 0.5::double) / n * (x2 - x1), 6) as x, round(y1 + (j + 0.5::double) / n * (y2 - y1), 6) as y from (select *, unnest(range(n)) as j from sg)", "s0 as (select id, 0 as k, x as x1, y as y1, x + 95 as x2, y as y2 from sites union all select id, 1, x + 95, y, x + 95, y + 2 from sites)", "sg as (select *, greatest(1, round_even(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 10, 0))::int as n from s0)"),
    "grid_cells": _q("select i, j, round(lat, 6) as lat, round(lon, 6) as lon, coalesce(n, 0) as n from cells left join held using (i, j)", _GRID.format(*BOX, n=25), f"held as (select {_cell_of('lat', BOX[1], BOX[3], 25)} as i, {_cell_of('lon', BOX[0], BOX[2], 25)} as j, count(*) as n from places group by 1, 2)"),
    "idw_surface": _q("select i, j, round(sum(w * value) / sum(w), 6) as value from cw group by 1, 2", _GRID.format(*BOX, n=25), _HOUR, _CW),
    "idw_contributions": _q("select i, j, k as rank, share from (select *, row_number() over (partition by i, j order by share desc, station_id) as k from (select i, j, station_id, round(100 * w / sum(w) over (partition by i, j) + 1e-9, 6) as share from cw)) where k <= 5", _GRID.format(*BOX, n=5), _HOUR, _CW),
    "cell_history": _q("select ts, round(sum(w * value) / sum(w), 6) as value, count(*) as n from panel join ww using (station_id) group by ts", f"ww as (select station_id, 1 / pow(greatest({_KM.format(a='19.07::double', b='72.88::double', c='lat', d='lon')}, 0.05), 0.5) as w from stations)"),
    "extrapolation_mask": _q("select id, flags, flags <> 0 as masked, concat_ws(',', case when flags & 1 = 1 then 'x below' end, case when flags & 2 = 2 then 'x above' end, case when flags & 4 = 4 then 'y below' end, case when flags & 8 = 8 then 'y above' end) as reasons from f", "b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from sites)", "f as (select id, (case when x < x0 then 1 when x > x1 then 2 else 0 end + case when y < y0 then 4 when y > y1 then 8 else 0 end)::int as flags from points, b)"),
    "idw_power_by_fold": _q("select * from byfold", _WSUMS.format(powers=_POWERS)),
    "idw_power_selection": _q("select fold, m.power as power, m.rmse as rmse from (select fold, min({'rmse': rmse, 'power': power}) as m from byfold group by 1)", _WSUMS.format(powers=_POWERS)),
    "variogram_cloud": _q("select * from cl", "cl as (select p.a, p.b, count(*) as n, round(any_value(km), 6) as km, round(avg(pow(x.value - y.value, 2)) / 2, 6) as gamma from panel x join panel y on x.ts = y.ts and x.station_id < y.station_id join pairs p on p.a = x.station_id and p.b = y.station_id group by 1, 2 having count(*) >= 30)"),
    "variogram_bins": _q("select floor(km / (select max(km) * 1.001 / 15 from cl))::bigint as bin, round(avg(km), 6) as km, round(avg(gamma), 6) as gamma, count(*) as n from cl group by 1", "cl as (select p.a, p.b, count(*) as n, round(any_value(km), 6) as km, round(avg(pow(x.value - y.value, 2)) / 2, 6) as gamma from panel x join panel y on x.ts = y.ts and x.station_id < y.station_id join pairs p on p.a = x.station_id and p.b = y.station_id group by 1, 2 having count(*) >= 30)"),
    "calibration_bins": _q("select greatest(0, least(19, len(list_filter(e, lambda q: q <= idw)) - 1))::bigint as bin, count(*) as n, round(avg(idw), 5) as mean, round(sqrt(avg(pow(idw - observed, 2))), 5) as rmse from l, ed group by 1", "l as (select station_id, ts, observed, round(idw, 7) as idw from logo)", "ed as (select quantile_cont(idw, [" + ", ".join(f"{k}/20.0::double" for k in range(21)) + "]) as e from l)"),
    "distance_bins_similarity": _q("select (case when km < 2 then 0 when km < 5 then 1 when km < 10 then 2 when km < 15 then 3 when km < 20 then 4 when km < 30 then 5 else 6 end)::bigint as bin, count(*) as n_pairs, round(avg(km), 5) as km, round(avg(r), 5) as corr from simil group by 1", _SIM),
    "near_minus_far": _q("select round(avg(r) filter (km < 5) - avg(r) filter (km >= 15), 5) as contrast, count(*) filter (km < 5) as n_near, count(*) filter (km >= 15) as n_far from simil", _SIM),
    "spearman_grid": _q(f"select round({_R.format('rx', 'ry')}, 6) as rho, count(*) as n from (select {_RANK.format('level')} as rx, {_RANK.format('spread')} as ry from units)", _UNITS),
    "circular_mean_by_group": _q("select station_id, round((atan2(s, c) / (2 * pi()) * 24 + 24) % 24, 6) as mean_hour, round(sqrt(s * s + c * c), 6) as strength, n from (select station_id, avg(sin((hour(lt) + 0.5) * pi() / 12)) as s, avg(cos((hour(lt) + 0.5) * pi() / 12)) as c, count(*) as n from loc where value > 100 group by 1)"),
    "mardia_r": _q("select round(sqrt(greatest((rc * rc + rs * rs - 2 * rc * rs * cs) / nullif(1 - cs * cs, 0), 0)), 6) as R, n from " + f"(select {_R.format('r', 'c')} as rc, {_R.format('r', 's')} as rs, {_R.format('c', 's')} as cs, count(*) as n from (select sin(peak * pi() / 12) as s, cos(peak * pi() / 12) as c, {_RANK.format('swing_pct')} as r from sm))", "sm as (select station_id, min_by(hour, -mean * 1000 + hour * 1e-9) as peak, round(100 * (max(mean) - min(mean)) / nullif(avg(mean), 0), 6) as swing_pct from prof group by 1)"),
    "bh_adjust": "with t as (select p_partkey as name, pow((p_partkey * 7919 % 100003) / 100003.0::double, 4) as p from part), r as (select *, row_number() over (order by p, name) as k, count(*) over () as n from t) select name, p, round(least(1.0, min(p * n / k) over (order by k desc rows unbounded preceding)), 9) as p_adj from r",
    "mantel_md5": _q("select * from mantel", _SIM, _MANTEL),
    "bootstrap_gap_md5": _q("select round(quantile_cont(gap, 0.025), 5) as lo, round(quantile_cont(gap, 0.975), 5) as hi, (select round(sqrt(sum(se) / sum(n)) - sqrt(sum(sc) / sum(n)), 5) from sums) as gap from gaps", "sums as (select g, count(*) as n, sum(pow(idw - observed, 2)) as se, sum(pow(city - observed, 2)) as sc from logo group by g)", "num as (select g, row_number() over (order by g) - 1 as k from sums)", f"dr as (select rep, ('0x' || substr(md5('1:' || rep || ':' || slot), 1, 8))::bigint % (select count(*) from sums) as k from (select unnest(range(1, {GAP_DRAWS + 1})) as rep), (select unnest(range((select count(*) from sums))) as slot))", "gaps as (select rep, round(sqrt(sum(se) / sum(n)) - sqrt(sum(sc) / sum(n)), 9) as gap from dr join num using (k) join sums using (g) group by rep)"),
    "loo_pearson": _q("select u.station_id, round(" + _R.format("v.level", "v.spread") + ", 6) as r from units u join units v on u.station_id <> v.station_id group by 1", _UNITS),
    "signed_rank_w": _q(f"select round(coalesce(sum(rk) filter (gap > 0), 0), 6)::double as w_plus, count(*) as n from (select gap, {_RANK.format('abs(gap)')} as rk from gs where gap <> 0)", "gs as (select g, round(sqrt(avg(pow(idw - observed, 2))) - sqrt(avg(pow(city - observed, 2))), 6) as gap from logo group by g)"),
    "mann_whitney_u": _q(f"select round(sum(rk) filter (one) - count(*) filter (one) * (count(*) filter (one) + 1) / 2.0, 6)::double as u, count(*) filter (one) as n1, count(*) filter (not one) as n2 from (select station_id <= 8 as one, {_RANK.format('level')} as rk from units)", _UNITS),
    "ols_two_predictors": _q("select round(my - b1 * m1 - b2 * m2, 3) as b0, round(b1, 4) as b1, round(b2, 4) as b2, n from (select *, (s22 * s1y - s12 * s2y) / nullif(s11 * s22 - s12 * s12, 0) as b1, (s11 * s2y - s12 * s1y) / nullif(s11 * s22 - s12 * s12, 0) as b2 from (select var_pop(lat) as s11, var_pop(lon) as s22, covar_pop(lat, lon) as s12, covar_pop(lat, level) as s1y, covar_pop(lon, level) as s2y, avg(level) as my, avg(lat) as m1, avg(lon) as m2, count(*) as n from units))", _UNITS),
    "loo_r2cv": _q("select round(1 - sum(pow((u.level - m - b * (u.spread - x)), 2)) / sum(pow(u.level - m, 2)), 6) as r2cv, count(*) as n from units u join (select a.station_id, avg(v.level) as m, avg(v.spread) as x, covar_pop(v.spread, v.level) / var_pop(v.spread) as b from units a join units v on a.station_id <> v.station_id group by 1) using (station_id)", _UNITS),
    "verdict_table": _q("select r, p, case when p is null or r is null then 'undecided' when p >= 0.05 then 'no evidence' when r > 0 then 'supported' else 'opposite' end as verdict from mantel", _SIM, _MANTEL),
    "report_rollup": _q("select event_type, reason, count(*) as n from (select event_type, case when flagged then 'flagged' when value is null then 'null' when value <= 0 or value > 400 then 'range' else 'kept' end as reason from raw) group by rollup(event_type, reason)"),
    "outages": _q("select station_id, max(gap) as longest_gap_h from (select *, date_diff('hour', lag(ts) over (partition by station_id order by ts), ts) - 1 as gap from panel) group by 1 having max(gap) >= 6"),
    "half_of_days": _q("select day::varchar as day from (select day, row_number() over (order by md5('1:1:' || day), day) as k, count(*) over () as n from (select distinct ts::date as day from panel)) where k <= n // 2"),
    "common_window": _q("select p.* from panel p where ts between (select max(a) from e) and (select min(b) from e)", "e as (select station_id, min(ts) as a, max(ts) as b from panel group by 1)"),
    "time_block_skill": _q(f"select g, (floor(epoch(ts) / 86400)::bigint % 4) as block, {_SCORES} from logo group by 1, 2 having count(*) >= 24"),
    "panel_variants": _q("select v as variant, round(avg(value) filter (ok), 6) as mean, count(*) filter (ok) as n from (select value, unnest(['all', 'nospike', 'nozero', 'night']) as v, unnest([true, value <= 150, value > 0, hour(lt) >= 18 or hour(lt) <= 2]) as ok from loc) group by 1"),
    "jackknife_groups": _q(f"select g.cv_group, round({_R.format('level', 'spread')}, 6) as r from (select distinct cv_group from stations join panel using (station_id)) g join (select u.*, s.cv_group from units u join stations s using (station_id)) u on u.cv_group <> g.cv_group group by 1", _UNITS),
    "day_block_bootstrap": _q("select round(quantile_cont(mean, 0.025), 5) as lo, round(quantile_cont(mean, 0.975), 5) as hi, count(*) as n from m", "sums as (select floor(epoch(ts) / (168 * 3600))::bigint as c, sum(value) as s, count(*) as n from panel group by 1)", "num as (select c, row_number() over (order by c) - 1 as k from sums)", f"dr as (select rep, ('0x' || substr(md5('1:' || rep || ':' || slot), 1, 8))::bigint % (select count(*) from sums) as k from (select unnest(range(1, {BLOCK_DRAWS + 1})) as rep), (select unnest(range((select count(*) from sums))) as slot))", "m as (select rep, round(sum(s) / sum(n), 8) as mean from dr join num using (k) join sums using (c) group by rep)"),
    "reweighted_profile": _q("select station_id, hour, round(avg(m) + 1e-9, 6) as mean, count(*) as parts from (select station_id, hour(lt)::int as hour, dayofyear(lt) % 2 as part, avg(value) as m from loc group by 1, 2, 3) group by 1, 2"),
    "sector_difference": _q("select station_id, round((avg(x) filter (k between 225 and 315) - avg(x) filter (k between 45 and 135)) / nullif(stddev_pop(value), 0), 6) as effect, count(*) filter (k between 225 and 315) as n_one, count(*) filter (k between 45 and 135) as n_other from (select *, value - avg(value) over (partition by station_id, hour(lt)) as x, floor(epoch(ts) / 3600)::bigint * 37 % 360 as k from loc) group by 1 having count(*) filter (k between 225 and 315) >= 20 and count(*) filter (k between 45 and 135) >= 20"),
    "percentile_of_value": _q("select round(avg((mean < 60)::int), 6) as share, count(*) as n from (select ts, round(avg(value) + 1e-9, 6) as mean from panel group by ts)"),
    "station_inventory": _q("select station_id, count(distinct event_type) as kinds, date_diff('day', min(ts), max(ts))::int as span_days, count(distinct ts::date) as days from raw group by 1"),
    "haversine_to_box": _q("select id, round(sqrt(pow(greatest(18.9::double - lat, 0::double, lat - 19.2::double) * 111.2, 2) + pow(greatest(72.8::double - lon, 0::double, lon - 73.0::double) * 105.0, 2)), 6) as km_outside, greatest(0, least(24, ceil((lat - 18.85::double) / ((19.4::double - 18.85::double) / 25)) - 1))::int as i, greatest(0, least(24, ceil((lon - 72.7::double) / ((73.2::double - 72.7::double) / 25)) - 1))::int as j from places"),
    "union_and_difference": _q("select 'union' as op, (select count(*) from a) + (select count(*) from b) as n union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except all select * from b)", "a as (select station_id, ts from panel where value > 100)", "b as (select station_id, ts from panel where value < 120)"),
}
