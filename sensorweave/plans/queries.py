"""Queries over the stand-in panel and the other tables, each an operator applied."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, indices, timefn
from ..operators import cleaning, crossval, interpolation, profiles, resampling, spatial, validation, windows
from ..session import table
from .panel import BOX, panel, places, points, raw, reporting, sites, stations

QUERIES: dict = {}

#: Draws of the tests, in both engines: permutations of places, samples of groups and of weeks.
MANTEL_DRAWS, GAP_DRAWS, BLOCK_DRAWS = 2000, 2000, 400


def query(f):
    QUERIES[f.__name__] = f
    return f


def _level(spark, sf):
    return raw(spark, sf).withColumn("ts", timefn.hour_of(F.col("ts")))


def _coarse(spark, sf):
    return panel(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))


def _profile(spark, sf):
    return profiles.diurnal(panel(spark, sf))


def _days(spark, sf):
    return windows.covered(windows.tumbling(panel(spark, sf), 24), 24, 0.25, 10)


def _logo(spark, sf):
    return interpolation.held_out(panel(spark, sf), stations(spark))


@query
def city_vs_idw_logo(spark, sf):
    return interpolation.scores(_logo(spark, sf), "station_id")


@query
def skill_overall(spark, sf):
    return interpolation.scores(_logo(spark, sf))


@query
def skill_by_group(spark, sf):
    return interpolation.scores(_logo(spark, sf), "g")


@query
def clean_reason_counts(spark, sf):
    return cleaning.reason_counts(raw(spark, sf), hi=400.0)


@query
def dedupe_hours(spark, sf):
    return cleaning.hourly(raw(spark, sf)).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("n") - 1).alias("duplicates"))


@query
def hourly_panel(spark, sf):
    return panel(spark, sf)


@query
def lone_spike_spatial(spark, sf):
    return cleaning.lone_spikes(panel(spark, sf)).select("station_id", "ts", "value", F.round("others", 6).alias("others"))


@query
def lone_spike_temporal(spark, sf):
    return cleaning.sudden_spikes(panel(spark, sf), times=1.5, q=0.9).select("station_id", "ts", "value", F.round("near_median", 6).alias("near_median"))


@query
def stuck_runs(spark, sf):
    return cleaning.stuck(_coarse(spark, sf), 3).select("station_id", "ts", "value", "run_len")


@query
def stuck_cost(spark, sf):
    return cleaning.stuck_cost(_coarse(spark, sf), 3)


@query
def saturation_values(spark, sf):
    return cleaning.shared_maxima(_coarse(spark, sf))


@query
def station_quality(spark, sf):
    return cleaning.quality(panel(spark, sf))


@query
def availability_by_type(spark, sf):
    return cleaning.availability(raw(spark, sf), ["click", "view"])


@query
def matched_panels(spark, sf):
    r = raw(spark, sf)
    one = lambda k: cleaning.hourly(r.where(F.col("event_type") == k))
    return cleaning.matched(one("click"), one("view"))


@query
def flat_sensors(spark, sf):
    return cleaning.flat_sensors(panel(spark, sf), 0.9)


@query
def complete_hours(spark, sf):
    return cleaning.complete_hours(panel(spark, sf))


@query
def as_of_reading(spark, sf):
    q = table(spark, sf, "orders").select((F.col("o_custkey") % 39 + 1).alias("station_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 720).cast("int"))).alias("at")).distinct()
    return cleaning.as_of(q, panel(spark, sf))


@query
def proximity_pairs(spark, sf):
    return spatial.close_pairs(reporting(spark, sf), 6.0)


@query
def distance_matrix(spark, sf):
    return spatial.distances(reporting(spark, sf)).select("a", "b", F.round("km", 6).alias("km"))


@query
def diurnal_profile(spark, sf):
    return _profile(spark, sf)


@query
def weekday_profile(spark, sf):
    return profiles.by(panel(spark, sf), "dow", F.weekday(timefn.local(F.col("ts"))), "station_id")


@query
def month_profile(spark, sf):
    return profiles.by(table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value")), "month", F.month("ts"))


@query
def profile_shape(spark, sf):
    return profiles.shape(_profile(spark, sf))


@query
def profile_summary(spark, sf):
    return profiles.summary(_profile(spark, sf))


@query
def profile_harmonics(spark, sf):
    return profiles.harmonics(_profile(spark, sf)).select("station_id", "amp1", "amp2")


@query
def residualised_by_hour(spark, sf):
    return profiles.residuals(panel(spark, sf))


@query
def anomalies_by_hour(spark, sf):
    return profiles.anomalies(panel(spark, sf)).select("station_id", "ts", "anomaly")


@query
def profile_correlation_pairs(spark, sf):
    return profiles.pairwise(_profile(spark, sf))


@query
def wide_pivot(spark, sf):
    return profiles.wide(panel(spark, sf), list(range(1, 40)))


@query
def unpivot_bounds(spark, sf):
    return profiles.bounds(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


@query
def season_windows(spark, sf):
    return windows.seasons(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", "l_quantity")


@query
def tumbling_window_means(spark, sf):
    return windows.tumbling(panel(spark, sf), 24)


@query
def coverage_filtered_windows(spark, sf):
    return _days(spark, sf)


@query
def city_hours(spark, sf):
    return windows.city(panel(spark, sf))


@query
def rolling_24h_city(spark, sf):
    return windows.rolling(windows.city(panel(spark, sf), 1))


@query
def episodes(spark, sf):
    out = windows.episodes(panel(spark, sf).where("value > 200").select("ts").distinct())
    return out.select(F.col("start_ts"), F.col("end_ts"), "n_hours")


@query
def top_pct_hours(spark, sf):
    return windows.top_hours(windows.city(panel(spark, sf), 1), 5.0)


@query
def sustained_spells(spark, sf):
    out = windows.episodes(panel(spark, sf).where("value > 150").select("ts").distinct(), 3)
    return out.where("n_hours >= 5")


@query
def sliding_windows(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"))
    return windows.sliding(rows, 180, 15)


@query
def icc_spatial_share(spark, sf):
    return windows.spatial_share(_days(spark, sf))


@query
def split_half(spark, sf):
    return windows.split_half(_days(spark, sf))


@query
def window_pair_reliability(spark, sf):
    return windows.window_pairs(_days(spark, sf), 7)


@query
def sector_class(spark, sf):
    e = raw(spark, sf)
    c = indices.wind_sector((F.col("event_id") * 37 % 360).cast("double"), F.col("value") / 10)
    return e.groupBy(c.alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query
def aqi_class(spark, sf):
    return panel(spark, sf).select("station_id", "ts", indices.index_of(F.round("value", 1)).alias("aqi"), indices.category_of(F.round("value", 1)).alias("category"))


@query
def aqi_inverse(spark, sf):
    """Values of events, taken for indices, as concentrations."""
    aqi = raw(spark, sf).where("value is not null").groupBy(F.floor("value").cast("long").alias("aqi")).agg(F.count(F.lit(1)).alias("n"))
    return aqi.select("aqi", indices.concentration_of(F.col("aqi").cast("double")).alias("conc"), "n")


@query
def split_name(spark, sf):
    site, agency = indices.site_and_agency(F.concat_ws(" - ", "p_name", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", site.alias("site"), agency.alias("agency"))


@query
def clock_labels(spark, sf):
    """Local hours of the panel on a twelve-hour clock, and whether their readings on each day are enough to interpret."""
    hours = panel(spark, sf).groupBy(F.hour(timefn.local(F.col("ts"))).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select("hour", timefn.clock(F.col("hour")).alias("label"), indices.thin(F.floor(F.col("n") / 30)).alias("thin"))


@query
def json_property(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query
def nearest_station(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (18.85 + 0.55 * (F.col("c_custkey") * 31 % 997) / 997.0).alias("lat"), (72.70 + 0.5 * (F.col("c_custkey") * 17 % 991) / 991.0).alias("lon"))
    return spatial.nearest_station(q, stations(spark))


@query
def radius_count(spark, sf):
    return spatial.radius_count(sites(spark, sf), points(spark, sf), 500.0)


@query
def nearest_point(spark, sf):
    return spatial.nearest(sites(spark, sf), points(spark, sf), 50.0).select("id", F.round("distance", 6).alias("distance"))


_RING = [(1000.0, 1000.0), (8000.0, 1500.0), (6000.0, 5000.0), (9000.0, 9000.0), (2000.0, 7000.0), (4000.0, 4000.0)]


@query
def point_in_polygon(spark, sf):
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(_RING, [*_RING[1:], _RING[0]], strict=True)], "x1 double, y1 double, x2 double, y2 double")
    return spatial.inside(points(spark, sf), edges)


@query
def polyline_resample(spark, sf):
    s = sites(spark, sf)
    lines = s.select("id", F.array(F.struct("x", "y"), F.struct((F.col("x") + 95).alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 95).alias("x"), (F.col("y") + 2).alias("y"))).alias("pts"))
    return spatial.resample(spatial.segments(lines))


@query
def grid_cells(spark, sf):
    """Cells of a grid with the places that lie in each."""
    held = places(spark, sf).groupBy(geo.cell(F.col("lat"), BOX[1], BOX[3], 25).alias("i"), geo.cell(F.col("lon"), BOX[0], BOX[2], 25).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    cells = spatial.grid(spark, BOX, 25).select("i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return cells.join(held, ["i", "j"], "left").select("i", "j", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n"))


def _hour(spark, sf):
    p = panel(spark, sf)
    last = p.agg(F.max("ts").alias("ts"))
    return p.join(F.broadcast(last), "ts").join(stations(spark), "station_id").select("station_id", "lat", "lon", "value")


@query
def idw_surface(spark, sf):
    return spatial.surface(spatial.grid(spark, BOX, 25), _hour(spark, sf))


@query
def idw_contributions(spark, sf):
    return spatial.contributions(spatial.grid(spark, BOX, 5), _hour(spark, sf)).select("i", "j", F.col("rank").cast("long").alias("rank"), "share")


@query
def cell_history(spark, sf):
    at = spark.range(1).select(F.lit(19.07).alias("lat"), F.lit(72.88).alias("lon"))
    w = stations(spark).select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")).crossJoin(at).select("station_id", geo.idw_weight(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 0.5).alias("w"))
    return panel(spark, sf).join(F.broadcast(w), "station_id").groupBy("ts").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("value"), F.count(F.lit(1)).alias("n"))


@query
def extrapolation_mask(spark, sf):
    """All points against the ranges of the sites, as cells of a map stand against those of its stations."""
    names = ["x", "y"]
    out = spatial.mask(points(spark, sf), profiles.bounds(sites(spark, sf), names), ["id"], names)
    return out.select("id", "flags", "masked", spatial.reasons(F.col("flags"), names).alias("reasons"))


def _power_sums(spark, sf):
    return crossval.power_errors(crossval.hours(panel(spark, sf)), crossval.network(stations(spark)))


def _power_errors(spark, sf):
    return crossval.by_error(_power_sums(spark, sf))


@query
def idw_power_by_fold(spark, sf):
    return _power_errors(spark, sf).where("fold is not null").select("fold", "power", "rmse")


@query
def idw_power_selection(spark, sf):
    return crossval.best_powers(_power_sums(spark, sf)).where("fold is not null").select("fold", "power", "rmse")


@query
def variogram_cloud(spark, sf):
    return interpolation.cloud(panel(spark, sf), stations(spark), 30)


@query
def variogram_bins(spark, sf):
    return interpolation.cloud_bins(interpolation.cloud(panel(spark, sf), stations(spark), 30))


@query
def calibration_bins(spark, sf):
    p = _logo(spark, sf)
    return interpolation.calibration(p.withColumn("idw", F.round("idw", 7)), 20, 1)


@query
def kriging_cv(spark, sf):
    p, s = panel(spark, sf), stations(spark)
    net = crossval.network(s)
    fitted = crossval.variograms(crossval.pair_errors(crossval.hours(p), net), net, least=30)
    return interpolation.scores(interpolation.kriged(p, s, {g: v for (_, g), v in fitted.items()}), "g")


def _similar(spark, sf):
    return profiles.pairwise(_profile(spark, sf)).where("r is not null").join(spatial.distances(stations(spark)), ["a", "b"]).where("g_a <> g_b")


@query
def distance_bins_similarity(spark, sf):
    km = F.col("km")
    b = F.when(km < 2, 0).when(km < 5, 1).when(km < 10, 2).when(km < 15, 3).when(km < 20, 4).when(km < 30, 5).otherwise(6)
    return _similar(spark, sf).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("km"), 5).alias("km"), F.round(F.avg("r"), 5).alias("corr"))


@query
def near_minus_far(spark, sf):
    near, far = F.col("km") < 5, F.col("km") >= 15
    return _similar(spark, sf).agg(F.round(F.avg(F.when(near, F.col("r"))) - F.avg(F.when(far, F.col("r"))), 5).alias("contrast"), F.sum(near.cast("long")).alias("n_near"), F.sum(far.cast("long")).alias("n_far"))


def _units(spark, sf):
    return panel(spark, sf).groupBy("station_id").agg(F.round(F.avg("value"), 6).alias("level"), F.round(F.stddev_pop("value"), 6).alias("spread")).join(stations(spark), "station_id")


@query
def spearman_grid(spark, sf):
    return resampling.spearman(_units(spark, sf), "level", "spread")


@query
def circular_mean_by_group(spark, sf):
    rows = panel(spark, sf).where("value > 100").withColumn("h", F.hour(timefn.local(F.col("ts"))) + 0.5)
    return resampling.circular_mean(rows, "h", "station_id")


@query
def mardia_r(spark, sf):
    return resampling.circular_linear(profiles.summary(_profile(spark, sf)), "peak", "swing_pct")


@query
def bh_adjust(spark, sf):
    tests = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 7919 % 100003 / 100003.0).alias("p"))
    return resampling.adjusted(tests.withColumn("p", F.pow("p", F.lit(4))))


@query
def mantel_md5(spark, sf):
    return resampling.mantel(_similar(spark, sf).select("a", "b", F.col("r").alias("x")), spatial.distances(stations(spark)).select("a", "b", "km"), MANTEL_DRAWS)


@query
def bootstrap_gap_md5(spark, sf):
    return resampling.bootstrap_gap(_logo(spark, sf), "g", GAP_DRAWS).select(F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), F.round("gap", 5).alias("gap"))


@query
def loo_pearson(spark, sf):
    return resampling.without_each(_units(spark, sf), "level", "spread", "station_id")


@query
def signed_rank_w(spark, sf):
    return resampling.signed_ranks(interpolation.scores(_logo(spark, sf), "g"), "gap")


@query
def mann_whitney_u(spark, sf):
    return resampling.rank_sum(_units(spark, sf), "level", F.col("station_id") <= 8)


@query
def ols_two_predictors(spark, sf):
    return resampling.least_squares(_units(spark, sf), "level", "lat", "lon").select(F.round("b0", 3).alias("b0"), F.round("b1", 4).alias("b1"), F.round("b2", 4).alias("b2"), "n")


@query
def loo_r2cv(spark, sf):
    return resampling.held_out_skill(_units(spark, sf), "level", "spread")


@query
def verdict_table(spark, sf):
    m = mantel_md5(spark, sf)
    return m.select("r", "p", resampling.verdict(F.col("r"), F.col("p")).alias("verdict"))


@query
def report_rollup(spark, sf):
    r = raw(spark, sf).withColumn("reason", F.coalesce(cleaning.first_failure(F.col("flagged"), F.col("value"), hi=400.0), F.lit("kept")))
    return r.rollup("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def outages(spark, sf):
    return validation.outages(panel(spark, sf), 6)


@query
def half_of_days(spark, sf):
    days = panel(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    return validation.half_of(days, 1).select(F.col("day").cast("string").alias("day"))


@query
def common_window(spark, sf):
    return validation.common_window(panel(spark, sf), "station_id")


@query
def time_block_skill(spark, sf):
    return validation.time_blocks(_logo(spark, sf))


@query
def panel_variants(spark, sf):
    v = F.col("value")
    return validation.variants(panel(spark, sf), {"all": v.isNotNull(), "nospike": v <= 150, "nozero": v > 0, "night": (F.hour(timefn.local(F.col("ts"))) >= 18) | (F.hour(timefn.local(F.col("ts"))) <= 2)})


@query
def jackknife_groups(spark, sf):
    return validation.without_groups(_units(spark, sf), "level", "spread", "cv_group")


@query
def day_block_bootstrap(spark, sf):
    return validation.day_block_bootstrap(panel(spark, sf), n=BLOCK_DRAWS)


@query
def reweighted_profile(spark, sf):
    return validation.reweighted(panel(spark, sf), F.pmod(F.dayofyear(timefn.local(F.col("ts"))), F.lit(2)))


@query
def sector_difference(spark, sf):
    k = F.pmod(timefn.epoch_hour(F.col("ts")) * 37, F.lit(360))
    return validation.conditional_difference(panel(spark, sf), k.between(225, 315), k.between(45, 135), 20)


@query
def percentile_of_value(spark, sf):
    return validation.share_below(windows.city(panel(spark, sf), 1), "mean", 60.0)


@query
def incomplete_harmonics(spark, sf):
    return validation.incomplete_harmonics(_profile(spark, sf).where("hour % 7 <> 3"))


@query
def correlation_power(spark, sf):
    """Chance to see a rank correlation of several sizes with as many groups as report."""
    units = reporting(spark, sf).select(F.col("gid").alias("id")).distinct()
    return validation.correlation_power(units, (0.2, 0.3, 0.4, 0.5))


@query
def split_half_phase(spark, sf):
    return validation.split_half_phase(panel(spark, sf))


@query
def station_inventory(spark, sf):
    r = raw(spark, sf)
    span = F.datediff(F.max("ts"), F.min("ts"))
    return r.groupBy("station_id").agg(F.count_distinct("event_type").alias("kinds"), span.alias("span_days"), F.count_distinct(F.to_date("ts")).alias("days"))


@query
def haversine_to_box(spark, sf):
    return places(spark, sf).select("id", F.round(F.hypot(geo.beyond(F.col("lat"), 18.9, 19.2) * 111.2, geo.beyond(F.col("lon"), 72.8, 73.0) * 105.0), 6).alias("km_outside"), geo.cell(F.col("lat"), BOX[1], BOX[3], 25).alias("i"), geo.cell(F.col("lon"), BOX[0], BOX[2], 25).alias("j"))


@query
def union_and_difference(spark, sf):
    a = panel(spark, sf).where("value > 100").select("station_id", "ts")
    b = panel(spark, sf).where("value < 120").select("station_id", "ts")
    count = lambda k, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
    return count("union", a.union(b)).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", a.exceptAll(b)))
