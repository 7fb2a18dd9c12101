"""Screening of raw readings: (station_id, ts, value, flagged) in, clean panels and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefn import epoch_hour, hour_of


def first_failure(flagged: Column, value: Column, lo: float = 0.0, hi: float = 1000.0, excluded: Column | None = None) -> Column:
    """The first rule a reading breaks, in the order of the screening; null if it passes."""
    out = F.when(excluded, "excluded") if excluded is not None else F
    return out.when(flagged, "flagged").when(value.isNull(), "null").when((value <= lo) | (value > hi), "range")


def reason_counts(raw: DataFrame, **bounds) -> DataFrame:
    """Rows removed by each rule, in one pass; kept ones as 'kept'."""
    reason = first_failure(F.col("flagged"), F.col("value"), **bounds)
    return raw.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def hourly(raw: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of a station's readings of an hour, and how many there were."""
    return raw.groupBy("station_id", hour_of(F.col("ts")).alias("ts")).agg(F.round(F.avg("value"), digits).alias("value"), F.count(F.lit(1)).alias("n"))


def median_of(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    at = lambda k: F.try_element_at(values, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2)


def lone_spikes(panel: DataFrame, least: float = 150.0, regional: float = 50.0) -> DataFrame:
    """Readings over `least` while the other stations' median of that hour is under `regional`.

    Only hours that hold a candidate are joined back. The median without a reading's own value
    comes from the hour's sorted values with one occurrence of it taken out.
    """
    high = panel.where(F.col("value") > least)
    hours = panel.join(high.select("ts").distinct(), "ts", "left_semi").groupBy("ts").agg(F.sort_array(F.collect_list("value")).alias("vs"))
    own = F.array_position("vs", F.col("value")).cast("int")
    rest = F.concat(F.slice("vs", F.lit(1), own - 1), F.slice("vs", own + 1, F.size("vs")))
    return high.join(hours, "ts").withColumn("others", median_of(rest)).where(F.col("others") < regional).select("station_id", "ts", "value", "others")


def sudden_spikes(panel: DataFrame, times: float = 4.0, hours: int = 3, least: int = 3, q: float = 0.999) -> DataFrame:
    """Readings over `times` the median of the station's readings within `hours`, and over its own q-quantile."""
    w = W.partitionBy("station_id").orderBy("eh").rangeBetween(-hours, hours)
    near = F.transform(F.filter(F.collect_list(F.struct("eh", "value")).over(w), lambda x: x.eh != F.col("eh")), lambda x: x.value)
    out = panel.withColumn("eh", epoch_hour(F.col("ts"))).withColumn("near", F.sort_array(near))
    out = out.withColumn("top", F.percentile("value", F.lit(q)).over(W.partitionBy("station_id"))).withColumn("middle", median_of(F.col("near")))
    return out.where((F.size("near") >= least) & (F.col("value") > times * F.col("middle")) & (F.col("value") > F.col("top"))).select("station_id", "ts", "value", F.col("middle").alias("near_median"))


def shared_maxima(panel: DataFrame, stations: int = 3) -> DataFrame:
    """Values that are the maximum of several stations: a saturated instrument's ceiling."""
    top = panel.groupBy("station_id").agg(F.max("value").alias("value"))
    return top.groupBy("value").agg(F.count(F.lit(1)).alias("n_stations")).where(F.col("n_stations") >= stations)


def runs(panel: DataFrame) -> DataFrame:
    """panel with run_id and run_len: equal values in strictly consecutive hours of a station."""
    w = W.partitionBy("station_id").orderBy("ts")
    h = epoch_hour(F.col("ts"))
    new = F.coalesce((F.lag("value").over(w) != F.col("value")) | (h - F.lag(h).over(w) != 1), F.lit(True))
    out = panel.withColumn("run_id", F.sum(new.cast("long")).over(w))
    return out.withColumn("run_len", F.count(F.lit(1)).over(W.partitionBy("station_id", "run_id")))


def stuck(panel: DataFrame, least: int = 24) -> DataFrame:
    return runs(panel).where(F.col("run_len") >= least)


def stuck_cost(panel: DataFrame, least: int = 24) -> DataFrame:
    r = runs(panel)
    bad = F.col("run_len") >= least
    out = r.groupBy("station_id").agg(F.sum(bad.cast("long")).alias("masked_h"), F.max(F.when(bad, F.col("run_len"))).alias("longest"), F.count(F.lit(1)).alias("of_obs"))
    return out.where("masked_h > 0").withColumn("pct", F.round(100.0 * F.col("masked_h") / F.col("of_obs"), 6))


def quality(panel: DataFrame) -> DataFrame:
    """Per station: readings, coverage of the whole window, first, last and longest gap in hours."""
    w = W.partitionBy("station_id").orderBy("ts")
    h = epoch_hour(F.col("ts"))
    whole = panel.agg((F.max(h) - F.min(h) + 1).alias("window_h"))
    gaps = panel.withColumn("gap", h - F.lag(h).over(w) - 1)
    out = gaps.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_obs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_h"))
    return out.crossJoin(F.broadcast(whole)).withColumn("coverage_pct", F.round(100.0 * F.col("n_obs") / F.col("window_h"), 6)).drop("window_h")


def availability(raw: DataFrame, kinds: list[str]) -> DataFrame:
    """Per station: hours with a reading of each kind, and all kinds listed."""
    out = raw.groupBy("station_id").agg(
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"),
        *(F.count_distinct(F.when(F.col("event_type") == k, hour_of(F.col("ts")))).alias(f"hours_{k}") for k in kinds),
    )
    return out


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that two panels share."""
    return a.select("station_id", "ts", F.col("value").alias("value_a")).join(b.select("station_id", "ts", F.col("value").alias("value_b")), ["station_id", "ts"])


def flat_sensors(panel: DataFrame, share: float = 0.5) -> DataFrame:
    """Stations whose coefficient of variation is under a share of the median one."""
    cv = panel.groupBy("station_id").agg((F.stddev_samp("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("cv"))
    middle = cv.agg(F.percentile("cv", F.lit(0.5)).alias("middle"))
    return cv.crossJoin(F.broadcast(middle)).withColumn("flat", F.col("cv") < share * F.col("middle")).select("station_id", F.round("cv", 6).alias("cv"), "flat")


def complete_hours(panel: DataFrame) -> DataFrame:
    """Every station in every hour of the record, missing values null."""
    hours = panel.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    return hours.crossJoin(panel.select("station_id").distinct()).join(panel.select("station_id", "ts", "value"), ["station_id", "ts"], "left")


def as_of(queries: DataFrame, panel: DataFrame) -> DataFrame:
    """Latest reading of the station at or before each query (station_id, at): one sorted pass over both."""
    both = queries.select("station_id", F.col("at").alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("query")).unionByName(
        panel.select("station_id", "ts", "value", F.lit(False).alias("query"))
    )
    w = W.partitionBy("station_id").orderBy("ts", "query").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("query"), F.struct("ts", "value")), ignorenulls=True).over(w)
    return both.withColumn("last", last).where("query").select("station_id", F.col("ts").alias("at"), F.col("last.ts").alias("as_of"), F.col("last.value").alias("value"))


def restricted(readings: DataFrame, panel: DataFrame) -> DataFrame:
    """Readings of another quantity at the panel's stations and within its span, for a comparison on equal terms."""
    span = panel.agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    own = readings.join(panel.select("station_id").distinct(), "station_id", "left_semi")
    return own.crossJoin(F.broadcast(span)).where(F.col("ts").between(F.col("from_ts"), F.col("to_ts"))).drop("from_ts", "to_ts")
