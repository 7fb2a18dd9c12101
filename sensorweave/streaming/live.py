"""Live readings as streams: (station_id, ts, value) in, hourly panels, episodes and stuck runs out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: How late a reading may be.
LATE = "6 hours"


def timed(stream: DataFrame) -> DataFrame:
    """Event time with zone, as watermarks need."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_hour(stream: DataFrame, late: str = LATE) -> DataFrame:
    """The first reading of each station and hour; later ones within the watermark are dropped."""
    s = timed(stream).withColumn("hour", F.date_trunc("hour", "ts"))
    return s.withWatermark("ts", late).dropDuplicatesWithinWatermark(["station_id", "hour"])


def hourly(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Mean of each station and hour, once the watermark has passed it."""
    g = timed(stream).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "station_id")
    return g.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("station_id", F.col("w.start").alias("ts"), "value", "n")


def sliding_day(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Mean of the 24 hours up to each hour's end, the quantity that is published."""
    g = timed(stream).withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), "station_id")
    return g.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("station_id", F.col("w.end").alias("ts"), "value", "n")


def episodes(stream: DataFrame, least: float, bridge: str = "6 hours", late: str = LATE) -> DataFrame:
    """Sessions of high readings, any station; a gap of more than the bridge begins a new one."""
    s = timed(stream).where(F.col("value") > least).withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", bridge).alias("w")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n")).select("start_ts", "end_ts", "n")


def stuck_alarms(stream: DataFrame, least: int = 24, late: str = LATE, forget: int = 48) -> DataFrame:
    """A row when a station has sent one value in `least` consecutive hours: state is the last value, its hour, the run's length and hours that wait.

    Hours wait until the watermark has passed them and then count in order, so an hour that comes late (but within `late`) breaks or
    makes a run as in a batch; of several readings of an hour the first to arrive counts. A timer wakes a station for its waiting hours, and one
    that has been silent for `forget` hours loses its state.
    """
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, hour, run, hours, values = state.get if state.exists else (None, -10, 0, [], [])
        held = dict(zip(hours, values, strict=True))
        for pdf in batches:
            for v, h in zip(pdf["value"].tolist(), pdf["eh"].tolist(), strict=True):
                if h > hour:
                    held.setdefault(int(h), float(v))
        past = state.getCurrentWatermarkMs() // 3_600_000  # hours that end by then are complete
        out = []
        for h in sorted(k for k in held if k < past):
            v = held.pop(h)
            run = run + 1 if h == hour + 1 and v == value else 1
            value, hour = v, h
            if run == least:
                out.append((int(key[0]), hour, value, run))
        if not held and state.hasTimedOut and past >= hour + forget:
            state.remove()
        else:
            waiting = sorted(held)
            state.update((value, hour, run, waiting, [held[h] for h in waiting]))
            wake = waiting[0] + 1 if waiting else max(hour, past) + forget
            state.setTimeoutTimestamp(int(max(wake * 3_600_000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=["station_id", "eh", "value", "run"])

    s = timed(stream).withWatermark("ts", late).select("station_id", "ts", "value", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("eh"))
    held = "value double, hour long, run long, hours array<long>, values array<double>"
    out = s.groupBy("station_id").applyInPandasWithState(step, "station_id long, eh long, value double, run long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("station_id", F.timestamp_seconds(F.col("eh") * 3600).alias("ts"), "value", "run")


def fresh(readings: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """(station_id, newest, ok): whether each station's newest reading is at most so old."""
    newest = F.max("ts")
    return readings.groupBy("station_id").agg(newest.alias("newest"), (newest >= now - F.make_dt_interval(hours=F.lit(hours))).alias("ok"))


def every(stream: DataFrame, minutes: int = 15):
    """A writer that starts a batch every so many minutes."""
    return stream.writeStream.trigger(processingTime=f"{minutes} minutes")
