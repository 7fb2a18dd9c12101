"""Column expressions on time stamps; panels hold hours as zone-less UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def epoch_hour(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / 3600).cast("long")


def season(ts: Column) -> Column:
    """Year and season; December belongs to the year of its January."""
    m = F.month(ts)
    name = F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 9, "JJAS").otherwise("ON")
    return F.concat_ws("-", (F.year(ts) + (m == 12).cast("int")).cast("string"), name)


def clock(hour: Column) -> Column:
    """Hour of day on a twelve-hour clock."""
    h = F.pmod(hour.cast("int") + 11, F.lit(12)) + 1
    return F.concat(h.cast("string"), F.when(hour < 12, " am").otherwise(" pm"))
