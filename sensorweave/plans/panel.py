"""The stand-in sensor panel that queries run on, made of the events table, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from ..session import table

BOX = (72.70, 18.85, 73.20, 19.40)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 39 + 1).alias("station_id"), "event_id", "ts", "value", "event_type", (F.col("event_type") == "error").alias("flagged"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.hourly(raw(spark, sf)).select("station_id", "ts", "value")


def stations(spark: SparkSession) -> DataFrame:
    s = spark.range(1, 40).select(F.col("id").alias("station_id"), F.when(F.col("id") <= 8, F.floor((F.col("id") - 1) / 2)).otherwise(F.col("id")).cast("long").alias("gid"))
    return s.select(
        "station_id", "gid", F.when(F.col("station_id") <= 8, F.concat(F.lit("pair_"), F.col("gid").cast("string"))).otherwise(F.col("station_id").cast("string")).alias("cv_group"),
        (18.85 + 0.55 * (F.col("gid") * 37 % 101) / 101.0 + 0.003 * (F.col("station_id") % 2)).alias("lat"), (72.70 + 0.50 * (F.col("gid") * 53 % 97) / 97.0).alias("lon"),
    )


def reporting(spark: SparkSession, sf: str) -> DataFrame:
    """The stations that have a reading in the panel."""
    return stations(spark).join(raw(spark, sf).where("value is not null").select("station_id").distinct(), "station_id")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Places within the box, of customers."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), (18.85 + 0.55 * (F.col("c_custkey") * 31 % 997) / 997.0).alias("lat"), (72.70 + 0.50 * (F.col("c_custkey") * 17 % 991) / 991.0).alias("lon"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """A cloud of points in metres, of orders."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 7919 % 10007).cast("double").alias("x"), (F.col("o_orderkey") * 104729 % 10009).cast("double").alias("y"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Query points in metres, of suppliers."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3571 % 10007).cast("double").alias("x"), (F.col("s_suppkey") * 7321 % 10009).cast("double").alias("y"))


#: The same in DuckDB.
SQL = """
raw as (select user_id % 39 + 1 as station_id, event_id, ts, value, event_type, event_type = 'error' as flagged from events),
panel as (select station_id, date_trunc('hour', ts)::timestamp as ts, round(avg(value), 6) as value from raw group by 1, 2),
st0 as (select station_id::bigint as station_id, case when station_id <= 8 then ((station_id - 1) // 2) else station_id end::bigint as gid from (select unnest(range(1, 40)) as station_id)),
stations as (select station_id, gid, case when station_id <= 8 then 'pair_' || gid::varchar else station_id::varchar end as cv_group,
  18.85::double + 0.55::double * (gid * 37 % 101) / 101.0::double + 0.003::double * (station_id % 2) as lat, 72.70::double + 0.50::double * (gid * 53 % 97) / 97.0::double as lon from st0),
points as (select o_orderkey as id, (o_custkey * 7919 % 10007)::double as x, (o_orderkey * 104729 % 10009)::double as y from orders),
places as (select c_custkey as id, 18.85::double + 0.55::double * (c_custkey * 31 % 997) / 997.0::double as lat, 72.70::double + 0.50::double * (c_custkey * 17 % 991) / 991.0::double as lon from customer),
sites as (select s_suppkey as id, (s_suppkey * 3571 % 10007)::double as x, (s_suppkey * 7321 % 10009)::double as y from supplier),
loc as (select *, ts + interval '5 hours 30 minutes' as lt from panel),
prof as (select station_id, hour(lt)::int as hour, round(avg(value), 6) as mean, count(*) as n from loc group by 1, 2),
pairs as (select a.station_id as a, b.station_id as b, a.cv_group as g_a, b.cv_group as g_b, 2 * 6371.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double,
  pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) as km from stations a join stations b on a.station_id < b.station_id),
seen as (select a.* from pairs a where a.a in (select station_id from raw where value is not null) and a.b in (select station_id from raw where value is not null)),
links as (select a, b, km from pairs union all select b, a, km from pairs),
logo as (select t.station_id, t.ts, any_value(t.value) as observed, sum(s.value / pow(greatest(km, 0.05), 0.5)) / sum(1 / pow(greatest(km, 0.05), 0.5)) as idw, avg(s.value) as city, any_value(gt.gid) as g
  from panel t join stations gt using (station_id) join panel s on s.ts = t.ts join stations gs on gs.station_id = s.station_id and gs.gid <> gt.gid join links on links.a = t.station_id and links.b = s.station_id group by 1, 2),
citywide as (select ts, round(avg(value) + 1e-9, 6) as mean, count(*) as n from panel group by ts having count(*) >= 10),
wins as (select station_id, floor((epoch(lt) - epoch((select date_trunc('day', min(lt))::timestamp from loc))) / 86400)::bigint as win, round(avg(value), 6) as mean, count(*) as n from loc group by 1, 2),
cov as (select station_id, win, mean, n from (select *, count(*) over (partition by win) as k from wins where n >= 6) where k >= 10),
cx as (select *, mean - avg(mean) over (partition by win) as x from cov)
"""
