"""Files in and out: nested geometry, column arrays, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "array<struct<lat: double, lon: double>>"
OSM = f"elements array<struct<type: string, id: long, tags: map<string, string>, geometry: {GEOMETRY}, members: array<struct<type: string, geometry: {GEOMETRY}>>>>"


def osm_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, tags, pts) of ways and of relations' ways, from map payloads (.json or .json.gz) with a declared schema."""
    e = spark.read.schema(OSM).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    ways = e.where("e.type = 'way'").select("e.id", F.lit(0).alias("part"), "e.tags", F.col("e.geometry").alias("pts"))
    members = e.where("e.type = 'relation'").select("e.id", "e.tags", F.posexplode("e.members").alias("part", "m")).where("m.type = 'way'").select("id", "part", "tags", F.col("m.geometry").alias("pts"))
    return ways.unionByName(members).where("size(pts) >= 2")


def roads(lines: DataFrame, kinds: tuple[str, ...] = ("motorway", "trunk", "primary", "secondary")) -> DataFrame:
    """Lines of those highway classes and of their links."""
    return lines.where(F.element_at("tags", "highway").isin(*kinds, *(f"{k}_link" for k in kinds)))


def column_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Wind by hour from a file of parallel arrays; km/h become m/s."""
    schema = "hourly struct<time: array<string>, wind_speed_10m: array<double>, wind_direction_10m: array<double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(F.arrays_zip("hourly.time", "hourly.wind_speed_10m", "hourly.wind_direction_10m")).alias("r"))
    return rows.select(F.to_timestamp_ntz("r.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), (F.col("r.wind_speed_10m") / 3.6).alias("speed_ms"), F.col("r.wind_direction_10m").alias("direction"))


def covers(rows: DataFrame, start: str, end: str) -> bool:
    """Whether the hours reach from start to end."""
    r = rows.agg(F.min("ts") <= F.lit(start).cast("timestamp_ntz"), F.max("ts") >= F.lit(end).cast("timestamp_ntz")).first()
    return bool(r[0] and r[1])


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_report(df: DataFrame, path: str, digits: int = 5) -> None:
    """CSV with doubles to so many significant digits."""
    out = df.select(*(F.format_string(f"%.{digits}g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    out.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame) -> DataFrame:
    """Rows of a markdown table in df's order of columns."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("line"))


def missing(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The ids that a partitioned table has no rows of, so that an ingest that stopped goes on with them alone."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except AnalysisException:
        return ids
    return ids.join(done, key, "left_anti")


def write_mask(mask: DataFrame, path: str, cells: int) -> None:
    """A mask's cells, one partition a resolution; other resolutions stay."""
    write_partitioned(mask.withColumn("cells", F.lit(cells)), path, "cells")


def write_card(row: DataFrame, path: str) -> None:
    """One row as a JSON document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows in any order, by which a cached artefact is known to be current."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    n, s = df.agg(F.count(F.lit(1)), F.sum(h)).first()
    return f"{n}-{s or 0}"
