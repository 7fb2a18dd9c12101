"""Spatial joins without an index: cells of a grid as equi-join keys, exact for any size."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import cell, haversine_km, idw_weight
from ..functions.indices import tidy


def distances(stations: DataFrame) -> DataFrame:
    """(a, b, km) of all pairs of a station table, a < b; the table is a dimension, so the join is a broadcast one."""
    side = lambda k: stations.select(F.col("station_id").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"), F.col("cv_group").alias(f"g_{k}"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).select("a", "b", "g_a", "g_b", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km"))


def close_pairs(stations: DataFrame, km: float = 1.0) -> DataFrame:
    """Pairs nearer than km that are not in one group."""
    return distances(stations).where((F.col("km") < km) & (F.col("g_a") != F.col("g_b"))).select("a", "b", F.round("km", 6).alias("km"))


def _binned(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})


def _around(queries: DataFrame, size: float) -> DataFrame:
    """Each query once for each of the nine cells around its own."""
    q = _binned(queries, size)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return q.withColumn("s", F.explode(steps)).withColumns({"bx": F.col("bx") + F.col("s.i"), "by": F.col("by") + F.col("s.j")}).drop("s")


#: Points, and queries, that a shard of a cell holds about, and rows that a task holds at once besides.
SHARD, BLOCK = 250_000, 1 << 17


def radius_count(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(id, n): points within the radius of each query, the rim included; an id that comes several times has the sum of its places.

    Queries meet points by cells of the radius' size, in which `_within` counts whole runs of points and compares only those near the rim.
    Cells of many points or queries are dealt over shards by place, whose counts add up; there, points in one place are counted first.
    """
    size = radius * (1 + 1e-9)  # so that a point on the rim is never two cells away
    xy = lambda df, *more: df.select(*more, F.col("x").cast("double"), F.col("y").cast("double")).where((F.abs("x") < math.inf) & (F.abs("y") < math.inf))
    p, q = _binned(xy(points), size), _around(xy(queries, "id"), size)
    held, asked = (t.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias(k)) for t, k in ((p, "kp"), (q, "kq")))
    many = F.broadcast(held.join(asked, ["bx", "by"]).where("kp > 1 or kq > 1"))  # few: each has more than a shard
    shard = lambda k, *of: F.pmod(F.xxhash64(*of), F.col(k))
    copied = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    p, q = p.join(many, ["bx", "by"], "left"), q.join(many, ["bx", "by"], "left").fillna(1, ["kp", "kq"])
    q = q.withColumn("sq", shard("kq", "x", "y", F.col("id").cast("string"))).withColumn("sp", copied("kp"))
    places = p.where("kp is not null").groupBy("bx", "by", "x", "y", "kp", "kq").agg(F.count(F.lit(1)).alias("m")).withColumn("sp", shard("kp", "x", "y")).withColumn("sq", copied("kq"))
    keys, none = ["bx", "by", "s"], F.lit(None).cast(queries.schema["id"].dataType).alias("id")
    s = (F.shiftleft(F.col("sp"), 32) + F.col("sq")).alias("s")
    both = q.select("id", "bx", "by", s, "x", "y", F.lit(0).cast("long").alias("m"))
    for more in (p.where("kp is null").select(none, "bx", "by", F.lit(0).cast("long").alias("s"), "x", "y", F.lit(1).cast("long").alias("m")), places.select(none, "bx", "by", s, "x", "y", "m")):
        both = both.unionByName(more)
    hits = both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(functools.partial(_within, radius=radius, size=size), T.StructType([queries.schema["id"], T.StructField("n", T.LongType())]))
    return queries.select("id", F.lit(0).cast("long").alias("n")).unionByName(hits).groupBy("id").agg(F.sum("n").alias("n"))


def _within(batches, radius: float, size: float):
    """(id, n) of rows sorted by cell, those with m = 0 being queries: the points of its cell within the radius, for some whole cells at a time."""
    keys, held = ["bx", "by", "s"], []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            t = pa.Table.from_batches(held)
            ends = np.flatnonzero(_turns(t, keys))
            if len(ends) > 1:
                yield from _counted(t.slice(0, ends[-1]), keys, radius, size)
                held = t.slice(ends[-1]).to_batches()
            else:
                held = t.combine_chunks().to_batches()
    if held:
        yield from _counted(pa.Table.from_batches(held), keys, radius, size)


def _turns(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row is the first of its cell."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _counted(t: pa.Table, keys: list[str], radius: float, size: float, slack: float = 1e-7, most: int = 1 << 16):
    """Counts for the queries of whole cells.

    The points of a cell stand in strips of equal numbers by x, sorted by y in each. Of a strip, a circle holds the points of an inner interval of
    y, none outside an outer one, and those between are compared. Both intervals have some slack, so rounding decides nothing.
    """
    cell, m, x, y = np.cumsum(_turns(t, keys)) - 1, *(t[k].to_numpy() for k in ("m", "x", "y"))
    u, v = x / size - t["bx"].to_numpy(), y / size - t["by"].to_numpy()
    query, point = np.flatnonzero(m == 0), np.flatnonzero(m)
    cells = int(cell[-1]) + 1 if len(cell) else 0
    if not len(query) or not len(point):
        return
    strips = max(1, int(math.sqrt(len(point) / cells / 45)))  # comparing costs as much as searching at about this number
    point = point[np.lexsort((u[point], cell[point]))]
    n = np.bincount(cell[point], minlength=cells)
    own = cell[point] * strips + (np.arange(len(point)) - (np.cumsum(n) - n)[cell[point]]) * strips // n[cell[point]]
    first = np.searchsorted(own, np.arange(cells * strips + 1))
    some, at = first[1:] > first[:-1], np.minimum(first[:-1], len(point) - 1)
    left, right = np.where(some, u[point[at]], np.nan), np.where(some, u[point[first[1:] - 1]], np.nan)
    order = np.lexsort((v[point], own))
    point, place = point[order], 4.0 * own[order] + v[point[order]]
    px, py, pm, sums = x[point], y[point], m[point].astype(float), np.concatenate(([0], np.cumsum(m[point])))
    query, reach = query[np.lexsort((v[query], cell[query]))], radius / size
    for lo in range(0, len(query), max(1, most // strips)):
        q = query[lo : lo + max(1, most // strips)]
        strip = (cell[q] * strips)[None, :] + np.arange(strips)[:, None]
        a, b = left[strip] - u[q], right[strip] - u[q]
        near, far = np.maximum(np.maximum(a, -b), 0), np.maximum(-a, b)
        which, of = np.nonzero(near <= reach + slack)  # not for empty strips
        near, far, strip, w = near[which, of], far[which, of], 4.0 * strip[which, of], v[q[of]]
        tall = np.sqrt(np.maximum((reach + slack) ** 2 - near**2, 0)) + slack
        full = np.sqrt(np.maximum((reach - slack) ** 2 - far**2, 0)) - slack
        seek = lambda z, side: np.searchsorted(place, strip + np.clip(z, -1, 2), side)  # noqa: B023, E731
        low, high = seek(w - tall, "left"), seek(w + tall, "right")
        inner = (far < reach - slack) & (full > 0)
        begin, end = np.where(inner, seek(w - full, "left"), high), np.where(inner, seek(w + full, "right"), high)
        begin, end = np.clip(begin, low, high), np.clip(end, low, high)
        total = np.bincount(of, weights=(sums[end] - sums[begin]).astype(float), minlength=len(q))
        start, length, who = np.concatenate((low, end)), np.concatenate((begin - low, high - end)), np.concatenate((of, of))
        upto = np.cumsum(length)
        parts = np.searchsorted(upto, np.arange(0, int(upto[-1]) + most, most)) if len(upto) else []
        for i, j in zip([0, *(int(k) + 1 for k in parts[1:-1])], [*(int(k) + 1 for k in parts[1:-1]), len(length)], strict=True):
            k = np.repeat(start[i:j] - (upto[i:j] - length[i:j] - (upto[i - 1] if i else 0)), length[i:j]) + np.arange(length[i:j].sum())
            owner = np.repeat(who[i:j], length[i:j])
            hit = (x[q][owner] - px[k]) ** 2 + (y[q][owner] - py[k]) ** 2 <= radius * radius
            total += np.bincount(owner, weights=pm[k] * hit, minlength=len(q))
        yield pa.RecordBatch.from_arrays([t["id"].take(pa.array(q)).combine_chunks(), pa.array(total.astype(np.int64))], names=["id", "n"])


def _finer(points: DataFrame, size: float, most: int = 64, levels: int = 8) -> int | None:
    """How often cells of the size are to be quartered until occupied ones hold about `most` places or fewer; none without points."""
    cells = [F.approx_count_distinct(F.struct(F.floor(F.col("x") / (size / 4**k)), F.floor(F.col("y") / (size / 4**k)))).alias(f"k{k}") for k in range(levels)]
    n, places, *held = points.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("x", "y")), *cells).first()
    return next((k for k, c in enumerate(held) if places <= most * c), levels - 1) if n else None


def nearest(queries: DataFrame, points: DataFrame, size: float, rounds: int = 12) -> DataFrame:
    """(id, distance) to the nearest point, exactly.

    The first cells are `size` wide, or smaller by powers of four where cells hold many places (`_finer`). Cells grow fourfold from round to round, and a query is done when its best distance is within the
    cell size, which the nine cells around it cover; only open queries go on, and a round's results are kept for the next. After `rounds`
    (a reach of 4**rounds cells) what is still open meets all points in one cell. A query without coordinates, or all where
    there is no point, have a null distance; points without coordinates count for nothing.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    points, none = points.where(placed), F.lit(None).cast("double").alias("distance")
    finer = _finer(points, size)
    if finer is None:
        return queries.select("id", none)
    size, rounds = size / 4**finer, rounds + finer
    open_, done = queries.where(placed).select("id", "x", "y"), queries.where(~placed).select("id", none)
    for k in range(rounds + 1):
        size = size if k < rounds else math.inf
        p = _binned(points, size).groupBy("bx", "by", F.col("x").alias("px"), F.col("y").alias("py")).agg(F.lit(1).alias("m"))
        best = _around(open_, size).join(p, ["bx", "by"], "left").groupBy("id", "x", "y").agg(F.min(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("d")).persist()
        near = F.col("d").isNotNull() & (F.col("d") <= size)
        done = done.unionByName(best.where(near).select("id", F.col("d").alias("distance")))
        open_ = best.where(~near).select("id", "x", "y")
        if open_.isEmpty():
            break
        size *= 4
    return done


def nearest_station(queries: DataFrame, stations: DataFrame, within_km: float = 2.0) -> DataFrame:
    """(id, station_id, km) of the nearest station of a dimension table, null beyond within_km; the lowest id at a tie."""
    pairs = queries.crossJoin(F.broadcast(stations.select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))))
    best = pairs.groupBy("id").agg(F.min(F.struct(F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 6).alias("km"), "station_id")).alias("m"))
    near = F.col("m.km") <= within_km
    return best.select("id", F.when(near, F.col("m.station_id")).alias("station_id"), F.when(near, F.col("m.km")).alias("km"))


def inside(points: DataFrame, edges: DataFrame, size: float | None = None) -> DataFrame:
    """(id, inside): nonzero winding of the rings' directed edges (x1, y1, x2, y2) around each point.

    Edges meet points by horizontal strips, so a point sees only edges that cross its height.
    """
    size = size or 1000.0
    strips = edges.where("y1 != y2").withColumn("s", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))
    p = points.withColumn("s", F.floor(F.col("y") / size))
    side = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("x") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    turn = F.when((F.col("y1") <= F.col("y")) & (F.col("y2") > F.col("y")) & (side > 0), 1).when((F.col("y1") > F.col("y")) & (F.col("y2") <= F.col("y")) & (side < 0), -1).otherwise(0)
    wound = p.join(strips, "s").groupBy("id").agg(F.sum(turn).alias("w"))
    return points.select("id").join(wound, "id", "left").select("id", (F.coalesce("w", F.lit(0)) != 0).alias("inside"))


def segments(lines: DataFrame) -> DataFrame:
    """Consecutive segments of polylines (id, pts: array of x, y)."""
    n = F.size("pts")
    step = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct((k - 1).alias("k"), F.element_at("pts", k.cast("int")).alias("p"), F.element_at("pts", (k + 1).cast("int")).alias("q")))
    out = lines.where(n >= 2).select("id", F.explode(step).alias("s"))
    return out.select("id", "s.k", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def resample(segs: DataFrame, spacing: float = 10.0) -> DataFrame:
    """Midpoints of equal parts of about `spacing`, one part at least."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.bround(length / spacing).cast("int"))
    out = segs.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("j") + 0.5) / F.col("n")
    return out.select("id", "k", "j", F.round(F.col("x1") + t * (F.col("x2") - F.col("x1")), 6).alias("x"), F.round(F.col("y1") + t * (F.col("y2") - F.col("y1")), 6).alias("y"))


def features_for(queries: DataFrame, major: DataFrame, roads: DataFrame, coast: DataFrame, industry: DataFrame, buildings: DataFrame, size: float = 500.0, spacing: float = 10.0) -> DataFrame:
    """Six land-use features of any points (id, x, y in metres): distances to major roads, coast and industry, road densities and building density.

    Roads and coast are points every `spacing` metres, industry the directed edges (id, k, x1, y1, x2, y2) of its rings, buildings points.
    A point within a ring is at distance 0. A layer without points has null distances and density 0.
    """
    far = lambda layer, name: nearest(queries, layer, size).select("id", F.round(F.col("distance") + 1e-9, 1).alias(name))
    area = lambda metres: math.pi * (metres / 1000) ** 2
    dense = lambda layer, metres, each, name, places: radius_count(queries, layer, metres).select("id", F.round(F.col("n") * (each / area(metres)), places).alias(name))
    rim = far(resample(industry, spacing).select("x", "y"), "rim").join(inside(queries, industry.select("x1", "y1", "x2", "y2")), "id")
    parts = [
        far(major, "dist_major_road_m"), dense(roads, 500.0, spacing / 1000, "road_density_500m", 2), dense(roads, 1000.0, spacing / 1000, "road_density_1km", 2), far(coast, "dist_coast_m"),
        rim.select("id", F.when(F.col("inside"), 0.0).otherwise(F.col("rim")).alias("dist_industrial_m")), dense(buildings, 500.0, 1.0, "building_density_500m", 1),
    ]
    out = queries.select("id")
    for part in parts:
        out = out.join(part, "id", "left")
    return out


def grid(spark, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """Centres of n x n cells of a box (lon0, lat0, lon1, lat1)."""
    lon0, lat0, lon1, lat1 = box
    i = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(lat0) + (F.col("id") + 0.5) * ((lat1 - lat0) / n)).alias("lat"))
    j = spark.range(n).select(F.col("id").cast("int").alias("j"), (F.lit(lon0) + (F.col("id") + 0.5) * ((lon1 - lon0) / n)).alias("lon"))
    return i.crossJoin(F.broadcast(j))


def _weights(cells: DataFrame, stations: DataFrame, power: float, *keys: str) -> DataFrame:
    pairs = cells.crossJoin(F.broadcast(stations.select("station_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "value")))
    return pairs.withColumn("w", idw_weight(haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), power)).select(*keys, "lat", "lon", "station_id", "value", "w")


def surface(cells: DataFrame, readings: DataFrame, power: float = 0.5) -> DataFrame:
    """Inverse-distance estimate of each cell from one hour's readings (station_id, lat, lon, value)."""
    w = _weights(cells, readings, power, "i", "j")
    return w.groupBy("i", "j").agg(F.round(F.sum(F.col("w") * F.col("value")) / F.sum("w"), 6).alias("value"))


def contributions(cells: DataFrame, readings: DataFrame, power: float = 0.5, most: int = 5) -> DataFrame:
    """The stations that weigh most in each cell, with their share in per cent."""
    w = _weights(cells, readings, power, "i", "j")
    share = tidy(100 * F.col("w") / F.sum("w").over(W.partitionBy("i", "j")))
    ranked = w.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy("i", "j").orderBy(F.desc("share"), "station_id")))
    return ranked.where(F.col("rank") <= most).select("i", "j", "station_id", "share", "rank")


def mask(features: DataFrame, bounds: DataFrame, keys: list[str], names: list[str], band: tuple[str, str] = ("min", "max")) -> DataFrame:
    """Two bits a feature (below, above its band of the training range) and whether any is set."""
    long = features.unpivot(keys, names, "feature", "x").join(F.broadcast(bounds.select("feature", F.col(band[0]).alias("low"), F.col(band[1]).alias("high"))), "feature")
    place = F.element_at(F.create_map(*(F.lit(v) for k, n in enumerate(names) for v in (n, k))), F.col("feature"))
    bit = F.when(F.col("x") < F.col("low"), 1).when(F.col("x") > F.col("high"), 2).otherwise(0)
    flags = F.sum(bit * F.pow(F.lit(4), place)).cast("int")
    return long.groupBy(*keys).agg(flags.alias("flags")).withColumn("masked", F.col("flags") != 0)


def mask_kind(flags: Column, names: list[str], built: str, roads: list[str], remoteness: list[str]) -> Column:
    """Why a cell is masked: `empty` (too few buildings and too little road), else `remote` (too far from something), else `other`; `none` if it isn't."""
    side = lambda n, s: F.shiftright(flags, 2 * names.index(n) + s).bitwiseAND(1) == 1
    some = lambda ns, s: functools.reduce(lambda a, b: a | b, [side(n, s) for n in ns])
    return F.when(side(built, 0) & some(roads, 0), "empty").when(some(remoteness, 1), "remote").when(flags != 0, "other").otherwise("none")


def mask_totals(masked: DataFrame, names: list[str]) -> DataFrame:
    """(reason, n): cells outside the band of each feature, below or above any, and of each kind."""
    flags = F.col("flags")
    both = {n: F.shiftright(flags, 2 * k).bitwiseAND(3) != 0 for k, n in enumerate(names)}
    low, high = sum(1 << 2 * k for k in range(len(names))), sum(2 << 2 * k for k in range(len(names)))
    all_ = both | {"_below_band": flags.bitwiseAND(low) != 0, "_above_band": flags.bitwiseAND(high) != 0} | {f"_{k}": F.col("kind") == k for k in ("empty", "remote", "other")}
    one = masked.agg(*(F.sum(c.cast("long")).alias(k) for k, c in all_.items()))
    return one.unpivot([], list(all_), "reason", "n").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reasons(flags: Column, names: list[str]) -> Column:
    """The features and sides that a mask's bits name, in order."""
    parts = [F.when(F.shiftright(flags, 2 * k + s).bitwiseAND(1) == 1, F.lit(f"{n} {'below' if s == 0 else 'above'}")) for k, n in enumerate(names) for s in (0, 1)]
    return F.concat_ws(",", *parts)
