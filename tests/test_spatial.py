"""Spatial joins on many points in few cells, against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sensorweave.operators import spatial
from sensorweave.plans import variants


def xy(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


@pytest.mark.parametrize("shard", [250_000, 40])
def test_counts_within_a_radius(spark, monkeypatch, shard):
    """Rims, copies, clusters, cells in several shards, and rows without a place; an id twice has one row, as in SQL."""
    monkeypatch.setattr(spatial, "SHARD", shard)
    rnd = random.Random(5)
    pts = [(k, float(rnd.randint(-20, 20)), float(rnd.randint(-20, 20))) for k in range(900)] + [(0, rnd.gauss(3, 0.01), rnd.gauss(-4, 0.01)) for _ in range(300)] + [(1, 3.0, 4.0)] * 50
    qs = [(k, float(rnd.randint(-25, 25)), float(rnd.randint(-25, 25))) for k in range(150)] + [(200, 0.0, 0.0), (200, 1.0, 0.0), (201, 900.0, 0.0)]
    odd = [(300, None, 1.0), (301, math.nan, 1.0), (302, math.inf, 1.0)]
    out = spatial.radius_count(xy(spark, qs + odd), xy(spark, pts + odd), 5.0)
    want = {q[0]: 0 for q in odd}
    for k, x, y in qs:
        want[k] = want.get(k, 0) + sum((x - a) ** 2 + (y - b) ** 2 <= 25 for _, a, b in pts)
    assert sorted((r.id, r.n) for r in out.collect()) == sorted(want.items())
    assert "power" not in out._jdf.queryExecution().executedPlan().toString().lower()  # no join makes a row of each pair near by


def test_nearest_of_dense_points_begins_in_small_cells(spark):
    """A cell of the given size has all points; smaller ones come first, so a query meets few of them."""
    rnd = random.Random(7)
    pts = [(k, rnd.gauss(0, 1), rnd.gauss(0, 1)) for k in range(3000)] + [(1, 0.5, 0.5)] * 500
    qs = [(k, rnd.gauss(0, 2), rnd.gauss(0, 2)) for k in range(80)] + [(100, 4000.0, 0.0)]
    points = xy(spark, pts)
    assert spatial._finer(points, 500.0) >= 4 and spatial._finer(points.limit(0), 500.0) is None
    got = {r.id: r.distance for r in spatial.nearest(xy(spark, qs), points, 500.0).collect()}
    assert got == {k: pytest.approx(min(math.dist((x, y), p[1:]) for p in pts)) for k, x, y in qs}


def test_mask_makes_features_once(spark, monkeypatch):
    """The percentiles and the flags of all sites read the same features."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x % 17)

    f = spark.range(1, 101).select("id", *[counted("id").alias(n) if k == 0 else (F.col("id") * k % 13).cast("double").alias(n) for k, n in enumerate(variants._NAMES)])
    monkeypatch.setattr(variants, "map_features", lambda *_: f)
    monkeypatch.setattr(variants, "sites", lambda *_: None)
    assert len(variants._masked(spark, "").collect()) == 100 and made.value == 100
