import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.llm import negatives as hn

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _brute(rows, every=100, scale=256):
    sound = []
    for i, v, k in rows:
        if i is not None and k is not None and v and None not in v and all(math.isfinite(c) for c in v):
            x = [math.floor(scale * c) for c in v]
            if sum(a * a for a in x) < 2**62:
                sound.append((i, x, k))
    out = []
    for a, (i, x, k) in enumerate(sound):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(x, y, strict=True)) if len(y) == len(x) else None for _, y, _ in sound]
        positives = sorted((-score[b], sound[b][0]) for b in range(len(sound)) if b != a and score[b] is not None and sound[b][2] == k)[:5]
        for s, p in positives:
            found = sorted((-score[b], sound[b][0]) for b in range(len(sound)) if score[b] is not None and sound[b][2] != k and -80 * s <= 100 * score[b] <= -100 * s)[:5]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(found)]
    return sorted(out)


def _got(df, **options):
    return sorted(tuple(r) for r in hn.mine(df, **options).select(*COLUMNS).collect())


def _rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist(), int((i // 3) % 4)) for i in range(500)]
    rows += [(1000 + i, rows[20][1], rows[20][2] if i % 3 else 9) for i in range(60)]  # equal vectors, anchors among them
    rows += [(100, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2])]  # repeated rows
    rows += [(2000, None, 1), (2100, [], 1), (2200, [None] * 16, 1), (2300, [float("nan")] * 16, 1), (2400, rows[4][1], None), (None, rows[4][1], 1), (2500, [float("inf")] + [0.0] * 15, 1)]
    rows += [(2600, [1.0, 2.0], 1), (2601, [1.0, 1.9], 1), (2602, [1.0, 1.9], 2), (2700, [0.0] * 16, 1), (2701, [2.0**40] + [0.0] * 15, 2)]
    return rows


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rank int, row int").repartition(4)
    assert _got(df) == _brute(rows)
    want = _brute(rows, 10)
    assert len(want) > 200
    for options in ({"tree": 3, "block": 40}, {"blocks": 1}):
        assert _got(df, anchor=F.col("vec_id") % 10 == 0, **options) == want


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 32)), 30, axis=0) + 0.05 * rng.normal(size=(600, 32)))).astype(int)
    order, depth, edge = hn.spanning_tree(x[::4])
    assert sorted(order) == list(range(150)) and depth[order[0]] == 0 and depth.max() <= hn.LEVELS
    b = hn.Block(np.arange(600), np.arange(600), np.array(["a", "b"] * 300, object), x, (x.astype(float) ** 2).sum(axis=1))
    for i in order:
        a = x[::4][i].astype(float)
        true = b.x @ a
        at, _ = b.best(4 * int(i), a, int(depth[i]), float(edge[i]), 5)
        low, high = b.path[-1]
        assert (low <= true).all() and (true <= high).all()
        want = np.lexsort((b.ids, -true))
        assert at.tolist() == [j for j in want.tolist() if j != 4 * i][:5]
    assert b.scored < 0.4 * 150 * 600


def test_large_scores_are_exact():
    x = np.array([[2**30 - 1, 3], [2**30 - 1, 5], [2**30, 1]])
    b = hn.Block(np.arange(3), np.arange(3), np.array(["a"] * 3, object), x, (x.astype(float) ** 2).sum(axis=1))
    a = np.array([2.0**30 - 1, 7.0])
    assert b.scores(np.arange(3), a).tolist() == [(2**30 - 1) * int(r[0]) + 7 * int(r[1]) for r in x]


def test_empty_and_own_anchors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert _got(spark.createDataFrame([], schema)) == []
    assert _got(spark.createDataFrame([(100, [1.0], "a")], schema)) == []
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.0], "a"), (3, [0.85, 0.3], "b"), (4, [-1.0, 0.0], "b")]
    got = _got(spark.createDataFrame(rows, schema), anchor=F.col("vec_id") == 1)
    assert got == [(1, 2, 1, 3, 256 * 230, 256 * 217)]
    with pytest.raises(TypeError):
        hn.mine(spark.createDataFrame([("x", [1.0], "a")], "vec_id string, embedding array<double>, label string"))
