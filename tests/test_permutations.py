"""Permutation tests of units: rows are not shuffled to be ranked, and all features are met at once."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.operators import regression, resampling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def order(ids, rep):
    return sorted(ids, key=lambda i: (hashlib.md5(f"1:{rep}:{i}".encode()).hexdigest(), i))


def test_permutations_rank_where_their_repetition_is(spark):
    out = resampling.permutations(spark.range(5, 30), 20)
    got = {}
    for r in out.collect():
        got.setdefault(r.rep, {})[r.id] = r.to
    assert got == {k: dict(zip(range(5, 30), order(range(5, 30), k), strict=True)) for k in range(1, 21)}
    text = plan(resampling.permutations(spark.range(5, 30), 20))
    assert text.index("NestedLoop") < text.index("Exchange hashpartitioning(rep")  # the exchange has repetitions only
    assert len(re.findall(r"hashpartitioning\(rep", text)) == 1


def test_rank_correlations_of_moved_units_with_gaps(spark):
    rnd, n = random.Random(11), 40
    rows = [(k, float(rnd.randint(0, 9)), None if k % 7 == 3 else rnd.random(), 4.0, None if k == 20 else float(rnd.randint(0, 6))) for k in range(1, 26)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    out = regression.permuted_rank_correlations(df, "id", "y", ["a", "b", "c"], n)
    ranks = lambda v: {i: sum(w < x for w in v.values()) + (1 + sum(w == x for w in v.values())) / 2 for i, x in v.items()}
    want = {}
    for col, name in ((1, "a"), (2, "b"), (3, "c")):
        ok = [r for r in rows if r[col] is not None and r[4] is not None]
        rx, ry = ranks({r[0]: r[col] for r in ok}), ranks({r[0]: r[4] for r in ok})
        ids, found = [r[0] for r in rows], []
        for rep in range(n + 1):
            moves = zip(ids, ids if rep == 0 else order(ids, rep), strict=True)
            x, y = zip(*[(rx[i], ry[t]) for i, t in moves if i in rx and t in ry], strict=True)
            found.append(None if np.std(x) == 0 else round(float(np.corrcoef(x, y)[0, 1]), 9))
        want[name] = (None, 1 / (n + 1)) if found[0] is None else (pytest.approx(found[0], abs=1e-6), pytest.approx((sum(abs(f) >= abs(found[0]) for f in found[1:]) + 1) / (n + 1), abs=1e-6))
    got = {r.feature: (r.rho, r.p) for r in out.collect()}
    assert got["a"] == want["a"] and got["b"] == want["b"] and got["c"][0] is None
    assert not re.search(r"hashpartitioning\(feature#\d+, rep#", plan(out))  # no row of each feature and move is dealt out
    assert out.where(F.col("p").isNull()).count() <= 1
