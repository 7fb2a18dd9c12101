from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from sensorweave.llm import whitening as wh


def _exact(rows):
    """n, S and the covariance by the definition, in fractions."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    c = [[Fraction(r[i]) - Fraction(sums[i], n) for i in range(d)] for r in x]
    v = [[sum(r[i] * r[j] for r in c) / n for j in range(d)] for i in range(d)]
    return x, n, sums, np.array([[float(a) for a in r] for r in v])


def test_equals_definition(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(120, 10)) * np.linspace(1, 0.1, 10)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(200, base[3].tolist()), (None, base[5].tolist())]
    x, n, sums, v = _exact([r[1] for r in rows])
    bad = [(300, None), (301, []), (302, [None] * 10), (303, [float("nan")] + [0.0] * 9), (304, [float("inf")] + [0.0] * 9), (305, [2.0**30] + [0.0] * 9)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows + bad], "vec_id long, embedding array<float>, n int, whitened int").repartition(3)
    fits = wh.fit(df)
    assert (fits[10].n, fits[10].sums) == (n, sums)
    got = wh.whiten(df, fits).collect()
    assert len(got) == 8 * n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1].T
    np.testing.assert_allclose(fits[10].values, e[:8], rtol=1e-12)
    signs = [np.sign(fits[10].vectors[k] @ u[k]) for k in range(8)]
    want = {}
    for (i, _), r in zip(rows, x, strict=True):
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)), [signs[k] * float(np.array([a - s / n for a, s in zip(r, sums, strict=True)]) @ u[k]) / np.sqrt(e[k]) for k in range(8)]))
    for r in got:
        far, w = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, far)
        assert r.whitened == pytest.approx(w[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-12)
        assert 0 <= r.identity_error < 1e-9
    assert sorted(r.component for r in got if r.vec_id is None) == list(range(1, 9))


def test_squares_of_any_size():
    y = np.array([[1 << 40, -3], [-(1 << 40), 5], [7, 1 << 39]])
    got = wh.square_sums(y)
    rows = [[int(a) for a in r] for r in y]
    assert list(got) == [sum(r[0] ** 2 for r in rows), sum((r[0] + r[1]) ** 2 for r in rows), sum(r[1] ** 2 for r in rows)]
    small = np.random.default_rng(2).integers(-1000, 1000, (50, 5))
    assert list(wh.square_sums(small)) == [int(((small[:, i] + small[:, j] * (i != j)) ** 2).sum()) for i in range(5) for j in range(i, 5)]


def test_covariance_survives_large_means():
    """Polarised sums are exact where products of doubles are not."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (1000, 3)) + 10**9
    sums = [int(s) for s in x.sum(axis=0)]
    whole, rest = [s // 1000 for s in sums], [s % 1000 for s in sums]
    v = wh.covariance(1000, rest, list(wh.square_sums(x - np.array(whole))))
    np.testing.assert_allclose(v, np.cov((x - 10**9).T, bias=True), rtol=1e-12)


def test_lengths_ties_and_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert wh.whiten(spark.createDataFrame([], schema), wh.fit(spark.createDataFrame([], schema))).collect() == []
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0, 2.0, 3.0]), (4, [0.0, 0.0, 1.0]), (5, [7.0])]
    df = spark.createDataFrame(rows, schema)
    got = {(r.vec_id, r.component): r for r in wh.whiten(df, wh.fit(df)).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (5, 1)]
    assert all(got[k].whitened is None and got[k].explained is None and got[k].identity_error is None and got[k].deviation == 0 for k in got if k[0] in (1, 2, 5))
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 2].whitened is None and got[3, 1].explained == pytest.approx(1)
    assert got[3, 1].n == 2 and got[3, 1].deviation == Decimal(1024**2 * (1 + 4 + 4))


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [2.0**29, 0.0]), (2, [-(2.0**29), 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in wh.whiten(df, wh.fit(df)).collect()}
    assert got[1] == got[2] == Decimal((1 << 40) ** 2 + 1024**2)
