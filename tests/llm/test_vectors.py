import numpy as np
import pandas as pd

from sensorweave.llm import vectors as vx


def _brute(rows):
    links = {r[0]: set() for r in rows}
    for i, e, k in rows:
        for j, f, m in rows:
            if i != j and k is not None and k == m and e is not None and f is not None and len(e) == len(f) and None not in e and None not in f:
                a, b = np.array(e, float), np.array(f, float)
                if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= vx.COSINE:
                    links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 2)) for i in range(300)]
    rows += [(400 + i, rows[3][1], rows[3][2]) for i in range(30)]  # copies
    rows += [(500, (2 * np.array(rows[3][1])).tolist(), rows[3][2]), (501, None, 1), (502, [0.0] * 16, 1), (503, [None] * 16, 1), (504, [float("nan")] * 16, 1), (505, rows[3][1], None), (506, [float("inf")] + [0.0] * 15, 1), (507, [1.0, 2.0], 1), (508, [1.0, 2.0], 1), (509, [], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    want = _brute(rows)
    for options in ({}, {"shard": 60, "block": 25}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vx.report(df, **options).collect()}
        assert got == want


def test_graph_recall():
    rng = np.random.default_rng(5)
    v = vx._unit(np.repeat(rng.normal(size=(100, 24)), 10, axis=0) + 0.05 * rng.normal(size=(1000, 24))).astype(np.float32)
    graph = vx.Graph(v)
    width = vx.audited(graph, 0.95)
    true = found = 0
    for i in range(0, 1000, 7):
        t = set(np.flatnonzero(v @ v[i] >= 0.95).tolist())
        true += len(t)
        found += len(t & set(graph.within(v[i], 0.95, width).tolist())) if width else len(t)
    assert found >= 0.97 * true


def test_empty_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vx.report(spark.createDataFrame([], schema)).collect() == []
    one = vx.report(spark.createDataFrame([(None, [1.0], 1), (3, None, None)], schema)).collect()
    assert sorted(map(str, map(tuple, one))) == sorted(map(str, [(None, 0, None, True), (3, 0, 3, True)]))
    assert len(vx._query(pd.DataFrame(columns=["rep", "v"]), pd.DataFrame(columns=["graph"]), 0.98)) == 0


class _OnlyItself(vx.Graph):
    """A graph that finds nothing but the vector that is asked for."""

    def within(self, q, least, width):
        return np.flatnonzero(self.v @ q >= 1 - 1e-5)


def test_the_audit_does_not_pass_by_self_hits():
    graph = _OnlyItself(vx._unit(np.random.default_rng(7).normal(size=(200, 24))).astype(np.float32))
    assert vx.audited(graph, 0.98) == 0


def test_the_audit_asks_for_vectors_of_other_shards():
    rng = np.random.default_rng(8)
    v = vx._unit(rng.normal(size=(200, 24)))

    class Deaf(vx.Graph):
        """Misses what the first half of the nodes links with, for vectors that the shard doesn't hold."""

        def within(self, q, least, width):
            got = np.flatnonzero(self.v @ q >= least)
            return got if (self.v @ q).max() > 1 - 1e-6 or (self.v @ q).max() < 0.995 else got[got >= 100]

    graph = Deaf(v.astype(np.float32))
    near = vx._unit(v[:60] + 0.01 * rng.normal(size=(60, 24))).astype(np.float32)
    assert vx.audited(graph, 0.98, queries=near, own=np.full(60, -1)) == 0


def test_a_link_counts_for_both_ends(spark):
    rng = np.random.default_rng(9)
    v = np.ones(8) + 0.13 * rng.normal(size=(90, 8))
    number = [int(x) for x in rng.integers(1, 4, 90)]
    reps = spark.createDataFrame([(i, number[i], v[i].tolist()) for i in range(90)], "rep long, n long, v array<double>")
    comp = spark.createDataFrame([(i, 0 if i < 70 else 70) for i in range(90)], "node long, component long")
    u = vx._unit(v)
    hit = (u @ u.T >= vx.COSINE) & (np.arange(90)[:, None] != np.arange(90)) & ((np.arange(90)[:, None] < 70) == (np.arange(90) < 70))
    for block in (20, 1000):
        got = {r.node: r.links for r in vx._links(reps, comp, vx.COSINE, block).collect()}
        assert got == dict(enumerate((hit @ np.array(number)).tolist()))
