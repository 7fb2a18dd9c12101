"""Near-duplicate vectors within a label: navigable small-world graphs a shard, every shard queried, exact check.

Equal vectors of a label are one from the start and count by their number. The vectors of a label
are dealt to shards of bounded size by hash; each shard builds a hierarchical navigable small-world
graph once. Blocks of a label's vectors then query every shard of it: a greedy descent through the
upper layers, a beam on the lowest, and from all matches a flood over their neighbours. Before a
block is queried, an audit compares the beam's matches with brute force and doubles the beam until
recall passes; a beam as wide as the shard is replaced by brute force itself. It asks for vectors from all shards of
the label that have links in this one, and for vectors made to link with one of its own; a vector's match with itself
doesn't count, and each vector counts alike. Cosines of matches are then taken in double precision. Of the
links a task reports only a spanning forest, so large groups are never spelled out as
pairs; components of the forests are the components of all links. A vector's links all lie in its component, so
they are counted there by brute force in blocks, and a link counts for both of its ends.

Ids are integers (others are refused). Null, zero, empty vectors and those with null or non-finite components, and rows without label or
id link with nothing; vectors of different lengths don't link. Rows with one id are vectors of their own
that share a component.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import components, cut, hot_join, integral

COSINE = 0.98
#: Vectors in a shard's graph, in a block of queries to it, and in a block whose links are counted, about; numbers in a shard's vectors at most.
#: A graph goes to every block of queries, so blocks are about as large as graphs and neither side is copied more often than the other.
SHARD, QUERIES, BLOCK, NUMBERS = 32768, 16384, 2048, 1 << 23
#: Links of a node (twice as many on the lowest layer), beams while building and querying, audited vectors, recall to reach.
LINKS, BUILD_BEAM, BEAM, AUDIT, RECALL = 8, 32, 24, 48, 0.99


class Graph:
    """A hierarchical navigable small-world graph of unit vectors."""

    def __init__(self, v: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        n = len(v)
        self.v, self.links = v, links
        u = (np.arange(1, n + 1) * 0.6180339887498949) % 1.0
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(int), 12)
        self.near = np.full((n, 2 * links), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        self.upper: list[dict[int, list[int]]] = [{} for _ in range(self.level.max(initial=0))]
        self.seen = np.zeros(n, np.int32)
        self.stamp, self.entry = 0, 0
        for i in range(1, n):
            self._add(i, beam)

    def neighbours(self, i: int, layer: int) -> np.ndarray:
        return self.near[i, : self.count[i]] if layer == 0 else np.array(self.upper[layer - 1].get(i, []), np.int32)

    def beam(self, q: np.ndarray, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        self.stamp += 1
        self.seen[start] = self.stamp
        found = [(float(s), i) for s, i in zip(self.v[start] @ q, start, strict=True)]
        todo = [(-s, i) for s, i in found]
        heapq.heapify(found)
        heapq.heapify(todo)
        while todo:
            s, i = heapq.heappop(todo)
            if -s < found[0][0] and len(found) >= width:
                break
            near = self.neighbours(i, layer)
            near = near[self.seen[near] != self.stamp]
            if not len(near):
                continue
            self.seen[near] = self.stamp
            for x, j in zip((self.v[near] @ q).tolist(), near.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (x, j))
                    heapq.heappush(todo, (-x, j))
                elif x > found[0][0]:
                    heapq.heapreplace(found, (x, j))
                    heapq.heappush(todo, (-x, j))
        return sorted(found, reverse=True)

    def _descend(self, q: np.ndarray, to: int) -> int:
        at = self.entry
        for layer in range(int(self.level[self.entry]), to, -1):
            best = float(self.v[at] @ q)
            while len(near := self.neighbours(at, layer)):
                s = self.v[near] @ q
                k = int(s.argmax())
                if s[k] <= best:
                    break
                at, best = int(near[k]), float(s[k])
        return at

    def _choose(self, q_sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to those chosen before; then the nearest of the rest."""
        order = np.argsort(-q_sims, kind="stable")
        ids, sims = ids[order], q_sims[order]
        among = self.v[ids] @ self.v[ids].T
        chosen, closest = [], np.full(len(ids), -2.0)
        for k in range(len(ids)):
            if sims[k] > closest[k]:
                chosen.append(k)
                closest = np.maximum(closest, among[k])
                if len(chosen) == most:
                    break
        rest = [k for k in range(len(ids)) if k not in set(chosen)]
        return ids[(chosen + rest)[:most]]

    def _add(self, i: int, width: int) -> None:
        q, top = self.v[i], int(self.level[self.entry])
        own = int(self.level[i])
        start = [self._descend(q, own)]
        for layer in range(min(own, top), -1, -1):
            found = self.beam(q, start, width, layer)
            start = [j for _, j in found]
            ids = self._choose(np.array([s for s, _ in found]), np.array(start, np.int32), self.links)
            self._link(i, ids, layer)
            for j in ids.tolist():
                self._link(j, np.append(self.neighbours(j, layer), np.int32(i)), layer)
        if own > top:
            self.entry = i

    def _link(self, i: int, ids: np.ndarray, layer: int) -> None:
        most = self.links * (2 if layer == 0 else 1)
        if len(ids) > most:
            ids = self._choose(self.v[ids] @ self.v[i], ids, most)
        if layer == 0:
            self.near[i, : len(ids)] = ids
            self.count[i] = len(ids)
        else:
            self.upper[layer - 1][i] = ids.tolist()

    def within(self, q: np.ndarray, least: float, width: int) -> np.ndarray:
        """Nodes of at least that similarity: those in the beam, and what a flood from them reaches."""
        got = [j for s, j in self.beam(q, [self._descend(q, 0)], width, 0) if s >= least]
        if not got:
            return np.zeros(0, np.int64)
        self.stamp += 1
        self.seen[got] = self.stamp
        out, edge = [np.array(got)], np.array(got)
        while len(edge):
            near = np.unique(self.near[edge])
            near = near[near >= 0]
            near = near[self.seen[near] != self.stamp]
            self.seen[near] = self.stamp
            edge = near[self.v[near] @ q >= least]
            out.append(edge)
        return np.concatenate(out)


def _unit(v: np.ndarray) -> np.ndarray:
    x = v / np.abs(v).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def audited(graph: Graph, least: float, width: int = BEAM, queries: np.ndarray | None = None, own: np.ndarray | None = None) -> int:
    """The beam that passes the audit; 0 for brute force.

    Queries are unit vectors of the label, own their nodes (-1 for those of other shards); the shard's by default.
    """
    n = len(graph.v)
    if queries is None:
        own = np.unique(np.linspace(0, n - 1, min(n, BLOCK)).astype(int))
        queries = graph.v[own]
    asked = []
    for q, k in zip(queries, own, strict=True):
        true = np.flatnonzero(graph.v @ q >= least)
        true = true[true != k]
        if len(true):
            asked.append((q, int(k), true))
    asked = [asked[k] for k in np.unique(np.linspace(0, len(asked) - 1, min(len(asked), AUDIT)).astype(int))]
    # vectors that link with a node for certain, whatever the label's own links are
    rng, made = np.random.default_rng(0), []
    for k in np.unique(np.linspace(0, n - 1, min(n, AUDIT)).astype(int)).tolist():
        v = graph.v[k].astype(float)
        side = rng.normal(size=len(v))
        side -= (side @ v) * v
        long = np.sqrt(side @ side)
        if long > 1e-9:
            c = least + (1 - least) * rng.uniform(0.1, 0.9)
            q = (c * v + np.sqrt(1 - c * c) * side / long).astype(np.float32)
            made.append((q, -1, np.flatnonzero(graph.v @ q >= least)))

    def recall(some: list) -> float:
        return float(np.mean([len(np.intersect1d(t, graph.within(q, least, width))) / len(t) for q, _, t in some if len(t)])) if some else 1.0

    while width < n:
        if recall(asked) >= RECALL and recall(made) >= RECALL:
            return width
        width *= 2
    return 0


def _build(pdf: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({"label": pd.Series(dtype=str), "dim": pd.Series(dtype=int), "shard": pd.Series(dtype=int), "graph": pd.Series(dtype=object)})
    pdf = pdf.sort_values("rep")
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    graph = Graph(_unit(v).astype(np.float32))
    rep = pdf["rep"].to_numpy()
    state = {"graph": graph, "raw": v, "rep": rep}  # unit vectors are made anew of the raw ones
    sample = sample.sort_values("rep")
    asked = sample["rep"].to_numpy()
    at = np.minimum(np.searchsorted(rep, asked), len(rep) - 1)
    queries = _unit(np.stack(sample["v"].to_numpy()).astype(np.float64)).astype(np.float32) if len(sample) else graph.v[:0]
    graph.width = audited(graph, COSINE - 1e-4, queries=queries, own=np.where(rep[at] == asked, at, -1))
    graph.v = None
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "graph": [pickle.dumps(state)]})


def _query(queries: pd.DataFrame, graphs: pd.DataFrame, least: float) -> pd.DataFrame:
    """The edges (a, b) of a forest of the queries' links."""
    columns = ["a", "b"]
    if not len(queries) or not len(graphs):
        return pd.DataFrame({c: pd.Series(dtype="Int64") for c in columns})
    state = pickle.loads(graphs["graph"].iloc[0])
    graph, raw, rep = state["graph"], _unit(state["raw"]), state["rep"]
    graph.v = raw.astype(np.float32)
    ids, v = queries["rep"].to_numpy(), _unit(np.stack(queries["v"].to_numpy()).astype(np.float64))
    q32, slack = v.astype(np.float32), least - 1e-4
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top.setdefault(y, y)
        return x

    a, b = [], []
    for k, i in enumerate(ids.tolist()):
        near = graph.within(q32[k], slack, graph.width) if graph.width else np.flatnonzero(graph.v @ q32[k] >= slack)
        near = near[raw[near] @ v[k] >= least]
        near = near[rep[near] != i]
        for j in rep[near].tolist():
            x, y = find(i), find(j)
            if x != y:
                top[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")})


def _count(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(node, links) of the vectors of a task, each with those of its component on the other side; side 2 is both."""
    pdf = pdf.sort_values("component", kind="stable")
    node, number, side = (pdf[c].to_numpy() for c in ("node", "n", "side"))
    of, out = pdf["component"].to_numpy(), np.zeros(len(pdf), np.int64)
    edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        v = _unit(np.stack(pdf["v"].iloc[lo:hi].to_numpy()).astype(np.float64))
        s = side[lo:hi]
        left, right = np.flatnonzero(s != 1), np.flatnonzero(s != 0)
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            hit = v[rows] @ v[right].T >= least
            if s[0] == 2:
                hit[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
            else:
                out[lo + right] += number[lo + rows] @ hit
            out[lo + rows] += hit @ number[lo + right]
    return pd.DataFrame({"node": node, "links": out})


def _links(reps: DataFrame, comp: DataFrame, least: float, block: int) -> DataFrame:
    """(node, links): the links of each vector, exactly, with all of its component."""
    sizes = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    groups = comp.count() // block + 1
    at = F.pmod(F.xxhash64(F.lit(7), "node"), "blocks").cast("int")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), F.col("component").alias("g"))
    many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: task(F.least(x, F.col("at")), F.greatest(x, F.col("at")), F.when(x == F.col("at"), 2).when(x > F.col("at"), 0).otherwise(1)))
    one = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(2).alias("side"), F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g")))
    rows = comp.join(sizes, "component").withColumn("at", at).withColumn("t", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)))
    rows = rows.select("node", "component", "t.*").join(reps.select(F.col("rep").alias("node"), "n", "v"), "node")
    counted = rows.groupBy("g", "i", "j").applyInPandas(lambda pdf: _count(pdf, least), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = COSINE, shard: int = SHARD, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    integral(vectors, vec_id)
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    own = own.withColumn("ok", F.coalesce(fit & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False)))
    own = own.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "label", "v")})
    reps = cut(own.where("ok").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).withColumn("dim", F.size("v")))
    most = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(NUMBERS) / F.col("dim"))))
    parts = lambda n: F.ceil(F.count(F.lit(1)) / F.first(most(n))).cast("int")
    # sample: one of so many vectors is asked in audits
    sizes = cut(reps.groupBy("label", "dim").agg(parts(shard).alias("shards"), parts(queries).alias("blocks"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("sample"), F.count(F.lit(1)).alias("rows")))
    dealt = hot_join(reps, sizes.drop("rows"), ["label", "dim"], sizes, "rows").withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int"))
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    sample = dealt.where(F.pmod(F.xxhash64(F.lit(13), "rep"), "sample") == 0).select("label", "dim", F.explode(every).alias("shard"), "rep", "v").toDF("label", "dim", "shard", "rep", "v")
    own_shard = dealt.select("label", "dim", "shard", "rep", "v").toDF("label", "dim", "shard", "rep", "v").groupBy("label", "dim", "shard")
    graphs = cut(own_shard.cogroup(sample.groupBy("label", "dim", "shard")).applyInPandas(_build, "label string, dim int, shard int, graph binary"))
    asked = dealt.select("label", "dim", F.explode(every).alias("shard"), F.pmod(F.xxhash64(F.lit(5), "rep"), "blocks").cast("int").alias("block"), "rep", "v")
    sent = graphs.join(sizes, ["label", "dim"]).select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph")
    key = ["label", "dim", "shard", "block"]
    found = cut(asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(lambda q, g: _query(q, g, least), "a long, b long"))
    comp = cut(components(found))
    links = _links(reps, comp, least, block)
    known = reps.select("k1", "k2", F.col("rep").alias("node"), "n").join(comp, "node", "left").join(links, "node", "left")
    known = cut(known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    linked = own.where("ok").select("id", "k1", "k2").join(known, ["k1", "k2"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = own.where("not ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
