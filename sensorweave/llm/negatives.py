"""Hard negatives by bounds along spanning trees of anchors.

Anchors are dealt to trees of bounded size by the signs of fixed projections, so near anchors share a tree; a task makes each tree,
of short edges and few levels. Candidates lie in blocks, a block to a task, past which all trees stream, parents before children. The root's scores
with the block are computed. A child's lie within edge length times candidate norm of its parent's (Cauchy and Schwarz);
only where that range meets what is asked for is the score computed, elsewhere the range itself goes on to the next level.

Two such passes are made. The first asks, within an anchor's own label, for its best rows: those whose upper bound reaches the least
that the lower bounds guarantee. The second asks, in other labels, for scores in the windows of its positives. Each
block gives its best few of an anchor or window, which are ranked together after. A task holds one block and one path of bounds. An
anchor's rows are copied once a block, candidates never.

Scores are whole numbers: components become floor(scale c), and products are exact (as 64-bit doubles up to 2**52, as whole numbers of
any size beyond). Rows without id or label, null and empty vectors, and those with a null or non-finite component or so large that scores
needn't fit a long (sum of squares 2**62 or more) take no part. Vectors of different lengths don't meet. Repeated rows are rows of their
own: a copy of an anchor is among its positives, and itself an anchor. Equal scores go by smaller id. Windows of negative positives are
empty. Empty tables give no rows; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, integral, map_batches
from .whitening import integers

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Anchors of a tree about; levels below its root; candidates of a block about; blocks of small tables.
TREE, LEVELS, BLOCK, BLOCKS = 1024, 6, 1 << 16, 16
#: From this product of norms on, doubles no longer hold every score.
EXACT = 2.0**52


def _prepared(df: DataFrame, vec_id: str, embedding: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """row (a number of its own), id, label, anchor, dim, x, squares and a code of signs, of the rows that take part."""
    own = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull())
    own = own.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(embedding).cast("array<double>").alias("v"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for at, x in integers(b.column(3), scale, 0, 2.0**31 / scale):
            squares = (x.astype(np.float64) ** 2).sum(axis=1)
            fits = squares < 2.0**62 * (1 - 1e-9)
            at, x, squares = at[fits], x[fits], squares[fits]
            d = x.shape[1]
            sides = np.random.default_rng(d).normal(size=(d, 30))
            code = ((x @ sides > 0) << np.arange(30)[::-1]).sum(axis=1)
            offsets = pa.array(np.arange(len(x) + 1) * d, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int32()))
            rows = pa.array(at)
            out.append(pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows), pa.array(np.full(len(x), d), pa.int32()), lists, pa.array(squares), pa.array(code, pa.int64())], ["id", "label", "anchor", "dim", "x", "squares", "code"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(len(o) for o in out) else None

    return cut(map_batches(own, run, "id long, label string, anchor boolean, dim int, x array<int>, squares double, code long").withColumn("row", F.monotonically_increasing_id()))


def spanning_tree(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, depth, edge): the nodes with parents before children and each branch whole, their depths and edges to parents.

    Nodes join one by one by the shortest edge to a node above the last level; the root is the node nearest the mean. An edge that is
    long beside the node's way to the root would bound nothing and use up a level, so that node is put below the root.
    """
    x = x.astype(np.float64)
    m = len(x)
    length = lambda i: np.sqrt(((x - x[i]) ** 2).sum(axis=1)) * (1 + 1e-12)  # noqa: E731  never too short
    root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    up = length(root)
    depth, parent, edge, done = np.zeros(m, int), np.full(m, root), up.copy(), np.zeros(m, bool)
    edge[root], done[root] = 0.0, True
    near = np.where(done, np.inf, edge)
    children: list[list[int]] = [[] for _ in range(m)]
    for _ in range(m - 1):
        i = int(near.argmin())
        done[i], near[i] = True, np.inf
        if 2 * edge[i] > up[i]:
            parent[i], edge[i] = root, up[i]
        depth[i] = depth[parent[i]] + 1
        children[parent[i]].append(i)
        if depth[i] < levels:
            d = length(i)
            closer = ~done & (d < near)
            near[closer], edge[closer], parent[closer] = d[closer], d[closer], i
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo += children[order[-1]][::-1]
    return np.array(order), depth, edge


def _forest(anchors: DataFrame, keys: list[str], tree: int) -> DataFrame:
    """The anchors with tree, sub, ord, depth and edge: trees of about `tree` anchors of one key, near ones by their codes; a crowded code is split by hash."""
    sizes = anchors.groupBy(*keys).agg(F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.count(F.lit(1)) / tree)))).cast("int").alias("bits"))
    placed = anchors.join(sizes, keys).withColumn("tree", F.expr("shiftright(code, 30 - bits)")).drop("bits")
    crowds = placed.groupBy(*keys, "tree").agg(F.ceil(F.count(F.lit(1)) / (2 * tree)).alias("subs"))
    placed = placed.join(crowds, [*keys, "tree"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs").cast("int")).drop("subs")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        order, depth, edge = spanning_tree(np.stack(pdf["x"].to_numpy()))
        at = np.empty(len(order), int)
        at[order] = np.arange(len(order))
        return pdf.assign(ord=at, depth=depth, edge=edge)

    return placed.groupBy(*keys, "tree", "sub").applyInPandas(grow, placed.select("*", F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.lit(0.0).alias("edge")).schema)


class Block:
    """A block of candidates, and bounds of their scores with the anchors on the path to the last one asked."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, squares: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that equal scores are in the order of ids
        self.ids, self.rows, self.labels, self.x = ids[order], rows[order], labels[order], x[order].astype(np.float64)
        self.norm = np.sqrt(squares[order]) * (1 + 1e-12)
        self.longest = float(self.norm.max())
        self.path: list[tuple[np.ndarray, np.ndarray]] = []
        self.scored = 0

    def scores(self, at: np.ndarray, a: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        if self.longest * float(np.sqrt(a @ a)) < EXACT:
            return np.rint(self.x[at] @ a).astype(np.int64)
        return (self.x[at].astype(np.int64).astype(object) @ a.astype(np.int64).astype(object)).astype(np.int64)

    def bounds(self, a: np.ndarray, depth: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds with anchor a, wide enough for the rounding of doubles; the caller narrows them in place."""
        del self.path[depth:]
        if depth == 0:
            s = self.scores(np.arange(len(self.ids)), a).astype(np.float64)
            low, high = s, s.copy()
        else:
            reach = edge * self.norm
            slack = 1e-12 * self.longest * float(np.sqrt(a @ a)) + 1e-3
            low, high = self.path[-1][0] - reach - slack, self.path[-1][1] + reach + slack
        self.path.append((low, high))
        return low, high

    def _narrow(self, at: np.ndarray, a: np.ndarray) -> np.ndarray:
        s = self.scores(at, a)
        for side in self.path[-1]:
            side[at] = s
        return s

    def best(self, row: int, a: np.ndarray, depth: int, edge: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best rows but the anchor's own."""
        low, high = self.bounds(a, depth, edge)
        k = len(low) - 1 - most
        at = np.flatnonzero(high >= np.partition(low, k)[k]) if k > 0 else np.arange(len(low))
        s = self._narrow(at, a)
        other = self.rows[at] != row
        at, s = at[other], s[other]
        first = np.argsort(-s, kind="stable")[:most]
        return self.ids[at[first]], s[first]

    def within(self, label: str, a: np.ndarray, depth: int, edge: float, positives: list[int], most: int, least: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each positive (by its place): ids and scores of the best rows of other labels in its window."""
        low, high = self.bounds(a, depth, edge)
        floors = [-((-p * least[0]) // least[1]) for p in positives]
        open_ = np.zeros(len(low), bool)
        for lo, hi in dict.fromkeys(zip(floors, positives, strict=True)):
            open_ |= (high >= lo) & (low <= hi)
        at = np.flatnonzero(open_ & (self.labels != label))
        if not len(at):
            return
        s = self._narrow(at, a)
        order = np.argsort(-s, kind="stable")
        at, s = at[order], s[order]
        for k, (lo, hi) in enumerate(zip(floors, positives, strict=True)):
            first = np.searchsorted(-s, -hi)
            last = min(first + most, int(np.searchsorted(-s, -lo, "right")))
            if last > first:
                yield k, self.ids[at[first:last]], s[first:last]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _swept(candidates: DataFrame, forest: DataFrame, keys: list[str], answer, schema: str, block: int, blocks: int) -> DataFrame:
    """answer(block, anchors) over every block of candidates and the trees of its key, which stream past in batches."""
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = candidates.count()
    sizes = cut(counts.select(*keys, F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("n") * blocks / max(total, 1))).cast("int").alias("blocks")))
    cells = int(sizes.agg(F.sum("blocks")).first()[0] or 1)
    columns = ["id", "row", "label", "x", "squares"]
    none = [F.lit(0).cast(kind).alias(name) for name, kind in (("tree", "long"), ("sub", "int"), ("ord", "int"), ("depth", "int"), ("edge", "double"))]
    left = candidates.join(sizes, keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), *columns, *none, F.array().cast("array<long>").alias("asked"))
    right = forest.join(sizes, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(*[F.col(k).alias(f"k_{k}") for k in keys], "block", F.lit(1).alias("kind"), *columns, *[c.cast(k) for c, k in ((F.col("tree"), "long"), (F.col("sub"), "int"), (F.col("ord"), "int"), (F.col("depth"), "int"), (F.col("edge"), "double"))], "asked")
    cell = [f"k_{k}" for k in keys] + ["block"]
    dealt = left.union(right).repartition(cells, *cell).sortWithinPartitions(*cell, "kind", "tree", "sub", "ord")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], None
        for b in batches:
            marks = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(cell) + 1)]
            turns = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                if hi == lo:
                    continue
                own, part = tuple(m[lo] for m in marks[:-1]), b.slice(lo, hi - lo)
                if own != at:
                    at, held, found = own, [], None
                if not marks[-1][lo]:
                    held.append(part)
                    continue
                if found is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    get = lambda name: t.column(name).to_numpy()  # noqa: B023, E731
                    found = Block(get("id"), get("row"), get("label"), _matrix(t.column("x").combine_chunks()), get("squares"))
                    held = []
                if found is not None and (out := answer(found, part)) is not None:
                    yield out

    return dealt.mapInArrow(run, schema)


def _each(part: pa.RecordBatch) -> Iterator[tuple]:
    """row, label, x, depth, edge and asked of the anchors of a batch."""
    get = lambda name: part.column(part.schema.names.index(name))
    return zip(get("row").to_pylist(), get("label").to_pylist(), _matrix(get("x")).astype(np.float64), get("depth").to_pylist(), get("edge").to_pylist(), get("asked").to_pylist(), strict=True)


def _batch(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    if not found:
        return None
    n = [len(f[2]) for f in found]
    return pa.record_batch([pa.array(np.repeat([f[0] for f in found], n), pa.int64()), pa.array(np.repeat([f[1] for f in found], n), pa.int32()), pa.array(np.concatenate([f[2] for f in found]), pa.int64()), pa.array(np.concatenate([f[3] for f in found]), pa.int64())], ["row", "k", "id", "score"])


def mine(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: tuple[int, int] = (80, 100), scale: int = SCALE, tree: int = TREE, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives with scores from least[0]/least[1] of the positive's to it.

    anchor says which rows are anchors; those with an id divisible by 100 by default.
    """
    ship(df.sparkSession)
    integral(df, vec_id)
    rows = _prepared(df, vec_id, embedding, label, F.col(vec_id) % 100 == 0 if anchor is None else anchor, scale)
    anchors = rows.where("anchor").select("id", "row", "label", "dim", "x", "squares", "code")
    found = "row long, k int, id long, score long"
    ranked = lambda df, k: df.withColumn("rank", F.row_number().over(Window.partitionBy("row", "k").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)

    def first(b: Block, part: pa.RecordBatch) -> pa.RecordBatch | None:
        return _batch([(row, 0, *b.best(row, x, depth, edge, positives)) for row, _, x, depth, edge, _ in _each(part)])

    def second(b: Block, part: pa.RecordBatch) -> pa.RecordBatch | None:
        return _batch([(row, k, ids, s) for row, own, x, depth, edge, asked in _each(part) for k, ids, s in b.within(own, x, depth, edge, asked, negatives, least)])

    forest = _forest(anchors, ["dim", "label"], tree).withColumn("asked", F.array().cast("array<long>"))
    best = cut(ranked(_swept(rows, forest, ["dim", "label"], first, found, block, blocks), positives).select("row", (F.col("rank") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda p: p["positive_score"]).alias("asked"))
    forest = cut(_forest(anchors, ["dim"], tree)).join(asked, "row", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<long>")))
    near = ranked(_swept(rows, forest, ["dim"], second, found, block, blocks), negatives)
    out = near.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(best, ["row", "k"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
