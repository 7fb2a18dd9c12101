"""Whitening of embeddings; the covariance comes by polarisation from exact integer sums.

Entries become integers x = floor(1024 c) + 100000. A first pass over the rows sums them by dimension. A second takes
the whole part of each mean off and sums squares, for every dimension and for the sum of every two dimensions. What the whole
parts leave of the means is less than one and is taken off the sums exactly, so these are n times the squares of centred values, in integers:
var(i + j) - var(i) - var(j) is then twice the covariance of i and j, with no rounding before the one
division that turns it into a double. eigh of that matrix runs in a task. A third pass measures the covariance of the whitened rows, a fourth returns them.

Of a pass only sums leave a task: d numbers, or d(d+1)/2. The driver holds n, the sums of the dimensions and the
components, (k + 2) d numbers for each length of vectors; it never holds rows.

Vectors of different lengths are fits of their own, with n, sums and components by length. Null and empty vectors, and those with null or
non-finite entries or one of 2**30 or more, take no part. Null ids are kept. Repeated rows count each. Components with no variance
(eigenvalue within rounding of 0: equal rows, one row, fewer rows than dimensions) have null for whitened, and no part in
identity_error; without any variance explained and identity_error are null too. An empty table gives no rows. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from here on count as not finite: their squares summed over a batch of rows would need more than 128 bits in a table.
LARGEST = float(1 << 30)
#: Numbers of a block of rows while squares are summed.
BLOCK = 1 << 20
_EXACT = pa.decimal128(38, 0)


def integers(column: pa.Array, scale: int, shift: int, largest: float = LARGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, x) of the sound vectors of a column of array<double>, a pair for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is nan
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        v = values[starts[at][:, None] + np.arange(d)]
        sound = (np.abs(v) < largest).all(axis=1)  # false for nan
        if sound.any():
            yield at[sound], np.floor(scale * v[sound]).astype(np.int64) + shift


def square_sums(y: np.ndarray) -> np.ndarray:
    """Sums over rows of y_i**2 and (y_i + y_j)**2, in the order (0, 0), (0, 1), .., (1, 1), (1, 2), .., as whole numbers of any size."""
    m, d = y.shape
    top = int(np.abs(y).max(initial=0))
    if 4 * top * top * m >= 1 << 62:
        y = y.astype(object)
    turned, out = np.ascontiguousarray(y.T), []
    for i in range(d):
        t = turned[i:].copy()
        t[1:] += turned[i]
        out.append((t * t).sum(axis=1) if t.dtype == object else np.einsum("ij,ij->i", t, t))
    return np.concatenate(out).astype(object)


@dataclass
class Fit:
    """What is known of the vectors of one length; k components of d numbers."""

    n: int
    sums: list[int]
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    error: float | None = None

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as 64-bit integers, or as objects where these could overflow."""
        y = x - self.whole
        if int(np.abs(y).max(initial=0) + 1) * self.n >= 1 << 62:
            y = y.astype(object)
        return y * self.n - np.array(self.rest, y.dtype)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """Rows on the components with variance, over their standard deviations; nan on the others."""
        has = self.values > 0
        out = np.full((len(z), len(has)), np.nan)
        out[:, has] = (z.astype(np.float64) / self.n) @ self.vectors[has].T / np.sqrt(self.values[has])
        return out


def _summed(df: DataFrame, parts, width: str) -> DataFrame:
    """Sums by length and place; parts(x) gives the count of rows and the whole numbers of a block, of which a task adds up all it sees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for _, x in integers(b.column(0), SCALE, SHIFT):
                d = x.shape[1]
                for k in range(0, len(x), max(1, BLOCK // d)):
                    block = x[k : k + max(1, BLOCK // d)]
                    found = parts(block)
                    held[d] = [held[d][0] + len(block), held[d][1] + found] if d in held else [len(block), found]
        for d, (n, found) in held.items():
            k = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, d), pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array(np.full(k, n), pa.int64()), pa.array([Decimal(int(s)) for s in found], _EXACT)], ["dim", width, "n", "s"])

    return df.mapInArrow(run, f"dim int, {width} int, n long, s decimal(38,0)").groupBy("dim", width).agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance matrix of the polarised sums of squares; each entry is rounded once."""
    d = len(rest)
    first = np.cumsum([0, *range(d, 0, -1)])
    own = [n * squares[first[i]] - rest[i] ** 2 for i in range(d)]  # n times the centred squares
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (n * squares[first[i] + j - i] - (rest[i] + rest[j]) ** 2 - own[i] - own[j]) / (2 * n**2)
    return v


def principal(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors by falling eigenvalue, at most so many, and the trace; values within rounding of 0 are 0."""
    e, u = np.linalg.eigh(v)
    e, u, trace = e[::-1][:most], u[:, ::-1].T[:most], float(np.trace(v))
    return np.where(e > trace * len(v) * 2.0**-52, e, 0.0), u, trace


def fit(vectors: DataFrame, embedding: str = "embedding", most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors."""
    ship(vectors.sparkSession)
    own = vectors.select(F.col(embedding).cast("array<double>").alias("v"))
    fits: dict[int, Fit] = {}
    for r in _summed(own, lambda x: x.sum(axis=0).astype(object), "i").orderBy("dim", "i").collect():
        fits.setdefault(r.dim, Fit(r.n, [])).sums.append(int(r.s))
    known = {d: (f.n, f.whole, f.rest) for d, f in fits.items()}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair")
        d = int(pdf["dim"].iloc[0])
        n, _, rest = known[d]
        e, u, trace = principal(covariance(n, rest, [int(s) for s in pdf["s"]]), most)
        return pd.DataFrame({"dim": d, "k": np.arange(len(e)), "e": e, "u": list(u), "trace": trace})

    pairs = _summed(own, lambda x: square_sums(x - known[x.shape[1]][1]), "pair")
    solved = cut(pairs.groupBy("dim").applyInPandas(solve, "dim int, k int, e double, u array<double>, trace double"))
    for d, rows in pd.DataFrame(solved.orderBy("dim", "k").collect(), columns=solved.columns).groupby("dim"):
        fits[d].values, fits[d].vectors, fits[d].trace = rows["e"].to_numpy(float), np.array(rows["u"].tolist()), float(rows["trace"].iloc[0])
    _measure(own, fits)
    return fits


def _measure(own: DataFrame, fits: dict[int, Fit]) -> None:
    """Set the largest error of the whitened rows' covariance. Their means are 0 but for rounding; what is there is taken off."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in integers(b.column(0), SCALE, SHIFT):
                f = fits[x.shape[1]]
                w = f.whitened(f.deviations(x))[:, f.values > 0]
                w = np.column_stack([w, np.ones(len(w))])
                held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["dim", "at", "s"])

    sums: dict[int, list[float]] = {}
    for r in own.mapInArrow(run, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s")).orderBy("dim", "at").collect():
        sums.setdefault(r.dim, []).append(r.s)
    for d, flat in sums.items():
        k = int((fits[d].values > 0).sum())
        m, n = np.array(flat).reshape(k + 1, k + 1), fits[d].n
        mean = m[k, :k] / n
        fits[d].error = float(np.abs(m[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max()) if k else None


def whiten(vectors: DataFrame, fits: dict[int, Fit], vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    ship(vectors.sparkSession)
    own = vectors.select(F.col(vec_id), F.col(embedding).cast("array<double>"))
    names = [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in integers(b.column(1), SCALE, SHIFT):
                f = fits[x.shape[1]]
                z, m, k = f.deviations(x), len(x), len(f.values)
                if z.dtype != object and x.shape[1] * int(np.abs(z).max()) ** 2 >= 1 << 62:
                    far = (z.astype(object) ** 2).sum(axis=1)
                else:
                    far = (z * z).sum(axis=1)
                far = pa.array([Decimal(int(s)) for s in far], _EXACT) if far.dtype == object else pa.array(far).cast(_EXACT)
                each = pa.array(np.repeat(np.arange(m), k))
                w, share = f.whitened(z).ravel(), np.tile(f.values / f.trace if f.trace else np.full(k, np.nan), m)
                error = pa.array([f.error], pa.float64()).take(pa.array(np.zeros(m * k, np.int64)))
                columns = [b.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, f.n))]
                columns += [far.take(each), pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)), error]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"`{vec_id}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
