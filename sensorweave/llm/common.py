"""What the operators share: written tables, word streams as arrays, components of a graph."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that a kernel holds as arrays at a time; one longer text is still handled whole.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

#: Byte of a text to byte of a word stream: A-Z lower-cased, what is no word character to a space.
WORD_BYTE = np.full(256, 32, np.uint8)
WORD_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x80:] = np.arange(0x80, 0x100)
_CODE = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), the same on every machine."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _codes() -> np.ndarray:
    global _CODE
    if _CODE is None:
        _CODE = mix(np.arange(1, 257, dtype=U64) * _Q)
    return _CODE


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse; those for longer texts than chunks are not kept."""
    if len(_POW["up"]) >= n:
        return _POW["up"][:n], _POW["down"][:n]
    size, made = max(n, CHUNK_BYTES + 4096), {}
    for k, p in (("up", _P), ("down", _P_INV)):
        x = np.full(size, p, U64)
        x[0] = U64(1)
        made[k] = np.cumprod(x, out=x)
    if size == CHUNK_BYTES + 4096:
        _POW.update(made)
    return made["up"][:n], made["down"][:n]


class Words:
    """The words of consecutive texts: byte spans, text index and 64-bit hash of each."""

    __slots__ = ("data", "start", "end", "doc", "hash", "first", "n_docs", "total", "down")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        self.data = a = WORD_BYTE[data]
        self.n_docs = n = len(offsets) - 1
        if not len(a):
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash, self.first, self.total = np.zeros(0, U64), np.zeros(n + 1, np.int64), np.zeros(1, U64)
            return
        isw = a != 32
        begins, ends = isw.copy(), isw.copy()
        begins[1:] &= ~isw[:-1]
        ends[:-1] &= ~isw[1:]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        head, tail = offsets[:-1][full], offsets[1:][full] - 1
        begins[head] |= isw[head]
        ends[tail] |= isw[tail]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = self._hash(a) if hashes else np.zeros(0, U64)

    def _hash(self, a: np.ndarray) -> np.ndarray:
        self.total = np.zeros(len(a) + 1, U64)
        up, self.down = _powers(len(a) + 1)
        codes = _codes()[a]
        codes *= up[:-1]
        np.cumsum(codes, out=self.total[1:])
        return self._between(self.end)

    def _between(self, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[self.start]) * self.down[self.start] + (end - self.start).astype(U64))

    def prefixes(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each word; 0 for words that are shorter."""
        end = self.start + k
        return np.where(end <= self.end, self._between(np.minimum(end, self.end)), U64(0))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within a text, and the index of its first word; a shorter text has one run, all its words."""
        h, n = self.hash, len(self.hash)
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        left = self.first[1:][self.doc] - np.arange(n)
        out, width = np.zeros(n, U64), np.minimum(k, left)
        for j in range(min(k, n)):
            out[: n - j] += np.where(left[: n - j] > j, h[j:] * _powers(k + 1)[0][j], U64(0))
        short = np.diff(self.first)[self.doc] < k
        at = np.flatnonzero((left >= k) | (short & (np.arange(n) == self.first[:-1][self.doc])))
        return mix(out[at] + width[at].astype(U64) * _Q), at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of consecutive texts of about `most` bytes, whole texts each."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """fn over Arrow batches of df, one in and one out, nothing kept between them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups: rows alike in the first `keys` columns are never parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) if n > 1 else []
        last = int(change[-1]) + 1 if len(change) else 0  # where the batch's last group begins
        if not last and held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        elif last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def integral(df: DataFrame, name: str) -> None:
    """Ids of other types are refused: components are told by the least id as a long."""
    kind = df.schema[name].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{name} must hold integers, not {kind}")


#: Rows of a key that no join needs to spread, whatever their share.
HOT_ROWS = 1 << 12


def hot_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, rows: str = "n", most: int = 1024) -> DataFrame:
    """left.join(right, on), where right has one row a key and counts tells in `rows` how many rows of left have a key.

    Keys with more than a `most`-th of all of left's rows, of which there can't be more than `most`, are
    broadcast, so that none of them fills a task; the other keys are shuffled.
    """
    total, top = counts.agg(F.sum(rows), F.max(rows)).first()
    limit = max(HOT_ROWS, (total or 0) // most)
    if (top or 0) <= limit:
        return left.join(right, on)
    hot = F.broadcast(cut(counts.where(F.col(rows) > limit).select(*on)))
    cold = left.join(hot, on, "left_anti").join(right.join(hot, on, "left_anti"), on)
    return left.join(F.broadcast(right.join(hot, on, "left_semi")), on).unionByName(cold)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="sensorweave-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


_TABLES: dict[str, str] = {}


def sweep(spark: SparkSession, folder: str) -> None:
    """Remove a folder, if the session still runs."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's name tells whose it was
        pass


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into a table in the shared folder; its lineage ends there, so a lost executor costs no more than its own tasks.

    A written table, not checkpoint(): that keeps the size estimate of its plan, which for joins
    is a product and over iterations grows to numbers whose digits alone take minutes. Tables of
    an application lie in one folder, which goes when the application ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        _TABLES[app] = posixpath.join(shared_folder(spark), f"tables-{app}")
        atexit.register(sweep, spark, _TABLES[app])
    path = posixpath.join(_TABLES[app], uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, component) of comp's and of more links (a, b), whose graph is that of comp's components."""
    if comp is None:
        return cut(components(links))
    side = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    ends = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    new = cut(components(ends.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")), "u", "v"))
    old = comp.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return cut(old.select("node", F.coalesce("to", "component").alias("component")).union(new.join(comp, "node", "left_anti").select("node", "component")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), the component being its smallest node.

    Each round hooks every node to its neighbour of smallest hash, if smaller than its own, and
    contracts the edges; the hash changes with the round, so paths shrink by a constant factor
    in expectation whatever the ids. Nodes without edges are not in the result; null ends and
    loops are ignored. Rounds are cut by written tables.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = cut(e.union(e.select("v", "u")).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c, r=len(maps): F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("n"))
        best = e.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        step = cut(best.select("u", F.when(F.col("m") < rank(F.col("u")), F.col("m.n")).otherwise(F.col("u")).alias("p")))
        maps.append(step)
        left, right = step.select("u", F.col("p").alias("pu")), step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = cut(e.join(left, "u").join(right, "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    lab = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in maps[1:]:
        lab = lab.join(step.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    lab = cut(lab)
    least = lab.groupBy("root").agg(F.min("node").alias("component"))
    return lab.join(least, "root").select("node", "component")
