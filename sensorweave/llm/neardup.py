"""Near-duplicate texts: ProbMinHash signatures of weighted shingles, bands, exact verification, classes.

A text's shingles are its runs of five words, weighing 1 + ln(occurrences). Each shingle is a
Poisson process whose rate is its weight; every arrival falls into one of M registers, and a
register keeps the shingle that arrived first. Arrivals are made in rounds and a shingle stops as
soon as its next arrival is later than all the text's registers, so most stop after one or two.
Two texts agree in a register with the probability of their probability Jaccard similarity. A text in which
shingles repeat has a second signature, all its shingles weighing 1: it agrees with another's with the probability of their plain
Jaccard similarity (of a text without repeats both signatures are one).

Equal texts are one class from the start, so large groups of copies cost one row each. Registers
go four to a band (fewer for lower similarities), and texts with a band of any of their signatures in common share a bucket. The same rule holds for buckets of every
size. In each of ROUNDS rounds a text proposes one link, to a member of the largest component of one
of its buckets, which is verified exactly; so a round costs at most a pair a text, and a group of
copies becomes one component without being spelled out. Then nothing is left to chance: wherever a
bucket still spans several components, all pairs across them are compared by registers, in tasks of two
blocks of bounded size, and those that agree in enough registers are verified exactly within such
tasks, which report no pairs but a spanning forest of their links. A pair is compared in the first
bucket that it shares only. Within a bucket that is not one component after the rounds, comparisons grow with the square of what its
largest component leaves, and so do, divided by the size of a block, the rows that are sent to them.

What is missed follows from the similarity asked for (see Plan). At 0.8, of either kind: pairs share none of 32 bands once in 20 million, agree in fewer than 80 of 128
registers once in 700,000 and have an end with fewer than three shared buckets less than once in 50,000.

A link is a probability Jaccard or a plain Jaccard similarity of 0.8 or more (they are equal where
no shingle repeats). The result has the components of links. Null texts and texts without words
link with nothing; texts of fewer than five words have one shingle, all their words. Ids are integers (others are refused). Rows with
one id are one document if their texts are equal, else documents of their own. Null ids are kept and compared with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import _Q, Words, chunks, cut, free_names, hot_join, integral, map_batches, merged, mix, whole_groups

SHINGLE, SIMILARITY = 5, 0.8
#: Registers of a signature, and registers of 16 bits that go to a stored number.
M, WORD = 128, 4
#: Rounds of proposed links before the rest is compared pair by pair.
ROUNDS = 2
#: Members and bytes of text of a block where pairs across components are compared.
BLOCK, BLOCK_BYTES = 2048, 8 << 20


@dataclass(frozen=True)
class Plan:
    """How candidates of a similarity are found: registers to a band, buckets that a text must share to have a partner, registers that a pair must agree in."""

    band: int
    shared: int
    likely: int

    @staticmethod
    def of(least: float) -> Plan:
        """The widest bands that a pair shares none of once in a million; the most buckets that an end has too few of once in 20,000; five deviations below the mean of agreeing registers."""
        if not 0 < least <= 1:
            raise ValueError("a similarity lies above 0, up to 1")
        fewer = lambda k, s: sum(comb(M // k, i) * least ** (k * i) * (1 - least**k) ** (M // k - i) for i in range(s))
        band = next((k for k in (4, 2) if fewer(k, 1) < 1e-6), 1)
        shared = max((s for s in range(1, 4) if fewer(band, s) < 5e-5), default=1)
        return Plan(band, shared, max(1, int(M * least - 4.9 * sqrt(M * least * (1 - least)))))

    def keys(self, regs: np.ndarray) -> np.ndarray:
        """The bands of registers, a row a text."""
        return regs.view({4: np.int64, 2: np.uint32, 1: np.uint16}[self.band])

    def column(self) -> Column:
        """(band, v) of a text's column of signatures, each once."""
        parts, bits = WORD // self.band, 16 * self.band
        each = lambda x, i: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda j: F.struct(((i % (M // WORD)) * parts + j).cast("int").alias("band"), F.call_function("shiftrightunsigned", x, j * bits).bitwiseAND((1 << bits) - 1 if bits < 64 else -1).alias("v")))
        return F.array_distinct(F.flatten(F.transform("bands", each)))


def weighted(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles, ordered by text and hash."""
    h, at = w.shingles(k)
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], 1 + np.log(np.diff(np.append(at, len(h))))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """The shingle that each register of each text keeps; 0 where the text has none."""
    first, own = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    latest, t, k = np.full(n_docs, np.inf), np.zeros(len(h)), 0
    while len(h):
        k += 1
        r = mix(h + np.full(1, k, np.uint64) * _Q)
        t = t - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / weight
        live = t < latest[doc]
        h, doc, weight, t, r = h[live], doc[live], weight[live], t[live], r[live]
        slot = doc * m + (mix(r) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        own[slot[won]] = h[won]
        if k < 8 or k % 8 == 0:
            latest = first.reshape(n_docs, m).max(1)
    return own.reshape(n_docs, m)


def bands(own: np.ndarray) -> np.ndarray:
    """16 bits of each register, four of them to a number of 64."""
    return mix(own).astype(np.uint16).view(np.int64)


def _registers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The weighted and the plain registers behind a column of signatures, a row a text; they are the same where a text has one signature."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, size = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths()).astype(np.int64)
    first, own = np.cumsum(size) - size, M // WORD
    rows = lambda at: values[at[:, None] + np.arange(own)].view(np.uint16)
    weighted_ = rows(first)
    return weighted_, weighted_ if (size == own).all() else rows(first + size - own)


def _agree(x: tuple[np.ndarray, np.ndarray], a: np.ndarray, y: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    """Registers in which rows a of x agree with rows b of y, of the signature that agrees more."""
    n = (x[0][a] == y[0][b]).sum(1)
    return n if x[0] is x[1] and y[0] is y[1] else np.maximum(n, (x[1][a] == y[1][b]).sum(1))


def _sign(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, content key, bytes and bands of each document that has an id and a word."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), *content(text), F.octet_length(text).alias("size"), F.col(text).alias("t"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        worded, keys, sizes = [], [], []
        for lo, hi, data, offsets in chunks(b.column(4)):
            w = Words(data, offsets)
            has = np.diff(w.first) > 0
            worded.append(has)
            doc, h, weight = weighted(w)
            own = bands(signatures(doc, h, weight, hi - lo))
            twice = np.bincount(doc, weight > 1, hi - lo) > 0
            again = twice[doc]
            plain = bands(signatures((np.cumsum(twice) - 1)[doc[again]], h[again], np.ones(again.sum()), int(twice.sum())))
            at = np.concatenate([np.arange(hi - lo), np.flatnonzero(twice)])
            order = np.argsort(at, kind="stable")
            order = order[has[at[order]]]
            keys.append(np.concatenate([own, plain])[order].ravel())
            sizes.append(np.where(twice, 2, 1)[has] * (M // WORD))
        keep, keys = np.concatenate(worded), np.concatenate(keys)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()), pa.array(keys))
        own = pa.RecordBatch.from_arrays(list(b.columns[:4]), ["id", "k1", "k2", "size"]).filter(pa.array(keep))
        return pa.RecordBatch.from_arrays([*own.columns, lists], ["id", "k1", "k2", "size", "bands"])

    return map_batches(rows, one, "id long, k1 long, k2 long, size int, bands array<long>")


def content(text: str) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def similarities(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The larger of plain and probability Jaccard similarity of each pair of texts, exactly."""
    out = []
    for lo, hi, data, offsets in chunks(a):
        left = weighted(Words(data, offsets))
        right = [[], [], []]
        for lo2, _, data2, offsets2 in chunks(b.slice(lo, hi - lo)):
            d, h, x = weighted(Words(data2, offsets2))
            for own, y in zip(right, (d + lo2, h, x), strict=True):
                own.append(y)
        out.append(_jaccard(left, [np.concatenate(x) for x in right], hi - lo))
    return np.concatenate(out) if out else np.zeros(0)


def _jaccard(left, right, n: int) -> np.ndarray:
    pair, h = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
    zero = np.zeros
    wa, wb = np.concatenate([left[2], zero(len(right[2]))]), np.concatenate([zero(len(left[2])), right[2]])
    order = np.lexsort((h, pair))
    pair, h, wa, wb = pair[order], h[order], wa[order], wb[order]
    if not len(h):
        return np.zeros(n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    pair, wa, wb = pair[at], np.add.reduceat(wa, at), np.add.reduceat(wb, at)
    both = (wa > 0) & (wb > 0)
    common, every = np.bincount(pair, both, n), np.bincount(pair, minlength=n)
    plain = common / np.maximum(every, 1)
    # by rising ratio wa / wb: a shingle's denominator is the sum of wb up to its ratio over its wb, and of wa beyond over its wa
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.lexsort((ratio, pair))
    pair, wa, wb, both = pair[order], wa[order], wb[order], both[order]
    begin = np.searchsorted(pair, np.arange(n + 1))
    ca, cb = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    i = np.flatnonzero(both)
    p = pair[i]
    below, above = cb[i + 1] - cb[begin[p]], ca[begin[p + 1]] - ca[i + 1]
    return np.maximum(plain, np.bincount(p, 1 / (below / wb[i] + above / wa[i]), n))


def _shared(reps: DataFrame, plan: Plan) -> DataFrame:
    """(band, v, rep, size): buckets of two texts and more, of texts that are in enough of them."""
    dealt = reps.select("rep", "size", F.explode(plan.column()).alias("k")).select("rep", "size", "k.band", "k.v")
    full = cut(dealt.groupBy("band", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = hot_join(dealt, full, ["band", "v"], full).select("band", "v", "rep", "size")
    often = held.groupBy("rep", "size").agg(F.collect_list(F.struct("band", "v")).alias("keys")).where(F.size("keys") >= plan.shared)  # at most two rows a band
    return cut(often.select("rep", "size", F.explode("keys").alias("k")).select("k.band", "k.v", "rep", "size"))


def _placed(held: DataFrame, comp: DataFrame | None) -> DataFrame:
    """held with each text's component."""
    if comp is None:
        return held.withColumn("comp", F.col("rep"))
    return held.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "v", "rep", "size", F.coalesce("component", "rep").alias("comp"))


def _proposed(own: DataFrame, tested: DataFrame | None, seed: int) -> DataFrame:
    """(a, b): for each text a one untested member b of the largest component of its buckets, the one that most of them name; a is of another component."""
    least = F.min(F.struct(F.xxhash64(F.lit(seed), "rep").alias("h"), F.col("rep").alias("b")))["b"]
    each = own.groupBy("band", "v", "comp").agg(F.count(F.lit(1)).alias("n"), least.alias("b")) if seed else own.select("band", "v", "comp", F.lit(1).alias("n"), F.col("rep").alias("b"))
    most = F.max(F.struct("n", F.xxhash64(F.lit(seed), "comp").alias("h"), "comp", "b"))
    full = cut(each.groupBy("band", "v").agg(most.alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("band", "v", "n", F.col("m.comp").alias("main"), "m.b"))
    named = hot_join(own, full.drop("n"), ["band", "v"], full).where("comp != main").groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    if tested is not None:
        named = named.join(tested, ["a", "b"], "left_anti")
    return cut(named.groupBy("a").agg(F.max(F.struct("n", F.xxhash64(F.lit(seed), "b").alias("h"), "b"))["b"].alias("b")))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def _likely(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """The pairs that agree in enough registers."""
    side = lambda k, x: reps.select(F.col("rep").alias(k), F.col("bands").alias(x))
    rows = hot_join(pairs.join(side("a", "x"), "a"), side("b", "y"), ["b"], _named(pairs)).select("a", "b", "x", "y")

    def one(t: pa.RecordBatch) -> pa.RecordBatch:
        every = np.arange(t.num_rows)
        agree = _agree(_registers(t.column(2)), every, _registers(t.column(3)), every)
        return pa.RecordBatch.from_arrays(list(t.columns[:2]), ["a", "b"]).filter(pa.array(agree >= plan.likely))

    return cut(map_batches(rows, one, "a long, b long"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    side = lambda k, t: texts.select(F.col("id").alias(k), F.col("t").alias(t))
    rows = hot_join(pairs.join(side("a", "ta"), "a"), side("b", "tb"), ["b"], _named(pairs), most=64).select("a", "b", "ta", "tb")

    def one(x: pa.RecordBatch) -> pa.RecordBatch:
        good = similarities(x.column(2), x.column(3)) >= least - 1e-9
        return pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(good))

    return cut(map_batches(rows, one, "a long, b long"))


def _dealt(own: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Tasks (band, v, kind, i, j) and their members (side, rep, comp) for all pairs across components of a bucket.

    A bucket that fits one block is one task, where every text meets all (side 2). In larger ones texts of the most
    frequent component need no comparison with each other: its blocks meet those of the other texts (kind 0), which
    meet each other (kind 1), so a bucket that is nearly one component costs a row or two for each of its members.
    """
    each = cut(own.groupBy("band", "v", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")))
    most = F.max(F.struct("n", "s", "comp"))
    span = each.groupBy("band", "v").agg(most.alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(s / block_bytes)).cast("int")
    whole = (F.col("n") <= block) & (F.col("s") <= block_bytes)
    span = cut(span.select("band", "v", "n", whole.alias("whole"), F.col("m.comp").alias("main"), blocks(F.col("m.n"), F.col("m.s")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("others")))
    at = F.xxhash64(F.lit(11), "rep")
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    i, j, zero = F.pmod(at, "mains").cast("int"), F.pmod(at, "others").cast("int"), F.lit(0)
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    with_mains = F.transform(upto(F.col("mains")), lambda x: task(0, x, j, F.lit(1)))
    with_others = F.transform(upto(F.col("others")), lambda x: task(1, F.least(x, j), F.greatest(x, j), F.when(x == j, 2).when(x > j, 0).otherwise(1)))
    from_main = F.transform(upto(F.col("others")), lambda x: task(0, i, x, zero))
    tasks = F.when(F.col("whole"), F.array(task(2, zero, zero, F.lit(2)))).when(F.col("comp") == F.col("main"), from_main).otherwise(F.concat(with_mains, with_others))
    return hot_join(own, span.drop("n"), ["band", "v"], span).select("band", "v", F.explode(tasks).alias("t"), "rep", "comp").select("band", "v", "t.kind", "t.i", "t.j", "t.side", "rep", "comp")


_TASK = ["band", "v", "kind", "i", "j"]


def _pairs(t: pa.Table, plan: Plan, most: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of pairs of one task and of different components that agree in enough registers and share no earlier bucket, and how many agree."""
    regs = _registers(t.column("bands"))
    col = {k: t.column(k).to_numpy() for k in ("band", "side", "comp", "rep")}
    first = np.ones(len(t), bool)
    first[1:] = np.any([(x := t.column(k).to_numpy())[1:] != x[:-1] for k in _TASK], axis=0)
    begin = np.append(np.flatnonzero(first), len(t))
    size = np.diff(begin)
    keys = [plan.keys(r) for r in (regs[:1] if regs[0] is regs[1] else regs)]

    def good(a: np.ndarray, b: np.ndarray):
        own = (col["comp"][a] != col["comp"][b]) & ((col["side"][a] != 2) | (col["rep"][a] < col["rep"][b]))
        a, b = a[own], b[own]
        for lo in range(0, len(a), most):
            x, y = a[lo : lo + most], b[lo : lo + most]
            n = _agree(regs, x, regs, y)
            x, y, n = x[n >= plan.likely], y[n >= plan.likely], n[n >= plan.likely]
            if len(x):
                met = np.any([k[x] == m[y] for k in keys for m in keys], axis=0)
                new = met.argmax(1) == col["band"][x]
                yield x[new], y[new], n[new]

    few, of = size <= 16, np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(few[of])
    for d in range(1, 16):  # small tasks together: each row with the d-th after it
        a, b = at[:-d], at[d:]
        same = of[a] == of[b]
        a, b = a[same], b[same]
        side = col["side"]
        turn = (side[a] == 1) | ((side[a] == 2) & (col["rep"][a] > col["rep"][b]))
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        own = (side[a] == 2) | (side[a] != side[b])
        yield from good(a[own], b[own])
    for g in np.flatnonzero(~few).tolist():
        rows = np.arange(begin[g], begin[g + 1])
        side = col["side"][rows]
        left, right = rows[side != 1], rows[side != 0]
        step = max(1, (most * 16) // max(1, len(right)))
        for lo in range(0, len(left), step):
            some = left[lo : lo + step]
            yield from good(np.repeat(some, len(right)), np.tile(right, len(some)))


def _flagged(dealt: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """The members of tasks that have a likely partner there."""
    ship(dealt.sparkSession)
    rows = dealt.join(reps.select("rep", "bands"), "rep").select(*_TASK, "side", "rep", "comp", "bands").repartition(*_TASK).sortWithinPartitions(*_TASK)

    def run(batches):
        for t in whole_groups(batches, len(_TASK)):
            hit = np.zeros(len(t), bool)
            for a, b, _ in _pairs(t, plan):
                hit[a] = hit[b] = True
            if hit.any():
                yield from t.drop_columns(["bands"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return rows.mapInArrow(run, dealt.schema)


def _forest(flagged: DataFrame, reps: DataFrame, texts: DataFrame, least: float, plan: Plan) -> DataFrame:
    """(a, b): for each task a forest of links that joins what its links join."""
    ship(flagged.sparkSession)
    rows = flagged.join(reps.select("rep", "bands"), "rep").join(texts.withColumnRenamed("id", "rep"), "rep")
    rows = rows.select(*_TASK, "side", "rep", "comp", "bands", "t").repartition(*_TASK).sortWithinPartitions(*_TASK)

    def run(batches):
        for t in whole_groups(batches, len(_TASK)):
            a, b, n = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.int64),) * 3, *_pairs(t, plan)], strict=True))
            order = np.argsort(-n, kind="stable")
            a, b, rep, comp = a[order], b[order], t.column("rep").to_numpy(), t.column("comp").to_numpy()
            begin, h, x = _texts(t.column("t"))
            top: dict[int, int] = {}

            def find(k: int) -> int:
                while (y := top.setdefault(k, k)) != k:
                    top[k] = k = top.setdefault(y, y)
                return k

            size = begin[1:] - begin[:-1]
            edges = np.append(np.searchsorted((total := np.cumsum(size[a] + size[b])), np.arange(0, total[-1], 1 << 17)), len(a)) if len(a) else [0]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                open_ = [k for k in range(lo, hi) if find(int(comp[a[k]])) != find(int(comp[b[k]]))]
                for k in np.array(open_, np.int64)[_alike(a[open_], b[open_], begin, h, x) >= least - 1e-9].tolist() if open_ else ():
                    p, q = find(int(comp[a[k]])), find(int(comp[b[k]]))
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        out.append(k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(rep[a[out]]), pa.array(rep[b[out]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _texts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the shingles of each text begin, all their hashes and weights."""
    doc, h, x = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for lo, _, data, offsets in chunks(column):
        d, own, y = weighted(Words(data, offsets))
        for to, new in zip((doc, h, x), (d + lo, own, y), strict=True):
            to.append(new)
    return np.searchsorted(np.concatenate(doc), np.arange(len(column) + 1)), np.concatenate(h), np.concatenate(x)


def _alike(a: np.ndarray, b: np.ndarray, begin: np.ndarray, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    def side(k: np.ndarray):
        n = begin[k + 1] - begin[k]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[k], n)
        return np.repeat(np.arange(len(k)), n), h[at], x[at]

    return _jaccard(side(a), side(b), len(a))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Documents with words: (id, k1, k2, rep), rep being the least id of their text; and (node, component) of linked reps."""
    integral(docs, doc_id)
    plan = Plan.of(least)
    signed = cut(_sign(docs, doc_id, text))
    reps = cut(signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    member = hot_join(signed.select("id", "k1", "k2"), reps.select("k1", "k2", "rep"), ["k1", "k2"], reps, "copies").select("id", "k1", "k2", "rep")
    if not reps.groupBy("rep").count().where("count > 1").isEmpty():  # an id with several texts: the least content key stands for it among the links
        reps = cut(reps.groupBy("rep").agg(F.min(F.struct("k1", "k2", "size", "bands")).alias("m")).select("rep", "m.*"))
    held = _shared(reps, plan)
    named = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), *content(text), F.col(text).alias("t"))

    def texts(ids: DataFrame) -> DataFrame:
        ends = ids.distinct().join(reps.select(F.col("rep").alias("id"), "k1", "k2"), "id")
        return cut(named.join(ends, ["id", "k1", "k2"]).select("id", "t").dropDuplicates(["id"]))

    comp, tested = None, None
    for k in range(ROUNDS):
        pairs = _proposed(_placed(held, comp), tested, k)
        likely = _likely(pairs, reps, plan)
        if likely.isEmpty():
            break
        links = _verified(likely, texts(likely.select(F.col("a").alias("id")).union(likely.select("b"))), least)
        if not links.isEmpty():
            comp = merged(comp, links)
        both = pairs.union(pairs.select("b", "a"))
        tested = both if tested is None else tested.union(both)
    flagged = cut(_flagged(_dealt(_placed(held, comp), BLOCK, BLOCK_BYTES), reps, plan))
    if not flagged.isEmpty():
        links = cut(_forest(flagged, reps, texts(flagged.select(F.col("rep").alias("id"))), least, plan))
        if not links.isEmpty():
            comp = merged(comp, links)
    if comp is None:
        comp = reps.limit(0).select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    return member, comp


def _found(member: DataFrame, comp: DataFrame) -> DataFrame:
    """id, k1, k2, class_id and component_id of the documents with words."""
    return member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("id", "k1", "k2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row for each document: doc_id, class_id (least id with its text), component_id (least id reachable by links), kept."""
    found = cut(_found(*classes(docs, doc_id, text, least)))
    wordless = docs.select(F.col(doc_id).cast("long").alias("id"), *content(text)).join(found.select("id", "k1", "k2").distinct(), ["id", "k1", "k2"], "left_anti").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    out = found.select("id", "class_id", "component_id").union(wordless)
    return out.select(F.col("id").alias("doc_id"), "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each component (the least id), and all that link with nothing; docs' own columns."""
    found = cut(_found(*classes(docs, doc_id, text, least)))
    i, k1, k2 = free_names(docs, "sw_id", "sw_k1", "sw_k2")
    named = lambda df: df.select(F.col("id").alias(i), F.col("k1").alias(k1), F.col("k2").alias(k2))
    same = [F.col(doc_id).cast("long") == F.col(i), F.xxhash64(text) == F.col(k1), F.xxhash64(F.lit(1), text) == F.col(k2)]
    left = docs.join(named(found.where("id != component_id")), same, "left_anti")
    twice = cut(named(found.where("id = component_id").groupBy("id", "k1", "k2").count().where("count > 1")))
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates([doc_id, text]))


def brute_force(texts: list[str | None], least: float = SIMILARITY) -> set[tuple[int, int]]:
    """All links by the definition, for tests."""
    import re
    from collections import Counter
    from math import log

    bags = []
    for t in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)] or ([tuple(w)] if w else [])
        bags.append({s: 1 + log(n) for s, n in Counter(runs).items()})
    out = set()
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common, every = a.keys() & b.keys(), a.keys() | b.keys()
            if common:
                plain = len(common) / len(every)
                once = plain >= least or max(*a.values(), *b.values()) == 1  # then both are the same
                p = plain if once else sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in common)
                if max(p, plain) >= least:
                    out.add((j, i))
    return out
