"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

An item's windows are its runs of `window` words (an item of fewer words is one window). A
window can occur in a text only where its rarest shingle does, so that shingle alone is its
prefix (containment 1 leaves a prefix of one token; a window shorter than a shingle is its own prefix). Rarity is the number of occurrences in
all documents, counted in a first pass over them. A second pass looks for prefixes, and from
each occurrence sends the prefix and the words around it, as many as a window can have; these meet
the windows by an equi-join on the prefix, which keeps the alignments in which the whole window fits between the text's first
and last word (length and position bounds) and has equal words.

Documents are scanned twice whatever the benchmark's size, and neither rewritten nor shuffled: what moves are counts of the
benchmark's shingles and the few words around prefixes. Both scans drop other shingles early by a bitmap of the
wanted ones, the only thing that is broadcast: at most 2^27 bits (16 MB); beyond some ten million
shingles of a benchmark it lets more rows through to the join and changes no result.

Null and empty texts have no words; null item ids and items without words are ignored; items
with the same id count once; rows of documents are judged one by one, repeated ones too, null ids too. Empty tables give no rows, or
rows without hits. Extra columns are of no consequence to the report and stay in what `clean` keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, chunks, cut, free_names, map_batches

#: Words in a window, and in the shingles that prefixes are made of.
WINDOW, SHINGLE = 13, 5
#: Bits of the bitmap of wanted shingles: so many for each of them, between two limits.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27


def _sieve(keys: DataFrame) -> np.ndarray:
    """The bitmap of the keys (h long), by their highest bits: summed by Spark, one row for each 64 bits."""
    bits = int(np.clip(np.ceil(np.log2(max(1, keys.count()) * BITS_EACH)), LEAST_BITS, MOST_BITS))
    words = keys.groupBy(F.shiftrightunsigned("h", 70 - bits).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _some(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in h that may be wanted."""
    top = h >> np.uint64(64 - (len(sieve).bit_length() + 5))
    return np.flatnonzero((sieve[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1))


def _runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's runs of k words and the words that begin them."""
    h, at = w.shingles(k)
    full = np.flatnonzero(at + k <= w.first[1:][w.doc[at]])
    return h[full], at[full]


def _items(benchmark: DataFrame, item_id: str, text: str, shingle: int) -> DataFrame:
    """(row, i, words, keys): items with words, and the keys of their shingles (a shorter item has one)."""
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).distinct()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        words, keys = [], []
        for lo, hi, data, offsets in chunks(b.column(1)):
            w = Words(data, offsets)
            h, at = w.shingles(shingle)
            text = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)]
            for d in range(hi - lo):
                a, e = int(w.first[d]), int(w.first[d + 1])
                words.append(text[a:e])
                keys.append(h[np.searchsorted(at, a) : np.searchsorted(at, e)].view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], ["i", "words", "keys"])

    return cut(map_batches(rows, one, "i string, words array<string>, keys array<long>").where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()))


def _counts(docs: DataFrame, text: str, sieve: np.ndarray, sizes: list[int]) -> DataFrame:
    """(h, n): occurrences in all documents of runs of those sizes that may be wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in chunks(b.column(0)):
            w = Words(data, offsets)
            for k in sizes:
                h = _runs(w, k)[0]
                found.append(h[_some(sent.value, h)])
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return map_batches(docs.select(text), one, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _windows(items: DataFrame, counts: DataFrame, shingle: int, window: int) -> DataFrame:
    """(h, off, size, g, i): each window's prefix, the prefix's place in it, its number of words, its words, its item."""
    each = items.select("row", F.posexplode("keys").alias("p", "h")).join(counts, "h", "left")
    ranked = items.join(each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n")))).alias("c")), "row").select("i", "words", "keys", F.col("c.n").alias("n"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(5)]
        for i, words, keys, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            size = min(window, len(words))
            off = np.lib.stride_tricks.sliding_window_view(np.array(n), max(1, size - shingle + 1)).argmin(1).tolist()
            for s in range(len(words) - size + 1):
                for c, v in zip(out, (keys[s + off[s]], off[s], size, " ".join(words[s : s + size]), i), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["h", "off", "size", "g", "i"])

    return cut(map_batches(ranked, one, "h long, off int, size int, g string, i string").distinct())


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text, by which what is found returns to it."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2")]


def _sightings(docs: DataFrame, doc_id: str, text: str, sieve: np.ndarray, sizes: list[int], shingle: int, window: int) -> DataFrame:
    """Each row's id, key and number of words, and its sightings of what may be prefixes: key, first word, words before it in `near`, the words near it."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_key(docs, doc_id, text), F.col(text).alias("t"))
    struct = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("near", pa.string())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        count, seen = [], []
        for lo, hi, data, offsets in chunks(b.column(3)):
            w = Words(data, offsets)
            own: dict[int, list[dict]] = {}

            def add(h: int, at: int, a: int, e: int, w: Words = w, own: dict = own) -> None:
                d = int(w.doc[at])
                a, e = max(a, int(w.first[d])), min(e, int(w.first[d + 1]))
                near = b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in range(a, e)).decode()
                own.setdefault(d, []).append({"h": h, "at": at - int(w.first[d]), "before": at - a, "near": near})

            for k in sizes:
                h, at = _runs(w, k)
                more = max(0, window - k) if k == shingle else 0  # shorter runs are whole windows
                for x in _some(sent.value, h).tolist():
                    p = int(at[x])
                    add(int(h[x].view(np.int64)), p, p - more, p + k + more)
            count += np.diff(w.first).tolist()
            seen += [own.get(d) for d in range(hi - lo)]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(count, pa.int64()), pa.array(seen, struct)], ["doc_id", "k1", "k2", "n_words", "seen"])

    return cut(map_batches(rows, one, f"doc_id {kind}, k1 long, k2 long, n_words long, seen array<struct<h:long,at:int,before:int,near:string>>"))


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, k1, k2, n_words); and (k1, k2, n_hit, items) for those keys with hits, items being sorted ids."""
    ship(docs.sparkSession)
    shingle = min(SHINGLE, window)
    items = _items(benchmark, item_id, item_text, shingle)
    sizes = sorted(r.k for r in items.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect())
    keys = cut(items.select(F.explode("keys").alias("h")).distinct())
    windows = _windows(items, _counts(docs, doc_text, _sieve(keys), sizes).join(keys, "h"), shingle, window)
    rows = _sightings(docs, doc_id, doc_text, _sieve(windows.select("h").distinct()), sizes, shingle, window)
    seen = rows.where("seen is not null").select("k1", "k2", F.explode("seen").alias("s")).select("k1", "k2", "s.*").distinct()
    met = seen.join(windows.select("h", "off", "size", "g").distinct(), "h").where("off <= before")
    words = F.split("near", " ")
    fits = met.where(F.array_join(F.slice(words, F.greatest(F.lit(1), F.col("before") - F.col("off") + 1), F.col("size")), " ") == F.col("g"))
    hits = cut(fits.select("k1", "k2", (F.col("at") - F.col("off")).alias("s"), "size", "g"))
    key = W.partitionBy("k1", "k2").orderBy("s", "size")
    ends = hits.select("k1", "k2", "s", "size").distinct().withColumn("past", F.coalesce(F.max(F.col("s") + F.col("size")).over(key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    covered = ends.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("s") + F.col("size") - F.greatest("s", "past"))).cast("long").alias("n_hit"))
    named = hits.select("k1", "k2", "g").distinct().join(windows.select("g", "i").distinct(), "g").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("i")).alias("items"))
    return rows.drop("seen"), covered.join(named, ["k1", "k2"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Of the words, a twentieth or more lie in windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document: words, hit words, items, digest of the item ids, verdict."""
    rows, found = judge(docs, benchmark, **options)
    hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    rows, found = judge(docs, benchmark, doc_id=doc_id, doc_text=doc_text, **options)
    k1, k2 = free_names(docs, "sw_k1", "sw_k2")
    bad = cut(rows.join(found, ["k1", "k2"]).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct())
    own = _key(docs, doc_id, doc_text)
    return docs.join(bad, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left_anti")


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """The definition itself, for tests: words, hit words and item ids of each text."""
    import re

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for i, x in items:
            x = words(x)
            n = min(window, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit |= set(range(p, p + n))
                        own.add(str(i))
        out.append((len(w), len(hit), sorted(own)))
    return out



