"""Fingerprints of documents: sketches that keep every shingle hash below a fixed fraction of all hashes.

A sketch is a sorted array of the first 16 hex digits of the md5 of runs of five words (A-Z lower-cased; a shorter text is one run). Whether a
hash is kept depends on nothing but itself, so sketches of any two texts can be compared, however unequal in length: the share of
one's hashes that the other has estimates containment, and common over all estimates Jaccard. For the same reason sketches merge: that of a
group of texts is the union of theirs. A text of which no hash is below the fraction keeps its smallest one, so that short texts
don't all look alike; a merger drops such hashes where there are others below the fraction. Texts without words have an empty sketch, like
each other (1) and unlike all else (0).

Everything is built from columns and joins. Likeness to a changed text: the last third of each document makes way for the
beginning of the next one by descending id. The order comes from ranges of ids, sorted apart, and one row from each range's end.
Texts are shuffled once by key, with their sketches as bytes, and beginnings once more; both joins read the same exchange (so
both must ask it for the same columns).

Null texts are empty; null ids come last in the order. Documents with one id are ordered by hashes of their texts; repeated rows (id and text) are
kept once while they are worked on and each is the next of another. Very long texts are handled whole. A single document is its own next one; an empty
table gives no rows. Other columns are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, integral

#: Words of a shingle, share of hashes that is kept, hex digits of a hash.
SHINGLE, FRACTION, DIGITS = 5, 1 / 8, 16
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bound(fraction: float) -> str:
    """Hashes that sort before it are kept."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies above 0, up to 1")
    return "g" if fraction == 1 else f"{round(fraction * 16**8):08x}"


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), _SEPARATORS), "")


def sketch(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """The sketch of a text, an array of strings."""
    start = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
    hashes = _once(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(start(w), lambda i: F.md5(F.array_join(F.slice(w, i, shingle), " ")))))
    below = lambda h: F.filter(h, lambda x: x < _bound(fraction))
    kept = _once(hashes, lambda h: _once(below(h), lambda b: F.when((F.size(b) > 0) | (F.size(h) == 0), b).otherwise(F.array(F.array_min(h)))))
    return F.sort_array(F.array_distinct(F.transform(kept, lambda x: F.substring(x, 1, DIGITS))))


def packed(s: Column) -> Column:
    """A sketch as bytes, half as long, for shuffles."""
    return F.unhex(F.array_join(s, ""))


def unpacked(b: Column) -> Column:
    size = DIGITS // 2
    starts = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.lower(F.hex(F.substring(b, i, F.lit(size)))))


def likeness(a: Column, b: Column) -> Column:
    """The estimate of Jaccard similarity from two sketches."""
    both = F.size(F.array_intersect(a, b))
    return _once(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def containment(a: Column, b: Column) -> Column:
    """The estimate of the share of a's shingles that b has; an empty text lies in every one."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both texts' shingles together, of their sketches."""
    every = F.sort_array(F.array_union(a, b))
    bound = _bound(fraction)[:DIGITS]
    return _once(every, lambda e: _once(F.filter(e, lambda x: x < bound), lambda s: F.when((F.size(s) > 0) | (F.size(e) == 0), s).otherwise(F.slice(e, 1, 1))))


def merged(df: DataFrame, by: str, sketches: str, fraction: float = FRACTION) -> DataFrame:
    """(by, hash): sketches of groups as rows, since a group's may be too long for one. Duplicates go before the shuffle."""
    every = df.select(F.col(by), F.explode(sketches).alias("hash")).distinct()
    below = F.col("hash") < _bound(fraction)[:DIGITS]
    least = every.groupBy(by).agg(F.min("hash").alias("hash")).where(~below)  # groups with none below, as hashes sort
    return every.where(below).unionByName(least)


_KEY = ["d", "z", "h1", "h2"]


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """d and z (id, and whether it is null), h1 and h2 (hashes of the text), t and more columns of t."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d"), F.col(doc_id).isNull().alias("z"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return own.select("d", "z", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), "t", *more)


def _previous(keys: DataFrame) -> DataFrame:
    """keys (distinct, with n and rows) and those of the document before each, prefixed p_; the last is before the first."""
    order = [F.col("z"), F.col("d").desc(), F.col("h1"), F.col("h2")]
    held = cut(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = F.struct(*_KEY, "n", "rows")
    within = Window.partitionBy("part").orderBy(*order)
    held = held.withColumns({"p": F.lag(own).over(within), "last": F.lead("d").over(within).isNull()})
    # a row for each part: as many as partitions
    ends = held.where("last").select("part", own.alias("end"))
    parts = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(parts), F.last("end").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    joined = held.join(F.broadcast(ends), "part").withColumn("p", F.coalesce("p", "end"))
    return joined.select(*_KEY, *[F.col(f"p.{c}").alias(f"p_{c}") for c in [*_KEY, "n", "rows"]])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """A row for each document: doc_id, n_chars, edited_sha256, the sketches of both texts, and likeness and containment of the first in the edited and the next text."""
    integral(docs, doc_id)
    size = F.length("t").cast("long")
    keys = _keyed(docs, doc_id, text).groupBy(*_KEY, size.alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    before = cut(_previous(keys))
    once = _keyed(docs, doc_id, text, packed(sketch(F.col("t"), fraction)).alias("s")).groupBy(*_KEY).agg(F.first("t").alias("t"), F.first("s").alias("s"))
    third = lambda n: F.floor(n / 3).cast("int")
    begun = once.join(before, _KEY).select(*[F.col(f"p_{c}").alias(c) for c in _KEY], F.substring("t", F.lit(1), third(F.col("p_n"))).alias("next_t"), F.col("s").alias("next_s"), F.col("p_rows").alias("rows"))
    both = once.join(begun, _KEY).withColumn("n", size)
    own = F.substring("t", F.lit(1), third(F.col("n")))
    nexts = F.when(F.col("rows") == 1, F.array(F.struct(F.col("next_t").alias("t"), F.col("next_s").alias("s"), F.lit(1).cast("long").alias("rows"))))
    nexts = nexts.otherwise(F.array(F.struct(F.col("next_t").alias("t"), F.col("next_s").alias("s"), F.lit(1).cast("long").alias("rows")), F.struct(own.alias("t"), F.col("s").alias("s"), (F.col("rows") - 1).alias("rows"))))
    each = both.select("d", "z", "n", "t", "s", F.explode(nexts).alias("next"))
    edited = F.concat(F.substring("t", F.lit(1), (F.col("n") - third(F.col("n"))).cast("int")), F.col("next.t"))
    each = each.select("d", "z", "n", "s", edited.alias("edited"), F.col("next.s").alias("next"), F.col("next.rows").alias("rows"))
    each = each.select("*", sketch(F.col("edited"), fraction).alias("e"))
    each = each.withColumns({"s": unpacked(F.col("s")), "next": unpacked(F.col("next"))})
    s, e, n = F.col("s"), F.col("e"), F.col("next")
    out = each.select(
        F.when(~F.col("z"), F.col("d")).alias("doc_id"), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), s.alias("sketch"), e.alias("edited_sketch"),
        likeness(s, e).alias("near_edited"), likeness(s, n).alias("near_next"), containment(s, e).alias("in_edited"), containment(s, n).alias("in_next"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    )
    return out.drop("copy")
