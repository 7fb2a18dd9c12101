"""Language identification by partial matching: byte context trees with escapes, one per language.

Training counts runs of ORDER + 1 symbols in a bounded sample of labelled texts and freezes the
counts. A symbol is a byte with A-Z lower-cased and every ASCII non-letter one symbol. In each
language a symbol seen in a context has probability c / (n + d), n occurrences and d distinct
symbols there; the escape has d / (n + d) and passes to the context without its oldest symbol,
whose distribution excludes what the longer one has seen, down to a uniform one, so that each
context's probabilities sum to one. A language that lacks a context uses its longest known suffix.

The trees of all languages share one table: history to longest known context, then context and
symbol to the probability in each language. A text's code length in a language is a sum over its
bytes, two array lookups each; the shortest code names the language (the first by name at a tie)
and the score is its posterior under equal priors.

Null texts and texts without a letter are `und` with score 0, as is every text where nothing was
learned. Null languages, texts and ids train nothing; rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import chunks, map_batches

ORDER = 3
#: Distinct texts a language is learned from at most, those with the smallest hashes: copies count once, and every language has some.
SAMPLE = 1200
#: Occurrences that the longest contexts need, and how many of them are kept at most (the most frequent).
LEAST, STATES = 3, 24000

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x41:0x5B] = np.arange(1, 27)
_SYMBOL[0x80:] = np.arange(27, 155)
A = 155


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; null ids don't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass
class Model:
    langs: list[str]
    context: np.ndarray  # history code -> context
    bits: np.ndarray  # context * A + symbol -> nats in each language


def _histories(sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code of the ORDER symbols before each position; before a text stand non-letters."""
    n = len(sym)
    out = np.zeros(n, np.int64)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(ORDER, 0, -1):
        out *= A
        if n > k:
            out[k:] += np.where(place[k:] >= k, sym[:-k], 0)
    return out


def sample(docs: DataFrame, text: str, lang: str, train: Column, most: int) -> DataFrame:
    """(lang, text) of the `most` distinct labelled texts of each language with the smallest hashes; all, if there are fewer."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit(17), text).alias("h"), F.col(text).alias("text"))
    first = Window.partitionBy("lang").orderBy("h")  # a task keeps no more than `most` of its rows before they are shuffled
    bounds = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= max(1, most)).groupBy("lang").agg(F.max("h").alias("last"))
    return rows.join(F.broadcast(bounds), "lang").where("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", train: Column | None = None, most: int = SAMPLE, states: int = STATES, least: int = LEAST) -> Model:
    ship(docs.sparkSession)

    def count(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            known = sorted(set(names))
            index = np.array([known.index(x) for x in names])
            for lo, hi, data, offsets in chunks(b.column(1)):
                sym = _SYMBOL[data].astype(np.int64)
                who = np.repeat(index[lo:hi], np.diff(offsets))
                code, n = np.unique((who * A**ORDER + _histories(sym, offsets)) * A + sym, return_counts=True)
                where, code = code // A ** (ORDER + 1), code % A ** (ORDER + 1)
                yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in where], pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    rows = sample(docs, text, lang, F.lit(True) if train is None else train, most).mapInArrow(count, "lang string, code long, n long")
    got = rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    return build(got.column("lang").to_pylist(), got.column("code").to_numpy(), got.column("n").to_numpy(), states, least)


def build(lang: list[str], code: np.ndarray, n: np.ndarray, states: int = STATES, least: int = LEAST) -> Model:
    """The shared table from the counts of runs."""
    langs = sorted(set(lang))
    who = np.array([{x: i for i, x in enumerate(langs)}[x] for x in lang], np.int64)
    code, n = np.asarray(code, np.int64), np.asarray(n, np.int64)
    history, sym = code // A, code % A
    if not langs:
        return Model([], np.zeros(A**ORDER, np.int32), np.zeros((A, 0), np.float32))
    context = np.zeros(A**ORDER, np.int32)
    tables, base, suffixes = [], 0, None
    for k in range(ORDER + 1):
        own = history % A**k
        ctx, at = np.unique(own, return_inverse=True)
        total = np.bincount(at, n)
        if k == ORDER:
            keep = np.sort(np.lexsort((ctx, -total))[:states])
            keep = keep[total[keep] >= least]
            new = np.full(len(ctx), -1)
            new[keep] = np.arange(len(keep))
            ctx, at = ctx[keep], new[at]
        table = np.empty((len(ctx), A, len(langs)), np.float32)
        shorter = None if k == 0 else tables[-1][np.searchsorted(suffixes, ctx % A ** (k - 1))]
        for j in range(len(langs)):
            mine = (who == j) & (at >= 0)
            c = np.zeros((len(ctx), A), np.float32)
            np.add.at(c, (at[mine], sym[mine]), n[mine])
            low = np.full((len(ctx), A), 1 / A, np.float32) if k == 0 else shorter[:, :, j]
            seen = c > 0
            d, t = seen.sum(1, keepdims=True), c.sum(1, keepdims=True)
            left = np.where(seen, 0, low)
            rest = left.sum(1, keepdims=True)
            escape = np.where(rest > 0, d / np.maximum(t + d, 1), 0)
            p = c * (1 - escape) / np.maximum(t, 1) + escape * left / np.maximum(rest, 1e-30)
            table[:, :, j] = np.where(t > 0, p, low)
        tables.append(table)
        suffixes = ctx
        view = context.reshape(A ** (ORDER - k), A**k)
        view[:, ctx] = np.arange(base, base + len(ctx), dtype=np.int32)
        base += len(ctx)
    bits = -np.log(np.maximum(np.concatenate(tables), 1e-12)).reshape(-1, len(langs))
    return Model(langs, context, bits.astype(np.float32))


def lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length in nats of each text in each language."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    if len(data) and len(model.langs):
        sym = _SYMBOL[data]
        cost = model.bits.take(model.context.take(_histories(sym, offsets)).astype(np.int64) * A + sym, axis=0)
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(cost, offsets[full], axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(False) if held is None else held).alias("held_out"), F.col(text).alias("text"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        model, names, score = sent.value, [], []
        for lo, hi, data, offsets in chunks(b.column(2)):
            cost = lengths(model, data, offsets)
            sym = _SYMBOL[data]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            plain, other = total((sym > 0) & (sym < 27)), total(sym >= 27)
            for d in range(hi - lo):
                # bytes beyond ASCII may or may not be letters
                if model.langs and (plain[d] or other[d] and any(map(str.isalpha, b.column(2)[lo + d].as_py()))):
                    best = int(cost[d].argmin())
                    names.append(model.langs[best])
                    score.append(float(1 / np.exp(cost[d, best] - cost[d]).sum()))
                else:
                    names.append("und")
                    score.append(0.0)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, one, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
