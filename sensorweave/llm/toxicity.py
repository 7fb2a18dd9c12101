"""Toxic spans by a linear-chain conditional random field, and the document scores they add up to.

Token labels come from document labels: a word or a word's beginning is an offending one if it
stands between many different pairs of neighbours in toxic texts and hardly ever in clean ones
(neighbours, so that copies of one text count once); its occurrences in toxic texts are labelled
1, all other tokens 0. The field has two states; its potentials are hashed weights of a word, its
beginnings and its two neighbours, and a transition matrix, all fitted by gradient ascent on the
exact conditional likelihood.

Forward and backward messages of a two-state chain are Moebius maps of the odds, so they compose
like 2 x 2 matrices: a whole chunk of texts is one chain that forgets at each text's first word,
cut into equal blocks whose maps are multiplied side by side. Marginals are exact.

A text's score is a logistic function of its expected number and share of offending tokens and its
largest marginal, fitted on texts that the field was not fitted on, with the weights that restore
the classes' proportions.

Null and empty texts get the score of a text without offending tokens. Null labels and ids teach
nothing; several labels of one id count as the largest. With labels of one class only, or none,
every score is 0 (or 1, if all known labels are 1). Rows are judged one by one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, chunks, cut, map_batches, mix

#: Labelled texts of each class to learn from, about, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 900, 12 << 20
#: Different surroundings in toxic texts that an offending word needs (or this share of the toxic texts), and its share among toxic texts.
LEAST, LEAST_SHARE, PURITY = 6, 0.03, 0.9
#: Bytes of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: Of the sampled texts, one in so many sets the score's logistic function instead of the field.
ASIDE = 3
ROUNDS, RATE, DECAY = 60, 0.6, 0.005
_WORD_BITS, _NEAR_BITS, _STEPS = 18, 16, 512


@dataclass
class Model:
    prior: float = 0.0
    weights: list[np.ndarray] | None = None  # by feature: word, neighbours, beginnings
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log potentials
    start: float = 0.0
    logit: np.ndarray | None = None


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, x0: float = 1.0) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]), all coefficients not negative."""
    n = len(a)
    steps = max(1, min(_STEPS, int(n**0.5) + 1))
    blocks = -(-n // steps)

    def shape(x: np.ndarray, fill: float) -> np.ndarray:
        y = np.full(blocks * steps, fill)
        y[:n] = x
        return np.ascontiguousarray(y.reshape(blocks, steps).T)

    a, b, c, d = shape(a, 1.0), shape(b, 0.0), shape(c, 0.0), shape(d, 1.0)
    p, q, r, s = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, steps):  # maps of whole blocks
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 8 == 0:
            k = 1 / (p + q + r + s)
            p, q, r, s = p * k, q * k, r * k, s * k
    x, enter = x0, np.empty(blocks)
    for k, (i, j, u, v) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        enter[k] = x
        x = (i * x + j) / (u * x + v)
    out = np.empty((steps, blocks))
    x = enter
    for t in range(steps):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(label 1) of each token; odds forward and backward. score: log potential of label 1 over 0; first: whether a text begins there."""
    e, t = np.exp(np.clip(score, -30, 30)), np.exp(trans)
    f = scan(np.where(first, 0, t[1, 1] * e), np.where(first, np.exp(start) * e, t[0, 1] * e), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0]))
    nxt, ends = np.append(e[1:], 1.0)[::-1], np.append(first[1:], True)[::-1]
    g = scan(np.where(ends, 0, t[1, 1] * nxt), np.where(ends, 1, t[1, 0]), np.where(ends, 0, t[0, 1] * nxt), np.where(ends, 1, t[0, 0]))[::-1]
    odds = f * g
    return odds / (1 + odds), f, g


def _features(w: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Indexes into the tables of weights, and whether a text begins at the word."""
    h = w.hash
    near = (h >> np.uint64(64 - _NEAR_BITS)).astype(np.int32)
    first = np.zeros(len(h), bool)
    first[w.first[:-1][np.diff(w.first) > 0]] = True
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:] = np.where(first[1:], 0, near[:-1])
    after[:-1] = np.where(first[1:], 0, near[1:])
    begins = [(w.prefixes(k) >> np.uint64(64 - _NEAR_BITS)).astype(np.int32) for k in PREFIXES]
    return [(h >> np.uint64(64 - _WORD_BITS)).astype(np.int32), before, after, *begins], first


def _potential(model: Model, x: list[np.ndarray]) -> np.ndarray:
    """Log potential of label 1 over 0; index 0 stands for no feature."""
    out = model.bias + model.weights[0][x[0]]
    for table, i in zip(model.weights[1:], x[1:], strict=True):
        out += table[i]
    return out


def tag(model: Model, w: Words) -> np.ndarray:
    """Marginals of the words' label."""
    if model.weights is None or not len(w.hash):
        return np.zeros(len(w.hash))
    x, first = _features(w)
    return marginals(_potential(model, x), first, model.trans, model.start)[0]


def _summary(p: np.ndarray, w: Words) -> np.ndarray:
    out = np.zeros((w.n_docs, 4))
    out[:, 0] = 1
    total = np.bincount(w.doc, p, minlength=w.n_docs)
    out[:, 1] = np.log1p(total)
    out[:, 3] = np.log((total + 0.1) / (np.diff(w.first) + 20)) / 4
    full = np.flatnonzero(np.diff(w.first))
    if len(full):
        out[full, 2] = np.maximum.reduceat(p, w.first[:-1][full])
    return out


def scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the texts, marginals of their words."""
    p = tag(model, w)
    if model.logit is None:
        return np.full(w.n_docs, model.prior), p
    return 1 / (1 + np.exp(-np.clip(_summary(p, w) @ model.logit, -30, 30))), p


def offending(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Whether each word, or a beginning of it, is an offending one; toxic: by text."""
    h, n = w.hash, len(w.hash)
    first = _features(w)[1]
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:] = np.where(first[1:], 0, h[:-1])
    right[:-1] = np.where(first[1:], 0, h[1:])
    _, one = np.unique(mix(mix(h + left) + right * np.uint64(3)), return_index=True)
    bad = toxic[w.doc[one]]
    mass = max(1, (~bad).sum()) / max(1, bad.sum())
    need = max(LEAST, LEAST_SHARE * toxic.sum())
    out = np.zeros(n, bool)
    for item in (h, *(w.prefixes(k) for k in PREFIXES)):
        known, at = np.unique(item[one], return_inverse=True)
        n_bad, n_good = np.bincount(at, bad, minlength=len(known)), np.bincount(at, ~bad, minlength=len(known))
        pure = known[(known > 0) & (n_bad >= need) & (n_bad * mass >= PURITY * (n_bad * mass + n_good))]
        out |= np.isin(item, pure)
    return out


def _words(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def _field(model: Model, texts: list[str], toxic: np.ndarray) -> None:
    """Fit the field's weights."""
    w = _words(texts)
    x, first = _features(w)
    y = (offending(w, toxic) & toxic[w.doc]).astype(float)
    sizes = [1 << _WORD_BITS] + [1 << _NEAR_BITS] * (len(x) - 1)
    model.weights, model.bias = [np.zeros(n) for n in sizes], -6.0
    if not y.any():
        return
    inner, labels, seen = ~first[1:], y.astype(int), np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][inner], labels[1:][inner]), 1)
    past = [np.zeros(n) for n in sizes] + [0.0, 0.0, np.zeros((2, 2))]
    for _ in range(ROUNDS):
        u = _potential(model, x)
        p, f, g = marginals(u, first, model.trans, model.start)
        e, t = np.exp(np.clip(u, -30, 30)), np.exp(model.trans)
        pair = np.stack([np.full(len(e) - 1, t[0, 0]), t[0, 1] * e[1:] * g[1:], f[:-1] * t[1, 0], f[:-1] * t[1, 1] * e[1:] * g[1:]])
        pair = (pair / pair.sum(0))[:, inner].sum(1).reshape(2, 2)
        err = y - p
        now = [*model.weights, model.bias, model.start, model.trans]
        grad = [*(np.bincount(i, err, n) for i, n in zip(x, sizes, strict=True)), err.sum(), err[first].sum(), seen - pair]
        for k, (v, d) in enumerate(zip(now, grad, strict=True)):
            d = d - DECAY * v
            past[k] = past[k] + d * d
            now[k] = v + RATE * d / np.sqrt(past[k] + 1e-8)
        for table in now[1 : len(sizes)]:
            table[0] = 0
        model.weights, (model.bias, model.start, model.trans) = now[: len(sizes)], now[len(sizes) :]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """texts with labels of both classes, in any order; weight: how many texts each stands for."""
    model = Model(prior=float((toxic * weight).sum() / weight.sum()))
    aside = np.zeros(len(texts), bool)
    for k in (True, False):
        own = np.flatnonzero(toxic == k)
        aside[own[ASIDE - 1 :: ASIDE]] = True
    pick = lambda m: [t for t, k in zip(texts, m, strict=True) if k]
    _field(model, pick(~aside), toxic[~aside])
    if not (toxic & aside).any() or not (~toxic & aside).any():
        aside[:] = True
    w = _words(pick(aside))
    z, weight, toxic = _summary(tag(model, w), w), weight[aside], toxic[aside]
    b = np.zeros(z.shape[1])
    b[0] = np.log(max(model.prior, 1e-6) / max(1 - model.prior, 1e-6))
    ridge = np.diag([1e-6, 0.1, 0.1, 0.1])
    weight = weight / weight.mean()
    for _ in range(50):  # Newton's method with a small penalty
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b = b + np.linalg.solve((z * (weight * q * (1 - q))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(b)), z.T @ (weight * (toxic - q)) - ridge @ b)
    model.logit = b
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from the labelled documents whose id fulfils `train`.

    The sample is drawn among label rows by hash of the id; only its bounded list of ids is
    broadcast, and documents are scanned once without being shuffled.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (F.lit(True) if train is None else train))
    rows = rows.groupBy(F.col(doc_id).alias("sw_id")).agg((F.max(label) >= 1).alias("toxic"))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(prior=1.0 if n.get(True) else 0.0)
    share = F.when(F.col("toxic"), F.lit(min(1.0, most / n[True]))).otherwise(F.lit(min(1.0, most / n[False])))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(23), "sw_id"), F.lit(1 << 20)) < share * (1 << 20))
    own = docs.select(F.col(doc_id).alias("sw_id"), F.col(text).alias("sw_text")).where("sw_text is not null")
    texts: dict[bool, dict[str, None]] = {True: {}, False: {}}
    held = {True: 0, False: 0}
    # in the order of a hash, so the bytes that fit don't depend on files or partitions
    sample = cut(own.join(F.broadcast(chosen), "sw_id").select("toxic", "sw_text"))
    for r in sample.orderBy(F.xxhash64(F.lit(29), "sw_text"), "sw_text").toLocalIterator():
        if held[r.toxic] < most_bytes and r.sw_text not in texts[r.toxic]:
            texts[r.toxic][r.sw_text] = None
            held[r.toxic] += len(r.sw_text.encode())
    if not texts[True] or not texts[False]:
        return Model(prior=n[True] / (n[True] + n[False]))
    both = [(t, k) for k in (True, False) for t in sorted(texts[k], key=lambda t: zlib.crc32(t.encode()))]
    toxic = np.array([k for _, k in both])
    model = fit([t for t, _ in both], toxic, np.where(toxic, n[True] / toxic.sum(), n[False] / (~toxic).sum()))
    _give_back()
    return model


def _give_back() -> None:
    """Freed arrays go back to the system: the driver lives on beside its JVM."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, and spans of offending words (code points, start:end, comma-joined) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.lit(False) if held is None else held).alias("held_out"), F.col(text).alias("text"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        got, spans = [], []
        for lo, hi, data, offsets in chunks(b.column(2), CHUNK_BYTES):
            w = Words(data, offsets)
            s, p = scores(sent.value, w)
            got.append(s)
            found: dict[int, list[str]] = {}
            hot = np.flatnonzero(p >= 0.5)
            if len(hot):
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for i in hot.tolist():
                    a = offsets[w.doc[i]]
                    found.setdefault(int(w.doc[i]), []).append(f"{point[w.start[i]] - point[a]}:{point[w.end[i]] - point[a]}")
            spans += [",".join(found.get(d, [])) for d in range(hi - lo)]
        s = np.concatenate(got)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], ["doc_id", "held_out", "score", "predicted", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, one, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their own columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.concatenate([scores(sent.value, Words(data, offsets))[0] for _, _, data, offsets in chunks(b.column(at))])
        return b.filter(pa.array(s < 0.5))

    return map_batches(docs, one, docs.schema)
