import itertools
import random

import numpy as np

from sensorweave.llm import toxicity as tx
from sensorweave.llm.langid import held_out


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(0)
    score, trans, start = rnd.normal(size=9), rnd.normal(size=(2, 2)), 0.3
    first = np.zeros(9, bool)
    first[[0, 4, 5]] = True
    want = np.zeros(9)
    z = 0.0
    for y in itertools.product((0, 1), repeat=9):
        e = sum(score[t] * y[t] + (start * y[t] if first[t] else trans[y[t - 1], y[t]]) for t in range(9))
        z += np.exp(e)
        want += np.exp(e) * np.array(y)
    assert np.allclose(tx.marginals(score, first, trans, start)[0], want / z)


def test_scan_of_long_chains():
    rnd = np.random.default_rng(1)
    a, b, c, d = rnd.uniform(0.1, 2, (4, 5000))
    x, want = 1.0, []
    for i in range(5000):
        x = (a[i] * x + b[i]) / (c[i] * x + d[i])
        want.append(x)
    assert np.allclose(tx.scan(a, b, c, d), want)


def _rows(n, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdehinorst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, bad = rnd.choices(vocab, k=rnd.randint(5, 60)), i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["Idiot", "scum", "loser!", "zzquem" + rnd.choice(vocab)]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1 if bad else 0))
    return rows, labels


def test_held_out_accuracy_offsets_and_filter(spark):
    rows, labels = _rows(900)
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5000, "", "x"), (5000, "é scum", "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (0, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    held = held_out("doc_id", 5, 0)
    model = tx.train(docs, marks, train=~held)
    out = tx.score(docs, model, held=held).collect()
    truth = dict(labels)
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(tested) > 100 and sum(truth[r.doc_id] == r.predicted for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out) and len(out) == len(rows) + 3
    by = {(r.doc_id, r.spans) for r in out}
    assert (5000, "2:6") in by and (5000, "") in by and (None, "") in by
    kept = tx.keep(docs, model)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if not r.predicted)


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for m in (marks, marks.limit(0)):
        assert {r.score for r in tx.score(docs, tx.train(docs, m)).collect()} == {0.0}
    assert tx.score(docs.limit(0), tx.train(docs, marks)).collect() == []
