import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sensorweave.llm import langid
from sensorweave.llm.common import text_bytes


def _texts(seed, n=60):
    rnd = random.Random(seed)
    stems = {"en": ["the", "and", "ing", "er", "th"], "fr": ["le", "é", "eau", "ou", "qu"], "de": ["sch", "und", "ü", "ei", "ch"]}
    return [(k, "".join(rnd.choice(v) + rnd.choice(["", " ", ". "]) for _ in range(rnd.randint(3, 40)))) for k, v in stems.items() for _ in range(n)]


def _slow_length(train, text):
    """Escapes and exclusion by walking the contexts, symbol by symbol."""
    sym = lambda t: [int(langid._SYMBOL[b]) for b in t.encode()]
    counts = Counter()
    for t in train:
        s = [0] * langid.ORDER + sym(t)
        for i in range(langid.ORDER, len(s)):
            for k in range(langid.ORDER + 1):
                counts[tuple(s[i - k : i]), s[i]] += 1
    by = {}
    for (c, s), n in counts.items():
        by.setdefault(c, {})[s] = n

    def dist(ctx):
        low = dict.fromkeys(range(langid.A), 1 / langid.A) if not ctx else dist(ctx[1:])
        own = by.get(ctx)
        if not own:
            return low
        n, d = sum(own.values()), len(own)
        rest = sum(p for s, p in low.items() if s not in own)
        esc = d / (n + d) if rest > 0 else 0
        return {s: own[s] * (1 - esc) / n if s in own else esc * low[s] / rest for s in range(langid.A)}

    s, total = [0] * langid.ORDER + sym(text), 0.0
    for i in range(langid.ORDER, len(s)):
        total -= math.log(dist(tuple(s[i - langid.ORDER : i]))[s[i]])
    return total


def test_code_lengths_equal_the_walk(spark):
    rows = _texts(1, 6)
    docs = spark.createDataFrame([(t, k) for k, t in rows], "text string, lang string")
    model = langid.train(docs, least=1)
    data, offsets = text_bytes(pa.array(["the eau", "", "sch!", "éé zz"]))
    got = langid.lengths(model, data, offsets)
    for j, lang in enumerate(model.langs):
        train = [t for k, t in rows if k == lang]
        assert np.allclose(got[:, j], [_slow_length(train, t) for t in ("the eau", "", "sch!", "éé zz")], rtol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, t, k, "x") for i, (k, t) in enumerate(_texts(3))] + [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 !", None, "x"), (903, "…—", "en", "x"), (None, "the and", "en", "x"), (1, "the ing", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = langid.held_out("doc_id", 4, 2)
    out = langid.predict(docs, langid.train(docs, train=F.col("doc_id").isNotNull() & ~held), held=held).collect()
    assert len(out) == len(rows)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {900, 901, 902, 903} and all(r.score == 0 for r in out if r.lang_pred == "und")
    truth = {i: k for i, _, k, _ in rows[:-2] if i < 900 and i != 1}
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(tested) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).collect() == []


def test_sample_counts_copies_once_and_has_every_language(spark):
    rows = [("en", "the and copy")] * 3000 + [("fr", "le eau")] + [("de", f"und {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = Counter(r.lang for r in langid.sample(docs, "text", "lang", F.lit(True), 20).collect())
    assert got == {"en": 1, "fr": 1, "de": 20}
    assert langid.train(docs, most=20).langs == ["de", "en", "fr"]
