import hashlib
import random

from sensorweave.llm import decontaminate as dc


def _make(seed, n_docs=40, n_items=14):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "É", "d9", "Word"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 3, 5, 13, 16, 20]))) for i in range(n_items)] + [(90, None), (91, "..."), (92, "")]
    docs = [text(rnd.choice([0, 1, 2, 6, 30, 80])) for _ in range(n_docs)] + [None, "", "a", "B"]
    docs += [docs[1] + " " + items[5][1] + " tail", items[3][1], docs[-1]]
    return docs, items


def _run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, n_words long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in dc.report(d, b, **kw).collect()}
    return [(rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].items_sha256, rows[i].contaminated) for i in range(len(docs))]


def _want(docs, items, window=13):
    return [(w, h, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), h > 0 and 20 * h >= w) for w, h, own in dc.brute_force(docs, items, window)]


def test_equals_the_definition(spark):
    for seed in range(3):
        docs, items = _make(seed)
        assert _run(spark, docs, items) == _want(docs, items)
        assert _run(spark, docs, items, window=3) == _want(docs, items, 3)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(dc, "LEAST_BITS", 6)
    monkeypatch.setattr(dc, "MOST_BITS", 7)
    docs, items = _make(7, 20, 6)
    assert _run(spark, docs, items) == _want(docs, items)


def test_very_long_texts_and_repeated_rows(spark):
    docs, items = _make(5, 3, 8)
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(120000))
    docs += [long + " " + items[6][1]]
    got = _run(spark, docs, items + items)
    assert got[:-1] == _want(docs[:-1], items) and got[-1][0] == 120000 + dc.brute_force([items[6][1]], [])[0][0] and got[-1][1] > 0
    d = spark.createDataFrame([(None, docs[1]), (None, docs[1]), (4, docs[1]), (4, docs[1])], "doc_id long, text string")
    rows = dc.report(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows}) == 1 and tuple(rows[0])[1:] == _want([docs[1]], items)[0]


def test_empty_tables_and_kept_columns(spark):
    docs, items = _make(9, 5, 3)
    assert _run(spark, docs, []) == _want(docs, [])
    d = spark.createDataFrame([(1, "x y", 5, b"z"), (1, "a", 5, None)], "doc_id long, text string, sw_k1 long, Sw_K2 binary")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    out = dc.clean(d, b)
    assert out.columns == d.columns and [r.text for r in out.collect()] == ["x y"]
    assert dc.report(d.limit(0), b).collect() == []
