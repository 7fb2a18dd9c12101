import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from sensorweave.llm import decontaminate, mixing, neardup, pii


def _write(spark, folder, seed=4):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdehinorst") for _ in range(rnd.randint(3, 7))) for _ in range(500)]
    say = lambda k: " ".join(rnd.choices(vocab, k=k))
    item = say(20)
    docs, labels = [], []
    for i in range(240):
        t = say(rnd.randint(20, 60))
        if i % 8 == 0:
            w = t.split()
            for _ in range(5):
                w.insert(rnd.randint(0, len(w)), rnd.choice(["idiot", "scum", "loser"]))
            t = " ".join(w)
        labels.append((i, 1 if i % 8 == 0 else 0))
        docs.append((i, t))
    docs += [(1000 + i, docs[i][1]) for i in (1, 2, 3)] + [(1100, docs[5][1] + " more"), (1200, item + " " + say(30)), (1300, say(20) + " mail a.b@cc.org"), (1400, None), (1500, "")]
    n = len(docs)
    spark.createDataFrame([(i, t, ("en", "de")[k % 2], f"src{k % 5}", None if t is None else len(t)) for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return n, item


def test_stages_take_effect(spark, tmp_path):
    n, item = _write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        before, docs = docs, spark.read.schema(out.schema).parquet(f"{tmp_path}/out-{name}")
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == names
        texts = [r.text for r in before.orderBy("doc_id").collect()]
        ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
        have = {r.doc_id for r in kept[name]}
        if name == "toxicity":
            bad = {i for i, t in zip(ids, texts, strict=True) if t and any(w in t.split() for w in ("idiot", "scum", "loser"))}
            assert len(bad & have) <= 0.1 * len(bad) and len(set(ids) - have - bad) <= 2
        if name == "near_duplicates":
            links = neardup.brute_force(texts)
            assert set(ids) - have == {ids[b] for _, b in links}
        if name == "decontamination":
            found = decontaminate.brute_force(texts, [(1, item)])
            assert have == {i for i, (w, h, _) in zip(ids, found, strict=True) if not (h and 20 * h >= w)}
        if name == "personal_data":
            assert sorted((r.doc_id, r.text) for r in kept[name] if r.text is not None) == sorted((i, pii.redacted(t)) for i, t in zip(ids, texts, strict=True) if t is not None)
            assert "[EMAIL]" in {r.doc_id: r.text for r in kept[name]}[1300]
    total = sum(len((r.text or "").split()) for r in kept["personal_data"])
    mixed = sum(len((r.text or "").split()) for r in kept["mixing"])
    assert 0.3 * total < mixed <= total * mixing.BUDGET + 1
    assert "epoch" in docs.columns


def test_empty_repeated_null_and_clashing_columns(spark, tmp_path):
    _write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "words of no id", None, "src9", 3), (7000, "words of one id", "en", "src1", 15), (7000, "words of one id", "en", "src1", 15), (7001, "tiny " * 30000, "en", None, 5)], docs.schema)
    extra = lambda df: df.selectExpr("*", "1 as sw_id", "2 as edge", "3 as host", "4 as epoch_", "5 as sw_k1")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    for rows, folder in ((extra(odd), f"{tmp_path}/none"), (extra(odd.limit(0)), f"{tmp_path}/none"), (extra(odd.limit(0)), str(tmp_path))):
        size = rows.count()
        for name, stage in cp.STAGES:
            rows, names = cp.common.cut(stage(spark, rows, folder)), rows.columns
            assert rows.columns[: len(names)] == names
            if name != "mixing":
                assert rows.count() == (4 if size and name != "toxicity" else size)
        assert size == 0 or {r.doc_id for r in rows.collect()} <= {None, 7000, 7001}
