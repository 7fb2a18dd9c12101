import random

import pytest
from pyspark.sql import functions as F

from sensorweave.llm import mixing as mx


def _docs(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "src0" if rnd.random() < 0.4 else rnd.choice(["src1", "src2", "src3", "zzz", None])
        rows.append((i, " ".join(["w"] * rnd.randint(0, 12)), rnd.choice(["en", "en", "de", "fr", "xx", None]), source, "e"))
    return spark.createDataFrame([*rows, (None, None, "en", "src0", "e"), (1, "a b", "en", "src0", "e"), (1, "a b", "en", "src0", "e")], "doc_id long, text string, lang string, source string, sw_leaf string").repartition(5)


def _by_leaf(df, *more):
    t = df.withColumn("t", mx.tokens(F.col("text"))).withColumn("d", mx.domain(F.col("source")))
    key = ["d", F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), *more]
    return {tuple(r)[:-1]: r.t for r in t.groupBy(*key).agg(F.sum("t").alias("t")).collect()}


@pytest.mark.parametrize("budget", [0.2, 0.9, 2.5, 5.0])
def test_budgets_and_epochs(spark, budget):
    docs = _docs(spark)
    have = _by_leaf(docs)
    want = mx.brute_force(have, sum(have.values()) * budget)
    got = mx.mix(docs, budget=budget).persist()
    assert got.columns == [*docs.columns, "epoch"]
    taken = _by_leaf(got)
    for k, b in want.items():
        assert b - 13 <= taken.get(k, 0) <= b + 1, (k, b, taken.get(k, 0))
    by_epoch = _by_leaf(got, "epoch")
    for k, n in have.items():  # full epochs hold all of a leaf
        whole = int((want[k] + 1e-6) // n) if n else 0
        assert all(by_epoch[(*k, e)] == n for e in range(1, whole + 1))


def test_the_same_again_and_seeds_differ(spark):
    docs = _docs(spark)
    ids = lambda d, **k: sorted(str(tuple(r)) for r in mx.mix(d, **k).select("doc_id", "epoch").collect())
    assert ids(docs) == ids(docs.repartition(7)) and ids(docs) != ids(docs, seed=8)


def test_empty(spark):
    assert mx.mix(_docs(spark).limit(0)).collect() == []
