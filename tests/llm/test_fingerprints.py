import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sensorweave.llm import fingerprints as fp


def _sketch(text, bound="2"):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest() for i in range(max(len(w) - 4, 1))] if w else []
    kept = [x for x in h if x < bound] or ([min(h)] if h else [])
    return sorted({x[:16] for x in kept})


def _like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def _brute(rows):
    """Rows by id descending; those with one id in any order of texts, so only for ids with one text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, e, b = _sketch(t), _sketch(edited), _sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, _like(a, e), _like(a, b)))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in fp.report(df).select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next").collect()), key=str)


def _text(k, n):
    return " ".join(f"w{(k * 7919 + i * (1 + k % 5)) % 997}" for i in range(n))


def test_equals_brute_force(spark):
    rows = [(3 * i, _text(i % 40, 5 + 13 * (i % 40))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "!!! ..."), (503, "One two"), (504, "ONE  two"), (505, "Été 你好 \U0001f600 naïve café x İ " * 9), (-7, _text(3, 60000)), (None, _text(2, 50))]
    rows += [(600, _text(1, 90))] * 4 + [(700, "a b")] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, t string, rows int").repartition(5)
    assert _got(df) == _brute(rows)
    assert _got(df.repartition(1)) == _brute(rows)


def test_one_empty_and_same_ids(spark):
    schema = "doc_id long, text string"
    assert _got(spark.createDataFrame([], schema)) == []
    assert _got(spark.createDataFrame([(1, "abc def")], schema)) == _brute([(1, "abc def")])
    rows = [(1, "a b c"), (1, "d e f"), (1, "a b c"), (None, "x"), (None, None)]
    got = _got(spark.createDataFrame(rows, schema))
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    with pytest.raises(TypeError):
        fp.report(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_containment_between_unequal_texts(spark):
    part, whole = _text(1, 900), _text(2, 5000) + " . " + _text(1, 900)
    rows = spark.createDataFrame([(part, whole)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = rows.select("a", "b", fp.containment(F.col("a"), F.col("b")).alias("ab"), fp.containment(F.col("b"), F.col("a")).alias("ba"), fp.likeness(F.col("a"), F.col("b")).alias("j"), fp.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert r.ab == 1 and r.ba < 0.6 and r.j == pytest.approx(r.ba)
    assert r.m == sorted(set(r.a) | set(r.b))


def test_mergers(spark):
    texts = ["one two three", "four five six", _text(4, 400), "", "one two three"]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "g int, t string").withColumn("s", fp.sketch(F.col("t")))
    got = {}
    for r in fp.merged(df, "g", "s").collect():
        got.setdefault(r.g, set()).add(r.hash)
    assert got[0] == {h for h in set(_sketch(texts[0])) | set(_sketch(texts[2])) if h < "2"}
    below = [h for h in _sketch(texts[1]) if h < "2"]
    assert got[1] == set(below or _sketch(texts[1]))
    both = df.where("g = 1").select(fp.merge(F.col("s"), F.array().cast("array<string>")).alias("m")).collect()
    assert [sorted(r.m) for r in both if r.m] == [_sketch(texts[1])]
    assert fp._bound(1 / 8) == "20000000" and fp._bound(1) == "g"
    with pytest.raises(ValueError):
        fp.sketch(F.col("t"), 0)
