import random

import numpy as np
import pyarrow as pa
import pytest

from sensorweave.llm import neardup as nd
from sensorweave.llm.common import Words, components, text_bytes


def _components(n, links, same=()):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in [*links, *same]:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _corpus(seed, base=12, copies=12, words=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    out = []
    for _ in range(base):
        w = rnd.choices(vocab, k=rnd.randint(3, words))
        out.append(" ".join(w))
        for _ in range(rnd.randint(0, copies)):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            out.append(rnd.choice([" ", ", "]).join(v))
    return out


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components(401, [(a, b) for a, b in edges if a is not None and a != b])
    assert got == {i: want[i] for i in got} and set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def test_agreement_estimates_probability_jaccard():
    rnd = np.random.default_rng(4)
    h = rnd.integers(1, 2**62, 90).astype(np.uint64)
    wa, wb = rnd.uniform(1, 3, 60), rnd.uniform(1, 3, 60)
    own = nd.signatures(np.repeat([0, 1], 60), np.concatenate([h[:60], h[30:]]), np.concatenate([wa, wb]), 2, 1 << 14)
    a, b = dict(zip(h[:60].tolist(), wa, strict=True)), dict(zip(h[30:].tolist(), wb, strict=True))
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert abs((own[0] == own[1]).mean() - want) < 0.02


def test_similarities_equal_the_definition():
    texts = _corpus(5, 6, 4, 12) + ["a b c d e f g a b c d e f g", "a b c d e f g", None, ""]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    got = nd.similarities(pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs]))
    for least in (0.3, 0.8):
        assert {(j, i) for (i, j), s in zip(pairs, got, strict=True) if s >= least - 1e-9} == nd.brute_force(texts, least)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    texts = _corpus(seed) + [None, None, "", "", "...", "one", "one", "one two"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rep long").repartition(4)
    got = {r.doc_id: r for r in nd.report(docs).collect()}
    worded = [i for i, t in enumerate(texts) if t and any(c.isalnum() for c in t)]
    same = [(i, j) for i in worded for j in worded if j < i and texts[i] == texts[j]]
    want = _components(len(texts), nd.brute_force(texts), same)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = nd.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_plain_similarity_of_texts_with_unequal_repeats(spark):
    rnd = random.Random(6)
    texts = []
    for k in range(20):  # the same shingles, one of them 20,000 times: plain similarity 1, the other kind near 0
        w = [f"p{k}x{rnd.randrange(10**6)}" for _ in range(30)]
        texts += [" ".join(w), " ".join(w[:1] * 6 + w[1:]), " ".join(w[:1] * 20_000 + w[1:])]
    assert nd.similarities(pa.array(texts[1:2]), pa.array(texts[2:3]))[0] == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nd.report(docs).collect()}
    links = {(3 * k + 1, 3 * k + 2) for k in range(20)} | {(3 * k, 3 * k + j) for k in range(20) for j in (1, 2)}
    assert [got[i] for i in range(60)] == _components(60, links)


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_other_similarities(spark, least):
    rnd = random.Random(int(10 * least))
    texts = []
    for k in range(60):
        w = [f"q{k}x{rnd.randrange(10**6)}" for _ in range(200)]
        n = round(204 * least / (1 + least)) + rnd.randint(-12, 12) + 110 * (least > 0.8)
        texts += [" ".join(w), " ".join(w[:n] + [f"{x}b" for x in w[n:]])]
    links = nd.brute_force(texts, least)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nd.report(docs, least=least).collect()}
    assert [got[i] for i in range(120)] == _components(120, links)


def test_plans():
    assert nd.Plan.of(0.8) == nd.Plan(4, 3, 80)
    assert nd.Plan.of(0.6).band == 2 and nd.Plan.of(0.2).band == 1
    with pytest.raises(ValueError):
        nd.Plan.of(0)


def test_large_groups_of_near_copies(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    base = rnd.choices(vocab, k=120)
    texts = []
    for _ in range(300):
        v = list(base)
        v[rnd.randrange(120)] = rnd.choice(vocab)
        texts.append(" ".join(v))
    texts += [" ".join(rnd.choices(vocab, k=100)) for _ in range(100)]
    # a passage that makes up half of many texts: common bands, no links
    texts += [" ".join(base[:60] + rnd.choices(vocab, k=60)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _components(len(texts), nd.brute_force(texts))
    got = {r.doc_id: r.component_id for r in nd.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in nd.keep(docs).collect()), key=str) == [(1, "a b c"), (None, "a b c"), (None, None)]
    assert sorted((tuple(r) for r in nd.report(docs).collect()), key=str) == sorted([(1, 1, 1, True)] * 2 + [(2, 1, 1, False)] + [(None, None, None, True)] * 2, key=str)
    assert nd.report(docs.limit(0)).collect() == []


def test_word_prefix_hashes():
    w = Words(*text_bytes(pa.array(["abcd abcf", "abcd"])))
    p = w.prefixes(3)
    assert p[0] == p[1] == p[2] and w.prefixes(4)[0] != w.prefixes(4)[1] and (w.prefixes(5) == 0).all()


@pytest.mark.parametrize("block", [64, 2048])
def test_links_inside_a_large_group_just_under_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block, raising=False)
    rnd = random.Random(11)
    own = iter(range(10**6))
    fresh = lambda n: [f"u{next(own)}" for _ in range(n)]
    passage = fresh(180)
    # a shared passage puts any two at 176 / (2 * 202 - 176) = 0.77; three more shared words put a pair at 0.80
    texts = [passage + fresh(26) for _ in range(400)]
    for k in range(0, 160, 2):
        texts[k + 1] = texts[k][:184] + texts[k + 1][184:]
    rnd.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    links = nd.brute_force(texts)
    assert len(links) == 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nd.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == _components(len(texts), links)
