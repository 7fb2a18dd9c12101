import random
import time

import numpy as np
import pytest

from sensorweave.llm import htmltext as ht


def _pages(n=60):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(4)) for _ in range(200)]
    say = lambda k: " ".join(rnd.choices(vocab, k=k))
    nav, quote = say(9), say(60)
    out = []
    for i in range(n):
        body = f"<h1>{say(4)} &amp; x</h1><p><b>{say(9)}<br><p>{quote if i % 3 == 0 else say(7)}</p>" + "<script>var t='</p>';</script>" * (i % 2)
        out.append((i, f"http://h{i % 4}.com/{i}", f"<!DOCTYPE html><html><head><title>{say(3)}</title></head><body><nav><ul><li><a href='/'>{nav}</a></li></ul></nav><!-- ad --><div class=\"ad\">{say(5)}</div><article>{body}</article><footer>&copy; {say(6)}</footer></body></html>"))
    return out


def test_articles_equal_another_reader(spark):
    rows = _pages() + [(900, "http://h0.com/", None), (901, None, ""), (902, "x", "plain &lt; text"), (0, "http://h0.com/0", _pages(1)[0][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = ht.extract(pages).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == ht.brute_force(h) for i, _, h in rows if i < 900)
    assert by[900] == "" and by[901] == "" and by[902] == "plain < text" and all(r.n_chars == len(r.text) for r in got)


def test_repeats_outside_articles_go_across_shards(spark):
    rnd = random.Random(2)
    say = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    line, short = say(12), "go home"
    rows = []
    for i in range(40):
        rows.append((i, f"http://{'one' if i % 2 else 'two'}.org/{i}", f"<div>{line} {say(8)}</div><div>{short}</div><p>{say(30)} own{i}</p>"))
    rows.append((99, "http://lone.org/", f"<div>{line}</div>"))
    out = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    for i in range(40):
        assert line not in out[i] and short not in out[i] and out[i].endswith(f"own{i}") and len(out[i].split()) == 39
    assert out[99] == line


def test_suffix_array():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        x = rnd.integers(0, 3, n)
        order, lcp = ht.suffix_array(x)
        suffix = [tuple(x[i : i + ht.RUN]) for i in order]
        assert suffix == sorted(suffix)
        for k in range(1, n):
            a, b = suffix[k - 1], suffix[k]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


@pytest.mark.parametrize("q", ["<" * 50000, "<a " + "x='" * 50000, "<p>" * 60000, "<div>" * 60000 + "</p>" * 60000, "&" * 100000, "<!--" * 50000, "<script>" * 50000, '<a b="x' * 30000])
def test_broken_markup_takes_linear_time(q):
    began = time.time()
    ht.blocks(q)
    assert time.time() - began < 5


def test_empty(spark):
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_what_few_pages_share_outside_articles_stays(spark):
    rnd = random.Random(4)
    say = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    menu, quote, story = say(10), say(40), say(80)
    rows = [(i, f"http://a.org/{i}", f"<div>{menu}</div><p>{say(30)}</p>" + f"<p>{quote}</p>" * (i in (3, 17))) for i in range(30)]
    rows += [(40, "http://a.org/x", f"<div>{menu}</div><div><p>{story}</p></div>"), (41, "http://a.org/x?p=1", f"<div>{menu}</div><p>{story}</p><br>")]
    rows += [(50, "http://b.org/x", f"<div><p>{story}</p></div>"), (51, "http://b.org/x?p=1", f"<p>{story}</p><br>")]
    out = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert not any(menu in t for t in out.values())
    assert all(quote in out[i] for i in (3, 17)) and all(out[i] == story for i in (40, 41, 50, 51))


def test_an_open_head_does_not_take_the_page():
    assert ht.blocks("<html><head><title>no</title><meta charset=utf-8><body><p>yes</p>") == [(ht.LOOSE, "yes")]
    assert ht.blocks("<head><title>no</title><style>p{}</style><article>yes</article>") == [(ht.CONTENT, "yes")]


def test_what_is_never_closed_ends_before_the_next_block():
    assert ht.blocks("<head><title>no<body><article>yes</article>") == [(ht.CONTENT, "yes")]
    assert ht.blocks("<p>a</p><svg><path d=1><p>b</p>") == [(ht.LOOSE, "a"), (ht.LOOSE, "b")]


def _without_boilerplate(pages):
    """Runs outside articles that stand on PAGES pages and a SHARE of a host's, by counting them one by one."""
    from collections import defaultdict

    on, every = defaultdict(set), defaultdict(set)
    runs = lambda w: [tuple(w[k : k + ht.RUN]) for k in range(len(w) - ht.RUN + 1)] or [tuple(w)]
    for _, url, html in pages:
        h = url.split("/")[2]
        every[h].add(html)
        for _, t in ht.blocks(html):
            for r in runs(t.split()):
                on[h, r].add(html)
    out = {}
    for i, url, html in pages:
        h, kept = url.split("/")[2], []
        for _, t in ht.blocks(html):
            w, gone = t.split(), set()
            for k, r in enumerate(runs(w)):
                if len(on[h, r]) >= max(ht.PAGES, ht.SHARE * len(every[h])):
                    gone |= set(range(k, k + len(r)))
            kept += [x for k, x in enumerate(w) if k not in gone]
        out[i] = " ".join(kept)
    return out


@pytest.mark.parametrize("shard", [120, 1 << 18])
def test_repeats_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ht, "SHARD_WORDS", shard)
    rnd = random.Random(6)
    say = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    lines = [say(rnd.randint(2, 14)) for _ in range(8)]
    rows = [(i, f"http://h{i % 3}.org/{i}", "".join(f"<p>{rnd.choice(lines) if rnd.random() < 0.5 else say(rnd.randint(1, 9))} {rnd.choice(lines)}</p>" for _ in range(4))) for i in range(60)]
    rows += [(100 + i, u, h) for i, u, h in rows[:9]]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = _without_boilerplate(rows)
    assert got == want and sum(len(w) for w in want.values()) < 0.9 * sum(len(ht.brute_force("<article>" + h)) for _, _, h in rows)


def test_articles_are_kept_whatever_wraps_them():
    text = lambda page: " ".join(t for r, t in ht.blocks(page) if r == ht.CONTENT)
    for page in (
        '<div class="page no-sidebar"><article><p>Body text.</p></article></div>', '<div class="has-nav"><article><p>Body text.</p></article></div>', "<form><main><p>Body text.</p></main></form>",
        "<header><article><p>Body text.</p></article></header>", '<article><div class="article-body no-share"><p>Body text.</p></div></article>', '<div class="with-menu sidebar-open"><main><p>Body text.</p></main></div>',
    ):
        assert text(page) == "Body text.", page
    for chrome in ('<div class="site-footer">x</div>', '<div class="main_menu">x</div>', '<div id="cookie-banner">x</div>', "<aside><article>x</article></aside>", '<section class="comments"><article>x</article></section>', '<article class="comment">x</article>', '<div class="widget sidebar">x</div>', "<form>x</form>"):
        assert text(f"{chrome}<article><p>Body text.</p></article>") == "Body text.", chrome
        assert [r for r, t in ht.blocks(chrome) if t == "x"] == [ht.CHROME], chrome


def _on(stream, page, k, most):
    """Pages with the k items from each place on; by trying every place."""
    return {p for block, p in zip(stream, page, strict=True) for i in range(len(block) - most + 1) if block[i : i + most] == k}


@pytest.mark.parametrize("seed", range(6))
def test_array_tells_longest_shared_stretches_and_their_pages(seed):
    rnd = random.Random(seed)
    words = [[rnd.choice("abc"[: 1 + seed % 3]) for _ in range(rnd.randint(0, 30))] for _ in range(14)]
    page = np.array(sorted(rnd.randrange(6) for _ in words))
    s = ht.Stream([" ".join(w) for w in words], np.zeros(len(words), bool))
    for t in (1, 2, 4):
        got = ht.longest_shared(s, page, t)
        for i in np.flatnonzero(s.at >= 0):
            w, a = words[s.block[i]], int(s.at[i] - s.words.first[s.block[i]])
            if len(w) < ht.RUN:
                assert got[i] == (len({p for x, p in zip(words, page, strict=True) if x == w}) >= t)
            else:
                fit = [k for k in range(ht.RUN, len(w) - a + 1) if len(_on(words, page, w[a : a + k], k)) >= t]
                assert got[i] == max(fit, default=0)
    known = [w for w in words[:5] if len(w) >= ht.RUN]
    both = ht.Stream([" ".join(w) for w in words + known], np.zeros(len(words) + len(known), bool))
    sums = {}
    for k, at, size, n in zip(*(x.tolist() for x in ht.agreement(both, page, len(known))), strict=True):
        for j in range(ht.RUN, size + 1):
            sums[k, at, j] = sums.get((k, at, j), 0) + n
    assert sums == {(k, a, j): n for k, w in enumerate(known) for a in range(len(w)) for j in range(ht.RUN, len(w) - a + 1) if (n := len(_on(words, page, w[a : a + j], j)))}


@pytest.mark.parametrize("shard", [60, 1 << 18])
def test_passages_of_any_length_are_counted_across_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(ht, "SHARD_WORDS", shard)
    rnd = random.Random(8)
    say = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    head, long, tail = say(9), say(24), say(8)
    rows = []
    for i in range(48):  # a footer, marked; most pages have more of it, some of these in running text
        foot = " ".join([head] * (i % 4 == 0) + [long] + [tail] * (i % 3 == 0))
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<article><p>{say(9)} {long}</p></article>" + (f"<footer>{foot}</footer>" if i % 5 else f"<p>{say(3)}</p><div>{foot}</div>") + "<nav><li>Home</li></nav>" + "<h2>Home</h2>" * (i % 24 == 3)))
    rows.append((100, rows[0][1], rows[0][2]))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {(r.host, r.passage): r.pages for r in ht.passages(pages).collect()}
    want = {}
    for h in ("h0.org", "h1.org"):
        own = [[t.split() for r, t in ht.blocks(q) if r != ht.CONTENT] for i, u, q in rows if i < 100 and u.split("/")[2] == h]
        each = {}
        for k, page in enumerate(own):
            for s in {tuple(b[i:j]) for b in page if len(b) >= ht.RUN for i in range(len(b)) for j in range(i + ht.RUN, len(b) + 1)}:
                each.setdefault(s, set()).add(k)
        often = {s: len(p) for s, p in each.items() if len(p) >= max(ht.PAGES, ht.SHARE * len(own))}
        assert all(often[tuple(p.split())] == n for (name, p), n in got.items() if name == h)
        inner = {s[a:b] for s in often for a, b in ((1, len(s)), (0, len(s) - 1))}
        want |= {(h, " ".join(s)): n for s, n in often.items() if s not in inner}
    assert want.items() <= got.items() and any(len(p.split()) > 24 for _, p in want)
    # the footer goes where it isn't marked, what is an article's stays
    for r in ht.extract(pages).collect():
        assert long in r.text and r.text.count(long) == 1, r
        assert r.text.endswith("Home") == (r.page_id % 24 == 3)


def test_a_word_said_over_and_over(spark):
    rows = [(i, "http://a.org/", f"<div>{'so ' * (3000 + i)}</div><p>own{i} words</p>") for i in range(8)]
    began = time.time()
    assert sorted(r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == [f"own{i} words" for i in range(8)]
    assert time.time() - began < 60
