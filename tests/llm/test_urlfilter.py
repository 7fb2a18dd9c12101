from hypothesis import given, settings
from hypothesis import strategies as st

from sensorweave.llm import urlfilter as uf


def _brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, uf.DEFAULT))
    return host, path, best[2], best[3]


RULES = [*uf.RULES, ("block", "a.b", "/x"), ("allow", "a.b", "/x"), ("block", "b", "")]


def test_equals_the_definition(spark):
    found = []
    urls = st.text(alphabet="abBx/.:?#é", max_size=12).map(lambda s: "h://" + s) | st.none() | st.sampled_from(["http://WWW.example.com/en/1", "https://sub.example.com/en/", "x.net/es/", "ftp://net/es/?q", "http://a.net/fr/x#y", "http://example.com", "://com/", "http://b", "http://q.a.b/xy", "a://b://c/"])

    @given(st.lists(urls, min_size=200, max_size=300))
    @settings(max_examples=1, deadline=None, database=None)
    def collect(xs):
        found.append(xs)

    collect()
    xs = found[-1] + found[-1][:5]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(xs)], "page_id long, url string, rule string")
    out = {r.page_id: tuple(r)[1:] for r in uf.judge(pages, uf.rule_table(spark, RULES)).collect()}
    assert [out[i] for i in range(len(xs))] == [_brute(u, RULES) for u in xs]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    none = uf.rule_table(spark, RULES).limit(0)
    assert [tuple(r) for r in uf.judge(pages, none).collect()] == [(1, "a.com", "/", None, "allow")] * 2
    assert uf.judge(pages.limit(0), uf.rule_table(spark, RULES)).collect() == []
