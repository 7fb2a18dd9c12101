"""Main text of web pages: markup tells regions, a host's suffix array tells boilerplate.

A page is read into blocks (text between block tags, white space made one space, references
decoded). Blocks in an article (or main) region are content, whatever repeats there: a passage that
many articles quote is still theirs. What stands outside is a stream of words, where boilerplate
repeats from page to page; the marked regions (menu, header, footer, advert ..) are in it too, so a footer
that some pages mark and others don't is known on all of them.

The host's suffix array over these streams, with whole common prefixes, yields its passages: the longest repeats, of any
length from RUN words on (or whole blocks that are shorter), which stand on PAGES distinct pages of the host and on a SHARE
of all its distinct pages, with the number of pages. The array of a host of any size is spread:

1. Distinct pages are dealt to shards of bounded size by their hash. What stands on a share of all pages stands on that
   share of some shard's, so the longest repeats with the share within a shard hold every passage.
2. Each shard's array, with those candidates in it, tells from each of their words on how far each page agrees; numbers of pages by
   length add up over shards, and the greatest length with pages enough is the passage that begins there.
3. An array of a page's words outside its article with the host's passages tells the longest stretch of a passage at each word; words under one of
   RUN or more (or a whole shorter block) go.

The exact check by markup follows: what is left in a region that is boilerplate by itself (menu, header, footer, sidebar, notice, advert, form, comments)
goes though it doesn't repeat. A class or id marks such a region
by a word of its own or the last part of one ("site-footer"), not by what it says of another ("no-sidebar", "has-nav"). An article in a form or
header, and main anywhere, is content again;
scripts, styles and comments of the markup never are text. Text of a head that isn't in one of its elements is the body's.
A marked block shorter than RUN words says nothing of others: a heading may be the word of a menu.

Without the article rule, page texts lose paragraphs: in the test tables nine of ten pages share one.

Null html is empty; pages that repeat (equal html) are told from distinct pages by their html, so
copies of a page don't make its text boilerplate; null urls have the host ''. One row a page. Pages are parsed once. Elements without text that
are never closed end before the next element that opens a block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Words, chunks, cut, hot_join, map_batches, whole_groups
from .urlfilter import host

RUN = 6
#: Distinct pages of a host that must have a run outside articles for it to be boilerplate: so many, and such a share of all.
PAGES, SHARE = 5, 0.25
#: Words of a host that a suffix array holds at most.
SHARD_WORDS = 1 << 18

# Elements without text, elements that are boilerplate, elements that don't break a line.
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg"}
_CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_FLOW = re.compile(r"<(?:body|main|article|section|header|footer|nav|aside|div|p|h[1-6]|ul|ol|table|form|blockquote|pre)\b", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_MARK = re.compile(r"(?<![\w-])(?!(?:no|non|not|has|have|with|without|is|hide|hidden|show|above|below|beside|on|off)[_-])(?:[\w-]*[_-])?(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|comment-list|disqus|cookies?|notice|consent|sidebar|breadcrumbs?|menu|nav|navbar|navigation|footer|share|social|related|newsletter|popup|modal)(?![A-Za-z0-9])(?!\w*[_-](?:open|closed|active|enabled|disabled|visible|collapsed)\b)", re.I)
_COMMENT = re.compile(r"(?<![\w-])(?:comments?|reply|replies)(?![A-Za-z0-9])", re.I)
_TAG = re.compile(r"<(?:!--(?s:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))")
_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")

#: SOFT is chrome unless an article begins in it: forms and headers wrap whole pages at times.
CONTENT, CHROME, LOOSE, SOFT = 0, 1, 2, 3


def blocks(html: str) -> list[tuple[int, str]]:
    """(region, text) of the blocks in page order; empty ones are left out."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and their regions
    opened: Counter[str] = Counter()
    region, was, past, n = LOOSE, LOOSE, 0, len(html)

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append((CHROME if was == SOFT else was, text))
            held.clear()

    while past < n:
        m = _TAG.search(html, past)
        if m is None:
            held.append(html[past:])
            break
        if m.start() > past:
            if not held:
                was = region
            held.append(html[past : m.start()])
        past = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _INLINE:
            continue
        flush()
        if closing:
            while opened[tag]:  # what is open within ends with it
                name, _ = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
            region = stack[-1][1] if stack else LOOSE
        elif tag in _RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, past)
                past = end.end() if end else flow.start() if (flow := _FLOW.search(html, past)) else n
        elif tag not in _VOID and not m[0].endswith("/>"):
            attrs = " ".join(x or y or z for x, y, z in _ATTR.findall(m[3])) if m[3].strip() else ""
            if tag == "main":
                region = CONTENT
            elif region != CHROME:
                if tag == "article":
                    region = CHROME if _COMMENT.search(attrs) else CONTENT
                elif tag == "form" or (tag == "header" and region != CONTENT):
                    region = SOFT
                elif tag in _CHROME or (attrs and _MARK.search(attrs) and tag not in ("html", "head", "body")):
                    region = CHROME
            if not (stack and stack[-1] == (tag, region)) or tag not in ("p", "li"):
                stack.append((tag, region))
                opened[tag] += 1
    flush()
    return out


def suffix_array(x: np.ndarray, most: int | None = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of an integer sequence, by doubling, and each one's common prefix with the one before, up to `most` items (None: whole)."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, code, size = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[code]  # a suffix's rank: how many are less by their first k items
    levels, k = [rank.astype(np.int32)], 1
    open_ = np.flatnonzero(size[code] > 1)
    while len(open_):
        second = np.zeros(len(open_), np.int64)
        inside = open_ + k < n
        second[inside] = rank[open_[inside] + k] + 1
        by = np.argsort(rank[open_] * (n + 1) + second)
        open_, second = open_[by], second[by]
        old = rank[open_]
        i = np.arange(len(open_))
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, second[1:] != second[:-1])
        first, own = np.maximum.accumulate(np.where(group, i, 0)), np.maximum.accumulate(np.where(new, i, 0))
        rank[open_] = old + own - first
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
        levels.append(rank.astype(np.int32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, lcp = order[1:].copy(), order[:-1].copy(), np.zeros(n, np.int64)
    for j in range(len(levels) - 1, -1, -1):  # equal ranks by k items: so many items are equal
        same = (a < n) & (b < n)
        same[same] = levels[j][a[same]] == levels[j][b[same]]
        step = same.astype(np.int64) << j
        a, b = a + step, b + step
        lcp[1:] += step
    return order, lcp if most is None else np.minimum(lcp, most)


class Least:
    """Least values of ranges of an array."""

    def __init__(self, v: np.ndarray):
        self.levels = [v.astype(np.int32)]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of v[lo:hi]; hi > lo."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for j in range(len(self.levels), int(level.max(initial=0)) + 1):  # least of 2 ** j from each place on
            self.levels.append(np.minimum(self.levels[-1][: -(1 << j >> 1)], self.levels[-1][1 << j >> 1 :]))
        out = np.empty(len(lo), np.int32)
        for j in np.unique(level).tolist():
            own = level == j
            out[own] = np.minimum(self.levels[j][lo[own]], self.levels[j][hi[own] - (1 << j)])
        return out


def _block_words(texts: list[str]) -> Words:
    return next((Words(d, o) for _, _, d, o in chunks(pa.array(texts, pa.string()), 1 << 40)), Words(np.zeros(0, np.uint8), np.zeros(1, np.int64)))


class Stream:
    """Blocks as one sequence with its suffix array: an item is a word, or a whole block of fewer than RUN words; an item of its own ends each block.

    at: first word of each item, -1 of ends. block: its block. need: items that a repeat from there on has at least. Marked short blocks have no items.
    """

    def __init__(self, texts: list[str], marked: np.ndarray):
        self.words = w = _block_words(texts)
        n, short = len(w.hash), np.diff(w.first) < RUN
        head = np.zeros(n, bool)
        head[w.first[:-1][np.diff(w.first) > 0]] = True
        at = np.flatnonzero(~short[w.doc] | (head & ~marked[w.doc])) if n else np.zeros(0, np.int64)
        item = w.hash.copy()
        whole, first = w.shingles(RUN)
        only = short[w.doc[first]]
        item[first[only]] = whole[only]
        place = np.arange(len(at)) + w.doc[at]
        size = len(at) + len(texts)
        self.at, self.block = np.full(size, -1), np.full(size, -1)
        self.at[place], self.block[place] = at, w.doc[at]
        self.need = np.full(size, size + 1)
        self.need[place] = np.where(short[w.doc[at]], 1, RUN)
        x = np.arange(size) + len(at)
        x[place] = np.unique(item[at], return_inverse=True)[1]
        self.order, self.lcp = suffix_array(x, None)
        self.least = Least(self.lcp)
        end = np.where(self.at < 0, np.arange(size), size)
        self.left = np.minimum.accumulate(end[::-1])[::-1] - np.arange(size)  # items up to the block's end
        #: ranks alike in the items that a repeat needs have one group
        self.group = np.cumsum(self.lcp < self.need[self.order])

    def passage(self, i: int, size: int) -> str:
        """The words of `size` items from i on."""
        w, a = self.words, int(self.at[i])
        last = int(w.first[self.block[i] + 1]) if self.need[i] == 1 else a + size
        return b" ".join(w.data[w.start[a] : w.end[last - 1]].tobytes().split()).decode()


def _windows(group: list[int], page: list[int], t: int) -> list[int]:
    """For each rank the last one from which on, up to it, the group has t pages; where there is none, the group's first, inverted."""
    out, n, a, own = [], {}, 0, None
    for b, (g, p) in enumerate(zip(group, page, strict=True)):
        if g != own:
            own, a, n = g, b, {}
        n[p] = n.get(p, 0) + 1
        while len(n) > t or (len(n) == t and n[page[a]] > 1):
            q = page[a]
            n[q] -= 1
            if not n[q]:
                del n[q]
            a += 1
        out.append(a if len(n) == t else ~a)
    return out


def longest_shared(s: Stream, page: np.ndarray, t: int) -> np.ndarray:
    """For each item, how many from it on stand on t pages or more; 0 where fewer than a repeat needs. page: of each block."""
    out = np.zeros(len(s.order), np.int64)
    rank = np.flatnonzero(s.block[s.order] >= 0)
    if not len(rank):
        return out
    group = s.group[rank]
    many = np.bincount(group)[group] >= t
    rank, group = rank[many], group[many]
    if not len(rank):
        return out
    begin = np.array(_windows(group.tolist(), page[s.block[s.order[rank]]].tolist(), t), np.int64)
    full, begin = begin >= 0, np.where(begin < 0, ~begin, begin)
    shared = np.where(full, s.left[s.order[rank]], 0)
    wide = np.flatnonzero(full & (rank[begin] < rank))
    shared[wide] = s.least.of(rank[begin[wide]] + 1, rank[wide] + 1)
    # the best of all windows, each as far as its ranks' neighbours agree
    best, lcp = shared.tolist(), np.where(np.append(True, group[1:] != group[:-1]), 0, s.lcp[rank]).tolist()
    for k in range(len(best) - 2, -1, -1):
        if best[k] < best[k + 1] and best[k] < lcp[k + 1]:
            best[k] = min(lcp[k + 1], best[k + 1])
    for k in range(1, len(best)):
        if best[k] < best[k - 1] and best[k] < lcp[k]:
            best[k] = min(lcp[k], best[k - 1])
    best = np.array(best)
    i = s.order[rank]
    out[i] = np.where(best >= s.need[i], best, 0)
    return out


def _maximal(size: np.ndarray) -> np.ndarray:
    """Items at which a repeat of the size given begins that doesn't lie in the one that begins before."""
    return np.flatnonzero((size > 0) & (np.append(0, size[:-1]) <= size))


def shared_passages(s: Stream, page: np.ndarray, t: int) -> set[str]:
    """The longest repeats that stand on t pages or more."""
    size = longest_shared(s, page, t)
    rank = np.empty(len(s.order), np.int64)
    rank[s.order] = np.arange(len(s.order))
    at = _maximal(size)
    at = at[np.argsort(rank[at])]
    if len(at) > 1:
        r = rank[at]
        again = (size[at[1:]] == size[at[:-1]]) & (s.least.of(r[:-1] + 1, r[1:] + 1) >= size[at[1:]])
        at = at[np.append(True, ~again)]
    return {s.passage(i, int(size[i])) for i in at.tolist()}


def agreement(s: Stream, page: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item in it, items, pages): on how many pages exactly so many items from there on stand at the longest. The last `known` blocks are the passages."""
    n, blocks = len(s.order), len(page)
    block = s.block[s.order]
    text, asked = np.flatnonzero((block >= 0) & (block < blocks)), np.flatnonzero(block >= blocks)
    text = text[np.isin(s.group[text], s.group[asked])]
    own = page[block[text]]
    pairs = np.unique(s.group[text] * np.int64(blocks + 1) + own)  # groups and their pages
    lo = np.searchsorted(pairs, s.group[asked] * np.int64(blocks + 1))
    count = np.searchsorted(pairs, (s.group[asked] + 1) * np.int64(blocks + 1)) - lo
    which = np.repeat(np.arange(len(asked)), count)
    p = pairs[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(which))] % (blocks + 1)
    r = asked[which]
    # the page's suffixes next to the passage's, on either side
    keys = np.sort(own * np.int64(n + 1) + text)
    near = np.searchsorted(keys, p * np.int64(n + 1) + r)
    best = np.zeros(len(r), np.int64)
    for side, step in ((near - 1, 0), (near, 1)):
        there = np.flatnonzero((side >= 0) & (side < len(keys)))
        there = there[(keys[side[there]] // (n + 1) == p[there]) & (s.group[keys[side[there]] % (n + 1)] == s.group[r[there]])]
        other = keys[side[there]] % (n + 1)
        a, b = (r[there], other) if step else (other, r[there])
        best[there] = np.maximum(best[there], s.least.of(a + 1, b + 1))
    i = s.order[r]
    both, pages = np.unique(np.stack([i, best]), axis=1, return_counts=True)
    which = s.block[both[0]] - blocks
    first = np.searchsorted(s.block[s.at >= 0], np.arange(blocks, blocks + known))  # of the items that are no ends
    return which, both[0] - np.flatnonzero(s.at >= 0)[first[which]], both[1], pages


def covered(s: Stream, blocks: int) -> np.ndarray:
    """Words of the first blocks that lie under a stretch of one of the passages, which are the other blocks."""
    n = len(s.order)
    block, rank = s.block[s.order], np.arange(n)
    known = block >= blocks
    before = np.maximum.accumulate(np.where(known, rank, -1))
    after = np.minimum.accumulate(np.where(known, rank, n)[::-1])[::-1]
    best = np.zeros(n, np.int64)
    own = (block >= 0) & ~known
    alike = lambda k: own & (s.group[np.clip(k, 0, n - 1)] == s.group)
    for a, b, there in ((before, rank, alike(before) & (before >= 0)), (rank, after, alike(after) & (after < n))):
        best[there] = np.maximum(best[there], s.least.of(a[there] + 1, b[there] + 1))
    hit = np.flatnonzero(own & (best >= s.need[s.order]))
    i, w = s.order[hit], s.words
    size = np.where(s.need[i] == 1, np.diff(w.first)[s.block[i]], best[hit])
    depth = np.bincount(s.at[i], minlength=len(w.hash) + 1) - np.bincount(s.at[i] + size, minlength=len(w.hash) + 1)
    return np.cumsum(depth)[:-1] > 0


def _rests(texts: list[str], marked: np.ndarray, passages: list[str]) -> list[str]:
    """The texts without the words that passages cover."""
    s = Stream(texts + passages, np.append(marked, np.zeros(len(passages), bool)))
    gone, w, out, base = covered(s, len(texts)), s.words, [], 0
    for d, t in enumerate(texts):
        a, b, raw = int(w.first[d]), int(w.first[d + 1]), t.encode()
        if not gone[a:b].any():
            out.append(t)
        elif gone[a:b].all():
            out.append("")
        else:  # what stays has what stands around its words up to those that go
            keep = bytearray()
            for i in (a + np.flatnonzero(~gone[a:b])).tolist():
                end = int(w.start[i + 1]) - base if i + 1 < b else len(raw)
                keep += raw[int(w.start[i]) - base : end]
            out.append(_SPACE.sub(" ", keep.decode(errors="ignore")).strip())
        base += len(raw)
    return out


def _page(html: str) -> int:
    return int.from_bytes(hashlib.blake2b(html.encode(), digest_size=8).digest(), "big", signed=True)


def _parsed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """A row for each page: page_id, url, host and its hash h, hash of the html, words outside articles, regions and texts of the blocks.

    Marked blocks that can't have RUN words are left out.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        docs = b.column(3).to_pylist()
        own = [[x for x in blocks(d) if x[0] != CHROME or len(x[1]) > 2 * RUN - 2] if d else [] for d in docs]
        words = [sum(t.count(" ") + 1 for r, t in x if r != CONTENT) for x in own]
        cols = [pa.array([_page(d) for d in docs], pa.int64()), pa.array(words, pa.int64()), pa.array([[r for r, _ in x] for x in own], pa.list_(pa.int32())), pa.array([[t for _, t in x] for x in own], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["page_id", "url", "host", "page", "words", "regions", "texts"])

    out = map_batches(rows, one, f"page_id {kind}, url string, host string, page long, words long, regions array<int>, texts array<string>")
    return cut(out.withColumn("h", F.xxhash64("host")))


def _shards(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel over the shards: h, least and own pages of the host, regions and texts of each page, passages of the host."""
    ship(rows.sparkSession)

    def run(batches):
        for t in whole_groups(batches, 2):
            shard = np.stack([t.column(k).to_numpy() for k in (0, 1)])
            edges = np.append(np.flatnonzero(np.append(True, (shard[:, 1:] != shard[:, :-1]).any(0))), len(t))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                regions, texts, known = (t.column(k).slice(lo, hi - lo).to_pylist() for k in (4, 5, 6))
                passages = next((x.split("\n") for x in known if x is not None), [])
                own = [k for k, x in enumerate(known) if x is None]
                page = np.repeat(np.arange(len(own)), [len(texts[k]) for k in own])
                marked = np.array([r == CHROME for k in own for r in regions[k]] + [False] * len(passages), bool)
                s = Stream([x for k in own for x in texts[k]] + passages, marked)
                yield kernel(int(shard[0, lo]), int(t.column(2)[lo].as_py()), int(t.column(3)[lo].as_py()), len(own), s, page, len(passages))

    return rows.repartition("h", "shard").sortWithinPartitions("h", "shard").mapInArrow(run, schema)


def _hosts(parsed: DataFrame) -> DataFrame:
    """h, rows n, distinct pages, those with words outside articles, shards, and the pages that a passage needs."""
    each = parsed.groupBy("h", "page").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    least = F.greatest(F.lit(PAGES).cast("long"), F.ceil(F.lit(SHARE) * F.count(F.lit(1))).cast("long"))
    return cut(each.groupBy("h").agg(F.sum("n").alias("n"), F.count_if(F.col("words") > 0).alias("own"), F.ceil(F.sum("words") / SHARD_WORDS).cast("int").alias("shards"), least.alias("least")))


def _passages(parsed: DataFrame, hosts: DataFrame) -> DataFrame:
    """(h, passage, pages): the longest repeats outside articles, as words, that stand on pages enough of the host, and on how many."""
    live = hosts.where("own >= least")
    part = lambda f: F.transform(F.filter(F.arrays_zip("regions", "texts"), lambda x: x["regions"] != CONTENT), lambda x: x[f])
    streams = parsed.where("words > 0").select("h", "page", part("regions").alias("regions"), part("texts").alias("texts")).dropDuplicates(["h", "page"])
    dealt = hot_join(streams, live.select("h", "least", "own", "shards"), ["h"], live).withColumn("shard", F.pmod("page", "shards").cast("int"))
    dealt = cut(dealt.select("h", "shard", "least", "own", "regions", "texts", F.lit(None).cast("string").alias("known")))

    def candidates(h: int, least: int, own: int, pages: int, s: Stream, page: np.ndarray, _: int) -> pa.RecordBatch:
        found = sorted(shared_passages(s, page, -(-least * pages // own)))
        return pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(found, pa.string())], ["h", "passage"])

    def lengths(h: int, least: int, own: int, pages: int, s: Stream, page: np.ndarray, known: int) -> pa.RecordBatch:
        k, at, size, n = agreement(s, page, known)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), h), pa.int64()), *(pa.array(x.astype(np.int64)) for x in (k, at, size, n))], ["h", "k", "at", "size", "n"])

    found = _shards(dealt, candidates, "h long, passage string")
    lists = cut(found.groupBy("h").agg(F.sort_array(F.collect_set("passage")).alias("list")))
    asked = lists.join(live, "h").select("h", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "least", "own", F.lit(None).cast("array<int>").alias("regions"), F.lit(None).cast("array<string>").alias("texts"), F.array_join("list", "\n").alias("known"))
    told = _shards(hot_join(dealt, lists.select("h"), ["h"], live).select(dealt.columns).union(asked), lengths, "h long, k long, at long, size long, n long")
    sums = told.groupBy("h", "k", "at", "size").agg(F.sum("n").alias("n"))
    longer = sums.withColumn("pages", F.sum("n").over(Window.partitionBy("h", "k", "at").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)))
    best = longer.join(live.select("h", "least"), "h").where("pages >= least").groupBy("h", "k", "at").agg(F.max_by(F.struct("size", "pages"), "size").alias("b")).select("h", "k", "at", "b.*")
    before = lambda c: F.lag(c).over(Window.partitionBy("h", "k").orderBy("at"))
    held = best.withColumn("inside", (before("at") == F.col("at") - 1) & (before("size") > F.col("size"))).where("not coalesce(inside, false)")
    words = F.split(F.get("list", F.col("k").cast("int")), " ")
    text = F.when(F.size(words) < RUN, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, F.col("at").cast("int") + 1, F.col("size").cast("int")), " "))
    return held.join(lists, "h").select("h", text.alias("passage"), "pages").distinct()


def passages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each passage of a host: host, passage (its words), n_words, pages (distinct pages that have it). One may lie in another that more words of a page precede."""
    parsed = _parsed(pages, page_id, url, html)
    names = parsed.groupBy("h").agg(F.min("host").alias("host"))
    return _passages(parsed, _hosts(parsed)).join(names, "h").select("host", "passage", F.size(F.split("passage", " ")).alias("n_words"), "pages")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    parsed = _parsed(pages, page_id, url, html)
    hosts = _hosts(parsed)
    known = _passages(parsed, hosts).groupBy("h").agg(F.array_join(F.sort_array(F.collect_list("passage")), "\n").alias("known"))
    lists = cut(hosts.select("h").join(known, "h", "left"))  # written, so that its size is known and page texts aren't shuffled to a small table
    kind = parsed.schema["page_id"].dataType.simpleString()

    def text(b: pa.RecordBatch) -> pa.RecordBatch:
        regions, texts, known = (b.column(k).to_pylist() for k in (2, 3, 4))
        by: dict[str, list[list[int]]] = {}  # rows by the passages of their host, so many words together
        held: Counter[str] = Counter()
        for row, (f, n) in enumerate(zip(known, b.column(5).to_pylist(), strict=True)):
            if f and n:
                if f not in by or held[f] + n > SHARD_WORDS:
                    by.setdefault(f, []).append([])
                    held[f] = 0
                held[f] += n
                by[f][-1].append(row)
        for f, parts in by.items():
            for rows in parts:
                outside = [(row, j) for row in rows for j, r in enumerate(regions[row]) if r != CONTENT]
                rests = _rests([texts[row][j] for row, j in outside], np.array([regions[row][j] == CHROME for row, j in outside], bool), f.split("\n"))
                for (row, j), rest in zip(outside, rests, strict=True):
                    texts[row][j] = rest
        # the check by markup: what is left in marked regions is boilerplate too
        out = [" ".join(t for r, t in zip(*x, strict=True) if t and r != CHROME) for x in zip(regions, texts, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = hot_join(parsed, lists, ["h"], hosts, most=64).select("page_id", "url", "regions", "texts", "known", "words")
    return map_batches(rows, text, f"page_id {kind}, url string, text string, n_chars long")


def brute_force(html: str | None) -> str:
    """What test pages with an article hold, told another way: for pages whose article has no regions of boilerplate within."""
    from html.parser import HTMLParser

    parts: list[str] = []

    class P(HTMLParser):
        depth = 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag not in _INLINE:
                parts.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag not in _INLINE:
                parts.append(" ")

        def handle_data(self, data):
            if self.depth > 0 and self.cdata_elem is None:
                parts.append(data)

    P().feed(html or "")
    return " ".join("".join(parts).split())
