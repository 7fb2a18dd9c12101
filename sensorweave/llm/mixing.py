"""Mixing sources to target weights: a budget of tokens passed down a tree of domain, language and source.

A node's capacity is its tokens times the most epochs allowed. From the root down, a node's budget
is shared among its children by weight; what a child cannot take goes to its siblings by weight, and
only what all of them cannot take has already gone to the node's own siblings, a level up, since a
node is never given more than its subtree's capacity. The water level of siblings comes from one
window over them, ordered by capacity over weight; the tree has a row a leaf, summed beforehand.

A leaf with budget b and n tokens gets every document b div n times, and of the next epoch the
prefix that fits into the rest, in an order seeded by epoch and document. Hashes of that order are
cut into CELLS equal cells; per-cell sums (of a row a leaf and cell) tell which cells are taken whole,
and only documents of the one cell where the prefix ends are sorted, so a leaf of any size spreads.

Null domain, language or source is a leaf of its own kind (its key is empty text); null and empty texts
have no tokens and are chosen with every full epoch and within the prefix; unknown weights are
`other`. Repeated rows are documents of their own (equal ones in any order). Empty tables stay empty. Columns may have any names.
A leaf's cells are at most CELLS rows of one task; the documents of one cell are a CELLS-th of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, free_names

#: Production weights; names not listed have the weight under "other". Domains are told by source.
DOMAINS = {"src0": "crawl", "src1": "forum", "src2": "news", "src3": "books"}
WEIGHTS = {
    "domain": {"crawl": 0.3, "forum": 0.15, "news": 0.15, "books": 0.1, "other": 0.3},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "other": 0.05},
    "source": {"other": 1.0},
}
#: Tokens to choose, as a share of all tokens; times a document may be chosen; seed of the epochs' orders.
BUDGET, EPOCHS, SEED = 0.6, 3, 7
CELLS = 1 << 12


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _by_name(names: dict, key: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in sorted(names.items()) for x in kv))
    return F.coalesce(F.try_element_at(known, key), F.lit(names["other"]))


def domain(source: Column, names: dict[str, str] = DOMAINS) -> Column:
    return _by_name({"other": "other"} | names, F.coalesce(source, F.lit("")))


def _shared(nodes: DataFrame, parent: list[str], weight: Column) -> DataFrame:
    """nodes with `cap` and their parent's `budget`: the budget of each, by water-filling among siblings."""
    w = W.partitionBy(*parent)
    rising = w.orderBy(F.col("cap") / F.col("w"), *[c for c in ("domain", "lang", "source") if c in nodes.columns])
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing))
    full = F.col("cap") <= F.col("level") * F.col("w")
    # siblings up to the first that does not fill up are full; the rest share at that one's level
    return (
        nodes.withColumn("w", weight).withColumn("level", level)
        .withColumn("stop", F.min(F.when(~full, F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(w))
        .withColumn("own", F.when(F.col("stop").isNull() | (full & (F.col("cap") / F.col("w") < F.col("stop.col1"))), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("stop.level") * F.col("w"))))
        .drop("w", "level", "stop", "budget")
    )


def budgets(leaves: DataFrame, total: Column | float, weights: dict = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens) to the same with `budget` tokens."""
    leaf = leaves.withColumn("cap", F.col("tokens") * F.lit(epochs))
    path, out = ["domain", "lang", "source"], None
    for k, name in enumerate(path):
        nodes = leaf.groupBy(*path[: k + 1]).agg(F.sum("cap").alias("cap"))
        if out is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(total), F.sum("cap").over(W.partitionBy()).cast("double")))
        else:
            nodes = nodes.join(out.select(*path[:k], F.col("own").alias("budget")), path[:k])
        out = _shared(nodes, path[:k], _by_name(weights[name], F.col(name)))
    return leaf.join(out.select(*path, F.floor(F.col("own") + 1e-6).cast("long").alias("budget")), path).select(*path, "tokens", "budget")


def mix(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id", weights: dict = WEIGHTS, domains: dict = DOMAINS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows, each as often as it is chosen, with the epoch in a last column."""
    d, n, key, epoch, whole, rest, cell, left, at = free_names(docs, "sw_leaf", "sw_tokens", "sw_key", "epoch", "sw_whole", "sw_rest", "sw_cell", "sw_left", "sw_edge")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    leaf = F.struct(domain(F.col(source), domains).alias("domain"), name(lang).alias("lang"), name(source).alias("source"))
    rows = docs.withColumns({d: leaf, n: tokens(F.col(text))})
    sums = cut(rows.groupBy(d).agg(F.sum(n).alias("tokens")))
    leaves = sums.select(f"{d}.*", F.col("tokens"))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget
    plan = budgets(leaves, total, weights, epochs).select(
        F.struct("domain", "lang", "source").alias(d),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int").alias(whole),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias(rest),
    )
    plan = cut(plan)
    # the order of the epoch that is taken in part; rows alike in id and text go by their other columns, equal rows in any order
    order = F.xxhash64(F.lit(seed), F.col(whole), F.col(doc_id), F.col(text))
    with_key = lambda df: df.join(plan, d).withColumn(key, order).withColumn(cell, F.shiftrightunsigned(key, 64 - 12).cast("int"))
    small = rows.select(d, n, F.col(doc_id), F.col(text))
    by_cell = with_key(small).groupBy(d, cell).agg(F.sum(n).alias("m"), F.first(rest).alias("r"))
    before = F.sum("m").over(W.partitionBy(d).orderBy(cell).rowsBetween(W.unboundedPreceding, -1))
    edge = cut(by_cell.withColumn("b", F.coalesce(before, F.lit(0))).where("b + m > r and b <= r").groupBy(d).agg(F.min(F.struct(F.col(cell), F.col("r") - F.col("b"))).alias("e")).select(d, F.col(f"e.{cell}").alias(at), F.col("e.col2").alias(left)))
    own = with_key(rows).join(edge, d, "left")
    others = [F.col(f.name) for f in docs.schema if "map" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    inside = W.partitionBy(d, cell).orderBy(key, F.xxhash64(*others)).rowsBetween(W.unboundedPreceding, 0)
    more = lambda df, take: df.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(whole) + take.cast("int")))).where(F.col(whole) + take.cast("int") > 0)
    at_edge = F.coalesce(F.col(cell) == F.col(at), F.lit(False))
    plain = more(own.where(~at_edge), F.coalesce(F.col(cell) < F.col(at), F.col(rest) > 0))
    last = own.where(at_edge).withColumn(left, F.sum(n).over(inside) <= F.col(left))
    return plain.select(*docs.columns, epoch).union(more(last, F.col(left)).select(*docs.columns, epoch))


def brute_force(leaves: dict[tuple[str, str, str], int], total: float, weights: dict = WEIGHTS, epochs: int = EPOCHS) -> dict[tuple[str, str, str], float]:
    """Budgets by repeated sharing, for tests."""

    def share(nodes: dict, budget: float, names: dict) -> dict:
        out, open_ = {}, dict(nodes)
        while open_:
            w = {k: names.get(k, names["other"]) for k in open_}
            level = budget / sum(w.values())
            full = [k for k in open_ if open_[k] <= level * w[k] + 1e-12]
            if not full:
                return out | {k: level * w[k] for k in open_}
            for k in full:
                out[k] = open_.pop(k)
                budget -= out[k]
        return out

    def down(prefix: tuple, budget: float) -> dict:
        if len(prefix) == 3:
            return {prefix: budget}
        caps: dict = {}
        for k, t in leaves.items():
            if k[: len(prefix)] == prefix:
                caps[k[len(prefix)]] = caps.get(k[len(prefix)], 0) + t * epochs
        out = {}
        for k, b in share(caps, min(budget, sum(caps.values())), weights[("domain", "lang", "source")[len(prefix)]]).items():
            out |= down((*prefix, k), b)
        return out

    return down((), total)
