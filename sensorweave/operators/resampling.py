"""Permutations, bootstraps and rank statistics; random orders come from md5, so every engine draws the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profiles import average_rank, pearson


def _draw(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def permutations(ids: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(rep, id, to): n permutations of the ids of a small dimension. Repetitions are dealt out before ids join them, so no row is shuffled to be ranked."""
    reps = ids.sparkSession.range(1, n + 1).select(F.col("id").alias("rep")).repartition(max(1, n // 8), "rep")
    numbered = ids.select("id", F.row_number().over(W.orderBy("id")).alias("k"))
    drawn = reps.crossJoin(F.broadcast(ids.select(F.col("id").alias("to")))).withColumn("k", F.row_number().over(W.partitionBy("rep").orderBy(_draw(F.lit(seed), F.col("rep"), F.col("to")), "to")))
    return drawn.join(F.broadcast(numbered), "k").select("rep", "id", "to")


def multiplicities(clusters: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(rep, cluster, mult): n bootstrap samples of clusters (id), as how often each was drawn."""
    size = clusters.count()
    numbered = clusters.select(F.col("id").alias("cluster"), (F.row_number().over(W.orderBy("id")) - 1).alias("k"))
    slots = clusters.sparkSession.range(1, n + 1).select(F.col("id").alias("rep")).crossJoin(clusters.sparkSession.range(size).select(F.col("id").alias("slot")))
    pick = F.conv(F.substring(_draw(F.lit(seed), F.col("rep"), F.col("slot")), 1, 8), 16, 10).cast("long") % size
    return slots.select("rep", pick.cast("int").alias("k")).join(F.broadcast(numbered), "k").groupBy("rep", "cluster").agg(F.count(F.lit(1)).alias("mult"))


def mantel(sim: DataFrame, dist: DataFrame, n: int = 2000, seed: int = 1) -> DataFrame:
    """Pearson correlation of two pair tables (a < b: x) and (a < b: km), with the two-sided p of joint permutations of the first."""
    both = sim.select("a", "b", "x").union(sim.select("b", "a", "x"))
    ids = dist.select(F.col("a").alias("id")).union(dist.select("b")).distinct()
    p = permutations(ids, n, seed)
    zero = ids.select(F.lit(0).cast("long").alias("rep"), "id", F.col("id").alias("to"))
    p = zero.unionByName(p)
    left, right = p.select("rep", F.col("id").alias("a"), F.col("to").alias("ta")), p.select("rep", F.col("id").alias("b"), F.col("to").alias("tb"))
    moved = dist.join(left, "a").join(right, ["rep", "b"]).join(both.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "x"), ["ta", "tb"])
    r = moved.groupBy("rep").agg(F.round(pearson(F.col("x"), F.col("km")), 9).alias("r"), F.count(F.lit(1)).alias("n"))
    seen = F.max(F.when(F.col("rep") == 0, F.col("r"))).over(W.partitionBy())
    out = r.withColumn("r0", seen).agg(F.max("r0").alias("r"), F.max(F.when(F.col("rep") == 0, F.col("n"))).alias("n_pairs"), F.sum(((F.col("rep") > 0) & (F.abs("r") >= F.abs("r0"))).cast("long")).alias("k"))
    return out.select(F.round("r", 6).alias("r"), "n_pairs", F.round((F.col("k") + 1) / (n + 1.0), 6).alias("p"))


def bootstrap_gap(errors: DataFrame, clusters: str, n: int = 2000, seed: int = 1) -> DataFrame:
    """RMSE gap of two estimates with a 95 % interval over resampled clusters; only each cluster's sums are replicated."""
    e, c = F.col("idw") - F.col("observed"), F.col("city") - F.col("observed")
    sums = errors.groupBy(F.col(clusters).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("se"), F.sum(c * c).alias("sc"))
    draws = multiplicities(sums.select(F.col("cluster").alias("id")), n, seed)
    rms = lambda s: F.sqrt(F.sum(F.col(s) * F.col("mult")) / F.sum(F.col("n") * F.col("mult")))
    gaps = draws.join(sums, "cluster").groupBy("rep").agg(F.round(rms("se") - rms("sc"), 9).alias("gap"))
    whole = sums.agg(F.round(F.sqrt(F.sum("se") / F.sum("n")) - F.sqrt(F.sum("sc") / F.sum("n")), 6).alias("gap"))
    return gaps.agg(F.round(F.percentile("gap", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("gap", F.lit(0.975)), 6).alias("hi")).crossJoin(whole)


def adjusted(tests: DataFrame) -> DataFrame:
    """Benjamini-Hochberg p of a small table (name, p)."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    rank = F.row_number().over(W.orderBy("p", "name"))
    scaled = tests.withColumns({"n": n, "rank": rank})
    down = W.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    return scaled.select("name", "p", F.round(F.least(F.lit(1.0), F.min(F.col("p") * F.col("n") / F.col("rank")).over(down)), 9).alias("p_adj"))


def spearman(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"rx": average_rank(F.col(x), *keys), "ry": average_rank(F.col(y), *keys)})
    return ranked.groupBy(*keys).agg(F.round(pearson(F.col("rx"), F.col("ry")), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def circular_mean(rows: DataFrame, hour: str, *keys: str) -> DataFrame:
    """Mean clock time and mean resultant length."""
    a = F.col(hour) * (2 * np.pi / 24)
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return rows.groupBy(*keys).agg(F.round(F.pmod(F.atan2(s, c) / (2 * np.pi) * 24, F.lit(24.0)), 6).alias("mean_hour"), F.round(F.hypot(s, c), 6).alias("strength"), F.count(F.lit(1)).alias("n"))


def circular_linear(rows: DataFrame, hour: str, x: str) -> DataFrame:
    """Mardia's correlation of a clock time with the ranks of x."""
    a = F.col(hour) * (2 * np.pi / 24)
    r = rows.withColumns({"s": F.sin(a), "c": F.cos(a), "r": average_rank(F.col(x))})
    out = r.agg(pearson(F.col("r"), F.col("c")).alias("rc"), pearson(F.col("r"), F.col("s")).alias("rs"), pearson(F.col("c"), F.col("s")).alias("cs"), F.count(F.lit(1)).alias("n"))
    square = (F.pow("rc", F.lit(2)) + F.pow("rs", F.lit(2)) - 2 * F.col("rc") * F.col("rs") * F.col("cs")) / F.nullif(1 - F.pow("cs", F.lit(2)), F.lit(0.0))
    return out.select(F.round(F.sqrt(F.greatest(square, F.lit(0.0))), 6).alias("R"), "n")


def without_each(rows: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Pearson correlation with each row left out, from sums less its own."""
    parts = {"sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "syy": F.col(y) * F.col(y), "sxy": F.col(x) * F.col(y)}
    total = rows.agg(F.count(F.lit(1)).alias("m"), *(F.sum(e).alias(n) for n, e in parts.items()))
    r = rows.select(key, *(e.alias(f"own_{n}") for n, e in parts.items())).crossJoin(F.broadcast(total))
    r = r.withColumns({n: F.col(n) - F.col(f"own_{n}") for n in parts} | {"m": F.col("m") - 1})
    top = F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = (F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("m") * F.col("syy") - F.col("sy") * F.col("sy"))
    return r.select(key, F.round(top / F.nullif(F.sqrt(F.greatest(den, F.lit(0.0))), F.lit(0.0)), 6).alias("r"))


def signed_ranks(rows: DataFrame, d: str) -> DataFrame:
    """Wilcoxon's W+ of nonzero differences, average ranks at ties."""
    r = rows.where(F.col(d) != 0).withColumn("rank", average_rank(F.abs(d)))
    return r.agg(F.round(F.sum(F.when(F.col(d) > 0, F.col("rank")).otherwise(0.0)), 6).alias("w_plus"), F.count(F.lit(1)).alias("n"))


def rank_sum(rows: DataFrame, x: str, first: Column) -> DataFrame:
    """Mann-Whitney's U of the rows that fulfil `first` against the others."""
    r = rows.withColumns({"rank": average_rank(F.col(x)), "one": first})
    n1 = F.sum(F.col("one").cast("long"))
    return r.agg(F.round(F.sum(F.when(F.col("one"), F.col("rank"))) - n1 * (n1 + 1) / 2.0, 6).alias("u"), n1.alias("n1"), (F.count(F.lit(1)) - n1).alias("n2"))


def signed_rank_p(w_plus: float, n: int) -> float:
    """Exact two-sided p of W+ without ties, by counting subsets of ranks."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k].copy()
    low = ways[: int(min(w_plus, n * (n + 1) / 2 - w_plus)) + 1].sum() / 2.0**n
    return float(min(1.0, 2 * low))


def least_squares(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Intercept and slopes of two predictors, from centred sums."""
    g = rows.agg(*(F.covar_pop(a, b).alias(n) for n, a, b in (("s11", x1, x1), ("s22", x2, x2), ("s12", x1, x2), ("s1y", x1, y), ("s2y", x2, y))), *(F.avg(c).alias(f"m{k}") for k, c in enumerate((y, x1, x2))), F.count(F.lit(1)).alias("n"))
    det = F.nullif(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"), F.lit(0.0))
    b1, b2 = (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det, (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det
    return g.select(F.round(F.col("m0") - b1 * F.col("m1") - b2 * F.col("m2"), 6).alias("b0"), F.round(b1, 6).alias("b1"), F.round(b2, 6).alias("b2"), "n")


def held_out_skill(rows: DataFrame, y: str, x: str) -> DataFrame:
    """R2 of leave-one-out line fits against leave-one-out means, by leverage."""
    w = W.partitionBy()
    n, mx, my = F.count(F.lit(1)).over(w), F.avg(x).over(w), F.avg(y).over(w)
    r = rows.withColumns({"n": n, "dx": F.col(x) - mx, "dy": F.col(y) - my}).withColumns({"sxx": F.sum(F.col("dx") * F.col("dx")).over(w), "sxy": F.sum(F.col("dx") * F.col("dy")).over(w)})
    e = (F.col("dy") - F.col("sxy") / F.col("sxx") * F.col("dx")) / (1 - 1 / F.col("n") - F.col("dx") * F.col("dx") / F.col("sxx"))
    base = F.col("dy") * F.col("n") / (F.col("n") - 1)
    return r.where("sxx > 0").agg(F.round(1 - F.sum(e * e) / F.sum(base * base), 6).alias("r2cv"), F.count(F.lit(1)).alias("n"))


def verdict(r: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull() | r.isNull(), "undecided").when(p >= alpha, "no evidence").when(r > 0, "supported").otherwise("opposite")
