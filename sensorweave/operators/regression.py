"""Regressions of units on two or more predictors: errors of slopes, held-out skill with copies, its permutations and paired bootstrap; p values of rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linear
from ..functions.stats import normal_p, student_p
from . import resampling
from .profiles import average_rank, pearson


def slopes(rows: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """(term, beta, se, t) of both slopes of a least-squares plane; nulls for collinear predictors or fewer than four rows."""
    g = rows.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()).agg(
        *(F.covar_pop(a, b).alias(n) for n, a, b in (("s11", x1, x1), ("s22", x2, x2), ("s12", x1, x2), ("s1y", x1, y), ("s2y", x2, y), ("syy", y, y))), F.count(F.lit(1)).alias("n")
    )
    det = F.when(F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12") > 1e-9 * F.col("s11") * F.col("s22"), F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12"))
    g = g.withColumns({"b1": (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det, "b2": (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det, "det": det})
    left = F.greatest(F.col("syy") - F.col("b1") * F.col("s1y") - F.col("b2") * F.col("s2y"), F.lit(0.0)) / F.when(F.col("n") > 3, F.col("n") - 3)
    one = lambda name, b, s: F.struct(F.lit(name).alias("term"), F.col(b).alias("beta"), F.sqrt(left * F.col(s) / F.col("det")).alias("se"))
    each = g.select(F.explode(F.array(one(x1, "b1", "s22"), one(x2, "b2", "s11"))).alias("e")).select("e.*")
    return each.select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round(F.col("beta") / F.nullif(F.col("se"), F.lit(0.0)), 6).alias("t"))


def copies_skill(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, r2): 1 less the squared leave-one-out errors of the plane on x1 and x2 over those of the mean, for rows of weight w and outcome y.

    All w copies of a row are left out together. A sample with collinear predictors has no row; keys name samples, so none is large.
    """
    w, own = F.col("w"), W.partitionBy(*keys)
    total = F.sum(w).over(own)
    r = rows.withColumns({d: F.col(x) - F.sum(w * F.col(x)).over(own) / total for d, x in (("d1", "x1"), ("d2", "x2"), ("dy", "y"))} | {"sw": total})
    r = r.withColumns({f"s{a}{b}": F.sum(w * F.col(f"d{a}") * F.col(f"d{b}")).over(own) for a, b in ("11", "22", "12", "1y", "2y")})
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    r = r.withColumn("det", det).where(F.col("det") > 1e-9 * F.col("s11") * F.col("s22"))
    fit = (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / F.col("det") * F.col("d1") + (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / F.col("det") * F.col("d2")
    reach = 1 / F.col("sw") + (F.col("d1") * F.col("d1") * F.col("s22") - 2 * F.col("d1") * F.col("d2") * F.col("s12") + F.col("d2") * F.col("d2") * F.col("s11")) / F.col("det")
    e, base = (F.col("dy") - fit) / F.nullif(1 - w * reach, F.lit(0.0)), F.col("dy") / F.nullif(1 - w / F.col("sw"), F.lit(0.0))
    return r.groupBy(*keys).agg(F.round(1 - F.sum(w * e * e) / F.nullif(F.sum(w * base * base), F.lit(0.0)), 9).alias("r2"))


def permuted_skill(units: DataFrame, key: str, y: str, x1: str, x2: str, n: int = 2000, seed: int = 1) -> DataFrame:
    """(r2, p): held-out skill of a table of units and the share of permutations of the outcome that reach it."""
    ids = units.select(F.col(key).alias("id"))
    moves = resampling.permutations(ids, n, seed).unionByName(ids.select(F.lit(0).cast("long").alias("rep"), "id", F.col("id").alias("to")))
    rows = moves.join(units.select(F.col(key).alias("id"), F.col(x1).alias("x1"), F.col(x2).alias("x2")), "id").join(units.select(F.col(key).alias("to"), F.col(y).alias("y")), "to")
    r = copies_skill(rows.withColumn("w", F.lit(1.0)), "rep")
    own = r.where("rep = 0").select(F.col("r2").alias("own"))
    return r.crossJoin(F.broadcast(own)).agg(F.round(F.max("own"), 6).alias("r2"), F.round((F.sum(((F.col("rep") > 0) & (F.col("r2") >= F.col("own"))).cast("long")) + 1) / (n + 1.0), 6).alias("p"))


def paired_skill(units: DataFrame, key: str, a: str, b: str, x1: str, x2: str, n: int = 2000, seed: int = 1) -> DataFrame:
    """(what, lo, hi, draws): 95 % intervals of the skill for two outcomes and of their difference (a - b), over the same samples of units."""
    draws = resampling.multiplicities(units.select(F.col(key).alias("id")), n, seed)
    both = units.select(F.col(key).alias("cluster"), F.col(x1).alias("x1"), F.col(x2).alias("x2"), F.explode(F.create_map(F.lit("a"), F.col(a), F.lit("b"), F.col(b))).alias("of", "y"))
    r = copies_skill(draws.join(both, "cluster").withColumn("w", F.col("mult").cast("double")), "rep", "of")
    pair = r.groupBy("rep").agg(F.max(F.when(F.col("of") == "a", F.col("r2"))).alias("a"), F.max(F.when(F.col("of") == "b", F.col("r2"))).alias("b"))
    long = pair.withColumn("a-b", F.col("a") - F.col("b")).unpivot(["rep"], ["a", "b", "a-b"], "what", "r2")
    return long.groupBy("what").agg(F.round(F.percentile("r2", F.lit(0.025)), 5).alias("lo"), F.round(F.percentile("r2", F.lit(0.975)), 5).alias("hi"), F.count("r2").alias("draws"))


def held_out_skill_of(units: DataFrame, key: str, y: str, xs: list[str], n: int = 5000, seed: int = 1) -> DataFrame:
    """(r2, p, units): leave-one-out skill of a least-squares plane on any number of predictors, and the share of permutations of the outcome that reach it.

    Predictors are standardised. Their normal equations are sums of one pass; a unit's leverage and a permutation's slopes are
    solved from these in expressions, so a permutation costs its sums, of one pass, and no fit: with slopes b, the squared left-out errors are
    sum(y^2 / l^2) - 2 b sum(z y / l^2) + b sum(z z / l^2) b, l being one less the leverage and y centred. Units with a null anywhere are left out; collinear predictors give nulls.
    """
    m = len(xs) + 1
    some = units.where(F.col(y).isNotNull())
    for x in xs:
        some = some.where(F.col(x).isNotNull())
    spread = some.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg(y).alias("my"), F.count(F.lit(1)).alias("units"))
    z = some.crossJoin(F.broadcast(spread)).select(F.col(key).alias("id"), F.col(y).cast("double").alias("y"), "my", "units", F.lit(1.0).alias("z0"), *[((F.col(x) - F.col(f"m{i}")) / F.nullif(F.col(f"s{i}"), F.lit(0.0))).alias(f"z{i + 1}") for i, x in enumerate(xs)])
    square = z.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)])
    reach = linear.solved(z.crossJoin(F.broadcast(square)).withColumns({f"b{i}": F.col(f"z{i}") for i in range(m)}), m)
    left = reach.select("id", "y", "my", "units", *[f"z{i}" for i in range(m)], (1 - sum(F.col(f"z{i}") * F.col(f"xb{i}") for i in range(m))).alias("left"))
    left = left.select("id", *[f"z{i}" for i in range(m)], (1 / F.nullif(F.col("left") * F.col("left"), F.lit(0.0))).alias("w"), (F.col("y") - F.col("my")).alias("y"), "units").persist()  # a row a unit, broadcast to permutations
    ids, own = left.select("id"), [F.col(f"z{i}") for i in range(m)]
    sums = [F.sum(zi * F.col("y")).alias(f"b{i}") for i, zi in enumerate(own)] + [F.sum(zi * F.col("y") * F.col("w")).alias(f"c{i}") for i, zi in enumerate(own)] + [F.sum(F.col("y") * F.col("y") * F.col("w")).alias("yy")]
    moved = resampling.permutations(ids, n, seed).join(F.broadcast(left.drop("y", "units")), "id").join(F.broadcast(left.select(F.col("id").alias("to"), "y")), "to")
    reps = moved.groupBy("rep").agg(*sums).unionByName(left.agg(*sums).select(F.lit(0).cast("long").alias("rep"), "*"))
    base = F.col("y") * F.col("units") / F.nullif(F.col("units") - 1, F.lit(0))
    whole = left.agg(F.sum(base * base).alias("base"), F.count(F.lit(1)).alias("units"), *[F.sum(own[i] * own[j] * F.col("w")).alias(f"d{i}_{j}") for i in range(m) for j in range(i, m)])
    fits = linear.solved(reps.crossJoin(F.broadcast(square)), m).crossJoin(F.broadcast(whole))
    cross = sum(F.col(f"xb{i}") * F.col(f"c{i}") for i in range(m))
    fitted = sum((1 if i == j else 2) * F.col(f"xb{i}") * F.col(f"xb{j}") * F.col(f"d{i}_{j}") for i in range(m) for j in range(i, m))
    r = fits.select("rep", "units", F.round(1 - (F.col("yy") - 2 * cross + fitted) / F.nullif(F.col("base"), F.lit(0.0)), 9).alias("r2"))
    first = F.max(F.when(F.col("rep") == 0, F.col("r2"))).over(W.partitionBy())  # a row a permutation
    r = r.withColumn("own", first)
    return r.agg(F.round(F.max("own"), 6).alias("r2"), F.round((F.sum(((F.col("rep") > 0) & (F.col("r2") >= F.col("own"))).cast("long")) + 1) / (n + 1.0), 6).alias("p"), F.max("units").alias("units"))


def permuted_rank_correlations(units: DataFrame, key: str, y: str, xs: list[str], n: int = 5000, seed: int = 1) -> DataFrame:
    """(feature, rho, p): Spearman's correlation of each feature with the outcome and its two-sided p by permutations, the same ones for all features."""
    u = units.select(F.col(key).alias("id"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)])
    for i in range(len(xs)):  # centred ranks among the units that have both, 0 for others; sums of these are exact
        has = F.col(f"x{i}").isNotNull() & F.col("y").isNotNull()
        middle = (F.sum(has.cast("long")).over(W.partitionBy()) + 1) / 2
        u = u.withColumn(f"m{i}", has.cast("double")).withColumns({f"{s}{i}": F.when(has, average_rank(v, f"m{i}") - middle).otherwise(0.0) for s, v in (("p", F.col(f"x{i}")), ("q", F.col("y")))})
    u = u.drop("y", *[f"x{i}" for i in range(len(xs))]).persist()  # a row a unit, broadcast to permutations
    a, b = (u.select(F.col("id").alias(k), *[F.col(f"{s}{i}").alias(f"{s}{i}{k}") for s in ("m", r) for i in range(len(xs))]) for k, r in (("id", "p"), ("to", "q")))
    ids = u.select("id")
    zero = ids.select(F.lit(0).cast("long").alias("rep"), "id", F.col("id").alias("to"))
    met = lambda moves: moves.join(F.broadcast(a), "id").join(F.broadcast(b), "to").groupBy("rep").agg(*[F.sum(e).alias(f"{s}{i}") for i in range(len(xs)) for s, e in _products(i).items()])
    sums = met(resampling.permutations(ids, n, seed)).unionByName(met(zero))
    each = sums.select("rep", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), *[F.col(f"{s}{i}").alias(s) for s in _products(i)]) for i, x in enumerate(xs)])).alias("f")).select("rep", "f.*").where("n > 0")
    spread = lambda s: F.sqrt(F.greatest(F.col(s + s) / F.col("n") - F.pow(F.col(s) / F.col("n"), 2), F.lit(0.0)))
    r = each.select("feature", "rep", F.round(F.try_divide(F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n"), F.nullif(spread("x") * spread("y"), F.lit(0.0))), 9).alias("r"))
    own = r.where("rep = 0").select("feature", F.col("r").alias("own"))
    out = r.join(own, "feature").groupBy("feature").agg(F.max("own").alias("rho"), F.sum(((F.col("rep") > 0) & (F.abs("r") >= F.abs("own"))).cast("long")).alias("k"))
    return out.select("feature", F.round("rho", 6).alias("rho"), F.round((F.col("k") + 1) / (n + 1.0), 6).alias("p"))


def _products(i: int) -> dict[str, Column]:
    """What the correlation of feature i sums over moved units: those that have it at both ends."""
    here, there, x, y = F.col(f"m{i}id"), F.col(f"m{i}to"), F.col(f"p{i}id"), F.col(f"q{i}to")
    return {"n": here * there, "x": x * there, "y": here * y, "xx": x * x * there, "yy": here * y * y, "xy": x * y}


def rank_correlation_test(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p) of Spearman's correlation by Student's distribution; p is 0 at +-1 and null below three rows."""
    r, n = F.col("rho"), F.col("n")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    p = F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(student_p(t, n - 2))
    return resampling.spearman(rows, x, y).select("rho", "n", F.round(p, 6).alias("p"))


def rank_sum_test(rows: DataFrame, x: str, first: Column) -> DataFrame:
    """(u, n1, n2, p) of Mann and Whitney by the normal law, corrected for ties and continuity; null where a side is empty or all are tied."""
    r = rows.where(F.col(x).isNotNull()).withColumns({"rank": average_rank(F.col(x)), "one": first, "tied": F.count(F.lit(1)).over(W.partitionBy(x))})
    one = F.sum(F.col("one").cast("long"))
    s = r.agg((F.sum(F.when(F.col("one"), F.col("rank"))) - one * (one + 1) / 2.0).alias("u"), one.alias("n1"), (F.count(F.lit(1)) - one).alias("n2"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    n, both = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    sd = F.sqrt(both / 12.0 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0))))
    z = (F.greatest(F.col("u"), both - F.col("u")) - both / 2.0 - 0.5) / F.nullif(sd, F.lit(0.0))
    return s.select(F.round("u", 6).alias("u"), "n1", "n2", F.round(F.when(z <= 0, 1.0).otherwise(normal_p(z)), 6).alias("p"))


def signed_rank_test(rows: DataFrame, d: str) -> DataFrame:
    """(w_plus, n, p) of Wilcoxon's test of nonzero differences: by all sums of ranks for up to 50 without ties, else by the normal law corrected for ties."""
    r = rows.where(F.col(d) != 0).withColumns({"rank": average_rank(F.abs(d)), "tied": F.count(F.lit(1)).over(W.partitionBy(F.abs(d)))})
    s = r.agg(F.sum(F.when(F.col(d) > 0, F.col("rank")).otherwise(0.0)).alias("w"), F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))
    all_, low = (F.col("n") * (F.col("n") + 1) / 2).cast("int"), F.least(F.col("w"), F.col("n") * (F.col("n") + 1) / 2.0 - F.col("w"))
    places = F.sequence(F.lit(0), all_)
    chances = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.transform(places, lambda i: F.when(i == 0, 1.0).otherwise(0.0)), lambda c, k: F.transform(places, lambda i: (F.get(c, i) + F.when(i >= k, F.get(c, i - k)).otherwise(0.0)) / 2))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.slice(chances, F.lit(1), low.cast("int") + 1), F.lit(0.0), lambda t, c: t + c))
    sd = F.sqrt((F.col("n") * (F.col("n") + 1.0) * (2 * F.col("n") + 1) - F.col("ties") / 2.0) / 24)
    law = normal_p((F.col("n") * (F.col("n") + 1) / 4.0 - low) / F.nullif(sd, F.lit(0.0)))
    return s.select(F.round("w", 6).alias("w_plus"), F.col("n").cast("long").alias("n"), F.round(F.when(F.col("n") == 0, None).when((F.col("n") <= 50) & (F.col("ties") == 0), exact).otherwise(law), 6).alias("p"))
