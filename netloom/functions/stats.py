"""Statistical kernels as Column expressions and DataFrame transforms; nothing here leaves the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Effect of a natural cubic smoothing spline with 3 degrees of freedom over lambda = .05 .. .95, read at .95: fixed values.
SPLINE_WEIGHTS = (
    -0.002493, -0.006528, -0.010535, -0.014437, -0.018072, -0.021165, -0.023300, -0.023890, -0.022166, -0.017175,
    -0.007789, 0.007251, 0.029257, 0.059473, 0.098903, 0.148063, 0.206669, 0.273251, 0.344682,
)
LAMBDAS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, brought back by the product between."""
    x = n.cast("double")
    z = x + 9.0
    s = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return s - F.log(reduce(lambda a, b: a * b, [x + float(i) for i in range(1, 9)]))


def _log_pmf(i: Column, m: Column, k: Column, n: Column) -> Column:
    """ln P(X = i), X hypergeometric: k draws from n of which m count."""
    f = log_factorial
    return f(m) - f(i) - f(m - i) + f(n - m) - f(k - i) - f(n - m - k + i) - f(n) + f(k) + f(n - k)


def _sum_up(i: Column, m: Column, k: Column, n: Column) -> Column:
    """P(X >= i) from the first term and the ratios of neighbours."""
    hi = F.least(m, k)
    zero = F.struct(F.exp(_log_pmf(i, m, k, n)).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, j: F.struct((a["t"] * (m - j) * (k - j) / ((j + 1) * (n - m - k + j + 1))).alias("t"), (a["s"] + a["t"]).alias("s"))
    return F.when(i > hi, 0.0).otherwise(F.aggregate(F.sequence(i, F.greatest(i, hi)), zero, step, lambda a: a["s"]))


def _sum_down(i: Column, m: Column, k: Column, n: Column) -> Column:
    """P(X <= i)."""
    lo = F.greatest(F.lit(0), k + m - n)
    zero = F.struct(F.exp(_log_pmf(i, m, k, n)).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, j: F.struct((a["t"] * j * (n - m - k + j) / ((m - j + 1) * (k - j + 1))).alias("t"), (a["s"] + a["t"]).alias("s"))
    return F.when(i < lo, 0.0).otherwise(F.aggregate(F.sequence(i, F.least(i, lo), F.lit(-1)), zero, step, lambda a: a["s"]))


def hypergeom_upper(x: Column, m: Column, k: Column, n: Column) -> Column:
    """P(X >= x). Sums away from the mean, so no first term underflows that matters; outside the support 0 or 1."""
    x, m, k, n = (c.cast("int") for c in (x, m, k, n))
    lo, hi = F.greatest(F.lit(0), k + m - n), F.least(m, k)
    above = x.cast("double") > m.cast("double") * k / F.greatest(n, F.lit(1))
    return F.when(x <= lo, 1.0).when(x > hi, 0.0).when(above, F.least(F.lit(1.0), _sum_up(x, m, k, n))).otherwise(F.greatest(F.lit(0.0), 1.0 - _sum_down(x - 1, m, k, n)))


def hypergeom_lower(x: Column, m: Column, k: Column, n: Column) -> Column:
    """P(X <= x)."""
    x, m, k, n = (c.cast("int") for c in (x, m, k, n))
    lo, hi = F.greatest(F.lit(0), k + m - n), F.least(m, k)
    above = x.cast("double") >= m.cast("double") * k / F.greatest(n, F.lit(1))
    return F.when(x >= hi, 1.0).when(x < lo, 0.0).when(above, F.greatest(F.lit(0.0), 1.0 - _sum_up(x + 1, m, k, n))).otherwise(F.least(F.lit(1.0), _sum_down(x, m, k, n)))


def storey_pi0(p: Column) -> Column:
    """Aggregate: the proportion of true nulls of a group's p-values, 1 where the estimate isn't usable."""
    m = F.count(p)
    est = reduce(lambda a, b: a + b, [F.lit(w) * F.count_if(p >= lam) / (m * (1 - lam)) for w, lam in zip(SPLINE_WEIGHTS, LAMBDAS)])
    return F.when((est <= 0) | (F.max(p) < 0.95), 1.0).otherwise(F.least(est, F.lit(1.0)))


def q_values(rows: DataFrame, keys: list[str], p: str, q: str) -> DataFrame:
    """``rows`` with Storey-Tibshirani q-values of ``p`` within ``keys``; null p gives null q, a single p is its own q.

    The step-up runs over the distinct values with their counts, which hypergeometric and permutation p-values have few of,
    not over all rows of a group.
    """
    valued = rows.where(F.col(p).isNotNull())
    stats = valued.groupBy(*keys).agg(F.count("*").alias("_m"), storey_pi0(F.col(p)).alias("_pi0"))
    each = valued.groupBy(*keys, p).agg(F.count("*").alias("_c"))
    up = each.withColumn("_r", F.sum("_c").over(W.partitionBy(*keys).orderBy(p).rowsBetween(W.unboundedPreceding, 0))).join(stats, keys)
    down = W.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    step = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)) * F.col("_pi0")
    qs = up.withColumn(q, F.when(F.col("_m") < 2, F.col(p)).otherwise(step)).select(*keys, p, q)
    return rows.join(qs, [*keys, p], "left")


def bc_support(h: int, most: int) -> list[float]:
    """Values up to 1/2 that a Besag-Clifford p-value with h exceedances and at most ``most`` draws can take."""
    values = {(h + 1) / (t + 1) for t in range(h, most + 1)} | {j / (most + 1) for j in range(1, h + 1)}
    return sorted(v for v in values if v <= 0.5)


def liang_pi0(counts: list[tuple[float, int]], support: list[float]) -> float:
    """Null proportion of discrete p-values by the right-boundary rule: the estimate at the first support point where it stops falling.

    At a support point s the estimate is #{p > s} / ((1 - s) m), as a p-value is at most s with probability s there. The
    points are scanned upwards; the one that ends the fall is taken, the last one if none does.
    """
    m = sum(c for _, c in counts)
    if not m:
        return 1.0
    ordered = sorted(counts)
    above, k, last = m, 0, None
    for s in support:
        while k < len(ordered) and ordered[k][0] <= s + 1e-12:
            above -= ordered[k][1]
            k += 1
        now = above / ((1 - s) * m)
        if last is not None and now >= last:
            return min(1.0, now)
        last = now
    return min(1.0, last if last is not None else 1.0)


def discrete_q_values(rows: DataFrame, keys: list[str], p: str, q: str, support: list[float]) -> DataFrame:
    """Step-up q-values of discrete p-values within ``keys``, the null proportion read off the support.

    A key has at most len(support) + 1 distinct values; keys are species pairs, few. A single p-value is its own q-value.
    """
    counts: dict[tuple, list[tuple[float, int]]] = {}
    for r in rows.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*")).collect():  # as many as p has values
        counts.setdefault(tuple(r[: len(keys)]), []).append((r[-2], r[-1]))
    out = []
    for key, values in counts.items():
        m, pi0, best = sum(c for _, c in values), liang_pi0(values, support), 1.0
        rank = m
        for v, c in sorted(values, reverse=True):
            best = min(best, pi0 * v * m / rank)
            out.append((*key, v, float(v if m < 2 else best)))
            rank -= c
    kinds = dict(rows.dtypes)
    qs = rows.sparkSession.createDataFrame(out, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{p}` double", f"`{q}` double"]))
    return rows.join(F.broadcast(qs), [*keys, p], "left")  # bounded by the support


def average_rank(order: Column, by: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean, ascending."""
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count("*").over(W.partitionBy(*by, order)) - 1) / 2


def sequential_p(flags: DataFrame, keys: list[str], perm: str, exceed: str, h: int) -> DataFrame:
    """Besag-Clifford stopping over numbered draws: n_perm, n_exceed, p = (n_exceed + 1) / (n_perm + 1) for each key."""
    run = flags.withColumn("_cum", F.sum(F.col(exceed).cast("int")).over(W.partitionBy(*keys).orderBy(perm).rowsBetween(W.unboundedPreceding, 0)))
    g = run.groupBy(*keys).agg(F.min(F.when(F.col("_cum") >= h, F.col(perm))).alias("_stop"), F.max(perm).alias("_all"), F.max("_cum").alias("_e"))
    n, e = F.coalesce("_stop", "_all"), F.least(F.col("_e"), F.lit(h))
    return g.select(*keys, n.cast("int").alias("n_perm"), e.cast("int").alias("n_exceed"), ((e + 1) / (n + 1)).alias("p_value"))


def adjusted_rand(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings (columns a, b of one row per item) for each key; 1 if both are trivial."""
    c2 = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(c2(F.col("n"))).alias("sij"), F.sum("n").alias("n"))
    one = lambda c, s: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(c2(F.col("n"))).alias(s))
    ja, jb = one(a, "sa"), one(b, "sb")
    if keys:
        t = both.join(ja, keys).join(jb, keys)
    else:
        t = both.withColumn("_k", F.lit(1)).join(ja.withColumn("_k", F.lit(1)), "_k").join(jb.withColumn("_k", F.lit(1)), "_k").drop("_k")
    e = F.col("sa") * F.col("sb") / c2(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - e
    return t.select(*keys, F.when((F.col("n") < 2) | (top == 0), 1.0).otherwise((F.col("sij") - e) / top).alias("ari"))
