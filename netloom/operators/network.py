"""From correlations to networks: mutual rank, context likelihood (CLR), density threshold, adjacency."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stats import average_rank
from ..sources.expression import Expression
from ..sources.tables import cut
from .similarity import DECIMALS, correlations, row_ranks, standard_rows, variance_filter


def both_ways(pairs: DataFrame, weight: str) -> DataFrame:
    """(species, g, nb, w): every pair in both directions, in one pass."""
    d = F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("j").alias("nb")), F.struct(F.col("j").alias("g"), F.col("i").alias("nb"))))
    return pairs.select("species", d.alias("p"), F.col(weight).alias("w")).select("species", "p.g", "p.nb", "w")


def _with_self(pairs: DataFrame, weight: str) -> DataFrame:
    """Both directions and the diagonal (weight 1): one more row per gene."""
    two = both_ways(pairs, weight)
    genes = two.select("species", "g").distinct()
    return two.unionByName(genes.select("species", "g", F.col("g").alias("nb"), F.lit(1.0).alias("w")))


def mutual_rank(pairs: DataFrame, log_transform: bool = False) -> DataFrame:
    """(species, i, j, w): sqrt(R_ij R_ji), R the average-tie rank within a gene's row including itself.

    Raw: ascending ranks, 1..n, larger is stronger. Log: descending ranks, 1 - ln(MR)/ln(n) clipped to [0, 1]. The two
    ranks of a pair meet in one aggregation by the unordered pair, not in a self-join.
    """
    rows = _with_self(pairs, "r")
    ranked = rows.withColumn("v", -F.col("w") if log_transform else F.col("w")).withColumn("k", average_rank(F.col("v"), ["species", "g"]))
    lo, hi = F.least("g", "nb"), F.greatest("g", "nb")
    met = ranked.where("g <> nb").groupBy("species", lo.alias("i"), hi.alias("j")).agg(F.max(F.when(F.col("g") < F.col("nb"), F.col("k"))).alias("a"), F.max(F.when(F.col("g") > F.col("nb"), F.col("k"))).alias("b"))
    mr = F.sqrt(F.col("a") * F.col("b"))
    if not log_transform:
        return met.select("species", "i", "j", mr.alias("w"))
    n = rows.select("species", "g").distinct().groupBy("species").agg(F.count("*").alias("n"))
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.log(mr) / F.log(F.col("n").cast("double"))))
    return met.join(n, "species").select("species", "i", "j", w.alias("w"))


def clr(pairs: DataFrame) -> DataFrame:
    """(species, i, j, w): hypot of the two positive z-scores of a correlation within its genes' rows (incl. themselves)."""
    s = _with_self(pairs, "r").groupBy("species", "g").agg(F.avg("w").alias("mu"), F.stddev_samp("w").alias("sd"))
    s = s.withColumn("sd", F.when(F.col("sd") < 1e-10, 1.0).otherwise(F.col("sd")))
    side = lambda c, x: s.select("species", F.col("g").alias(c), F.col("mu").alias(f"mu{x}"), F.col("sd").alias(f"sd{x}"))
    z = lambda x: F.greatest(F.lit(0.0), (F.col("r") - F.col(f"mu{x}")) / F.col(f"sd{x}"))
    return pairs.join(side("i", "1"), ["species", "i"]).join(side("j", "2"), ["species", "j"]).select("species", "i", "j", F.hypot(z("1"), z("2")).alias("w"))


#: Bins that locate a density threshold.
BINS = 8192


def density_threshold(weights: DataFrame, density: float = 0.03) -> DataFrame:
    """(species, threshold, n_pairs): the k-th largest weight of each species, k = round(density N) within [1, N - 1].

    Exact without sorting a species: weights are counted in BINS equal bins between a species' least and greatest weight,
    the bin that holds the k-th is found from the counts, and only that bin's distinct values are ranked.
    """
    if not 0 < density < 1:
        raise ValueError("density must be between 0 and 1")
    ends = weights.groupBy("species").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.count("*").alias("n"))
    ends = ends.withColumn("k", F.greatest(F.lit(1), F.least(F.round(F.lit(density) * F.col("n")).cast("long"), F.col("n") - 1)))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).otherwise(0).cast("int")
    binned = weights.join(F.broadcast(ends), "species").withColumn("bin", place)  # one row per species
    counts = binned.groupBy("species", "bin").agg(F.count("*").alias("c"), F.first("k").alias("k"), F.first("n").alias("n"))
    down = W.partitionBy("species").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # at most BINS + 1 rows a species
    hit = counts.withColumn("upto", F.sum("c").over(down)).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("species", "bin", (F.col("k") - F.col("upto") + F.col("c")).alias("rest"), F.col("n").alias("n_pairs"))
    inside = binned.drop("k", "n").join(F.broadcast(hit), ["species", "bin"]).groupBy("species", "w", "rest", "n_pairs").agg(F.count("*").alias("c"))
    ranked = inside.withColumn("upto", F.sum("c").over(W.partitionBy("species").orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where(F.col("upto") >= F.col("rest")).groupBy("species").agg(F.max("w").alias("threshold"), F.first("n_pairs").alias("n_pairs"))


def adjacency(weights: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(species, g, nb, w): neighbours at or above the threshold, both directions, self excluded."""
    kept = weights.join(F.broadcast(thresholds.select("species", "threshold")), "species").where(F.col("w") >= F.col("threshold"))
    return both_ways(kept, "w")


#: Species of up to this many genes are normalised as one matrix in one task (about 0.5 GB); larger ones in blocks and windows.
LOCAL_GENES = 4096


def _matrix_weights(cor_method: str, norm_method: str, absolute: bool, log_transform: bool):
    """Arrow function: the weights i < j of one species from its profiles."""

    def run(t: pa.Table) -> pa.Table:
        genes = np.array(t["gene"].to_pylist(), dtype=object)
        order = np.argsort(genes)
        genes, z = genes[order], standard_rows(np.array(t["values"].to_pylist(), dtype=np.float64)[order], cor_method)
        r = np.round(np.clip(z @ z.T, -1, 1), DECIMALS) + 0.0
        if absolute:
            r = np.abs(r)
        np.fill_diagonal(r, 1.0)
        n = len(genes)
        if norm_method == "MR":
            k = row_ranks(-r if log_transform else r)
            w = np.sqrt(k * k.T)
            if log_transform:
                w = np.clip(1 - np.log(w) / np.log(n), 0, 1)
        else:
            sd = r.std(axis=1, ddof=1, keepdims=True)
            zs = np.maximum(0, (r - r.mean(axis=1, keepdims=True)) / np.where(sd < 1e-10, 1.0, sd))
            w = np.hypot(zs, zs.T)
        a, b = np.triu_indices(n, 1)
        names = pa.array(genes, pa.string())
        sp = pa.array([t["species"][0].as_py()] * len(a), pa.string())
        return pa.Table.from_arrays([sp, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(w[a, b])], ["species", "i", "j", "w"])

    return run


def network_weights(profiles: DataFrame, sizes: dict[str, int], cor_method: str, norm_method: str, absolute: bool, log_transform: bool, local_genes: int = LOCAL_GENES) -> DataFrame:
    """(species, i, j, w) of all species, by the way their size asks for; both ways give the same weights."""
    large = [s for s, n in sizes.items() if n > local_genes]
    small = profiles.where(~F.col("species").isin(large)) if large else profiles
    # a number of partitions of its own: else the few input rows are coalesced and one task computes all species
    tasks = max(1, len(sizes) - len(large))
    out = small.repartition(tasks, "species").groupBy("species").applyInArrow(_matrix_weights(cor_method, norm_method, absolute, log_transform), "species string, i string, j string, w double")
    out = out.repartition(max(profiles.sparkSession.sparkContext.defaultParallelism, sum(n * n for s, n in sizes.items() if s not in large) // 4_000_000), "species", "i")
    if large:
        r = correlations(profiles.where(F.col("species").isin(large)), cor_method, absolute)
        out = out.unionByName(mutual_rank(r, log_transform) if norm_method == "MR" else clr(r))
    return out


@dataclass
class Networks:
    """Networks of one or more species: all weights i < j (not thresholded), thresholds, and gene counts."""

    weights: DataFrame
    thresholds: DataFrame
    genes: DataFrame
    params: dict

    def neighbours(self, multiplier: float = 1.0) -> DataFrame:
        """Adjacency, the thresholds scaled by ``multiplier``."""
        t = self.thresholds if multiplier == 1.0 else self.thresholds.withColumn("threshold", F.col("threshold") * multiplier)
        return adjacency(self.weights, t)

    def sizes(self) -> DataFrame:
        """(species, n_genes)."""
        return self.genes.groupBy("species").agg(F.count("*").alias("n_genes"))


def compute_network(profiles: DataFrame | Expression, cor_method: str = "pearson", norm_method: str = "MR", density: float = 0.03, abs_cor: bool = False, mr_log_transform: bool = False, min_var: float | None = 0.0, local_genes: int = LOCAL_GENES) -> Networks:
    """Networks of all species in ``profiles`` (species, gene, values), or of an Expression's profiles.

    Raises ValueError for a density outside (0, 1), an unknown method, null gene names, or a species with fewer than
    three genes after the variance filter.
    """
    if not 0 < density < 1:
        raise ValueError("density must be between 0 and 1")
    if norm_method not in ("MR", "CLR"):
        raise ValueError("norm_method must be MR or CLR")
    p = getattr(profiles, "profiles", profiles).select("species", "gene", "values")
    kept = cut(variance_filter(p, min_var))
    named = p.groupBy("species").agg(F.count_if(F.col("gene").isNull()).alias("bad"))
    found = named.join(kept.groupBy("species").agg(F.count("*").alias("n")), "species", "left").fillna(0, ["n"]).collect()  # one row per species
    for r in found:
        if r["bad"] or r["n"] < 3:
            raise ValueError(f"species {r['species']}: needs named genes and at least three with variance above {min_var}")
    w = cut(network_weights(kept, {r["species"]: r["n"] for r in found}, cor_method, norm_method, abs_cor, mr_log_transform, local_genes))  # read by every later step
    return Networks(w, cut(density_threshold(w, density)), kept.select("species", "gene"), {"cor_method": cor_method, "norm_method": norm_method, "density": density})
