"""Modules: detection, consensus, comparison across species, hubs.

Membership is (species, gene, module). Detection is iterative on one graph, so it runs as one Arrow task per species and
resolution; all that compares or counts memberships is DataFrame work.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stats import adjusted_rand as ari, bc_support, discrete_q_values, hypergeom_upper, q_values
from ..sources.tables import cut, spread
from . import graph_kernels as G
from .network import Networks
from .permutation import batches

PAIR = ["sp1", "sp2"]


def thresholded(nets: Networks) -> DataFrame:
    """(species, i, j, w) edges at or above the threshold."""
    return nets.weights.join(F.broadcast(nets.thresholds.select("species", "threshold")), "species").where(F.col("w") >= F.col("threshold")).select("species", "i", "j", "w")


def _with_nodes(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges and one row per gene (j null), so isolated genes stay nodes of the graph."""
    return edges.select("species", "i", "j", "w").unionByName(genes.select("species", F.col("gene").alias("i"), F.lit(None).cast("string").alias("j"), F.lit(0.0).alias("w")))


def _graph(pdf: pd.DataFrame):
    """(names, i, j, w) of a species' rows, independent of their order."""
    names = np.array(sorted(set(pdf["i"]) | set(pdf["j"].dropna())), dtype=object)
    e = pdf[pdf["j"].notna()].sort_values(["i", "j"])
    at = {g: k for k, g in enumerate(names)}
    return names, e["i"].map(at).to_numpy(dtype=np.int64), e["j"].map(at).to_numpy(dtype=np.int64), e["w"].to_numpy(dtype=float)


MEMBER = "species string, resolution double, gene string, module int"


def partitions(nets: Networks, method: str = "leiden", resolutions: list[float] = (1.0,), objective: str = "CPM", n_iterations: int = 2, trials: int = 10, seed: int = 1) -> DataFrame:
    """(species, resolution, gene, module) by leiden, infomap or sbm, each resolution on its own; modules are numbered from 1, isolated genes alone.

    Raises ValueError for an unknown method or a species without edges.
    """
    if method not in ("leiden", "infomap", "sbm"):
        raise ValueError("method must be leiden, infomap or sbm")
    edges = cut(thresholded(nets))
    none = nets.thresholds.join(edges, "species", "left_anti").limit(1).collect()
    if none:
        raise ValueError(f"no edges in {none[0]['species']}")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, i, j, w = _graph(pdf)
        n = len(names)
        if method == "leiden":
            com = G.leiden(n, i, j, w, key[1], objective, n_iterations, seed)
        elif method == "infomap":
            com = G.infomap(n, i, j, w, trials, seed)
        else:
            com = G.gaussian_sbm(n, i, j, w, seed=seed)
        return pd.DataFrame({"species": key[0], "resolution": key[1], "gene": names, "module": com + 1})

    rows = _with_nodes(edges, nets.genes).withColumn("resolution", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])))
    return spread(rows, "species", "resolution").groupBy("species", "resolution").applyInPandas(run, MEMBER)


class Detection(NamedTuple):
    """What module detection found.

    modules: species, gene, module. summary: species, n_modules, modularity (unweighted, on the species' graph). scan (several
    resolutions): species, resolution, n_modules, ari_next. structure: the test for a single community; None where it wasn't run.
    """

    modules: DataFrame
    summary: DataFrame
    scan: DataFrame | None = None
    structure: DataFrame | None = None


def detect_modules(
    nets: Networks, method: str = "leiden", resolutions: list[float] | float = 1.0, objective: str = "CPM", n_iterations: int = 2, trials: int = 10, seed: int = 1,
    threshold: float | None = None, max_iter: int = 10, test_k1: bool = True, n_perm: int = 100, alpha: float = 0.05,
) -> Detection:
    """Modules of every species: one partition at one resolution, or the consensus over several.

    Several resolutions need leiden and go through :func:`structure_test` (``test_k1``, unless ``threshold`` is fixed) and
    :func:`consensus_modules`; the consensus is by modularity, whatever ``objective`` says of a single resolution.
    """
    rs = sorted({float(r) for r in ([resolutions] if isinstance(resolutions, (int, float)) else resolutions)})
    scan = structure = None
    if len(rs) > 1:
        if method != "leiden":
            raise ValueError("several resolutions need method leiden")
        if test_k1 and threshold is None:
            structure = cut(structure_test(nets, rs, n_perm, alpha, seed))
        m = cut(consensus_modules(nets, rs, threshold, max_iter, n_iterations, seed, structure is not None, n_perm, alpha, structure).select("species", "gene", "module"))
        scan = resolution_scan(cut(partitions(nets, "leiden", rs, "modularity", n_iterations, trials, seed)))
    else:
        m = cut(partitions(nets, method, rs, objective, n_iterations, trials, seed).select("species", "gene", "module"))
    q = modularity(m.withColumn("resolution", F.lit(rs[0])), thresholded(nets)).select("species", "modularity")
    return Detection(m, m.groupBy("species").agg(F.countDistinct("module").alias("n_modules")).join(q, "species", "left"), scan, structure)


def structure_test(nets: Networks, resolutions: list[float], n_perm: int = 100, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(species, observed, n_done, n_exceed, p_value): is there more than one community?

    The statistic is the spectral norm of the excess co-classification over resolutions; the null rewires the graph
    (degrees kept, weights shuffled). Replicates are a grouping key, run in batches of ceil(1 / alpha); a species stops after a batch
    if no replicate exceeded or p > alpha.
    """
    resolutions = [float(r) for r in resolutions]

    def stat(n, i, j, w, rep):
        members = [G.leiden(n, i, j, w, r, "modularity", 1, seed + rep) for r in resolutions]
        return G.spectral_norm(n, i, j, G.coclassification(n, i, j, members)[0])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, i, j, w = _graph(pdf)
        rep = key[1]
        if rep:
            i, j, w = G.rewire(len(names), i, j, w, 5 * len(i), seed + rep)
        return pd.DataFrame({"species": [key[0]], "rep": [rep], "stat": [stat(len(names), i, j, w, rep)]})

    rows = cut(_with_nodes(thresholded(nets), nets.genes))
    step = math.ceil(1 / alpha)
    go, all_stats, at = rows, None, 0
    while at < n_perm:
        reps = list(range(0 if at == 0 else at + 1, min(n_perm, at + step) + 1))
        s = cut(spread(go.withColumn("rep", F.explode(F.array(*map(F.lit, reps)))), "species", "rep").groupBy("species", "rep").applyInPandas(run, "species string, rep int, stat double"))
        all_stats = s if all_stats is None else all_stats.unionByName(s)
        at = min(n_perm, at + step)
        obs = all_stats.where("rep = 0").select("species", F.col("stat").alias("observed"))
        t = all_stats.where("rep > 0").join(obs, "species").groupBy("species", "observed").agg(F.count("*").cast("int").alias("n_done"), F.count_if(F.col("stat") >= F.col("observed")).cast("int").alias("n_exceed"))
        t = t.withColumn("p_value", (F.col("n_exceed") + 1) / (F.col("n_done") + 1))
        more = t.where((F.col("n_exceed") > 0) & (F.col("p_value") <= alpha)).select("species")
        if more.isEmpty():
            break
        go = rows.join(more, "species", "left_semi")
    return t


def coclassification(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(species, i, j, observed, expected, excess) per edge, over the resolutions of ``members``.

    observed is the share of resolutions with both ends in one module; a module of size s adds (s/N)^2 to expected where
    both are in it; excess is their difference, at least 0.
    """
    size = members.groupBy("species", "resolution", "module").agg(F.count("*").alias("s"))
    n = members.groupBy("species", "resolution").agg(F.count("*").alias("n"))
    m = members.join(size, ["species", "resolution", "module"]).join(n, ["species", "resolution"]).withColumn("f", F.pow(F.col("s") / F.col("n"), F.lit(2.0)))
    a = m.select("species", "resolution", F.col("gene").alias("i"), F.col("module").alias("ma"), "f")
    b = m.select("species", "resolution", F.col("gene").alias("j"), F.col("module").alias("mb"))
    same = F.when(F.col("ma") == F.col("mb"), 1.0).otherwise(0.0)
    t = edges.select("species", "i", "j").join(a, ["species", "i"]).join(b, ["species", "resolution", "j"]).groupBy("species", "i", "j").agg(F.avg(same).alias("observed"), F.avg(same * F.col("f")).alias("expected"))
    return t.withColumn("excess", F.greatest(F.col("observed") - F.col("expected"), F.lit(0.0)))


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(species, resolution, modularity), unweighted: sum over modules of L/m - (d/2m)^2."""
    a = members.select("species", "resolution", F.col("gene").alias("i"), F.col("module").alias("ma"))
    b = members.select("species", "resolution", F.col("gene").alias("j"), F.col("module").alias("mb"))
    e = edges.select("species", "i", "j").join(a, ["species", "i"]).join(b, ["species", "resolution", "j"])
    side = F.explode(F.array(F.struct(F.col("ma").alias("c"), F.when(F.col("ma") == F.col("mb"), 1).otherwise(0).alias("l")), F.struct(F.col("mb").alias("c"), F.lit(0).alias("l"))))
    c = e.select("species", "resolution", side.alias("x")).groupBy("species", "resolution", "x.c").agg(F.count("*").alias("d"), F.sum("x.l").alias("l"))
    m = e.groupBy("species", "resolution").agg(F.count("*").alias("m"))
    return c.join(m, ["species", "resolution"]).groupBy("species", "resolution").agg(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def resolution_scan(members: DataFrame) -> DataFrame:
    """(species, resolution, n_modules, ari_next): agreement of each resolution's partition with the next one's."""
    r = members.select("species", "resolution").distinct().withColumn("next", F.lead("resolution").over(W.partitionBy("species").orderBy("resolution")))
    b = members.select("species", F.col("resolution").alias("next"), "gene", F.col("module").alias("b"))
    joined = members.join(r.dropna(), ["species", "resolution"]).join(b, ["species", "next", "gene"])
    n = members.groupBy("species", "resolution").agg(F.countDistinct("module").alias("n_modules"))
    return n.join(ari(joined, ["species", "resolution"], "module", "b").withColumnRenamed("ari", "ari_next"), ["species", "resolution"], "left")


def consensus_modules(nets: Networks, resolutions: list[float], threshold: float | None = None, max_iter: int = 10, n_iterations: int = 2, seed: int = 1, test_k1: bool = True, n_perm: int = 100, alpha: float = 0.05, tested: DataFrame | None = None) -> DataFrame:
    """(species, gene, module, iterations): consensus over resolutions, one task per species.

    Leiden (modularity) at each resolution; edges weighted by positive excess co-classification form the next graph, until neighbouring
    resolutions agree (ARI > 0.999) or max_iter; a fixed threshold makes one pass over edges with observed >= threshold. The partition with the best modularity on
    the original graph is kept, the first among equals; without excess the initial partitions stand. Without a threshold, ``test_k1`` runs
    structure_test first (``tested``: its result, where it is known): a species with p >= alpha is one module (iterations 0).
    """
    if threshold is not None and not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    rs = sorted(float(r) for r in resolutions)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, i, j, w = _graph(pdf)
        n, it = len(names), 0
        parts = [G.leiden(n, i, j, w, r, "modularity", n_iterations, seed) for r in rs]
        while it < (1 if threshold else max_iter):
            if not threshold and all(G.adjusted_rand(a, b) > 0.999 for a, b in zip(parts, parts[1:])):
                break
            excess, seen, _ = G.coclassification(n, i, j, parts)
            x = np.where(seen >= threshold, seen, 0) if threshold else excess
            keep = x > 0
            if not keep.any():
                break
            it += 1
            parts = [G.leiden(n, i[keep], j[keep], x[keep], r, "modularity", n_iterations, seed) for r in rs]
        best = max(range(len(rs)), key=lambda k: (round(G.modularity(n, i, j, parts[k]), 12), -k))
        return pd.DataFrame({"species": key[0], "gene": names, "module": parts[best] + 1, "iterations": it})

    rows = _with_nodes(thresholded(nets), nets.genes)
    schema = "species string, gene string, module int, iterations int"
    if threshold is not None or not test_k1:
        return rows.groupBy("species").applyInPandas(run, schema)
    tested = structure_test(nets, rs, n_perm, alpha, seed) if tested is None else tested
    one = cut(tested.where(F.col("p_value") >= alpha).select("species"))
    whole = nets.genes.join(one, "species", "left_semi").select("species", "gene", F.lit(1).alias("module"), F.lit(0).alias("iterations"))
    return rows.join(one, "species", "left_anti").groupBy("species").applyInPandas(run, schema).unionByName(whole)


def module_pairs(members: DataFrame, orthologs: DataFrame) -> DataFrame:
    """All module pairs of each species pair: overlap, size1 (mapped genes of module 1), size2 (mappable genes of module 2), universe.

    Orthologs are restricted to genes in both memberships and de-duplicated; module 1 is mapped to species 2 and de-duplicated;
    pairs without overlap are there with overlap 0.
    """
    o = mapped_rows(members, orthologs)
    universe = o.groupBy(*PAIR).agg(F.countDistinct("gene2").alias("universe"))
    m1 = o.select(*PAIR, "module1", "gene2").distinct()
    s1 = m1.groupBy(*PAIR, "module1").agg(F.count("*").alias("size1"))
    m2 = o.select(*PAIR, "gene2", "module2").distinct()
    s2 = m2.groupBy(*PAIR, "module2").agg(F.count("*").alias("size2"))
    all1 = _module_list(o, members, "sp1", "module1")
    all2 = _module_list(o, members, "sp2", "module2")
    ov = m1.join(m2, [*PAIR, "gene2"]).groupBy(*PAIR, "module1", "module2").agg(F.count("*").alias("overlap"))
    # modules of the two sides meet on the species pair: the result's own size
    t = all1.join(all2, PAIR).join(s1, [*PAIR, "module1"], "left").join(s2, [*PAIR, "module2"], "left").join(ov, [*PAIR, "module1", "module2"], "left").join(universe, PAIR)
    return t.fillna(0, ["size1", "size2", "overlap"])


def _module_list(o: DataFrame, members: DataFrame, side: str, name: str) -> DataFrame:
    return o.select(*PAIR).distinct().join(members.select(F.col("species").alias(side), F.col("module").alias(name)).distinct(), side)


def mapped_rows(members: DataFrame, orthologs: DataFrame) -> DataFrame:
    """Distinct (sp1, sp2, gene1, gene2, module1, module2) of ortholog rows with both genes in a module."""
    o = orthologs.select(*PAIR, "gene1", "gene2").distinct()
    a = members.select(F.col("species").alias("sp1"), F.col("gene").alias("gene1"), F.col("module").alias("module1"))
    b = members.select(F.col("species").alias("sp2"), F.col("gene").alias("gene2"), F.col("module").alias("module2"))
    return o.join(a, ["sp1", "gene1"]).join(b, ["sp2", "gene2"])


def _jaccard(ov: str = "overlap", a: str = "size1", b: str = "size2"):
    u = F.col(a) + F.col(b) - F.col(ov)
    return F.when(u > 0, F.col(ov) / F.greatest(u, F.lit(1))).otherwise(0.0)


#: Draws that one task makes of a species pair.
DRAWS = 50


def _exceeding(seed: int, last: int) -> Callable:
    """Grouped function: the draws from key ``lo`` (DRAWS of them, up to ``last``) in which a module pair's jaccard reaches the observed one.

    The left column stands in the order of (gene1, gene2), the right one is put in the order of md5(seed | draw | gene1:gene2).
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"sp1": [], "sp2": [], "module1": [], "module2": [], "perm": []})
        left = left.sort_values(["gene1", "gene2"])
        names = [f"{a}:{b}".encode() for a, b in zip(left["gene1"], left["gene2"])]
        m1, of1 = pd.factorize(left["module1"])
        g2, _ = pd.factorize(left["gene2"])
        m2, of2 = pd.factorize(left["module2"])
        n_g, n_m = int(g2.max()) + 1, len(of2)
        module_of = np.zeros(n_g, dtype=np.int64)
        module_of[g2] = m2  # a gene is in one module
        at1, at2 = (np.array([list(of).index(x) for x in right[c]], dtype=np.int64) for of, c in ((of1, "module1"), (of2, "module2")))
        size, observed = right["size2"].to_numpy(), np.round(right["jaccard"].to_numpy(), 9)
        hits = []
        for draw in range(key[2], min(key[2] + DRAWS - 1, last) + 1):
            prefix = f"{seed}|{draw}|".encode()
            order = np.argsort(np.frombuffer(b"".join([md5(prefix + x).digest() for x in names]), dtype=">u8")[::2], kind="stable")
            cells = np.unique(m1 * n_g + g2[order])  # distinct (module 1, drawn gene)
            of_cell, drawn = cells // n_g, module_of[cells % n_g]
            k = np.bincount(of_cell, minlength=len(of1))[at1]
            x = np.bincount(of_cell * n_m + drawn, minlength=len(of1) * n_m)[at1 * n_m + at2]
            hit = np.flatnonzero(np.round(x / np.maximum(k + size - x, 1), 9) >= observed)
            hits += [(draw, h) for h in hit]
        at = [h for _, h in hits]
        return pd.DataFrame({"sp1": key[0], "sp2": key[1], "module1": right["module1"].to_numpy()[at], "module2": right["module2"].to_numpy()[at], "perm": [d for d, _ in hits]})

    return run


def compare_modules(members: DataFrame, orthologs: DataFrame, method: str = "hypergeometric", min_exceedances: int = 50, max_permutations: int = 10_000, seed: int = 1) -> DataFrame:
    """Module pairs with overlap, jaccard, p_value, q_value (within a species pair), by exact test or by shuffled orthologs.

    hypergeometric: P(X >= overlap), 1 if overlap or a size is 0. jaccard: the sp2 column of the distinct ortholog rows is
    shuffled, mapped sets are rebuilt, a draw exceeds if its jaccard reaches the observed one; sequential stopping; 1 if
    the observed jaccard is 0.
    """
    if method not in ("hypergeometric", "jaccard"):
        raise ValueError("method must be hypergeometric or jaccard")
    t = cut(module_pairs(members, orthologs).withColumn("jaccard", _jaccard()))
    if method == "hypergeometric":
        x, m, k, n = (F.col(c) for c in ("overlap", "size2", "size1", "universe"))
        p = t.withColumn("p_value", F.when((x > 0) & (m > 0) & (k > 0), hypergeom_upper(x, m, k, n)).otherwise(1.0))
        return q_values(p, PAIR, "p_value", "q_value")
    rows = cut(mapped_rows(members, orthologs))
    key = [*PAIR, "module1", "module2"]
    tested = cut(t.where("jaccard > 0").select(*key, "size2", "jaccard"))
    active, flags = tested, None
    for lo, hi in batches(max_permutations):
        chunk = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(DRAWS))).alias("lo")
        left = spread(rows.join(active.select(*PAIR).distinct(), PAIR, "left_semi").select("*", chunk), *PAIR, "lo")
        right = spread(active.select(*[F.col(c).alias(c) for c in active.columns], chunk), *PAIR, "lo")  # columns of its own, as left's come from the same rows
        found = left.groupBy(*PAIR, "lo").cogroup(right.groupBy(*PAIR, "lo")).applyInPandas(_exceeding(seed, hi), "sp1 string, sp2 string, module1 int, module2 int, perm int")
        f = cut(found)  # exceeding draws alone; all others are known to be there
        flags = f if flags is None else flags.unionByName(f)
        if hi == max_permutations:
            break
        done = flags.groupBy(*key).agg(F.count("*").alias("e")).where(F.col("e") >= min_exceedances)
        active = cut(active.join(done.select(*key), key, "left_anti"))
        if active.isEmpty():
            break
    nth = flags.withColumn("e", F.row_number().over(W.partitionBy(*key).orderBy("perm"))).where(F.col("e") <= min_exceedances)
    got = nth.groupBy(*key).agg(F.count("*").cast("int").alias("n_exceed"), F.max(F.when(F.col("e") == min_exceedances, F.col("perm"))).alias("stop"))
    p = tested.select(*key).join(got, key, "left").select(*key, F.coalesce("stop", F.lit(max_permutations)).cast("int").alias("n_perm"), F.coalesce("n_exceed", F.lit(0)).alias("n_exceed"))
    p = p.withColumn("p_value", (F.col("n_exceed") + 1) / (F.col("n_perm") + 1))
    out = cut(t.join(p, key, "left").fillna(1.0, ["p_value"]).fillna(0, ["n_perm", "n_exceed"]))
    return discrete_q_values(out, PAIR, "p_value", "q_value", bc_support(min_exceedances, max_permutations))


def best_matches(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Best partner of each module in both directions: least p (then partner number), and how many partners have q < alpha."""

    def one(name: str, mine: str, other: str) -> DataFrame:
        w = W.partitionBy(*PAIR, mine).orderBy("p_value", other)
        n = F.count_if(F.col("q_value") < alpha).over(W.partitionBy(*PAIR, mine))
        return pairs.withColumn("_k", F.row_number().over(w)).withColumn("n_significant", n).where("_k = 1").select(*PAIR, F.lit(name).alias("direction"), F.col(mine).alias("module"), F.col(other).alias("best_match"), "p_value", "q_value", "jaccard", "n_significant")

    return one("sp1", "module1", "module2").unionByName(one("sp2", "module2", "module1"))


def classify_modules(pairs: DataFrame, alpha: float = 0.05, jaccard_threshold: float = 0.1) -> DataFrame:
    """(sp1, sp2, species = 'sp1'|'sp2', module, classification) from best matches: species_specific (q >= alpha), conserved (jaccard >= threshold), partially_conserved."""
    c = F.when(F.col("q_value") >= alpha, "species_specific").when(F.col("jaccard") >= jaccard_threshold, "conserved").otherwise("partially_conserved")
    return best_matches(pairs).select(*PAIR, F.col("direction").alias("species"), "module", "best_match", c.alias("classification"))


def module_density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(species, mi, mj, n_edges, density) for pairs of modules mi < mj with edges between: n / (size_i size_j)."""
    a = members.select("species", F.col("gene").alias("i"), F.col("module").alias("a"))
    b = members.select("species", F.col("gene").alias("j"), F.col("module").alias("b"))
    e = edges.select("species", "i", "j").join(a, ["species", "i"]).join(b, ["species", "j"]).where("a <> b").groupBy("species", F.least("a", "b").alias("mi"), F.greatest("a", "b").alias("mj")).agg(F.count("*").alias("n_edges"))
    s = members.groupBy("species", "module").agg(F.count("*").alias("s"))
    t = e.join(s.select("species", F.col("module").alias("mi"), F.col("s").alias("si")), ["species", "mi"]).join(s.select("species", F.col("module").alias("mj"), F.col("s").alias("sj")), ["species", "mj"])
    return t.select("species", "mi", "mj", "n_edges", (F.col("n_edges") / (F.col("si") * F.col("sj"))).alias("density"))


def coarsen_modules(members: DataFrame, edges: DataFrame, target: int | DataFrame) -> DataFrame:
    """(species, module, coarse): modules merged to ``target`` (a number, or one row (species, target) a species) by complete linkage on 1 - density / max density.

    Modules are clustered per species in one small task (a row per module pair); without edges between modules they
    merge in module order; target >= number of modules changes nothing.
    """
    if isinstance(target, int) and target < 1:
        raise ValueError("target must be at least 1")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mods = sorted(pdf.loc[pdf["mj"].isna(), "mi"].astype(int))
        at, n, want = {m: k for k, m in enumerate(mods)}, len(mods), int(pdf["target"].iat[0])
        if want >= n:
            return pd.DataFrame({"species": key[0], "module": mods, "coarse": mods})
        d = np.zeros((n, n))
        for r in pdf[pdf["mj"].notna()].itertuples():
            d[at[int(r.mi)], at[int(r.mj)]] = d[at[int(r.mj)], at[int(r.mi)]] = r.density
        dist = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float) if d.max() == 0 else 1 - d / d.max()
        return pd.DataFrame({"species": key[0], "module": mods, "coarse": G.complete_linkage(dist, want) + 1})

    nodes = members.select("species", F.col("module").alias("mi")).distinct().select("species", "mi", F.lit(None).cast("int").alias("mj"), F.lit(0.0).alias("density"))
    rows = module_density(members, edges).select("species", "mi", "mj", "density").unionByName(nodes)
    rows = rows.withColumn("target", F.lit(target)) if isinstance(target, int) else rows.join(target.select("species", "target"), "species")
    return rows.groupBy("species").applyInPandas(run, "species string, module int, coarse int")


class PairedComparison(NamedTuple):
    """classification: pair_name, scale, species, module, classification, grp. raw: pair_name, scale and the module pairs. counts: pair_name, n_sp1, n_sp2, ratio."""

    classification: DataFrame
    raw: DataFrame
    counts: DataFrame


def compare_modules_paired(
    members: DataFrame, orthologs: DataFrame, contrasts: DataFrame, traits: DataFrame | None = None, edges: DataFrame | None = None, method: str = "jaccard", matched_scale: bool = True,
    coarsen_ratio: float = 2.0, alpha: float = 0.05, jaccard_threshold: float = 0.1, min_exceedances: int = 50, max_permutations: int = 10_000, seed: int = 1,
) -> PairedComparison:
    """Module comparison of contrasts (pair_name, sp1, sp2; without pair_name it is sp1.sp2), at natural and at matched scale.

    grp is 'conserved' (partially conserved too) or, of a species-specific module, the side's trait (null without traits). Where the module
    counts of a contrast differ by more than coarsen_ratio, the finer side is coarsened to the smaller count by ``edges``
    (species, i, j, w) and the contrast is compared again as scale 'matched'; other contrasts have no matched rows. All
    contrasts are one plan: a coarsened species goes by its name and the contrast's. Raises ValueError for matched_scale without
    edges, and for contrasts of species without modules or trait.
    """
    if matched_scale and edges is None:
        raise ValueError("matched_scale needs edges")
    if "pair_name" not in contrasts.columns:
        contrasts = contrasts.withColumn("pair_name", F.concat_ws(".", *PAIR))
    pairs = [(r["pair_name"], r["sp1"], r["sp2"]) for r in contrasts.select("pair_name", *PAIR).collect()]  # as the caller lists them
    counts = {r["species"]: r["n"] for r in members.groupBy("species").agg(F.countDistinct("module").alias("n")).collect()}  # one row per species
    if missing := {s for p in pairs for s in p[1:]} - set(counts):
        raise ValueError(f"no modules of {sorted(missing)}")
    if traits is not None and (missing := {s for p in pairs for s in p[1:]} - {r["species"] for r in traits.select("species").distinct().collect()}):
        raise ValueError(f"no trait of {sorted(missing)}")

    def at(m: DataFrame, o: DataFrame, by: DataFrame, scale: str) -> tuple[DataFrame, DataFrame]:
        raw = cut(compare_modules(m, o, method, min_exceedances, max_permutations, seed)).join(by, PAIR)
        c = classify_modules(raw.drop("pair_name", "real1", "real2").distinct(), alpha, jaccard_threshold).join(by, PAIR)
        c = c.withColumn("_sp", F.when(F.col("species") == "sp1", F.col("real1")).otherwise(F.col("real2")))
        c = c.join(traits.select(F.col("species").alias("_sp"), "trait"), "_sp", "left") if traits is not None else c.withColumn("trait", F.lit(None).cast("string"))
        grp = F.when(F.col("classification") != "species_specific", "conserved").otherwise(F.col("trait"))
        named = raw.drop(*PAIR).withColumnsRenamed({"real1": "sp1", "real2": "sp2"}).withColumn("scale", F.lit(scale))
        return c.select("pair_name", F.lit(scale).alias("scale"), "species", "module", "classification", grp.alias("grp")), named

    plain = contrasts.select("pair_name", *PAIR, F.col("sp1").alias("real1"), F.col("sp2").alias("real2"))
    c, raw = at(members, orthologs.join(contrasts.select(*PAIR), PAIR, "left_semi"), plain, "natural")
    uneven = [p for p in pairs if max(counts[p[1]], counts[p[2]]) / min(counts[p[1]], counts[p[2]]) > coarsen_ratio] if matched_scale else []
    spark = members.sparkSession
    if uneven:
        tagged = [(s, f"{s}@{n}", min(counts[a], counts[b])) for n, a, b in uneven for s in (a, b)]
        names = F.broadcast(spark.createDataFrame(tagged, "species string, tagged string, target int"))
        named = lambda df, *cols: df.join(names, "species").select(F.col("tagged").alias("species"), *cols)
        m = cut(named(members, "gene", "module"))
        coarse = coarsen_modules(m, named(edges, "i", "j", "w"), names.select(F.col("tagged").alias("species"), "target"))
        merged = m.join(coarse, ["species", "module"]).select("species", "gene", F.col("coarse").alias("module"))
        by = spark.createDataFrame([(n, f"{a}@{n}", f"{b}@{n}", a, b) for n, a, b in uneven], "pair_name string, sp1 string, sp2 string, real1 string, real2 string")
        o = orthologs.join(F.broadcast(by.withColumnsRenamed({"sp1": "t1", "sp2": "t2", "real1": "sp1", "real2": "sp2"})), PAIR).drop(*PAIR).withColumnsRenamed({"t1": "sp1", "t2": "sp2"})
        c2, raw2 = at(cut(merged), o.select(*PAIR, "gene1", "gene2", "hog"), by, "matched")
        c, raw = c.unionByName(c2), raw.unionByName(raw2)
    sizes = spark.createDataFrame([(n, counts[a], counts[b], round(max(counts[a], counts[b]) / min(counts[a], counts[b]), 1)) for n, a, b in pairs], "pair_name string, n_sp1 long, n_sp2 long, ratio double")
    return PairedComparison(c, raw, sizes)


def paired_summary(paired: DataFrame) -> DataFrame:
    """Number of modules by contrast, scale and grp."""
    return paired.groupBy("pair_name", "scale", "grp").agg(F.count("*").alias("n_modules"))


def _module_metrics(pdf: pd.DataFrame) -> pd.DataFrame:
    names, i, j, w = _graph(pdf)
    n = len(names)
    return pd.DataFrame({"species": pdf["species"].iat[0], "module": int(pdf["module"].iat[0]), "gene": names, "betweenness": G.betweenness(n, i, j, w), "eigenvector": G.eigenvector(n, i, j, w)})


def identify_module_hubs(members: DataFrame, edges: DataFrame, gene_hogs: DataFrame | None = None, comparison: DataFrame | None = None, centrality: str = "degree", top_n: int | None = None, top_fraction: float = 0.1, min_module_size: int = 3, paths: bool = True) -> DataFrame:
    """Hub table: species, module, gene, degree (strength within the module), betweenness, eigenvector, mean_edge_weight, global_degree, rank, is_hub, hog.

    rank is the minimum rank by the chosen centrality; hubs are the first top_n, or ceil(top_fraction n), by that
    centrality, global degree, the other centrality, mean edge weight, conservation (all descending), group q, gene.
    comparison rows are (species, gene, conserv_eff, hog_q), as :func:`conservation` gives them. Modules below min_module_size have no metrics but global_degree, and no hub. ``paths``:
    betweenness and eigenvector, a task per module; without, they are null and can't rank.
    """
    if centrality not in ("degree", "betweenness", "eigenvector"):
        raise ValueError("unknown centrality")
    if centrality != "degree" and not paths:
        raise ValueError(f"{centrality} needs paths")
    if top_n is not None and top_n < 1 or not 0 < top_fraction < 1:
        raise ValueError("top_n must be positive and top_fraction between 0 and 1")
    m = members.select("species", "gene", "module")
    a = m.select("species", F.col("gene").alias("i"), F.col("module").alias("ma"))
    b = m.select("species", F.col("gene").alias("j"), F.col("module").alias("mb"))
    e = cut(edges.select("species", "i", "j", "w").join(a, ["species", "i"]).join(b, ["species", "j"]))
    ends = F.explode(F.array("i", "j"))
    s = e.select("species", ends.alias("gene"), "w", (F.col("ma") == F.col("mb")).alias("inner")).groupBy("species", "gene").agg(
        F.sum("w").alias("global_degree"), F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0.0)).alias("degree"), F.count_if("inner").alias("links"))
    size = m.groupBy("species", "module").agg(F.count("*").alias("n"))
    t = m.join(size, ["species", "module"]).join(s, ["species", "gene"], "left").fillna(0.0, ["global_degree", "degree"]).fillna(0, ["links"])
    ok = F.col("n") >= min_module_size
    if paths:
        inner = e.where("ma = mb").select("species", F.col("ma").alias("module"), "i", "j", "w").join(size.where(ok), ["species", "module"], "left_semi")
        nodes = m.join(size.where(ok), ["species", "module"], "left_semi").select("species", "module", F.col("gene").alias("i"), F.lit(None).cast("string").alias("j"), F.lit(0.0).alias("w"))
        c = spread(inner.unionByName(nodes), "species", "module").groupBy("species", "module").applyInPandas(_module_metrics, "species string, module int, gene string, betweenness double, eigenvector double")
        t = t.join(c, ["species", "module", "gene"], "left")
    else:
        t = t.withColumns({c: F.lit(None).cast("double") for c in ("betweenness", "eigenvector")})
    t = t.withColumn("mean_edge_weight", F.when(F.col("links") > 0, F.col("degree") / F.greatest("links", F.lit(1))).otherwise(0.0))
    t = t.withColumns({c: F.when(ok, F.col(c)) for c in ("degree", "betweenness", "eigenvector", "mean_edge_weight")})
    t = t.join(gene_hogs.groupBy("species", "gene").agg(F.min("hog").alias("hog")), ["species", "gene"], "left") if gene_hogs is not None else t.withColumn("hog", F.lit(None).cast("string"))
    t = t.join(comparison.select("species", "gene", "conserv_eff", "hog_q"), ["species", "gene"], "left") if comparison is not None else t.withColumns({"conserv_eff": F.lit(0.0), "hog_q": F.lit(1.0)})
    t = t.fillna({"conserv_eff": 0.0, "hog_q": 1.0})
    per, other = W.partitionBy("species", "module"), "betweenness" if centrality == "degree" else "degree"
    order = [F.desc(centrality), F.desc("global_degree"), F.desc(other), F.desc("mean_edge_weight"), F.desc("conserv_eff"), F.asc("hog_q"), F.asc("gene")]
    top = F.least(F.lit(top_n), F.col("n")) if top_n else F.greatest(F.lit(1), F.ceil(F.lit(top_fraction) * F.col("n")))
    t = t.withColumn("_k", F.row_number().over(per.orderBy(*order))).withColumn("rank", F.when(ok, F.rank().over(per.orderBy(F.desc(centrality))))).withColumn("is_hub", ok & (F.col("_k") <= top))
    return t.select("species", "module", "gene", "degree", "betweenness", "eigenvector", "mean_edge_weight", "global_degree", "rank", "is_hub", "hog", F.lit(centrality).alias("primary_centrality"))


def conservation(results: DataFrame, gene_hogs: DataFrame) -> DataFrame:
    """(species, gene, conserv_eff, hog_q) of summarize_comparison's rows: a gene's mean effect over its pairs, its group's least q."""
    side = F.explode(F.array(F.struct(F.col("sp1").alias("species"), F.col("gene1").alias("gene")), F.struct(F.col("sp2").alias("species"), F.col("gene2").alias("gene"))))
    eff = results.select(side.alias("x"), F.sqrt(F.col("sp1_effect") * F.col("sp2_effect")).alias("e")).groupBy("x.species", "x.gene").agg(F.avg("e").alias("conserv_eff"))
    q = results.groupBy("hog").agg(F.min(F.least("q1", "q2")).alias("hog_q"))
    genes = gene_hogs.groupBy("species", "gene").agg(F.min("hog").alias("hog"))
    return genes.join(eff, ["species", "gene"], "left").join(q, "hog", "left").select("species", "gene", "conserv_eff", "hog_q")


def classify_hub_conservation(hubs: DataFrame, traits: DataFrame, pairs: DataFrame | None = None, alpha: float = 0.05, jaccard_threshold: float = 0.1, min_trait_fraction: float = 0.5, correspondence_threshold: float = 0.5, centrality: str = "degree") -> DataFrame:
    """(hog, classification, n_species, n_species_hub, n_cross_pairs, n_corresponding) for every group with a hub table row.

    A trait has the group as hub if at least min_trait_fraction of the trait's species *that have the group* have a hub
    gene in it. Two such traits: all cross-trait pairs of hub species are looked up in ``pairs`` (either orientation) by
    their hub modules; conserved_hub if enough of the known ones correspond, rewired_hub if not, multi_trait_hub if none is
    known. One: <trait>_specific_hub; hubs but no trait: sporadic_hub; no hub: non_hub.
    """
    h = hubs.where(F.col("hog").isNotNull())
    key = F.struct(F.coalesce(F.col(centrality), F.lit(-1.0)), F.col("gene"))
    sp = cut(h.groupBy("hog", "species").agg(F.bool_or("is_hub").alias("hub"), F.max_by("module", F.when(F.col("is_hub"), key)).alias("module")).join(traits.select("species", "trait"), "species", "left"))
    base = sp.groupBy("hog").agg(F.count("*").alias("n_species"), F.count_if("hub").alias("n_species_hub"))
    by = sp.where(F.col("trait").isNotNull()).groupBy("hog", "trait").agg((F.count_if("hub") / F.count("*")).alias("f"), F.count_if("hub").alias("nh")).where((F.col("nh") > 0) & (F.col("f") >= min_trait_fraction))
    groups = by.groupBy("hog").agg(F.count("*").alias("n_traits"), F.min("trait").alias("one"))
    hs = sp.where("hub").join(by.select("hog", "trait"), ["hog", "trait"], "left_semi").select("hog", "species", "module", "trait")
    x = hs.select("hog", F.col("species").alias("spa"), F.col("module").alias("ma"), F.col("trait").alias("ta")).join(hs.select("hog", F.col("species").alias("spb"), F.col("module").alias("mb"), F.col("trait").alias("tb")), "hog").where("ta < tb")
    if pairs is not None:
        match = pairs.select(*PAIR, "module1", "module2", ((F.col("q_value") < alpha) & (F.col("jaccard") >= jaccard_threshold)).alias("ok"))
        flip = match.select(F.col("sp2").alias("sp1"), F.col("sp1").alias("sp2"), F.col("module2").alias("module1"), F.col("module1").alias("module2"), "ok")
        both = match.unionByName(flip)
        known = both.select(F.col("sp1").alias("spa"), F.col("sp2").alias("spb")).distinct().withColumn("known", F.lit(True))
        x = x.join(known, ["spa", "spb"], "left").join(both.select(F.col("sp1").alias("spa"), F.col("sp2").alias("spb"), F.col("module1").alias("ma"), F.col("module2").alias("mb"), "ok"), ["spa", "spb", "ma", "mb"], "left")
    else:
        x = x.withColumns({"known": F.lit(None).cast("boolean"), "ok": F.lit(None).cast("boolean")})
    c = x.groupBy("hog").agg(F.count("*").alias("n_cross_pairs"), F.count_if("known").alias("n_known"), F.count_if("ok").alias("n_ok"))
    t = base.join(groups, "hog", "left").join(c, "hog", "left").fillna(0, ["n_traits"])
    label = (
        F.when(F.col("n_species_hub") == 0, "non_hub")
        .when((F.col("n_traits") >= 2) & (F.col("n_known") == 0), "multi_trait_hub")
        .when((F.col("n_traits") >= 2) & (F.col("n_ok") / F.greatest("n_known", F.lit(1)) >= correspondence_threshold), "conserved_hub")
        .when(F.col("n_traits") >= 2, "rewired_hub")
        .when(F.col("n_traits") == 1, F.concat("one", F.lit("_specific_hub")))
        .otherwise("sporadic_hub")
    )
    return t.select("hog", label.alias("classification"), "n_species", "n_species_hub", F.when(F.col("n_traits") >= 2, F.col("n_cross_pairs")).alias("n_cross_pairs"), F.when((F.col("n_traits") >= 2) & (F.col("n_known") > 0), F.col("n_ok")).alias("n_corresponding"))


def characterize_hubs(hubs: DataFrame, profiles: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """Hub rows with bridge_fraction (1 - degree / global degree, clipped), bt_degree_ratio, cv of the profile, annotation columns.

    Ratios are null where the denominator isn't positive; cv is null for a mean of 0; of a gene annotated twice the first row
    by its values counts.
    """
    t = hubs.withColumn("bridge_fraction", F.when(F.col("global_degree") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("degree") / F.col("global_degree"))))).withColumn("bt_degree_ratio", F.when(F.col("degree") > 0, F.col("betweenness") / F.col("degree")))
    if profiles is not None:
        from .similarity import sample_variance

        mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
        cv = profiles.withColumn("_m", F.abs(mean)).select("species", "gene", F.when(F.col("_m") > 2.2e-16, F.sqrt(sample_variance("values")) / F.col("_m")).alias("cv"))
        t = t.join(cv, ["species", "gene"], "left")
    if annotations is not None:
        rest = [c for c in annotations.columns if c != "gene"]
        first = annotations.groupBy("gene").agg(F.min(F.struct(*rest)).alias("_a")).select("gene", *[F.col(f"_a.{c}").alias(c if c not in t.columns else f"{c}_annotation") for c in rest])
        t = t.join(first, "gene", "left")
    return t


def reduce_orthogroups(profiles: DataFrame, cor_threshold: float = 0.7) -> DataFrame:
    """(species, gene, representative, values): similar genes of a group merged into their mean profile.

    Within a species' group, genes with variance are clustered (Ward on 1 - r, merged while d <= 1 - cor_threshold); a
    cluster is named by its first gene. Genes without group or variance pass through. One row per original gene.
    """
    if not 0 <= cor_threshold <= 1:
        raise ValueError("cor_threshold must be between 0 and 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")
        x = np.array(pdf["values"].tolist(), dtype=float)
        out = pd.DataFrame({"species": pdf["species"].to_numpy(), "gene": pdf["gene"].to_numpy(), "representative": pdf["gene"].to_numpy(), "values": list(x)})
        live = np.flatnonzero(x.var(axis=1) > 0)
        if len(live) > 1:
            label = G.ward_clusters(x[live], cor_threshold)
            for c in np.unique(label):
                rows = live[label == c]
                mean = x[rows].mean(axis=0)
                for r in rows:
                    out.at[r, "representative"] = pdf["gene"].iat[rows[0]]
                    out.at[r, "values"] = mean
        return out

    schema = "species string, gene string, representative string, values array<double>"
    grouped = profiles.where(F.col("hog").isNotNull())
    alone = profiles.where(F.col("hog").isNull()).select("species", "gene", F.col("gene").alias("representative"), "values")
    return spread(grouped, "species", "hog").groupBy("species", "hog").applyInPandas(run, schema).unionByName(alone)
