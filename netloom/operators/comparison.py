"""Cross-species neighbourhood comparison: pair statistics, q-values, edges, sweeps, co-expressed groups.

All species pairs are compared in one plan: the pair is a grouping key, so there is no loop over pairs on the driver.
Ortholog rows are (sp1, sp2, gene1, gene2, hog).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import hypergeom_lower, hypergeom_upper, q_values
from ..sources.tables import cut, spread
from .network import Networks, both_ways

PAIR = ["sp1", "sp2"]
ROW = ["sp1", "sp2", "hog", "gene1", "gene2"]


def usable_orthologs(orthologs: DataFrame, genes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Distinct ortholog rows whose genes are in both networks."""
    for c in ("sp1", "sp2", "gene1", "gene2", "hog"):
        if c not in orthologs.columns:
            raise ValueError(f"orthologs lack column {c}")
    o = orthologs.select(*keys, *ROW[:2], F.col("hog").cast("string").alias("hog"), "gene1", "gene2").distinct()
    for sp, g in (("sp1", "gene1"), ("sp2", "gene2")):
        o = o.join(genes.select(F.col("species").alias(sp), F.col("gene").alias(g)), [sp, g], "left_semi")
    return o


def oriented(orthologs: DataFrame, species_pairs: list[tuple[str, str]], species: set[str]) -> DataFrame:
    """Ortholog rows of the given species pairs, turned round where a pair is given the other way."""
    if bad := {s for p in species_pairs for s in p} - species:
        raise ValueError(f"species_pairs name unknown species {sorted(bad)}")
    wanted = F.broadcast(orthologs.sparkSession.createDataFrame([tuple(p) for p in dict.fromkeys(map(tuple, species_pairs))], "sp1 string, sp2 string"))  # as the caller lists them
    flip = orthologs.select(F.col("sp2").alias("sp1"), F.col("sp1").alias("sp2"), F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), "hog")
    return orthologs.select(flip.columns).unionByName(flip).join(wanted, PAIR, "left_semi").distinct()


def _directed(o: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Both directions: anchor gene ``a`` of species ``sa``, other gene ``o`` of ``so``."""
    one = F.struct(F.lit(1).alias("d"), F.col("sp1").alias("sa"), F.col("gene1").alias("a"), F.col("sp2").alias("so"), F.col("gene2").alias("o"))
    two = F.struct(F.lit(2).alias("d"), F.col("sp2").alias("sa"), F.col("gene2").alias("a"), F.col("sp1").alias("so"), F.col("gene1").alias("o"))
    return o.withColumn("x", F.explode(F.array(one, two))).select(*keys, *ROW, "x.*")


def compare_neighborhoods(nets: Networks, orthologs: DataFrame, neighbours: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """Pair statistics of every usable ortholog row, in both directions.

    Direction 1: m = |A|, A the neighbours of gene1; k = |B|, B the distinct orthologs (in species 1) of gene2's
    neighbours; x = |A and B|; universe = genes of network 1. p_con = P(X >= x) if x > 1 else 1; p_div = P(X <= x) and
    effect = (x/k)/(m/N) if k, m > 0 else 1; jaccard = x / |A or B|, 0 if empty. B is de-duplicated after mapping, so a
    multi-copy ortholog counts once. No usable row gives an empty table. ``keys``: columns of the orthologs that tell
    variants of them apart (draws); networks are the same for all variants and aren't copied.
    """
    # what several branches read is written once: neighbours (a few percent of the weights), bridge rows, mapped sets, result
    nbr, by = cut((nets.neighbours() if neighbours is None else neighbours).select("species", "g", "nb")), [*keys, *PAIR]
    d = cut(_directed(usable_orthologs(orthologs, nets.genes, keys), keys))
    bridge = d.select("d", *by, "so", "o", "a").distinct()
    mapped = cut(nbr.select(F.col("species").alias("so"), F.col("nb").alias("o"), F.col("g").alias("og")).join(bridge, ["so", "o"]).select("d", *by, F.col("og").alias("o"), F.col("a").alias("member")).distinct())
    k = mapped.groupBy("d", *by, "o").agg(F.count("*").alias("k"))
    m = nbr.groupBy(F.col("species").alias("sa"), F.col("g").alias("a")).agg(F.count("*").alias("m"))
    x = (
        d.join(mapped, ["d", *by, "o"])
        .join(nbr.select(F.col("species").alias("sa"), F.col("g").alias("a"), F.col("nb").alias("member")), ["sa", "a", "member"], "left_semi")
        .groupBy("d", *keys, *ROW).agg(F.count("*").alias("x"))
    )
    n = nets.sizes().select(F.col("species").alias("sa"), F.col("n_genes").alias("n"))
    t = d.join(m, ["sa", "a"], "left").join(k, ["d", *by, "o"], "left").join(x, ["d", *keys, *ROW], "left").join(n, "sa").fillna(0, ["m", "k", "x"])
    t = spread(t, "d", *keys, *ROW)
    m_, k_, x_, n_ = (F.col(c) for c in "mkxn")
    some, union = (k_ > 0) & (m_ > 0), m_ + k_ - x_
    t = t.select(
        "d", *keys, *ROW, m_.alias("neigh"), k_.alias("ortho_neigh"), x_.alias("overlap"),
        F.when(x_ > 1, hypergeom_upper(x_, m_, k_, n_)).otherwise(1.0).alias("p_con"),
        F.when(some, hypergeom_lower(x_, m_, k_, n_)).otherwise(1.0).alias("p_div"),
        F.when(some, (x_ / F.greatest(k_, F.lit(1))) / (F.greatest(m_, F.lit(1)) / n_)).otherwise(1.0).alias("effect"),
        F.when(union > 0, x_ / F.greatest(union, F.lit(1))).otherwise(0.0).alias("jaccard"),
    )
    cols = ["neigh", "ortho_neigh", "overlap", "p_con", "p_div", "effect", "jaccard"]
    # the two directions of a row meet in an aggregation over rows that lie by its key; the tails are computed once before it
    met = spread(t, *keys, *ROW).groupBy(*keys, *ROW).agg(*[F.max(F.when(F.col("d") == i, F.col(c))).alias(f"sp{i}_{c}") for i in (1, 2) for c in cols])
    return cut(met)


def summarize_comparison(comparison: DataFrame, alternative: str = "greater", filter_zero: bool | None = None, keys: list[str] = ()) -> DataFrame:
    """Comparison rows with q1, q2 (per direction, within a species pair). Rows without overlap in either direction are dropped for 'greater'."""
    if alternative not in ("greater", "less"):
        raise ValueError("alternative must be greater or less")
    if filter_zero is None:
        filter_zero = alternative == "greater"
    rows = comparison.where("sp1_overlap > 0 and sp2_overlap > 0") if filter_zero else comparison
    p, by = "p_con" if alternative == "greater" else "p_div", [*keys, *PAIR]
    return q_values(q_values(rows, by, f"sp1_{p}", "q1"), by, f"sp2_{p}", "q2")


def summary_counts(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per species pair: significant pairs (1, 2, both) and total, the same for gene 1, gene 2 and group by their least q."""
    r = cut(results).withColumn("qr", F.greatest("q1", "q2"))
    pairs = r.groupBy(*PAIR).agg(F.lit("pairs").alias("level"), F.count_if(F.col("q1") < alpha).alias("n_sp1"), F.count_if(F.col("q2") < alpha).alias("n_sp2"), F.count_if(F.col("qr") < alpha).alias("n_reciprocal"), F.count("*").alias("n_total"))

    def level(name: str, key: str) -> DataFrame:
        g = r.groupBy(*PAIR, key).agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("qr").alias("qr"))
        return g.groupBy(*PAIR).agg(F.lit(name).alias("level"), F.count_if(F.col("q1") < alpha).alias("n_sp1"), F.count_if(F.col("q2") < alpha).alias("n_sp2"), F.count_if(F.col("qr") < alpha).alias("n_reciprocal"), F.count("*").alias("n_total"))

    return reduce(DataFrame.unionByName, [pairs, level("gene1", "gene1"), level("gene2", "gene2"), level("hog", "hog")])


def comparison_to_edges(results: DataFrame, alternative: str = "greater", alpha: float = 0.05, keys: list[str] = ()) -> DataFrame:
    """Edges: q = least of both directions (nulls skipped), effect and jaccard geometric means, type by alpha (null if q is)."""
    hit = "conserved" if alternative == "greater" else "diverged"
    q = F.least("q1", "q2")
    return results.select(
        *keys, "gene1", "gene2", F.col("sp1").alias("species1"), F.col("sp2").alias("species2"), "hog", q.alias("q_value"),
        F.sqrt(F.col("sp1_effect") * F.col("sp2_effect")).alias("effect_size"), F.sqrt(F.col("sp1_jaccard") * F.col("sp2_jaccard")).alias("jaccard"),
        F.when(q.isNull(), F.lit(None).cast("string")).when(q < alpha, hit).otherwise("ns").alias("type"),
    )


def find_coexpressologs(
    nets: Networks, orthologs: DataFrame, method: str = "analytical", alternative: str = "greater", alpha: float = 0.05, neighbours: DataFrame | None = None,
    species_pairs: list[tuple[str, str]] | None = None, keys: list[str] = (), min_exceedances: int = 50, max_permutations: int = 10_000, seed: int = 1,
) -> DataFrame:
    """Edges of all species pairs (or of ``species_pairs``, in the order given); a pair without usable orthologs simply has none.

    analytical: each pair of genes has its own q-value from the hypergeometric tails. permutation: groups are tested by
    shuffled genes and every pair of a group takes its group's q-value (no ``keys``). Raises ValueError for an unknown
    method or alternative, and for species pairs without a network.
    """
    if method not in ("analytical", "permutation"):
        raise ValueError("method must be analytical or permutation")
    if species_pairs is not None:
        orthologs = oriented(orthologs, species_pairs, {r[0] for r in nets.thresholds.select("species").distinct().collect()})  # one row per species
    comparison = compare_neighborhoods(nets, orthologs, neighbours, keys)
    if method == "analytical":
        return comparison_to_edges(summarize_comparison(comparison, alternative, keys=keys), alternative, alpha, keys)
    from .permutation import permutation_edges, permutation_hog_test

    if keys:
        raise ValueError("method permutation takes no keys")
    tests = permutation_hog_test(nets, orthologs, comparison, alternative, min_exceedances, max_permutations, seed)
    return permutation_edges(comparison, tests, alternative, alpha)


run_pairwise_comparisons = find_coexpressologs


def density_sweep(nets: Networks, orthologs: DataFrame, multipliers: list[float] = tuple(round(0.95 + 0.01 * k, 2) for k in range(11)), method: str = "permutation", alternative: str = "greater", alpha: float = 0.05, **test) -> tuple[DataFrame, DataFrame]:
    """(edges, densities) with a ``multiplier`` column, the thresholds scaled by each multiplier; ``test`` as of find_coexpressologs.

    Species carry the multiplier in their name while they pass through the comparison, so all steps of the sweep are one plan.
    """
    if not multipliers or any(m <= 0 for m in multipliers):
        raise ValueError("multipliers must be positive")
    if (pairs := test.pop("species_pairs", None)) is not None:
        orthologs = oriented(orthologs, pairs, {r[0] for r in nets.thresholds.select("species").collect()})  # one row per species
    tag = lambda df, *cols: df.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers)))).withColumns({c: F.concat_ws("@", F.col(c), F.col("multiplier").cast("string")) for c in cols})
    t = nets.thresholds.withColumn("multiplier", F.explode(F.array(*map(F.lit, multipliers)))).withColumn("species_m", F.concat_ws("@", "species", F.col("multiplier").cast("string"))).withColumn("threshold", F.col("threshold") * F.col("multiplier"))
    low = nets.weights.join(F.broadcast(nets.thresholds.select("species", "threshold")), "species").where(F.col("w") >= F.col("threshold") * min(multipliers)).drop("threshold")
    kept = low.join(F.broadcast(t.select("species", "species_m", "threshold", "multiplier")), "species").where(F.col("w") >= F.col("threshold"))  # the lowest step's edges hold all others'
    w = kept.select(F.col("species_m").alias("species"), "i", "j", "w")
    scaled = Networks(w, t.select(F.col("species_m").alias("species"), "threshold"), tag(nets.genes, "species").select("species", "gene"), nets.params)
    o = tag(orthologs, "sp1", "sp2")
    edges = find_coexpressologs(scaled, o, method, alternative, alpha, both_ways(w, "w"), **test)
    base = lambda c: F.split(F.col(c), "@")[0]
    edges = edges.withColumn("multiplier", F.split(F.col("species1"), "@")[1].cast("double")).withColumns({c: base(c) for c in ("species1", "species2")})
    counts = kept.groupBy("multiplier", "species").agg(F.count("*").alias("n_edges"))
    dens = t.select("species", "multiplier", "n_pairs").join(counts, ["multiplier", "species"], "left").fillna(0, ["n_edges"]).withColumn("density", F.col("n_edges") / F.col("n_pairs"))
    return edges, dens


def sweep_summary(edges: DataFrame, densities: DataFrame) -> DataFrame:
    """Per multiplier: mean density over species, edges and significant edges."""
    e = edges.groupBy("multiplier").agg(F.count("*").alias("n_edges"), F.count_if(F.col("type") != "ns").alias("n_significant"))
    d = densities.groupBy("multiplier").agg(F.round(F.avg("density"), 6).alias("density"))
    return d.join(e, "multiplier", "left").fillna(0, ["n_edges", "n_significant"])


def coexpressed_hogs(candidate: str, nets: Networks, gene_hogs: DataFrame, traits: DataFrame, min_species: int = 2, edges: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """Groups co-expressed with a candidate group in at least ``min_species`` species.

    gene_hogs is (species, gene, hog), the first hog by name counting. Neighbours of the candidate's genes, without those genes, are mapped to groups; a
    species' weight of a partner is the greatest over candidate genes of the mean weight to the partner's neighbour genes
    (pooled over candidate genes, so weights below the threshold count). With edges: any conserved, mean effect, least q.
    """
    hogs = gene_hogs.groupBy("species", "gene").agg(F.min("hog").alias("hog"))  # a group's genes have no size bound: Spark picks their join
    cand = hogs.where(F.col("hog") == candidate).select("species", F.col("gene").alias("g"))
    nbr = nets.neighbours() if neighbours is None else neighbours
    partners = nbr.join(cand, ["species", "g"], "left_semi").select("species", F.col("nb").alias("gene")).distinct()
    partners = partners.join(cand.select("species", F.col("g").alias("gene")), ["species", "gene"], "left_anti").join(hogs, ["species", "gene"])
    every = both_ways(nets.weights, "w").join(cand, ["species", "g"], "left_semi")
    w = every.join(partners.select("species", F.col("gene").alias("nb"), "hog"), ["species", "nb"]).groupBy("species", "hog", "g").agg(F.avg("w").alias("w")).groupBy("species", "hog").agg(F.max("w").alias("w"))
    agg = w.join(traits.select("species", "trait").distinct(), "species", "left").groupBy("hog").agg(
        F.count("*").alias("n_species"), F.array_join(F.array_sort(F.collect_set("species")), ",").alias("species"), F.array_join(F.array_sort(F.collect_set("trait")), ",").alias("traits"), F.avg("w").alias("mean_weight")
    ).where(F.col("n_species") >= min_species)
    if edges is None:
        return agg
    e = edges.groupBy("hog").agg(F.bool_or(F.col("type") == "conserved").alias("conserved"), F.avg("effect_size").alias("mean_effect"), F.min("q_value").alias("min_q"))
    return agg.join(e, "hog", "left")
