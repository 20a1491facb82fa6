"""Cliques of conserved edges across species, and how robust they are.

Groups are small and independent: the search of a group is one call of the kernel inside an Arrow task, everything
around it (best edge per gene pair, gene cap, matching, robustness) is DataFrame work. A variant of the data (a
threshold multiplier, a noise replicate, a permutation) is a grouping key, never a loop of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import cut, spread
from . import clique_kernel as K, variants as V
from .comparison import find_coexpressologs
from .network import LOCAL_GENES, Networks, both_ways

STATS = "n_species int, mean_q double, max_q double, mean_effect_size double, n_edges int, n_missing int, intensity double, coherence double, min_effect_size double"
STAT_NAMES = [c.split()[0] for c in STATS.split(", ")]
EDGE = ["gene1", "gene2", "species1", "species2", "hog", "q_value", "effect_size"]


def best_edges(edges: DataFrame, species: list[str], keys: list[str], max_genes: int | None, types: list[str] | None, weights: tuple[float, float]) -> DataFrame:
    """One row per unordered gene pair of a group (least w_q q - w_eff effect, then q), with ``within_cap``.

    The cap keeps the max_genes genes of a species with most pairs in the group, ties by name; None keeps all.
    """
    e = edges.where(F.col("species1").isin(species) & F.col("species2").isin(species) & (F.col("species1") != F.col("species2")))
    if types is not None and "type" in e.columns:
        e = e.where(F.col("type").isin(types))
    a, b = F.struct(F.col("gene1").alias("g"), F.col("species1").alias("s")), F.struct(F.col("gene2").alias("g"), F.col("species2").alias("s"))
    e = e.where(F.col("q_value").isNotNull()).select(*keys, "hog", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("q_value").alias("q"), F.coalesce("effect_size", F.lit(0.0)).alias("eff"))
    cost = weights[0] * F.col("q") - weights[1] * F.col("eff")
    by = [*keys, "hog"]
    one = e.groupBy(*by, "a", "b").agg(F.min(F.struct(cost.alias("c"), "q", "eff")).alias("m")).select(*by, "a", "b", "m.q", "m.eff")
    if max_genes is None:
        return one.select(*by, F.col("a.g").alias("gene1"), F.col("a.s").alias("species1"), F.col("b.g").alias("gene2"), F.col("b.s").alias("species2"), "q", "eff", F.lit(True).alias("within_cap"))
    end = F.explode(F.array("a", "b"))
    links = one.select(*by, end.alias("x")).groupBy(*by, "x").agg(F.count("*").alias("n"))
    top = links.withColumn("_k", F.row_number().over(W.partitionBy(*by, "x.s").orderBy(F.desc("n"), "x.g"))).where(F.col("_k") <= max_genes).select(*by, "x", F.lit(True).alias("in"))
    side = lambda c: top.select(*by, F.col("x").alias(c), F.col("in").alias(f"in_{c}"))
    t = one.join(side("a"), [*by, "a"], "left").join(side("b"), [*by, "b"], "left")
    return t.select(*by, F.col("a.g").alias("gene1"), F.col("a.s").alias("species1"), F.col("b.g").alias("gene2"), F.col("b.s").alias("species2"), "q", "eff", (F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("within_cap"))


_ROW = ["gene1", "species1", "gene2", "species2", "q", "eff", "within_cap"]


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return list(pdf[_ROW].sort_values(["gene1", "gene2"]).itertuples(index=False, name=None))


def _check(species: list[str], least: int) -> None:
    if len(species) < 2:
        raise ValueError("needs at least two species")
    if not 2 <= least <= len(species):
        raise ValueError("min_species must be between 2 and the number of species")


def find_cliques(edges: DataFrame, species: list[str], min_species: int | None = None, max_genes: int = 10, max_missing: int = 0, types: list[str] | None = ("conserved",), weights: tuple[float, float] = (1.0, 0.0), keys: list[str] = ()) -> DataFrame:
    """(keys..., hog, clique, genes, statistics...): ``genes`` holds one gene or null per species, species sorted.

    clique numbers a group's cliques from 1 (by species set). Edges of other species or types, and rows with a null q,
    take no part; no edges give an empty table. A species set without a feasible gene assignment gives no clique.
    """
    names, keys = sorted(species), list(keys)
    least = min_species or len(names)
    _check(names, least)
    e = best_edges(edges, names, keys, max_genes, None if types is None else list(types), weights)
    kinds = dict(e.dtypes)

    by = [*keys, "hog"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []

        def close(key: tuple, rows: list[tuple]) -> None:
            found = K.group_cliques(rows, least, max_missing, weights) if len({s for r in rows for s in (r[1], r[3])}) >= least else []
            done.extend([*key, n, [g.get(s) for s in names], *[st[c] for c in STAT_NAMES]] for n, (g, st) in enumerate(found, 1))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(arrow)], schema=arrow)
            done.clear()
            return out

        last, rows = None, []
        for b in batches:
            for *key, row in zip(*[b.column(k).to_pylist() for k in range(len(by))], zip(*[b.column(k).to_pylist() for k in range(len(by), b.num_columns)])):
                if key != last:
                    if rows:
                        close(last, rows)
                    last, rows = key, []
                rows.append(row)
            yield flush()
        if rows:
            close(last, rows)
        yield flush()

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["hog string", "clique int", "genes array<string>", STATS])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    # groups lie together in their partition, rows by genes: one call takes all groups of a partition
    return spread(e, *by).sortWithinPartitions(*by, "gene1", "gene2").select(*by, *_ROW).mapInArrow(run, schema)


def wide(cliques: DataFrame, species: list[str]) -> DataFrame:
    """Genes as one column per species."""
    names = sorted(species)
    rest = [c for c in cliques.columns if c not in ("genes", "clique")]
    return cliques.select(*rest, *[F.col("genes")[k].alias(s) for k, s in enumerate(names)])


def slot_jaccard(a: str, b: str) -> Column:
    """Share of the slots occupied in either array that hold the same gene."""
    z = F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))
    used = F.size(F.filter(z, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    same = F.size(F.filter(z, lambda p: p["x"] == p["y"]))
    return F.when(used > 0, same / F.greatest(used, F.lit(1))).otherwise(0.0)


def clique_stability(edges: DataFrame, species: list[str], cliques: DataFrame, all_species: list[str] | None = None, max_k: int | None = None, max_genes: int = 10, jaccard_threshold: float = 0.8, types: list[str] | None = ("conserved",), weights: tuple[float, float] = (1.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(tests, novel): leave-k-species-out stability of cliques.

    tests: hog, clique, removed (species names), k, stable - one row per clique and removed set that leaves at least two of
    its species. Cliques are searched again without the removed species (at least 2 species, no missing edges); stable if some
    has slot jaccard >= threshold over the remaining species. novel: hog, removed, n_novel: cliques that no full clique took.
    """
    names, every = sorted(species), sorted(all_species or species)
    most = max_k if max_k is not None else max(1, len(every) - 2)
    if not 1 <= most < len(every):
        raise ValueError("max_k must be at least 1 and below the number of species")
    if not set(names) <= set(every):
        raise ValueError("species must be among all_species")
    masks = [",".join(c) for k in range(1, most + 1) for c in combinations(every, k)]
    removed = F.explode(F.array(*map(F.lit, masks)))
    hogs = cliques.select("hog").distinct()
    e = best_edges(edges, names, [], None, None if types is None else list(types), weights).join(hogs, "hog", "left_semi").withColumn("removed", removed)
    c = cliques.select("hog", "clique", "genes").withColumn("removed", removed)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hog, out = key[0], set(key[1].split(","))
        active = set(names) - out
        rows = _rows(left)
        reduced = [g for g, _ in K.group_cliques(_capped(rows, active, max_genes), 2, 0, weights, active)] if len(active) > 1 else []
        taken, res = set(), []
        keep = [i for i, s in enumerate(names) if s in active]
        for r in right.sort_values("clique").itertuples():
            full = [r.genes[i] for i in keep]
            if sum(g is not None for g in full) < 2:
                continue
            hit = next((n for n, g in enumerate(reduced) if K.slot_jaccard(full, [g.get(names[i]) for i in keep]) >= jaccard_threshold), None)
            if hit is not None:
                taken.add(hit)
            res.append([hog, int(r.clique), key[1], len(out), hit is not None, 0])
        if res:
            res.append([hog, None, key[1], len(out), None, len(reduced) - len(taken)])
        return pd.DataFrame(res, columns=["hog", "clique", "removed", "k", "stable", "n_novel"]).astype({"clique": "Int32", "stable": "boolean"})

    t = cut(spread(e, "hog", "removed").groupBy("hog", "removed").cogroup(spread(c, "hog", "removed").groupBy("hog", "removed")).applyInPandas(run, "hog string, clique int, removed string, k int, stable boolean, n_novel int"))
    return t.where(F.col("clique").isNotNull()).drop("n_novel"), t.where(F.col("clique").isNull()).select("hog", "removed", "n_novel")


def _capped(rows: list[tuple], active: set[str], most: int) -> list[tuple]:
    """Rows among active species with the gene cap taken anew."""
    live = [r for r in rows if r[1] in active and r[3] in active]
    links: dict[tuple[str, str], int] = {}
    for r in live:
        for s, g in ((r[1], r[0]), (r[3], r[2])):
            links[s, g] = links.get((s, g), 0) + 1
    seen: dict[str, int] = {}
    kept = set()
    for (s, g), _ in sorted(links.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        seen[s] = seen.get(s, 0) + 1
        if seen[s] <= most:
            kept.add((s, g))
    return [(*r[:6], (r[1], r[0]) in kept and (r[3], r[2]) in kept) for r in live]


def stability_scores(tests: DataFrame) -> DataFrame:
    """Per clique: n_tested, n_stable, score, and stability_class: the largest k such that all tests up to k were stable (each k tested)."""
    by = tests.groupBy("hog", "clique", "k").agg(F.count("*").alias("t"), F.count_if("stable").alias("s"))
    first_bad = F.min(F.when(F.col("s") < F.col("t"), F.col("k")))
    g = by.groupBy("hog", "clique").agg(F.sum("t").alias("n_tested"), F.sum("s").alias("n_stable"), first_bad.alias("bad"), F.array_sort(F.collect_set("k")).alias("ks"))
    run = F.aggregate("ks", F.lit(0), lambda a, k: F.when(k == a + 1, k).otherwise(a))
    return g.select("hog", "clique", "n_tested", "n_stable", (F.col("n_stable") / F.col("n_tested")).alias("score"), F.least(run, F.coalesce(F.col("bad") - 1, run)).cast("int").alias("stability_class"))


def species_disruption(tests: DataFrame) -> DataFrame:
    """Per removed single species: number of cliques it breaks."""
    return tests.where("k = 1").groupBy(F.col("removed").alias("species")).agg(F.count_if(~F.col("stable")).alias("n_cliques_disrupted"))


def annotate_traits(cliques: DataFrame, species: list[str], traits: DataFrame) -> DataFrame:
    """(hog, clique, species_present, traits, sole_rep): sole_rep if the only trait has a single target species.

    Of a species listed with several traits the least counts; species without a trait add none.
    """
    of = traits.where(F.col("species").isin(list(species)) & F.col("trait").isNotNull()).groupBy("species").agg(F.min("trait").alias("trait"))
    x = _slots(cliques, species).join(F.broadcast(of), "species", "left")  # at most one row per given species
    count = of.groupBy("trait").agg(F.count("*").alias("n_of_trait"))
    g = x.join(F.broadcast(count), "trait", "left").groupBy("hog", "clique").agg(F.array_join(F.array_sort(F.collect_set("species")), ",").alias("species_present"), F.array_join(F.array_sort(F.collect_set("trait")), ",").alias("traits"), F.countDistinct("trait").alias("n"), F.min("n_of_trait").alias("m"))
    return g.select("hog", "clique", "species_present", "traits", ((F.col("n") == 1) & (F.col("m") == 1)).alias("sole_rep"))


def _slots(cliques: DataFrame, species: list[str]) -> DataFrame:
    """(hog, clique, species, gene) of the occupied slots."""
    names = sorted(species)
    s = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("species"), F.col("genes").alias("gene")))
    return cliques.select("hog", "clique", s.alias("x")).select("hog", "clique", "x.species", "x.gene").where(F.col("gene").isNotNull())


def clique_persistence(cliques: DataFrame, species: list[str], nets: Networks, edges: DataFrame) -> DataFrame:
    """(hog, clique, persistence, mean_persistence): how far thresholds could rise before co-expressologs of the clique vanish.

    Of each pair of clique genes, co-expressologs are edges (either orientation, any type) between their neighbours; a ratio is the lesser
    of the two weights over their thresholds; persistence is the least and the mean of all ratios, null without any.
    """
    s = _slots(cliques, species)
    a = s.select("hog", "clique", F.col("species").alias("sa"), F.col("gene").alias("ga"))
    b = s.select("hog", "clique", F.col("species").alias("sb"), F.col("gene").alias("gb"))
    pairs = a.join(b, ["hog", "clique"]).where("sa < sb")
    t = nets.thresholds.select("species", "threshold")
    nbr = cut(nets.neighbours().join(F.broadcast(t), "species").select("species", "g", "nb", (F.col("w") / F.col("threshold")).alias("r")))
    e1 = edges.select(F.col("species1").alias("sa"), F.col("gene1").alias("x"), F.col("species2").alias("sb"), F.col("gene2").alias("y"))
    e2 = edges.select(F.col("species2").alias("sa"), F.col("gene2").alias("x"), F.col("species1").alias("sb"), F.col("gene1").alias("y"))
    e = e1.unionByName(e2).where("sa < sb").distinct()
    na = nbr.select(F.col("species").alias("sa"), F.col("g").alias("ga"), F.col("nb").alias("x"), F.col("r").alias("ra"))
    nb = nbr.select(F.col("species").alias("sb"), F.col("g").alias("gb"), F.col("nb").alias("y"), F.col("r").alias("rb"))
    hit = pairs.join(na, ["sa", "ga"]).join(e, ["sa", "sb", "x"]).join(nb, ["sb", "gb", "y"]).groupBy("hog", "clique").agg(F.min(F.least("ra", "rb")).alias("persistence"), F.avg(F.least("ra", "rb")).alias("mean_persistence"))
    return cliques.select("hog", "clique").join(hit, ["hog", "clique"], "left")


def variant_edges(kept: DataFrame, genes: DataFrame, orthologs: DataFrame, variants: list, alpha: float) -> DataFrame:
    """Analytical edges of every variant in one plan, with a ``variant`` column.

    kept: thresholded (variant, species, i, j, w); orthologs may have a ``variant`` column or serve all variants. Species
    names carry the variant while they pass through the comparison.
    """
    name = lambda c: F.concat_ws("@", F.col(c), F.col("variant").cast("string"))
    every = F.explode(F.array(*map(F.lit, variants)))
    g = genes.withColumn("variant", every).select(name("species").alias("species"), "gene")
    o = (orthologs if "variant" in orthologs.columns else orthologs.withColumn("variant", every)).withColumns({"sp1": name("sp1"), "sp2": name("sp2")})
    w = both_ways(kept.withColumn("species", name("species")), "w")
    e = find_coexpressologs(Networks(w, w, g, {}), o, alpha=alpha, neighbours=w)
    kind = kept.schema["variant"].dataType
    return e.withColumn("variant", F.split("species1", "@")[1].cast(kind)).withColumns({c: F.split(F.col(c), "@")[0] for c in ("species1", "species2")})


def _matched(base: DataFrame, found: DataFrame) -> DataFrame:
    """(hog, clique, variant, jaccard, intensity) of the best match of each baseline clique among the variant's cliques of its group."""
    x = base.select("hog", "clique", "genes").join(found.select("variant", "hog", F.col("genes").alias("other"), F.col("intensity").alias("i2")), "hog")
    return x.withColumn("jaccard", slot_jaccard("genes", "other")).groupBy("hog", "clique", "variant").agg(F.max(F.struct("jaccard", "i2")).alias("m")).select("hog", "clique", "variant", "m.jaccard", F.col("m.i2").alias("intensity"))


def clique_threshold_sweep(cliques: DataFrame, species: list[str], nets: Networks, orthologs: DataFrame, multipliers: list[float] = (1.5, 2.0, 3.0, 5.0, 10.0), jaccard_threshold: float = 0.5, alpha: float = 0.05, min_species: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(survival, life): cliques at raised thresholds.

    survival: hog, clique, multiplier, jaccard, survived, with multiplier 1 as baseline. life: birth (1), death (first
    multiplier not survived, null if none), persistence = death - birth.
    """
    ms = [float(m) for m in multipliers]
    base = cut(cliques)
    one = base.select("hog", "clique", F.lit(1.0).alias("multiplier"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("survived"))
    if ms:
        t = nets.thresholds.select("species", "threshold").withColumn("variant", F.explode(F.array(*map(F.lit, ms))))
        kept = cut(nets.weights.join(F.broadcast(t), "species").where(F.col("w") >= F.col("threshold") * F.col("variant")).select("variant", "species", "i", "j", "w"))
        found = find_cliques(variant_edges(kept, nets.genes, orthologs, ms, alpha), species, min_species, keys=["variant"])
        m = _matched(base, found)
        grid = base.select("hog", "clique").withColumn("variant", F.explode(F.array(*map(F.lit, ms)))).join(m, ["hog", "clique", "variant"], "left")
        j = F.coalesce("jaccard", F.lit(0.0))
        one = one.unionByName(grid.select("hog", "clique", F.col("variant").alias("multiplier"), j.alias("jaccard"), (F.col("jaccard").isNotNull() & (j >= jaccard_threshold)).alias("survived")))
    survival = cut(one)
    life = survival.groupBy("hog", "clique").agg(F.lit(1.0).alias("birth"), F.min(F.when(~F.col("survived"), F.col("multiplier"))).alias("death")).withColumn("persistence", F.col("death") - F.col("birth"))
    return survival, life


#: Greatest value of :func:`gaussian`: sqrt(-2 ln u) at the least u, 2^-53 or so.
MOST_NOISE = 8.6


def gaussian(seed: int, *cols: Column) -> Column:
    """Standard normal noise from hashes of the columns: the same on every run and partitioning."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *cols), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))


def clique_perturbation_test(cliques: DataFrame, species: list[str], nets: Networks, orthologs: DataFrame, n_boot: int = 100, noise_sd: float = 0.1, jaccard_threshold: float = 0.5, alpha: float = 0.05, seed: int = 1, min_species: int | None = None, local_genes: int = LOCAL_GENES) -> DataFrame:
    """(hog, clique, survival_rate, mean_jaccard, n_matched): cliques under noise added to every weight (clamped at 0), same thresholds.

    n_matched counts replicates with any clique of the group, mean_jaccard is over those (null if none). Replicates
    are computed in tasks that hold a species pair's networks as matrices, for species above ``local_genes`` as joins.
    """
    if noise_sd < 0:
        raise ValueError("noise_sd must not be negative")
    boots = list(range(1, n_boot + 1))
    base = cut(cliques)
    if not boots:
        return base.select("hog", "clique", F.lit(None).cast("double").alias("survival_rate"), F.lit(None).cast("double").alias("mean_jaccard"), F.lit(0).cast("bigint").alias("n_matched")).limit(0)
    # the noise has a bound (gaussian): weights too far below the threshold can't reach it in any replicate, those far above are in all
    x, bound = nets.weights.join(F.broadcast(nets.thresholds.select("species", "threshold")), "species"), MOST_NOISE * noise_sd
    noisy = F.greatest(F.lit(0.0), F.col("w") + noise_sd * gaussian(seed, F.col("variant"), F.col("species"), F.col("i"), F.col("j"))) if noise_sd else F.col("w")
    drawn = lambda near: near.withColumn("variant", F.explode(F.array(*map(F.lit, boots)))).withColumn("w", noisy).where(F.col("w") >= F.col("threshold"))
    if V.fits(nets, local_genes):
        sure = F.col("w") >= F.col("threshold") + bound
        edges = V.noisy_edges(nets, orthologs, list(species), x.where(sure), drawn(x.where(~sure & (F.col("w") >= F.col("threshold") - bound))), n_boot, alpha)
    else:
        edges = variant_edges(cut(drawn(x.where(F.col("w") >= F.col("threshold") - bound)).select("variant", "species", "i", "j", "w")), nets.genes, orthologs, boots, alpha)
    m = _matched(base, find_cliques(cut(edges.where(F.col("type") == "conserved")), species, min_species, keys=["variant"]))  # read twice
    g = m.groupBy("hog", "clique").agg((F.count_if(F.col("jaccard") >= jaccard_threshold) / n_boot).alias("survival_rate"), F.avg("jaccard").alias("mean_jaccard"), F.count("*").alias("n_matched"))
    return base.select("hog", "clique").join(g, ["hog", "clique"], "left").fillna(0.0, ["survival_rate"]).fillna(0, ["n_matched"])


def shuffled_orthologs(orthologs: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """Orthologs with the gene2 side of each species pair shuffled, for variants 1..n_perm; the other side stands in one order."""
    from .permutation import draw_order

    once = cut(orthologs.select("sp1", "sp2", "gene1", "gene2", "hog").distinct())
    left = once.withColumn("_at", F.row_number().over(W.partitionBy("sp1", "sp2").orderBy("gene1", "gene2", "hog"))).drop("gene2")
    every = spread(once.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))), "sp1", "sp2", "variant")
    order = draw_order(seed, F.col("variant"), F.concat_ws(":", "gene1", "gene2", "hog"))
    right = every.withColumn("_at", F.row_number().over(W.partitionBy("sp1", "sp2", "variant").orderBy(order, "gene1", "gene2", "hog"))).select("sp1", "sp2", "variant", "_at", "gene2")
    return right.join(left, ["sp1", "sp2", "_at"]).drop("_at")


def clique_intensity_test(cliques: DataFrame, species: list[str], nets: Networks, orthologs: DataFrame, n_perm: int = 500, alternative: str = "greater", alpha: float = 0.05, seed: int = 1, min_species: int | None = None, local_genes: int = LOCAL_GENES) -> DataFrame:
    """(hog, clique, intensity, null_mean, null_sd, z, n_matched, p_value) against cliques of shuffled orthologs.

    A null value is the intensity of the best-matching clique of the same group; z = (obs - mean)/sd, p = (b + 1)/(m + 1)
    over matched permutations, null without any. Draws are computed in tasks that hold a species pair's networks as matrices,
    for species above ``local_genes`` as joins.
    """
    base = cut(cliques)
    if n_perm and V.fits(nets, local_genes):
        edges = V.shuffled_edges(nets, orthologs, list(species), n_perm, seed, alpha)
    else:
        o = shuffled_orthologs(orthologs, n_perm, seed)  # networks are the same in all draws: their edges aren't copied
        edges = find_coexpressologs(nets, o, alpha=alpha, keys=["variant"])
    drawn = cut(edges.where(F.col("type") == "conserved").join(base.select("hog").distinct(), "hog", "left_semi"))  # conserved edges of groups with cliques, read twice
    m = _matched(base, find_cliques(drawn, species, min_species, keys=["variant"])).withColumnRenamed("intensity", "null_i")
    x = m.join(base.select("hog", "clique", "intensity"), ["hog", "clique"])
    b = F.col("null_i") >= F.col("intensity") if alternative == "greater" else F.col("null_i") <= F.col("intensity")
    g = x.groupBy("hog", "clique").agg(F.avg("null_i").alias("null_mean"), F.stddev_samp("null_i").alias("null_sd"), F.count("null_i").alias("n_matched"), F.count_if(b).alias("b"))
    t = base.select("hog", "clique", "intensity").join(g, ["hog", "clique"], "left").fillna(0, ["n_matched"])
    z = F.when(F.col("null_sd") > 0, (F.col("intensity") - F.col("null_mean")) / F.col("null_sd"))
    return t.select("hog", "clique", "intensity", "null_mean", "null_sd", z.alias("z"), "n_matched", F.when(F.col("n_matched") > 0, (F.col("b") + 1) / (F.col("n_matched") + 1)).alias("p_value"))


def classify_cliques(edges: DataFrame, species: list[str], traits: dict[str, str], min_species: int = 2, max_genes: int = 10, max_missing: int = 0, types: tuple[str, ...] = ("conserved",), stability: DataFrame | None = None, life: DataFrame | None = None, min_stability_class: int = 0, min_persistence: float = 1.0) -> DataFrame:
    """(hog, classification, n_species, best_mean_q, trait_groups[, stability_class, persistence, robust]) of every group in ``edges``.

    complete: a clique of all species without missing edges; partial: a clique over two traits; differentiated: cliques within two
    traits and no edge between traits; trait_specific: within exactly one; else unclassified. The best clique is the
    one with the least mean q. A persistence of null (never died) isn't robust.
    """
    if missing := [s for s in species if s not in traits]:
        raise ValueError(f"no trait for {missing}")
    if "type" not in edges.columns:
        raise ValueError("edges lack column type")
    names = sorted(species)
    trait_array = F.array(*[F.lit(traits[s]) for s in names])
    edges = cut(edges)  # read by every search below
    full = cut(find_cliques(edges, names, min_species, max_genes, max_missing, list(types)))
    spanned = F.array_distinct(F.filter(F.transform("genes", lambda g, i: F.when(g.isNotNull(), F.get(trait_array, i))), lambda t: t.isNotNull()))
    f = full.withColumn("complete", (F.col("n_species") == len(names)) & (F.col("n_missing") == 0)).withColumn("cross", F.size(spanned) >= 2)
    best = lambda cond: F.min(F.when(cond, F.struct("mean_q", "n_species")))
    whole = f.groupBy("hog").agg(F.bool_or("complete").alias("is_complete"), F.bool_or("cross").alias("is_cross"), best(F.col("complete")).alias("bc"), best(F.lit(True)).alias("bf"))
    trait_of = F.create_map(*[F.lit(x) for s in names for x in (s, traits[s])])
    t1, t2 = F.try_element_at(trait_of, F.col("species1")), F.try_element_at(trait_of, F.col("species2"))
    # all traits are searched at once, the trait being a key
    within = find_cliques(edges.withColumn("trait", t1).where(t1 == t2), names, min_species, max_genes, max_missing, list(types), keys=["trait"]).select("hog", "trait", "mean_q", "n_species")
    hogs = edges.select("hog").distinct()
    inner = within.groupBy("hog").agg(F.array_sort(F.collect_set("trait")).alias("in_traits"), F.min(F.struct("mean_q", "n_species")).alias("bw"))
    crossing = edges.where(F.col("type").isin(list(types)) & (t1 != t2)).select("hog").distinct().withColumn("crossing", F.lit(True))
    x = hogs.join(whole, "hog", "left").join(inner, "hog", "left").join(crossing, "hog", "left")
    n_in = F.coalesce(F.size("in_traits"), F.lit(0))
    n_in = F.when(F.col("in_traits").isNull(), 0).otherwise(n_in)
    c = F.when(F.col("is_complete"), "complete").when(F.col("is_cross"), "partial").when((n_in >= 2) & F.col("crossing").isNull(), "differentiated").when(n_in == 1, "trait_specific").otherwise("unclassified")
    x = x.withColumn("classification", c)
    b = F.when(F.col("classification") == "complete", F.col("bc")).when(F.col("classification") == "partial", F.col("bf")).when(F.col("classification") != "unclassified", F.col("bw"))
    out = x.withColumn("b", b).select("hog", "classification", F.col("b.n_species").alias("n_species"), F.col("b.mean_q").alias("best_mean_q"), F.when(F.col("classification").isin("differentiated", "trait_specific"), F.array_join("in_traits", ",")).alias("trait_groups"))
    if stability is not None:
        out = out.join(stability.groupBy("hog").agg(F.max("stability_class").alias("stability_class")), "hog", "left")
    if life is not None:
        p = life.groupBy("hog").agg(F.when(F.count_if(F.col("persistence").isNull()) == 0, F.max("persistence")).alias("persistence"))
        out = out.join(p, "hog", "left")
    if stability is not None or life is not None:
        ok = F.lit(True)
        if stability is not None:
            ok = ok & F.coalesce(F.col("stability_class") >= min_stability_class, F.lit(False))
        if life is not None:
            ok = ok & F.coalesce(F.col("persistence") >= min_persistence, F.lit(False))
        out = out.withColumn("robust", ok)
    return out
