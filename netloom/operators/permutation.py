"""Permutation tests with reproducible shuffles and sequential stopping.

A shuffle of a set is the order of ``md5(seed | draw | item)``, so it is the same on every engine and every rerun. One
shuffle of each network's genes per draw serves all groups: a group reads the genes that land on its members' slots,
which for a group alone is a uniform draw without replacement. Draws run in growing batches; groups that
have stopped take no part in later batches, and the stopping draw is the sequential one, not a batch's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import bc_support, discrete_q_values, sequential_p
from ..sources.tables import cut, spread
from . import edge_kernel as K
from .comparison import PAIR, _directed, usable_orthologs
from .network import LOCAL_GENES, Networks
from .variants import columns, fits, gene_numbers, packed


def draw_order(seed: int, draw: Column, item: Column) -> Column:
    """Sort key of an item within a draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), item))


def shuffles(items: DataFrame, by: list[str], item: str, draws: tuple[int, int], seed: int) -> DataFrame:
    """(by..., perm, item, drawn): ``drawn`` is the item on ``item``'s place in the shuffle of draw ``perm`` (first..last of ``draws``)."""
    once = items.select(*by, item).distinct()
    slot = once.withColumn("at", F.row_number().over(W.partitionBy(*by).orderBy(item)))
    drawn = spread(once.withColumn("perm", F.explode(F.sequence(F.lit(draws[0]), F.lit(draws[1])))), *by, "perm").withColumn("at", F.row_number().over(W.partitionBy(*by, "perm").orderBy(draw_order(seed, F.col("perm"), F.col(item)), item))).withColumnRenamed(item, "drawn")
    return drawn.join(slot, [*by, "at"]).drop("at") if by else drawn.join(slot, "at").drop("at")


def shuffled_ids(ids: DataFrame, draws: tuple[int, int], seed: int) -> DataFrame:
    """(species, perm, slot, drawn): the same shuffles of (species, gene, id), genes by their number in sorted order."""
    every = spread(ids.withColumn("perm", F.explode(F.sequence(F.lit(draws[0]), F.lit(draws[1])))), "species", "perm")
    order = W.partitionBy("species", "perm").orderBy(draw_order(seed, F.col("perm"), F.col("gene")), "gene")
    return every.select("species", "perm", F.row_number().over(order).alias("slot"), F.col("id").alias("drawn"))


def batches(most: int, first: int = 200, growth: int = 4) -> list[tuple[int, int]]:
    """Draw ranges 1..first, then growing."""
    out, at, size = [], 1, first
    while at <= most:
        out.append((at, min(most, at + size - 1)))
        at, size = at + size, size * growth
    return out


def fold_enrichment(nets: Networks, orthologs: DataFrame) -> DataFrame:
    """Sparse (sp1, sp2, a, b, fe): x/E of both directions added, E = m k / n; pairs without overlap are absent.

    A sparse product as join and count: neighbours of ``a`` meet the genes reachable from ``b`` on the shared gene.
    """
    nbr = cut(nets.neighbours().select("species", "g", "nb"))
    d = _directed(usable_orthologs(orthologs, nets.genes)).select("d", *PAIR, "sa", "so", "a", "o").distinct()
    mapped = cut(nbr.select(F.col("species").alias("so"), F.col("nb").alias("o"), F.col("g").alias("og")).join(d, ["so", "o"]).select("d", *PAIR, "sa", F.col("og").alias("o"), F.col("a").alias("member")).distinct())
    k = mapped.groupBy("d", *PAIR, "o").agg(F.count("*").alias("k"))
    m = nbr.groupBy(F.col("species").alias("sa"), F.col("g").alias("a")).agg(F.count("*").alias("m"))
    n = nets.sizes().select(F.col("species").alias("sa"), F.col("n_genes").alias("n"))
    hit = mapped.join(nbr.select(F.col("species").alias("sa"), F.col("g").alias("a"), F.col("nb").alias("member")), ["sa", "member"]).groupBy("d", *PAIR, "sa", "a", "o").agg(F.count("*").alias("x"))
    t = hit.join(k, ["d", *PAIR, "o"]).join(m, ["sa", "a"]).join(n, "sa").withColumn("f", F.col("x") / (F.col("m") * F.col("k") / F.col("n")))
    one = F.col("d") == 1
    return t.groupBy(*PAIR, F.when(one, F.col("a")).otherwise(F.col("o")).alias("a"), F.when(one, F.col("o")).otherwise(F.col("a")).alias("b")).agg(
        F.coalesce(F.max(F.when(one, F.col("f"))), F.lit(0.0)).alias("f1"), F.coalesce(F.max(F.when(~one, F.col("f"))), F.lit(0.0)).alias("f2")
    ).select(*PAIR, "a", "b", (F.col("f1") + F.col("f2")).alias("fe"))


def _draws_by_joins(nets: Networks, orthologs: DataFrame, rows: DataFrame, alternative: str, min_exceedances: int, ranges: list[tuple[int, int]], seed: int) -> tuple[DataFrame, DataFrame]:
    """(sp1, sp2, hog, t_obs) and (sp1, sp2, hog, n_perm, n_exceed, p_value): a draw's genes and enrichments meet in joins."""
    # genes go by their place in the sorted names of their species: narrow keys, and a slot's number is its place
    ids = cut(nets.genes.select("species", "gene").distinct().withColumn("id", F.row_number().over(W.partitionBy("species").orderBy("gene"))))
    side = lambda sp, g, to: ids.select(F.col("species").alias(sp), F.col("gene").alias(g), F.col("id").alias(to))
    fe = cut(fold_enrichment(nets, orthologs).withColumnsRenamed({"a": "ga", "b": "gb"}).join(side("sp1", "ga", "a"), ["sp1", "ga"]).join(side("sp2", "gb", "b"), ["sp2", "gb"]).select(*PAIR, "a", "b", "fe"))
    key = [*PAIR, "hog"]
    one = rows.join(side("sp1", "gene1", "s1"), ["sp1", "gene1"]).select(*key, "s1").distinct()
    two = rows.join(side("sp2", "gene2", "s2"), ["sp2", "gene2"]).select(*key, "s2").distinct()
    slots = cut(one.join(two, key))
    total = lambda df, by: df.groupBy(*by).agg(F.round(F.sum(F.coalesce("fe", F.lit(0.0))), 9).alias("t"))
    obs = cut(total(slots.join(fe.select(*PAIR, F.col("a").alias("s1"), F.col("b").alias("s2"), "fe"), [*PAIR, "s1", "s2"], "left"), key).withColumnRenamed("t", "t_obs"))
    active = obs.where("t_obs > 0") if alternative == "greater" else obs
    flags: DataFrame | None = None
    for lo, hi in ranges:
        live = cut(slots.join(active.select(*key), key, "left_semi"))
        wanted = live.select(F.col("sp1").alias("species"), F.col("s1").alias("slot")).unionByName(live.select(F.col("sp2").alias("species"), F.col("s2").alias("slot"))).distinct()
        sh = cut(shuffled_ids(ids.join(wanted.select("species").distinct(), "species", "left_semi"), (lo, hi), seed).join(wanted, ["species", "slot"], "left_semi"))
        drawn = (
            live.join(sh.select(F.col("species").alias("sp1"), F.col("slot").alias("s1"), "perm", F.col("drawn").alias("a")), ["sp1", "s1"])
            .join(sh.select(F.col("species").alias("sp2"), F.col("slot").alias("s2"), "perm", F.col("drawn").alias("b")), ["sp2", "s2", "perm"])
            .join(fe, [*PAIR, "a", "b"], "left")
        )
        t = total(drawn, [*key, "perm"]).join(obs, key)
        f = cut(t.select(*key, "perm", (F.col("t") >= F.col("t_obs") if alternative == "greater" else F.col("t") <= F.col("t_obs")).alias("exceed")))
        flags = f if flags is None else flags.unionByName(f)
        if hi == ranges[-1][1]:
            break
        going = flags.groupBy(*key).agg(F.count_if("exceed").alias("e")).where(F.col("e") < min_exceedances)
        active = cut(active.join(going.select(*key), key, "left_semi"))
        if active.isEmpty():
            break
    return obs, sequential_p(flags, key, "perm", "exceed", min_exceedances)


def _block(seed: int, alternative: str, h: int):
    """Arrow function: t_obs and the first h exceeding draws of every group over one block of draws."""
    out = pa.schema([("sp1", pa.string()), ("sp2", pa.string()), ("hog", pa.string()), ("t_obs", pa.float64()), ("draws", pa.list_(pa.int32()))])

    def run(groups: pa.Table, nets: pa.Table) -> pa.Table:
        if not groups.num_rows:
            return out.empty_table()
        first, last = groups["first"][0].as_py(), groups["last"][0].as_py()
        species, other = nets["species"].to_pylist(), nets["other"].to_pylist()
        at = {(s, o): r for r, (s, o) in enumerate(zip(species, other))}
        groups = groups.sort_by([(c, "ascending") for c in PAIR])
        pairs = list(zip(groups["sp1"].to_pylist(), groups["sp2"].to_pylist()))
        perms: dict[str, np.ndarray] = {}
        sides: dict[str, K.Side] = {}
        for s in sorted({s for p in pairs for s in p}):
            r = at[s, None]
            names, inside = nets["names"][r].as_py(), nets["inside"][r].as_py()
            items = [x.encode() for x in names[:inside]]
            perms[s] = np.stack([np.arange(inside), *(K.shuffle(seed, v, items) for v in range(first, last + 1))]).astype(np.int32)  # row 0: as observed
            sides[s] = K.Side(len(names), nets["n"][r].as_py(), *columns(nets, "edges", r))
        tables, lo = [], 0
        while lo < len(pairs):
            p = sp1, sp2 = pairs[lo]
            hi = next((i for i in range(lo, len(pairs)) if pairs[i] != p), len(pairs))
            part = groups.slice(lo, hi - lo).combine_chunks()
            slots = part["slots"].chunk(0)
            s1, s2 = (c.to_numpy(zero_copy_only=False) for c in slots.flatten().flatten())
            starts = np.r_[0, np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))[:-1]]
            bridge = columns(nets, "edges", at[p]) if p in at else [np.zeros(0, np.int64)] * 2
            fe = K.fold_enrichment(sides[sp1], sides[sp2], bridge)
            width, flat, a, b = fe.shape[1], fe.ravel(), perms[sp1], perms[sp2]
            step = max(1, 2_000_000 // len(s1))
            total = lambda d: np.round(np.add.reduceat(flat[a[d][:, s1].astype(np.int64) * width + b[d][:, s2]], starts, axis=1), 9)
            t_obs = total(slice(0, 1))[0]
            near = [t >= t_obs if alternative == "greater" else t <= t_obs for t in (total(slice(i, i + step)) for i in range(1, len(a), step))]
            g, v = np.nonzero(np.concatenate(near).T & ((t_obs > 0) | (alternative != "greater"))[:, None])
            begin = np.searchsorted(g, np.arange(hi - lo))
            kept = np.arange(len(g)) - begin[g] < h  # draws ascend within a group
            ends = np.r_[0, np.cumsum(np.bincount(g[kept], minlength=hi - lo))].astype(np.int32)
            tables.append(pa.Table.from_arrays([part["sp1"], part["sp2"], part["hog"], pa.array(t_obs), pa.ListArray.from_arrays(pa.array(ends), pa.array((v[kept] + first).astype(np.int32)))], schema=out))
            lo = hi
        return pa.concat_tables(tables)

    return run


def _draws_in_tasks(nets: Networks, orthologs: DataFrame, rows: DataFrame, alternative: str, min_exceedances: int, ranges: list[tuple[int, int]], seed: int) -> tuple[DataFrame, DataFrame]:
    """As ``_draws_by_joins``: a task holds the networks, one species pair's enrichments at a time, and takes a block of draws of all groups."""
    spark, key, h = rows.sparkSession, [*PAIR, "hog"], min_exceedances
    t = nets.thresholds.select("species", "threshold")
    kept = cut(nets.weights.join(F.broadcast(t), "species").where(F.col("w") >= F.col("threshold")).select("species", "i", "j"))
    ids = gene_numbers(nets.genes, kept)
    side = lambda sp, g, to: ids.where(F.col("c") > 0).select(F.col("species").alias(sp), F.col("gene").alias(g), F.col("id").alias(to))
    one = rows.join(side("sp1", "gene1", "s1"), ["sp1", "gene1"]).select(*key, "s1").distinct()
    two = rows.join(side("sp2", "gene2", "s2"), ["sp2", "gene2"]).select(*key, "s2").distinct()
    slots = cut(one.join(two, key).groupBy(*key).agg(F.collect_list(F.struct("s1", "s2")).alias("slots")))
    bridge = usable_orthologs(orthologs, nets.genes).select(*PAIR, "gene1", "gene2").distinct().join(side("sp1", "gene1", "a"), ["sp1", "gene1"]).join(side("sp2", "gene2", "b"), ["sp2", "gene2"])
    bridge = bridge.groupBy(F.col("sp1").alias("species"), F.col("sp2").alias("other")).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    data = cut(packed(kept, ids).withColumn("other", F.lit(None).cast("string")).unionByName(bridge, allowMissingColumns=True))
    active, found = slots, None
    for lo, hi in ranges:
        # every block computes the enrichments again, so blocks aren't small
        size = max(100, -(-(hi - lo + 1) // (2 * spark.sparkContext.defaultParallelism)))
        blocks = [(b, b, min(hi, b + size - 1)) for b in range(lo, hi + 1, size)]
        each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(b, ("block", "first", "last"))]) for b in blocks])).alias("x")
        left = active.select(*[F.col(c).alias(c) for c in active.columns], each).select(*active.columns, "x.*")
        right = data.select(*[F.col(c).alias(c) for c in data.columns], each).select(*data.columns, "x.block")
        f = cut(spread(left, "block").groupBy("block").cogroup(spread(right, "block").groupBy("block")).applyInArrow(_block(seed, alternative, h), "sp1 string, sp2 string, hog string, t_obs double, draws array<int>"))
        found = f if found is None else found.unionByName(f)
        if hi == ranges[-1][1]:
            break
        going = found.groupBy(*key).agg(F.sum(F.size("draws")).alias("e"), F.max("t_obs").alias("t")).where((F.col("e") < h) & ((F.col("t") > 0) | F.lit(alternative != "greater")))
        active = cut(active.join(going.select(*key), key, "left_semi"))
        if active.isEmpty():
            break
    g = cut(found.groupBy(*key).agg(F.max("t_obs").alias("t_obs"), F.array_sort(F.flatten(F.collect_list("draws"))).alias("draws")))
    tested = g if alternative != "greater" else g.where("t_obs > 0")
    e = F.least(F.size("draws"), F.lit(h))
    n = F.when(F.size("draws") >= h, F.get("draws", F.lit(h - 1))).otherwise(F.lit(ranges[-1][1]))  # what hasn't stopped took all draws
    return g.select(*key, "t_obs"), tested.select(*key, n.cast("int").alias("n_perm"), e.cast("int").alias("n_exceed"), ((e + 1) / (n + 1)).alias("p_value"))


def permutation_hog_test(nets: Networks, orthologs: DataFrame, comparison: DataFrame, alternative: str = "greater", min_exceedances: int = 50, max_permutations: int = 10_000, seed: int = 1, first_batch: int = 200, local_genes: int = LOCAL_GENES) -> DataFrame:
    """Group test: sp1, sp2, hog, n_pairs, n_sp1, n_sp2, t_obs, n_perm, n_exceed, mean_eff, p_value, q_value.

    t_obs sums the fold enrichment over all gene pairs of the group; a draw exceeds if its sum is at least (greater) or
    at most (less) t_obs, sums rounded to 9 places. q-values are taken within a species pair. A group with t_obs <= 0 has p 1 and no draws (greater). Comparison rows
    whose genes aren't in the networks are left out. Draws are computed in tasks that hold networks as matrices (``_draws_in_tasks``),
    for species above ``local_genes`` as joins (``_draws_by_joins``).
    """
    if alternative not in ("greater", "less"):
        raise ValueError("alternative must be greater or less")
    rows = comparison
    for sp, g in (("sp1", "gene1"), ("sp2", "gene2")):
        rows = rows.join(nets.genes.select(F.col("species").alias(sp), F.col("gene").alias(g)), [sp, g], "left_semi")
    rows = cut(rows)
    key = [*PAIR, "hog"]
    run = _draws_in_tasks if min_exceedances > 0 and fits(nets, local_genes) else _draws_by_joins
    obs, p = run(nets, orthologs, rows, alternative, min_exceedances, batches(max_permutations, first_batch), seed)
    info = rows.groupBy(*key).agg(F.count("*").alias("n_pairs"), F.countDistinct("gene1").alias("n_sp1"), F.countDistinct("gene2").alias("n_sp2"), F.avg(F.sqrt(F.col("sp1_effect") * F.col("sp2_effect"))).alias("mean_eff"))
    out = cut(info.join(obs, key).join(p, key, "left").fillna(0, ["n_perm", "n_exceed"]).fillna(1.0, ["p_value"]))
    return discrete_q_values(out, PAIR, "p_value", "q_value", bc_support(min_exceedances, max_permutations))


def permutation_edges(comparison: DataFrame, tests: DataFrame, alternative: str = "greater", alpha: float = 0.05) -> DataFrame:
    """Edges of the permutation method: every pair takes its group's q, joined by group; 'ns' where it has none."""
    hit = "conserved" if alternative == "greater" else "diverged"
    e = comparison.join(tests.select(*PAIR, "hog", "q_value"), [*PAIR, "hog"], "left")
    return e.select(
        "gene1", "gene2", F.col("sp1").alias("species1"), F.col("sp2").alias("species2"), "hog", "q_value", F.sqrt(F.col("sp1_effect") * F.col("sp2_effect")).alias("effect_size"),
        F.sqrt(F.col("sp1_jaccard") * F.col("sp2_jaccard")).alias("jaccard"), F.when(F.col("q_value") < alpha, hit).otherwise("ns").alias("type"))


def tag_permutation(classification: DataFrame, modules: DataFrame, orthologs: DataFrame, contrasts: DataFrame, traits: DataFrame, target: str, n_perm: int = 1000, min_recurrence: int = 2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Do the same groups recur in species-specific modules on the target trait's side more often than with shuffled traits?

    classification is (pair_name, module, species = 'sp1'|'sp2', classification), modules (species, gene, module),
    contrasts (pair_name, sp1, sp2). A contrast contributes the side that has the target trait if exactly one side has it.
    Returns (test, recurrence): one row n_observed, n_perm, n_exceed, p_value = (n_exceed + 1)/(n_perm + 1), and
    (hog, n_contrasts) for groups of at least min_recurrence contrasts. A gene of several groups counts for the least name.
    """
    side = F.explode(F.array(F.struct(F.lit("sp1").alias("side"), F.col("sp1").alias("species")), F.struct(F.lit("sp2").alias("side"), F.col("sp2").alias("species"))))
    sides = cut(contrasts.select("pair_name", side.alias("x")).select("pair_name", "x.side", "x.species"))
    gene = F.explode(F.array(F.struct(F.col("sp1").alias("species"), F.col("gene1").alias("gene")), F.struct(F.col("sp2").alias("species"), F.col("gene2").alias("gene"))))
    hogs = orthologs.select("hog", gene.alias("x")).select("x.species", "x.gene", "hog").groupBy("species", "gene").agg(F.min("hog").alias("hog"))
    specific = classification.where(F.col("classification") == "species_specific").select("pair_name", F.col("species").alias("side"), "module")
    pool = cut(specific.join(sides, ["pair_name", "side"]).join(modules, ["species", "module"]).join(hogs, ["species", "gene"]).select("pair_name", "side", "hog").distinct())

    def recurring(labels: DataFrame, by: list[str]) -> DataFrame:
        s = sides.join(labels, "species").withColumn("hit", F.col("trait") == target)
        one = s.groupBy(*by, "pair_name").agg(F.count_if("hit").alias("n"), F.max(F.when(F.col("hit"), F.col("side"))).alias("side")).where("n = 1")
        return one.join(pool, ["pair_name", "side"]).groupBy(*by, "hog").agg(F.count("*").alias("n_contrasts")).where(F.col("n_contrasts") >= min_recurrence)

    observed = cut(recurring(traits, []))
    n_obs = observed.count()
    sh = shuffles(traits, [], "species", (1, n_perm), seed)
    labels = sh.join(traits.select(F.col("species").alias("drawn"), "trait"), "drawn").select("perm", "species", "trait")
    null = recurring(labels, ["perm"]).groupBy("perm").agg(F.count("*").alias("n"))
    e = null.agg(F.count_if(F.col("n") >= n_obs).cast("int").alias("e"))
    n_exceed = F.col("e") if n_obs else F.lit(n_perm)  # a draw without recurring groups reaches 0
    test = e.select(F.lit(n_obs).alias("n_observed"), F.lit(n_perm).alias("n_perm"), n_exceed.alias("n_exceed"), ((n_exceed + 1) / F.lit(n_perm + 1)).alias("p_value"))
    return test, observed
