"""Conserved edges of many variants of the data (noise replicates, shuffled orthologs), variants in Arrow tasks.

A task holds the networks of one species pair, packed, and computes a block of variants; only conserved edges leave
it, so neither neighbours nor comparison rows of a variant are ever written. For species of up to LOCAL_GENES genes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.tables import cut, spread
from . import edge_kernel as K
from .comparison import PAIR
from .network import LOCAL_GENES, Networks

#: Variants that a task computes of one species pair.
BLOCK = 20


def fits(nets: Networks, most: int = LOCAL_GENES) -> bool:
    """Are all species small enough for their networks to be matrices in a task?"""
    return all(r["n_genes"] <= most for r in nets.sizes().collect())  # one row per species


def gene_numbers(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(species, gene, id, c): places from 0 in the sorted names of a species; c rows in ``genes``, those only in edges last with c = 0."""
    ends = edges.select("species", F.explode(F.array("i", "j")).alias("gene")).distinct()
    names = genes.select("species", "gene", F.lit(1).alias("c")).unionByName(ends.withColumn("c", F.lit(0))).groupBy("species", "gene").agg(F.sum("c").alias("c"))
    return cut(names.withColumn("id", F.row_number().over(W.partitionBy("species").orderBy(F.col("c") == 0, "gene")) - 1))


def numbered(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (..., species, i, j) with gene numbers a, b in place of names."""
    side = lambda c, to: ids.select("species", F.col("gene").alias(c), F.col("id").alias(to))
    return edges.join(side("i", "a"), ["species", "i"]).join(side("j", "b"), ["species", "j"]).drop("i", "j")


def packed(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(species, names, inside, n, edges): a species' network as one row."""
    names = ids.groupBy("species").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "gene"))), lambda x: x["gene"]).alias("names"), F.count_if(F.col("c") > 0).cast("int").alias("inside"), F.sum("c").cast("int").alias("n"))
    e = numbered(edges.select("species", "i", "j"), ids).groupBy("species").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    return cut(names.join(e, "species", "left"))


def columns(t: pa.Table, name: str, row: int, n: int = 2) -> list[np.ndarray]:
    """The numbers in a row's array of structs."""
    v = t[name][row].values
    return [np.zeros(0, np.int64)] * n if v is None else [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in v.flatten()]


_OUT = pa.schema([("variant", pa.int32()), ("gene1", pa.string()), ("gene2", pa.string()), ("species1", pa.string()), ("species2", pa.string()), ("hog", pa.string()), ("q_value", pa.float64()), ("effect_size", pa.float64()), ("jaccard", pa.float64()), ("type", pa.string())])


def _block(last: int, seed: int | None, alpha: float):
    """Arrow function: conserved edges of a block of variants of one species pair; with a seed orthologs are shuffled, else edges vary."""

    def run(rows: pa.Table, nets: pa.Table) -> pa.Table:
        at = {s: r for r, s in enumerate(nets["species"].to_pylist())}
        if not rows.num_rows or not nets.num_rows:
            return _OUT.empty_table()
        sp1, sp2, block = (rows[c][0].as_py() for c in (*PAIR, "block"))
        if sp1 not in at or sp2 not in at:
            return _OUT.empty_table()
        rows = rows.sort_by("at")
        names = {s: nets["names"][at[s]].values for s in (sp1, sp2)}
        inside, n = ({s: nets[c][at[s]].as_py() for s in (sp1, sp2)} for c in ("inside", "n"))
        place = lambda s, c: np.array(pc.fill_null(pc.index_in(rows[c], names[s].slice(0, inside[s])), -1), np.int64)
        g1, g2 = place(sp1, "gene1"), place(sp2, "gene2")
        hogs = rows["hog"].combine_chunks().dictionary_encode()
        h = np.array(pc.fill_null(hogs.indices, -1), np.int64)
        items = [x.encode() for x in rows["item"].to_pylist()] if seed is not None else []
        fixed = {s: columns(nets, "edges", at[s]) for s in (sp1, sp2)}
        varying = {s: columns(nets, "varying", at[s], 3) for s in (sp1, sp2)} if seed is None else {}
        lf = {n[s]: K.log_factorials(max(n[s], len(names[s]))) for s in (sp1, sp2)}
        n2, kinds = len(names[sp2]), len(hogs.dictionary) + 1
        side = lambda s, more=((), ()): K.Side(len(names[s]), n[s], *(np.r_[x, y].astype(np.int64) for x, y in zip(fixed[s], more)))
        sides = {s: side(s) for s in (sp1, sp2)}
        out: list[tuple[np.ndarray, ...]] = []
        for v in range(block * BLOCK + 1, min(last, (block + 1) * BLOCK) + 1):
            other = g2
            if seed is not None:
                other = g2[K.shuffle(seed, v, items)]
            else:
                sides = {s: side(s, [x[varying[s][0] == v] for x in varying[s][1:]]) for s in (sp1, sp2)}
            usable = (g1 >= 0) & (other >= 0)
            pair, hog = np.divmod(np.unique(((g1 * n2 + other) * kinds + h + 1)[usable]), kinds)  # of several equal rows one counts
            bridge = np.divmod(np.unique(pair), n2)
            a, b = np.divmod(pair[hog > 0], n2)  # rows without a group help to map neighbours but are no edges
            row, q, eff, jac = K.conserved(sides[sp1], sides[sp2], a, b, bridge, alpha, lf)
            out.append((np.full(len(row), v, np.int32), a[row], b[row], hog[hog > 0][row] - 1, q, eff, jac))
        if not out:
            return _OUT.empty_table()
        v, a, b, hog, q, eff, jac = (np.concatenate(x) for x in zip(*out))
        word = lambda x: pa.array([x] * len(v), pa.string())
        return pa.Table.from_arrays([pa.array(v), names[sp1].take(pa.array(a)), names[sp2].take(pa.array(b)), word(sp1), word(sp2), hogs.dictionary.take(pa.array(hog)), pa.array(q), pa.array(eff), pa.array(jac), word("conserved")], schema=_OUT)

    return run


def _edges(rows: DataFrame, nets: DataFrame, last: int, seed: int | None, alpha: float) -> DataFrame:
    """Blocks of variants 1..last of ortholog rows (sp1, sp2, gene1, gene2, hog, at, item) meet the packed networks (species, ...[, block])."""
    rows = cut(rows)
    blocks = F.explode(F.sequence(F.lit(0), F.lit((last - 1) // BLOCK))).alias("block")
    pairs = rows.select(*PAIR).distinct().select(*PAIR, blocks).withColumn("species", F.explode(F.array_distinct(F.array(*PAIR))))
    right = pairs.join(nets, [c for c in ("species", "block") if c in nets.columns])
    by = [*PAIR, "block"]
    schema = "variant int, gene1 string, gene2 string, species1 string, species2 string, hog string, q_value double, effect_size double, jaccard double, type string"
    return spread(rows.select(*[F.col(c).alias(c) for c in rows.columns], blocks), *by).groupBy(*by).cogroup(spread(right, *by).groupBy(*by)).applyInArrow(_block(last, seed, alpha), schema)


def of_species(orthologs: DataFrame, species: list[str]) -> DataFrame:
    """Distinct ortholog rows of pairs of the given species."""
    return orthologs.where(F.col("sp1").isin(species) & F.col("sp2").isin(species)).select(*PAIR, "gene1", "gene2", "hog").distinct()


def shuffled_edges(nets: Networks, orthologs: DataFrame, species: list[str], n_perm: int, seed: int, alpha: float) -> DataFrame:
    """Conserved edges of the draws 1..n_perm of ``shuffled_orthologs``, with the draw as ``variant``."""
    t = nets.thresholds.select("species", "threshold")
    kept = cut(nets.weights.join(F.broadcast(t), "species").where(F.col("w") >= F.col("threshold")).select("species", "i", "j"))
    once = of_species(orthologs, species)
    at = F.row_number().over(W.partitionBy(*PAIR).orderBy("gene1", "gene2", "hog"))
    rows = once.select(*PAIR, "gene1", "gene2", F.col("hog").cast("string").alias("hog"), at.alias("at"), F.concat_ws(":", "gene1", "gene2", "hog").alias("item"))
    return _edges(rows, packed(kept, gene_numbers(nets.genes, kept)), n_perm, seed, alpha)


def noisy_edges(nets: Networks, orthologs: DataFrame, species: list[str], sure: DataFrame, varying: DataFrame, n_boot: int, alpha: float) -> DataFrame:
    """Conserved edges of the replicates 1..n_boot: network edges ``sure`` (species, i, j) of all and ``varying`` (variant, species, i, j) of some."""
    sure, varying = cut(sure.select("species", "i", "j")), cut(varying.select("variant", "species", "i", "j"))
    ids = gene_numbers(nets.genes, sure.unionByName(varying.drop("variant")))
    block = F.floor((F.col("variant") - 1) / BLOCK).cast("int").alias("block")
    more = numbered(varying, ids).groupBy("species", block).agg(F.collect_list(F.struct("variant", "a", "b")).alias("varying"))
    each = packed(sure, ids).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK))))
    rows = of_species(orthologs, species).select(*PAIR, "gene1", "gene2", F.col("hog").cast("string").alias("hog"), F.lit(0).alias("at"))
    return _edges(rows, each.join(more, ["species", "block"], "left"), n_boot, None, alpha)
