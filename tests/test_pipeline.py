"""The pipeline object: prerequisites, immutability, chaining."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import modules as M
from netloom.operators.network import Networks
from netloom.plans.pipeline import Pipeline
from test_network import star


def test_chain(spark):
    nets, o = star(spark)
    p = Pipeline(nets, o, ["A", "B"], {"A": "annual", "B": "perennial"})
    with pytest.raises(ValueError, match="find_coexpressologs"):
        p.find_cliques()
    q = p.find_coexpressologs().find_cliques()
    assert p.done() == [] and q.done() == ["edges", "cliques"] and q.summary()["edges"] == 15
    m = q.detect_modules(objective="modularity").identify_module_hubs(top_n=1).classify_hub_conservation()
    assert m.hub_classification.count() > 0 and "hubs" in repr(m)
    assert q.classify_cliques().classification.count() == 15
    with pytest.raises(ValueError):
        Pipeline(nets, o, ["A"], {"A": "x"})
    with pytest.raises(ValueError):
        Pipeline(nets, o, ["A", "B"], {"A": "x"})
    with pytest.raises(ValueError, match="networks"):
        Pipeline(nets, o, ["A", "B", "C"], {"A": "x", "B": "y", "C": "y"})
    with pytest.raises(ValueError, match="unknown"):
        Pipeline(nets, o, ["A", "B"], {"A": "x", "B": "y"}, species_pairs=[("A", "Z")])
    named = Pipeline(nets, o, ["A", "B"], {"A": "x", "B": "y"}, spark.createDataFrame([("A", "B")], "sp1 string, sp2 string"))
    assert named.contrasts.first()["pair_name"] == "A.B"


def test_matched_scale_coarsens(spark):
    """Six modules of A, of which 1-3 and 4-6 are linked, against two of B."""
    a = [(f"a{k:02d}", k // 8 + 1) for k in range(48)]
    b = [(f"b{k:02d}", k // 24 + 1) for k in range(48)]
    m = spark.createDataFrame([("A", g, x) for g, x in a] + [("B", g, x) for g, x in b], "species string, gene string, module int")
    o = spark.createDataFrame([("A", "B", g, h, g) for (g, _), (h, _) in zip(a, b)], "sp1 string, sp2 string, gene1 string, gene2 string, hog string")
    w = spark.createDataFrame([("A", g, h, 1.0) for g, x in a for h, y in a if g < h and (x - 1) // 3 == (y - 1) // 3] + [("B", "b00", "b01", 1.0)], "species string, i string, j string, w double")
    genes = m.select("species", "gene")
    t = spark.createDataFrame([("A", 0.5, 1128), ("B", 0.5, 1128)], "species string, threshold double, n_pairs long")
    contrasts = spark.createDataFrame([("AB", "A", "B")], "pair_name string, sp1 string, sp2 string")
    p = Pipeline(Networks(w, t, genes, {}), o, ["A", "B"], {"A": "annual", "B": "perennial"}, contrasts, modules=m)
    rows = p.compare_modules_paired(jaccard_threshold=0.5, method="hypergeometric").module_comparisons
    n = {(r["scale"], r["species"]): r["n"] for r in rows.groupBy("scale", "species").agg(F.count("*").alias("n")).collect()}
    assert n == {("natural", "sp1"): 6, ("natural", "sp2"): 2, ("matched", "sp1"): 2, ("matched", "sp2"): 2}
    got = {(r["scale"], r["species"], r["classification"], r["grp"]) for r in rows.collect()}
    assert ("matched", "sp1", "conserved", "conserved") in got and ("natural", "sp1", "partially_conserved", "conserved") in got
    with pytest.raises(ValueError, match="edges"):
        M.compare_modules_paired(m, o, contrasts, p._traits())


def test_several_resolutions_are_one_partition(spark):
    nets, o = star(spark)
    p = Pipeline(nets, o, ["A", "B"], {"A": "annual", "B": "perennial"}).detect_modules(resolutions=[0.5, 1.0])
    assert p.modules.count() == p.modules.select("species", "gene").distinct().count() == nets.genes.count()
