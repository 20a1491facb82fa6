"""Graph kernels, modules, permutation tests and cliques."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import clique_kernel as K, cliques as Q, graph_kernels as G, modules as M, permutation as P
from netloom.operators.network import Networks
from test_network import star


def planted(seed=0, n=60, k=3):
    rng = np.random.default_rng(seed)
    label = np.arange(n) // (n // k)
    i, j = np.triu_indices(n, 1)
    inner = label[i] == label[j]
    keep = inner | (rng.random(len(i)) < 0.05)
    return n, i[keep], j[keep], np.where(inner, 0.9, 0.1)[keep], label


@pytest.mark.parametrize("find", [lambda *g: G.leiden(*g, 0.3, "CPM"), lambda *g: G.leiden(*g, 1.0, "modularity"), lambda *g: G.infomap(*g, 3), lambda *g: G.gaussian_sbm(*g)])
def test_planted_partition_is_found(find):
    *g, label = planted()
    assert G.adjusted_rand(find(*g), label) > 0.9


def test_block_model_has_no_maximum():
    *g, label = planted(n=200, k=20)
    found = G.gaussian_sbm(*g)
    assert len(set(found.tolist())) > 12 and G.adjusted_rand(found, label) > 0.9


def test_kernels_by_hand():
    i, j, w = np.array([0, 1]), np.array([1, 2]), np.array([1.0, 1.0])
    assert G.betweenness(3, i, j, w).tolist() == [0, 1, 0]
    assert G.spectral_norm(3, i, j, w) == pytest.approx(2**0.5)
    assert G.eigenvector(3, i, j, w) == pytest.approx([2**-0.5, 1, 2**-0.5])
    d = np.array([[0, 1, 5], [1, 0, 5], [5, 5, 0.0]])
    assert G.complete_linkage(d, 2).tolist() == [0, 0, 1]
    x = np.array([[1, 2, 3, 4], [1, 2, 3, 4.1], [4, 1, 3, 0.0]])
    assert G.ward_clusters(x, 0.7).tolist() == [0, 0, 2]
    a, b, c = G.rewire(60, *planted()[1:4], 500, 1)
    assert np.bincount(np.r_[a, b], minlength=60).tolist() == np.bincount(np.r_[planted()[1], planted()[2]], minlength=60).tolist()


def nets_of(spark, seed=0):
    n, i, j, w, label = planted(seed)
    name = lambda k: f"g{k:02d}"
    weights = spark.createDataFrame([("A", name(a), name(b), float(x)) for a, b, x in zip(i, j, w)], "species string, i string, j string, w double")
    genes = spark.createDataFrame([("A", name(k)) for k in range(n)], "species string, gene string")
    t = spark.createDataFrame([("A", 0.05, 1770)], "species string, threshold double, n_pairs long")
    return Networks(weights, t, genes, {}), {name(k): int(v) for k, v in enumerate(label)}


def test_detection_in_spark(spark):
    nets, label = nets_of(spark)
    rows = M.detect_modules(nets, "leiden", 1.0, "modularity").modules.collect()
    assert G.adjusted_rand([r.module for r in rows], [label[r.gene] for r in rows]) > 0.9
    rows = M.consensus_modules(nets, [0.5, 1.0, 1.5]).collect()
    assert len(rows) == 60 and G.adjusted_rand([r.module for r in rows], [label[r.gene] for r in rows]) > 0.9
    t = M.structure_test(nets, [0.5, 1.0, 1.5], n_perm=20).first()
    assert t.n_done == 20 and t.p_value < 0.06
    with pytest.raises(ValueError):
        M.detect_modules(nets, "other")


def test_consensus_of_no_structure_is_one_module(spark):
    rng = np.random.default_rng(4)
    names = [f"g{k:02d}" for k in range(40)]
    w = spark.createDataFrame([("A", a, b, 1.0) for a, b in combinations(names, 2) if rng.random() < 0.2], "species string, i string, j string, w double")
    nets = Networks(w, spark.createDataFrame([("A", 0.5, 780)], "species string, threshold double, n_pairs long"), spark.createDataFrame([("A", g) for g in names], "species string, gene string"), {})
    rows = M.consensus_modules(nets, [0.5, 1.0, 1.5]).collect()
    assert len(rows) == 40 and {r.module for r in rows} == {1}
    assert len({r.module for r in M.consensus_modules(nets, [0.5, 1.0, 1.5], test_k1=False).collect()}) > 1


def test_hubs(spark):
    nets, label = nets_of(spark)
    m = spark.createDataFrame([("A", g, k) for g, k in label.items()], "species string, gene string, module int")
    h = M.identify_module_hubs(m, M.thresholded(nets), top_n=2).collect()
    assert sum(r.is_hub for r in h) == 6 and all(r.rank >= 1 for r in h)
    small = spark.createDataFrame([("A", "g00", 1), ("A", "g01", 1)], "species string, gene string, module int")
    assert all(r["degree"] is None and not r["is_hub"] for r in M.identify_module_hubs(small, M.thresholded(nets)).collect())


def brute_betweenness(nodes, edge):
    """Betweenness from all simple paths; lengths are 1/w."""
    out = dict.fromkeys(nodes, 0.0)

    def walks(path, end):
        if path[-1] == end:
            yield path
            return
        for v in nodes:
            if v not in path and frozenset((path[-1], v)) in edge:
                yield from walks([*path, v], end)

    for a, b in combinations(nodes, 2):
        all_paths = [(sum(1 / edge[frozenset(x)] for x in zip(p, p[1:])), p) for p in walks([a], b)]
        if all_paths:
            least = min(d for d, _ in all_paths)
            short = [p for d, p in all_paths if d < least + 1e-9]
            for v in nodes:
                out[v] += sum(v in p[1:-1] for p in short) / len(short)
    return out


def test_path_centralities_of_hubs(spark):
    rng = np.random.default_rng(2)
    nodes = [f"g{k}" for k in range(7)]
    rows = [("A", a, b, float(rng.integers(1, 4))) for a, b in combinations(nodes, 2) if rng.random() < 0.5]
    want = brute_betweenness(nodes, {frozenset(r[1:3]): r[3] for r in rows})
    m = spark.createDataFrame([("A", g, 1) for g in nodes], "species string, gene string, module int")
    e = spark.createDataFrame(rows, "species string, i string, j string, w double")
    got = M.characterize_hubs(M.identify_module_hubs(m, e)).collect()
    assert {r.gene: r.betweenness for r in got} == pytest.approx(want) and max(want.values()) > 0
    assert all(r.bt_degree_ratio == pytest.approx(want[r.gene] / r.degree) for r in got if r.degree > 0)
    none = M.characterize_hubs(M.identify_module_hubs(m, e, paths=False)).collect()
    assert all(r.betweenness is None and r.eigenvector is None and r.bt_degree_ratio is None for r in none)
    with pytest.raises(ValueError, match="paths"):
        M.identify_module_hubs(m, e, centrality="betweenness", paths=False)


def test_hub_queries_compute_paths(spark):
    import __spark_entry__ as entry

    q = entry.queries()["characterize_hubs"](spark, "/root/testdata/sf0.001")
    assert q.where("bt_degree_ratio > 0").count() > 0


def test_batches_equal_one_run(spark):
    nets, o = star(spark)
    from netloom.operators.comparison import compare_neighborhoods

    c = compare_neighborhoods(nets, o)
    one, many = (
        {r["hog"]: (r["n_perm"], r["n_exceed"], r["t_obs"]) for r in P.permutation_hog_test(nets, o, c, min_exceedances=3, max_permutations=30, first_batch=b).collect()} for b in (30, 4)
    )
    assert one == many and len(one) == 20
    assert one["H16"][0] == 0


@pytest.mark.parametrize("alternative", ["greater", "less"])
def test_group_draws_in_tasks(spark, monkeypatch, alternative):
    """Groups are tested without joins of draws, with the results of the joins."""
    from netloom.operators.comparison import compare_neighborhoods
    from netloom.plans.gene_queries import nets, orthologs

    d, pair = "/root/testdata/sf0.001", ("SP_A", "SP_B")
    n, o = nets(spark, d, pair), orthologs(spark, d, pair)
    c = compare_neighborhoods(n, o)
    key = lambda df: {r.hog: [round(r[x], 9) for x in ("t_obs", "n_perm", "n_exceed", "mean_eff", "p_value", "q_value")] for r in df.collect()}
    run = lambda **k: key(P.permutation_hog_test(n, o, c, alternative, min_exceedances=4, max_permutations=30, first_batch=10, **k))
    joins = run(local_genes=0)
    monkeypatch.setattr(P, "shuffled_ids", None)
    assert run() == joins and len({tuple(x) for x in joins.values()}) > 50


def test_permutation_edges_without_joins_of_draws(spark, monkeypatch):
    from netloom.operators.comparison import find_coexpressologs

    nets, o = star(spark)
    monkeypatch.setattr(P, "_draws_by_joins", None)
    monkeypatch.setattr(P, "shuffled_ids", None)
    e = find_coexpressologs(nets, o, "permutation", max_permutations=30, min_exceedances=3).collect()
    assert len(e) == 20 and {r.type for r in e} <= {"conserved", "ns"}


def test_kernel_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        genes = [(f"{s}{k}", s) for s in "ABCD" for k in range(3)]
        rows = [(a, s, b, t, round(float(rng.random()), 3), 1.0, True) for (a, s), (b, t) in combinations(genes, 2) if s != t and rng.random() < 0.5]
        edge = {(r[0], r[2]): r[4] for r in rows}
        got = {tuple(sorted(g)): st["mean_q"] for g, st in K.group_cliques(rows, 2, 0, (1.0, 0.0))}
        for sp, q in got.items():
            best = min(
                (sum(edge[p] for p in combinations(c, 2)) / (len(sp) * (len(sp) - 1) / 2) for c in __import__("itertools").product(*[[f"{s}{k}" for k in range(3)] for s in sp]) if all(p in edge for p in combinations(c, 2))),
                default=None,
            )
            assert q == pytest.approx(best)


@pytest.mark.parametrize("missing", [1, 2])
def test_tolerant_kernel_against_brute_force(missing):
    """With missing edges allowed: fewest missing, then least mean q; genes that no edge joins are no clique."""
    from itertools import product

    rng = np.random.default_rng(missing)
    none = 0
    for _ in range(40):
        names = "ABC" if rng.random() < 0.5 else "ABCD"
        rows = [(f"{s}{i}", s, f"{t}{j}", t, round(float(rng.random()), 3), 1.0, True) for s, t in combinations(names, 2) for i in range(2) for j in range(2) if rng.random() < 0.25]
        edge, joined = {(r[0], r[2]): r[4] for r in rows}, {(r[1], r[3]) for r in rows}
        genes = {s: sorted({g for r in rows for g, x in ((r[0], r[1]), (r[2], r[3])) if x == s}) for s in names}
        here = [s for s in names if genes[s]]
        want = {}
        for size in range(2, len(here) + 1):
            for sp in combinations(here, size):
                if sum(p not in joined for p in combinations(sp, 2)) > missing:
                    continue
                options = []
                for c in product(*[genes[s] for s in sp]):
                    have = [edge[p] for p in combinations(c, 2) if p in edge]
                    absent = size * (size - 1) // 2 - len(have)
                    if have and absent <= missing:
                        options.append((absent, sum(have) / len(have)))
                    none += not have
                if options:
                    want[sp] = min(options)
        got = {tuple(sorted(g)): (st["n_missing"], st["mean_q"]) for g, st in K.group_cliques(rows, 2, missing, (1.0, 0.0))}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert none


def test_gene_cap(spark):
    """The cap keeps the genes of a species with most pairs in the group, ties by name."""
    rows = [("A1", f"B{k}", "A", "B", "H", 0.01 * k, 1.0, 0.5, "conserved") for k in range(1, 6)] + [("A2", "B5", "A", "B", "H", 0.001, 1.0, 0.5, "conserved"), ("A3", "B1", "A", "B", "H", 0.0001, 1.0, 0.5, "conserved")]
    e = spark.createDataFrame(rows, EDGES)
    best = lambda cap: Q.find_cliques(e, ["A", "B"], max_genes=cap).first()["genes"]
    assert best(10) == ["A3", "B1"] and best(1) == ["A1", "B1"] and best(2) == ["A2", "B5"]


def test_trait_annotation(spark):
    c = spark.createDataFrame([("H1", 1, ["a", None, "c"]), ("H2", 1, ["a", "b", None]), ("H3", 1, [None, None, "c"])], "hog string, clique int, genes array<string>")
    t = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "x"), ("C", "y"), ("Z", "y"), ("A", None)], "species string, trait string")
    got = {r["hog"]: (r["species_present"], r["traits"], r["sole_rep"]) for r in Q.annotate_traits(c, ["A", "B", "C"], t).collect()}
    assert got == {"H1": ("A,C", "x,y", False), "H2": ("A,B", "x", False), "H3": ("C", "y", True)}


def test_variants_of_orthologs_are_compared_at_once(spark):
    """Edges with a key are those of each variant on its own; networks aren't copied."""
    from netloom.operators.comparison import find_coexpressologs

    nets, o = star(spark)
    every = Q.shuffled_orthologs(o, 3, 1)
    cols = ["gene1", "gene2", "hog", "q_value", "type"]
    got = sorted((r["variant"], *(str(r[c]) for c in cols)) for r in find_coexpressologs(nets, every, keys=["variant"]).collect())
    want = sorted((v, *(str(r[c]) for c in cols)) for v in (1, 2, 3) for r in find_coexpressologs(nets, every.where(F.col("variant") == v).drop("variant")).collect())
    assert got == want and got
    for v in (1, 2, 3):
        rows = every.where(F.col("variant") == v).collect()
        assert sorted(r["gene2"] for r in rows) == sorted(f"B{k}" for k in range(1, 21)) and sorted(r["gene1"] for r in rows) == sorted(f"A{k}" for k in range(1, 21))


def test_noise_has_a_bound(spark):
    x = spark.range(20_000).select(Q.gaussian(1, F.col("id")).alias("g")).agg(F.max("g"), F.min("g"), F.avg("g"), F.stddev("g")).first()
    assert max(x[0], -x[1]) < Q.MOST_NOISE and abs(x[2]) < 0.03 and abs(x[3] - 1) < 0.03


def test_module_draws_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = spark.createDataFrame([(s, f"{s}{k:02d}", int(k // 6) + 1) for s in "AB" for k in range(24)], "species string, gene string, module int")
    o = spark.createDataFrame([("A", "B", f"A{k:02d}", f"B{int(rng.integers(24)) if k % 3 else k:02d}", f"H{k}") for k in range(24)], "sp1 string, sp2 string, gene1 string, gene2 string, hog string")
    run = lambda: sorted(map(tuple, M.compare_modules(m, o, "jaccard", 4, 60, 1).select("module1", "module2", "n_perm", "n_exceed", "p_value", "q_value").collect()))
    one = run()
    monkeypatch.setattr(M, "batches", lambda most: P.batches(most, 5, 2))
    assert run() == one and len(one) == 16 and len({r[2] for r in one}) > 2


EDGES = "gene1 string, gene2 string, species1 string, species2 string, hog string, q_value double, effect_size double, jaccard double, type string"


def edges(spark):
    def full(h, sp, q, kind="conserved"):
        return [(f"{a}{h}", f"{b}{h}", a, b, h, q, 2.0, 0.5, kind) for a, b in combinations(sp, 2)]

    rows = full("H1", "ABCD", 0.01) + full("H2", "ABC", 0.02) + full("H3", "AB", 0.01) + full("H3", "CD", 0.01) + full("H3", "AC", 0.9, "ns") + full("H4", "AB", 0.01) + full("H5", "ABCD", 0.9, "ns")
    return spark.createDataFrame(rows + rows[:2], EDGES)


TRAITS = {"A": "annual", "B": "annual", "C": "perennial", "D": "perennial"}


def test_classification_waterfall(spark):
    got = {r["hog"]: (r["classification"], r["trait_groups"]) for r in Q.classify_cliques(edges(spark), list("ABCD"), TRAITS).collect()}
    assert got == {"H1": ("complete", None), "H2": ("partial", None), "H3": ("differentiated", "annual,perennial"), "H4": ("trait_specific", "annual"), "H5": ("unclassified", None)}


def test_cliques_and_stability(spark):
    e = edges(spark)
    c = Q.find_cliques(e, list("ABCD"), 2)
    rows = {r["hog"]: r for r in c.collect() if r["hog"] in ("H1", "H2")}
    assert rows["H1"]["n_edges"] == 6 and rows["H1"]["coherence"] == pytest.approx(1) and rows["H1"]["intensity"] == pytest.approx(0.99)
    tests, novel = Q.clique_stability(e, list("ABCD"), Q.find_cliques(e, list("ABCD"), 3), max_k=2)
    s = {r["hog"]: (r["n_tested"], r["n_stable"], r["stability_class"]) for r in Q.stability_scores(tests).collect()}
    assert s == {"H1": (10, 10, 2), "H2": (7, 7, 2)}
    assert novel.agg(F.sum("n_novel")).first()[0] == 0
    assert Q.find_cliques(e.limit(0), list("ABCD")).count() == 0
    with pytest.raises(ValueError):
        Q.find_cliques(e, ["A"])


def test_noise_free_perturbation_survives(spark):
    nets, o = star(spark)
    from netloom.operators.comparison import find_coexpressologs

    c = Q.find_cliques(find_coexpressologs(nets, o), ["A", "B"])
    r = Q.clique_perturbation_test(c, ["A", "B"], nets, o, n_boot=2, noise_sd=0.0).collect()
    assert r and all(x.survival_rate == 1 and x.mean_jaccard == 1 for x in r)


def _both_ways(spark, monkeypatch, run):
    """Rows of a robustness test by matrices, which never compares draws by joins, and by joins."""
    from netloom.operators.comparison import find_coexpressologs
    from netloom.plans.gene_queries import ABC, nets, orthologs

    d = "/root/testdata/sf0.001"
    n, o = nets(spark, d, ABC), orthologs(spark, d, ABC)
    base = Q.cut(Q.find_cliques(find_coexpressologs(n, o), list(ABC)))
    key = lambda df: {(r.hog, r.clique): [None if v is None else round(v, 9) for v in r[2:]] for r in df.collect()}
    joins = key(run(base, list(ABC), n, o, local_genes=0))
    monkeypatch.setattr(Q, "find_coexpressologs", None)
    assert key(run(base, list(ABC), n, o)) == joins
    return joins


def test_intensity_draws_in_tasks(spark, monkeypatch):
    from netloom.operators import variants as V
    from netloom.operators.comparison import find_coexpressologs
    from netloom.plans.gene_queries import ABC, nets, orthologs

    d = "/root/testdata/sf0.001"
    n, o = nets(spark, d, ABC), orthologs(spark, d, ABC)
    key = lambda df: sorted((r.variant, r.species1, r.species2, r.gene1, r.gene2, r.hog, *(round(x, 9) for x in (r.q_value, r.effect_size, r.jaccard))) for r in df.where("type = 'conserved'").collect())
    joins = key(find_coexpressologs(n, Q.shuffled_orthologs(o, 25, 1), alpha=0.9, keys=["variant"]))
    assert key(V.shuffled_edges(n, o, list(ABC), 25, 1, 0.9)) == joins and len({r[0] for r in joins}) > 1
    assert _both_ways(spark, monkeypatch, lambda *a, **k: Q.clique_intensity_test(*a, n_perm=3, **k))


def test_noise_replicates_in_tasks(spark, monkeypatch):
    got = _both_ways(spark, monkeypatch, lambda *a, **k: Q.clique_perturbation_test(*a, n_boot=4, noise_sd=3.0, **k))
    assert len({r[0] for r in got.values()}) > 2


def test_slot_jaccard_takes_all_cliques(spark):
    import __spark_entry__ as entry
    from netloom.operators.comparison import find_coexpressologs
    from netloom.plans.gene_queries import nets, orthologs
    from netloom.sources.planted import SPECIES

    d = "/root/testdata/sf0.001"
    n, o = nets(spark, d, SPECIES), orthologs(spark, d, SPECIES)
    raised = Networks(n.weights, n.thresholds.withColumn("threshold", F.col("threshold") * 1.01), n.genes, n.params)
    one, two = ([(r.hog, r.clique, r.genes) for r in Q.find_cliques(find_coexpressologs(x, o), list(SPECIES), 2).collect()] for x in (n, raised))
    want = sorted((h, c, k, round(K.slot_jaccard(a, b), 6)) for h, c, a in one for g, k, b in two if g == h)
    rows = entry.queries()["slot_jaccard"](spark, d)
    assert sorted(map(tuple, rows.select("hog", "clique", "other", "jaccard").collect())) == want
    assert len({x[3] for x in want}) > 1


def test_tag_permutation_takes_the_classification(spark, monkeypatch):
    from netloom.plans import module_queries as MQ

    seen = []
    run = P.tag_permutation
    monkeypatch.setattr(P, "tag_permutation", lambda c, *a, **k: seen.append(c) or run(c, *a, **k))
    d = "/root/testdata/sf0.001"
    MQ.QUERIES["tag_permutation"](spark, d)
    o, m = MQ.orthologs(spark, d, MQ.SPECIES), MQ.members(spark, d, MQ.SPECIES)
    pairs = {("SP_A", "SP_B"): "AB", ("SP_C", "SP_D"): "CD"}
    want = sorted((pairs[r.sp1, r.sp2], r.species, r.module, r.classification) for r in M.classify_modules(M.compare_modules(m, o)).collect() if (r.sp1, r.sp2) in pairs)
    assert sorted(tuple(r[c] for c in ("pair_name", "species", "module", "classification")) for r in seen[0].collect()) == want


@pytest.mark.parametrize("name, module, operator, draws", [
    ("hog_permutation", P, "permutation_hog_test", {"min_exceedances": 50, "max_permutations": 10_000}),
    ("permutation_edges", P, "permutation_hog_test", {"min_exceedances": 50, "max_permutations": 10_000}),
    ("permutation_edges", P, "permutation_edges", {"alpha": 0.05}),
    ("module_jaccard_perm", M, "compare_modules", {"min_exceedances": 50, "max_permutations": 10_000}),
    ("tag_permutation", P, "tag_permutation", {"n_perm": 1000, "min_recurrence": 2}),
    ("structure_test", M, "structure_test", {"n_perm": 100, "alpha": 0.05}),
    ("infomap_modules", M, "partitions", {"trials": 10}),
    ("clique_perturbation", Q, "clique_perturbation_test", {"n_boot": 100, "noise_sd": 0.1}),
    ("clique_intensity_test", Q, "clique_intensity_test", {"n_perm": 500, "alpha": 0.05}),
])
def test_queries_have_all_draws(spark, monkeypatch, name, module, operator, draws):
    import inspect

    from netloom.plans import clique_queries as CQ, module_queries as MQ

    class Called(Exception):
        pass

    sign = inspect.signature(getattr(module, operator))

    def called(*a, **k):
        b = sign.bind(*a, **k)
        b.apply_defaults()
        raise Called({c: b.arguments[c] for c in draws})

    monkeypatch.setattr(module, operator, called)
    if operator == "permutation_edges":
        monkeypatch.setattr(MQ, "_hog_tests", lambda *a: (None, None))
    if name in CQ.QUERIES:
        monkeypatch.setattr(Q, "find_cliques", lambda *a, **k: None)
    if name == "tag_permutation":
        monkeypatch.setattr(M, "compare_modules", lambda *a, **k: None)
        monkeypatch.setattr(M, "classify_modules", lambda *a: spark.createDataFrame([], "sp1 string, sp2 string, species string, module int, classification string"))
    with pytest.raises(Called) as got:
        {**MQ.QUERIES, **CQ.QUERIES}[name](spark, "/root/testdata/sf0.001")
    assert got.value.args[0] == draws


def test_conservation_breaks_ties(spark):
    """Equal centralities: the gene with the greater effect, then the one of the group with the lesser q is the hub."""
    m = spark.createDataFrame([("A", g, 1) for g in "pqrs"], "species string, gene string, module int")
    e = spark.createDataFrame([("A", a, b, 1.0) for a, b in combinations("pqrs", 2)], "species string, i string, j string, w double")
    hogs = spark.createDataFrame([("A", g, f"H{g}") for g in "pqrs"], "species string, gene string, hog string")
    r = spark.createDataFrame([("A", "B", "Hq", "q", "x", 4.0, 4.0, 0.5, 0.4), ("A", "B", "Hr", "r", "y", 4.0, 4.0, 0.5, 0.01), ("A", "B", "Hs", "s", "z", 1.0, 1.0, 0.001, 0.001)], "sp1 string, sp2 string, hog string, gene1 string, gene2 string, sp1_effect double, sp2_effect double, q1 double, q2 double")
    hub = lambda c: [x.gene for x in M.identify_module_hubs(m, e, hogs, c, top_n=1).where("is_hub").collect()]
    assert hub(None) == ["p"] and hub(M.conservation(r, hogs)) == ["r"]


def test_coclassification_against_the_dense_way(spark):
    """Per edge as by full gene x gene matrices over the resolutions."""
    rng = np.random.default_rng(8)
    n, parts = 20, [rng.integers(k, size=20) for k in (2, 4, 7)]
    i, j = np.triu_indices(n, 1)
    keep = rng.random(len(i)) < 0.3
    same = np.array([p[:, None] == p for p in parts])
    share = np.array([[(p == c).sum() / n for c in p] for p in parts])
    seen, expected = same.mean(0), (same * share[:, :, None] ** 2).mean(0)
    members = spark.createDataFrame([("A", float(r), f"g{k:02d}", int(p[k])) for r, p in enumerate(parts) for k in range(n)], "species string, resolution double, gene string, module int")
    edges = spark.createDataFrame([("A", f"g{a:02d}", f"g{b:02d}") for a, b in zip(i[keep], j[keep])], "species string, i string, j string")
    got = {(int(r.i[1:]), int(r.j[1:])): (r.observed, r.expected, r.excess) for r in M.coclassification(members, edges).collect()}
    assert len(got) == keep.sum()
    for (a, b), v in got.items():
        assert v == pytest.approx((seen[a, b], expected[a, b], max(0.0, seen[a, b] - expected[a, b])))


def test_detection_result(spark):
    nets, label = nets_of(spark)
    d = M.detect_modules(nets, resolutions=[0.5, 1.0, 1.5], n_perm=20)
    row = d.summary.first()
    assert row.n_modules == 3 and 0.3 < row.modularity < 1 and d.structure.first().p_value < 0.06 and d.scan.count() == 3
    one = M.detect_modules(nets, "infomap", trials=2)
    assert one.scan is None and one.structure is None and one.summary.first().n_modules == 3
    with pytest.raises(ValueError, match="leiden"):
        M.detect_modules(nets, "sbm", [0.5, 1.0])


@pytest.mark.parametrize("name", ["module_overlap_hyper", "hub_conservation", "hub_bridges", "cliques_3sp", "tag_permutation"])
def test_sql(same, name):
    assert same(name) > 0
