"""Statistics, networks and comparison: brute force, hand-computed values, both normalisation ways, SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import stats as S
from netloom.operators import comparison as C, network as N, similarity as Y
from netloom.sources import expression as E, orthologs as O


def test_hypergeometric_tails(spark):
    rows = [(x, m, k, n) for n in (20, 150) for m in (0, 3, 10, 19) for k in (0, 1, 7, 15) for x in range(0, 12)]
    df = spark.createDataFrame(rows, "x int, m int, k int, n int")
    a = [F.col(c) for c in "xmkn"]
    c = math.comb
    for r in df.select("*", S.hypergeom_upper(*a).alias("u"), S.hypergeom_lower(*a).alias("l")).collect():
        p = [c(r.m, i) * c(r.n - r.m, r.k - i) / c(r.n, r.k) if r.k - i >= 0 else 0.0 for i in range(0, max(r.m, r.x) + 1)]
        assert r.u == pytest.approx(sum(p[r.x :]), abs=1e-11)
        assert r.l == pytest.approx(sum(p[: r.x + 1]), abs=1e-11)


def test_q_values(spark):
    rng = np.random.default_rng(0)
    p = np.round(np.r_[rng.random(300), rng.random(100) * 0.01, [0.99]], 3)
    got = {(r["k"], r["p"]): r["q"] for r in S.q_values(spark.createDataFrame([("a", float(x)) for x in p] + [("b", 0.3), ("c", None)], "k string, p double"), ["k"], "p", "q").collect()}
    pi0 = min(1.0, sum(w * (p >= lam).sum() / (len(p) * (1 - lam)) for w, lam in zip(S.SPLINE_WEIGHTS, S.LAMBDAS)))
    for v in set(p.tolist()):
        want = pi0 * min(1.0, min(x * len(p) / (p <= x).sum() for x in p if x >= v))
        assert got["a", v] == pytest.approx(want, rel=1e-9)
        assert got["a", v] >= 0
    assert got["b", 0.3] == 0.3 and got["c", None] is None


def test_liang_and_support():
    s = S.bc_support(2, 9)
    assert s == sorted(v for v in {3 / (t + 1) for t in range(2, 10)} | {0.1, 0.2} if v <= 0.5)
    assert S.liang_pi0([(v, 10) for v in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)], s) == pytest.approx(1.0, abs=0.15)
    # the estimate falls over .1 and .2 and has stopped falling at .3: the right end of that step counts
    counts = [(0.05, 60), (0.15, 20), (0.9, 20)]
    assert S.liang_pi0(counts, [0.1, 0.2, 0.3]) == pytest.approx(20 / (0.7 * 100)) and S.liang_pi0(counts, [0.1, 0.2]) == pytest.approx(20 / (0.8 * 100))
    assert S.liang_pi0([], [0.5]) == 1.0 and S.liang_pi0([(0.9, 10)], [0.1, 0.5]) == 1.0


def test_discrete_q_values_by_key(spark):
    """Within a key: monotone in p, at most 1, and as a key alone gives; a single p is its own q."""
    rng = np.random.default_rng(2)
    support = S.bc_support(5, 99)
    rows = [(k, int(i), float(rng.choice(support + [0.7, 1.0]))) for k in "ab" for i in range(80)] + [("c", 1, 0.03), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, p double")
    got = {(r.k, r.i): (r.p, r.q) for r in S.discrete_q_values(df, ["k"], "p", "q", support).collect()}
    assert got["c", 1] == (0.03, 0.03) and got["d", 1] == (None, None)
    for k in "ab":
        mine = sorted(v for (a, _), v in got.items() if a == k)
        assert all(x[1] <= y[1] + 1e-12 for x, y in zip(mine, mine[1:])) and mine[-1][1] <= 1
        alone = S.discrete_q_values(df.where(F.col("k") == k), ["k"], "p", "q", support).collect()
        assert sorted((r.p, r.q) for r in alone) == mine


def test_sequential_p(spark):
    flags = [("a", i, i in (2, 4, 6)) for i in range(1, 9)] + [("b", i, False) for i in range(1, 9)]
    got = {r["k"]: r for r in S.sequential_p(spark.createDataFrame(flags, "k string, perm int, e boolean"), ["k"], "perm", "e", 2).collect()}
    assert (got["a"]["n_perm"], got["a"]["n_exceed"]) == (4, 2) and got["a"]["p_value"] == pytest.approx(3 / 5)
    assert (got["b"]["n_perm"], got["b"]["n_exceed"]) == (8, 0) and got["b"]["p_value"] == pytest.approx(1 / 9)


def profiles(spark, n=40, k=12, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(s, f"{s}{i}", rng.standard_normal(k).round(2).tolist()) for s in "AB" for i in range(n)], "species string, gene string, values array<double>")


@pytest.mark.parametrize("norm,log", [("MR", False), ("MR", True), ("CLR", False)])
def test_one_matrix_equals_blocks(spark, norm, log):
    p = profiles(spark)
    sizes = {"A": 40, "B": 40}
    a, b = (N.network_weights(p, sizes, "pearson", norm, False, log, local_genes=g) for g in (4096, 1))
    x, y = ({(r.species, r.i, r.j): r.w for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and len(x) == 2 * 40 * 39 // 2
    assert max(abs(x[k] - y[k]) for k in x) < 1e-9


def test_blocks_of_any_size(spark):
    p = profiles(spark)
    x, y = ({(r.species, r.i, r.j): r.r for r in Y.correlations(p, block=b).collect()} for b in (512, 7))
    assert x == pytest.approx(y)


@pytest.mark.parametrize("density", [0.01, 0.03, 0.5, 0.9])
def test_threshold_is_kth_largest(spark, density):
    w = spark.createDataFrame([("A", str(i), "x", float(i * 7 % 101) / 3) for i in range(780)], "species string, i string, j string, w double")
    k = min(max(1, round(density * 780)), 779)
    assert N.density_threshold(w, density).first()["threshold"] == sorted((r.w for r in w.collect()), reverse=True)[k - 1]


def test_network_errors(spark):
    with pytest.raises(ValueError):
        N.compute_network(profiles(spark), density=1.5)
    flat = spark.createDataFrame([("A", str(i), [1.0, 1.0]) for i in range(5)], "species string, gene string, values array<double>")
    with pytest.raises(ValueError):
        N.compute_network(flat)


def star(spark):
    """Two species of 20 genes: gene 1 joined to 2..11, gene 12 to 13..15; one-to-one orthologs."""
    pairs = [(1, j) for j in range(2, 12)] + [(12, j) for j in (13, 14, 15)]
    w = [(s, *sorted((f"{s}{i}", f"{s}{j}")), 10.0) for s in "AB" for i, j in pairs]
    weights = spark.createDataFrame(w, "species string, i string, j string, w double")
    genes = spark.createDataFrame([(s, f"{s}{i}") for s in "AB" for i in range(1, 21)], "species string, gene string")
    t = spark.createDataFrame([("A", 2.0, 190), ("B", 2.0, 190)], "species string, threshold double, n_pairs long")
    o = spark.createDataFrame([("A", "B", f"A{i}", f"B{i}", f"H{i}") for i in range(1, 21)], "sp1 string, sp2 string, gene1 string, gene2 string, hog string")
    return N.Networks(weights, t, genes, {}), o


def test_star_by_hand(spark):
    nets, o = star(spark)
    c = {r["hog"]: r for r in C.compare_neighborhoods(nets, o).collect()}
    assert c["H1"]["sp1_p_con"] == pytest.approx(1 / math.comb(20, 10)) and c["H1"]["sp1_effect"] == pytest.approx(2) and c["H1"]["sp2_jaccard"] == 1
    assert c["H12"]["sp1_p_con"] == pytest.approx(1 / math.comb(20, 3)) and c["H12"]["sp1_effect"] == pytest.approx(20 / 3)
    assert c["H2"]["sp1_p_con"] == 1 and c["H2"]["sp1_effect"] == pytest.approx(20)
    assert (c["H16"]["sp1_neigh"], c["H16"]["sp1_p_con"], c["H16"]["sp1_effect"], c["H16"]["sp1_jaccard"]) == (0, 1.0, 1.0, 0.0)
    kept = {r["hog"] for r in C.summarize_comparison(C.compare_neighborhoods(nets, o)).collect()}
    assert kept == {f"H{i}" for i in range(1, 16)}


@pytest.mark.parametrize("method,test", [("analytical", {}), ("permutation", {"max_permutations": 40, "min_exceedances": 3})])
def test_sweep_at_one_is_direct(spark, method, test):
    nets, o = star(spark)
    e, _ = C.density_sweep(nets, o, [1.0, 9.0], method, **test)
    direct = {(r.gene1, r.gene2, round(r.q_value, 9)) for r in C.find_coexpressologs(nets, o, method, **test).collect()}
    assert {(r.gene1, r.gene2, round(r.q_value, 9)) for r in e.where("multiplier = 1.0").collect()} == direct
    with pytest.raises(ValueError):
        C.density_sweep(nets, o, [])


def test_species_pairs_and_methods(spark):
    nets, o = star(spark)
    two = {(r.gene1, r.gene2, r.species1, r.species2, round(r.q_value, 9)) for r in C.find_coexpressologs(nets, o).collect()}
    turned = {(r.gene2, r.gene1, r.species2, r.species1, round(r.q_value, 9)) for r in C.find_coexpressologs(nets, o, species_pairs=[("B", "A")]).collect()}
    assert two == turned
    by = {r.hog: (r.q_value, r.type) for r in C.find_coexpressologs(nets, o, "permutation", max_permutations=200, min_exceedances=5).collect()}
    assert len(by) == 20 and by["H1"][0] < by["H16"][0] and by["H16"] == (by["H17"][0], "ns")
    with pytest.raises(ValueError, match="unknown"):
        C.find_coexpressologs(nets, o, species_pairs=[("A", "Q")])
    with pytest.raises(ValueError, match="method"):
        C.find_coexpressologs(nets, o, "other")


def test_text_files_and_container(spark, tmp_path):
    (tmp_path / "e.txt").write_text("Genes\tS2\tS1\ng1\t1.5\t2\ng2\tNA\t4\n")
    (tmp_path / "o.txt").write_text("Species1\tSpecies2\thog\na1\tb1\t1\na2\t\t2\n")
    (tmp_path / "g.txt").write_text("species\tgene_id\tgene_content\nSP1\tg1\tSP1:a1;SP2:b1,b2\nSP1\tg2\tSP22:c1\n")
    rows = {r.gene: (r.samples, r["values"]) for r in E.read_expression(spark, str(tmp_path / "e.txt"), "A").collect()}
    assert rows == {"g1": (["S1", "S2"], [2.0, 1.5]), "g2": (["S1", "S2"], [4.0, None])}
    assert [tuple(r) for r in E.read_orthologs(spark, str(tmp_path / "o.txt"), "A", "B").collect()] == [("A", "B", "a1", "b1", "1")]
    groups = O.read_groups(spark, str(tmp_path / "g.txt"))
    loose, exact = (sorted(map(tuple, O.parse_orthologs(groups, "SP1", "SP2", x).collect())) for x in (False, True))
    assert loose == [("g1", "b1", "1"), ("g1", "b2", "1"), ("g2", "c1", "2")] and exact == loose[:2]
    data = spark.createDataFrame([("A", "g", "t1", 1.0, "H", "leaf", 1), ("A", "g", "t1", 0.5, "H", "leaf", 2), ("A", "g", "t2", 3.0, None, "root", 3), ("B", "h", "t1", 9.0, "H", None, 4)], "abbrev string, gene_id string, sample_id string, `vst.count` double, HOG string, tissue string, n int")
    x = E.build_expression(data, "A", sample_metadata=["tissue"], order="n")
    assert [tuple(r) for r in x.profiles.collect()] == [("A", "g", ["t1", "t2"], [0.5, 3.0])]
    assert [tuple(r) for r in x.gene_hogs().collect()] == [("A", "g", "H")]
    assert sorted(map(tuple, x.samples.collect())) == [("A", "t1", "leaf"), ("A", "t2", "root")]
    assert E.build_expression(data).profiles.where("species = 'A'").first()["values"] == [1.0, 3.0]
    with pytest.raises(ValueError, match="no rows"):
        E.build_expression(data, ["A", "Z"])
    with pytest.raises(ValueError, match="lack"):
        E.build_expression(data, value="other")


def test_dense_index_over_ranges(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7 % 1000).alias("c")).repartition(5)
    assert [r.k for r in O.dense_index(df, "c", "k").orderBy("c").collect()] == list(range(1, 1001))


def test_orthologs_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_ROWS", 7)
    rows = [(s, f"{s}{k}", "H1" if k < 20 else f"G{k}") for s in "ABC" for k in range(30)] + [("A", "none", None)]
    got = [tuple(r) for r in O.extract_orthologs(spark.createDataFrame(rows, "species string, gene string, hog string")).collect()]
    want = {(a[0], b[0], a[1], b[1], a[2]) for a in rows for b in rows if a[2] is not None and a[2] == b[2] and a[0] < b[0]}
    assert len(got) == len(want) and set(got) == want


def test_networks_of_a_container(spark):
    import random

    rnd = random.Random(1)
    data = spark.createDataFrame([("A", f"g{k}", f"s{t}", rnd.random()) for k in range(12) for t in range(6)], "abbrev string, gene_id string, sample_id string, `vst.count` double")
    x = E.build_expression(data)
    one, two = (sorted((r.i, r.j, round(r.w, 9)) for r in N.compute_network(p, density=0.1).weights.collect()) for p in (x, x.profiles))
    assert one == two and len(one) == 66


@pytest.mark.parametrize("name", ["parse_orthologs", "long_to_matrix", "mutual_rank_raw", "mutual_rank_log", "density_threshold_blocks", "coexpressologs", "coexpressed_hogs"])
def test_sql(same, name):
    assert same(name) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
