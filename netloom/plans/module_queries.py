"""Queries of the permutation and module operators, with their SQL. Memberships are the planted labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stats import adjusted_rand
from ..operators import comparison as C, modules as M, permutation as P
from ..sources.planted import SPECIES, expression, traits
from .gene_queries import nets, orthologs, rounded
from .sql import discrete_q_sql, q_sql, upper, upto

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N_PERM, H = 10_000, 50  # the operators' defaults


def query(name: str, oracle: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def members(spark: SparkSession, d: str, species=SPECIES) -> DataFrame:
    return expression(spark, d, species).select("species", "gene", (F.col("label") + 1).cast("int").alias("module"))


def scans(spark: SparkSession, d: str, species=SPECIES) -> DataFrame:
    """Three memberships: labels, labels modulo 5, modulo 2."""
    r = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("resolution"), F.lit(m).alias("m")) for k, m in ((1, 2), (2, 5), (3, 10))]))
    return expression(spark, d, species).select("species", "gene", "label", r.alias("r")).select("species", "r.resolution", "gene", (F.col("label") % F.col("r.m")).cast("int").alias("module"))


_MEM = ("mem", "select species, gene, cast(label + 1 as integer) as module from expr")
_SCANS = ("scans", "select species, cast(resolution as double) as resolution, gene, label % md as module from expr cross join (values (1.0, 2), (2.0, 5), (3.0, 10)) as t(resolution, md)")
_INNER = ("e1", "select species, g as i, nb as j, w from nbr where g < nb")

_FE = [
    ("fx", "select d.d, d.sp1, d.sp2, n.g as a, d.o, n.species, count(*) as x from mapped d join nbr n on n.nb = d.m and n.species = case d.d when 1 then d.sp1 else d.sp2 end group by all"),
    ("fv", "select fx.*, x / (md.m * mk.k / ng.n) as f from fx join mk on mk.d = fx.d and mk.sp1 = fx.sp1 and mk.sp2 = fx.sp2 and mk.o = fx.o join md on md.species = fx.species and md.g = fx.a join ng on ng.species = fx.species"),
    ("fe", "select sp1, sp2, a, b, sum(f) as fe from (select sp1, sp2, case d when 1 then a else o end as a, case d when 1 then o else a end as b, f from fv) group by all"),
]


@query("fe_matrix", upto("md", "select sp1, sp2, a, b, round(fe, 6) as fe from fe", extra=_FE))
def _fe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.fold_enrichment(nets(spark, d), orthologs(spark, d)))


_HOG = [
    *_FE,
    ("slots", "select x.sp1, x.sp2, x.hog, x.gene1 as s1, y.gene2 as s2 from (select distinct sp1, sp2, hog, gene1 from cmp) x join (select distinct sp1, sp2, hog, gene2 from cmp) y using (sp1, sp2, hog)"),
    ("obs", "select s.sp1, s.sp2, s.hog, round(sum(coalesce(fe, 0)), 9) as t_obs from slots s left join fe on fe.sp1 = s.sp1 and fe.sp2 = s.sp2 and fe.a = s.s1 and fe.b = s.s2 group by all"),
    ("ev", f"select species, gene, perm from expr cross join (select unnest(range(1, {N_PERM} + 1)) as perm)"),
    ("sl", "select *, row_number() over (partition by species, perm order by gene) as slot from ev"),
    ("dr", "select species, perm, gene as drawn, row_number() over (partition by species, perm order by md5(concat_ws('|', '7', perm, gene)), gene) as slot from ev"),
    ("sh", "select species, perm, gene, drawn from sl join dr using (species, perm, slot)"),
    ("tp", "select s.sp1, s.sp2, s.hog, x.perm, round(sum(coalesce(fe, 0)), 9) as t from slots s join sh x on x.species = s.sp1 and x.gene = s.s1 join sh y on y.species = s.sp2 and y.gene = s.s2 and y.perm = x.perm left join fe on fe.sp1 = s.sp1 and fe.sp2 = s.sp2 and fe.a = x.drawn and fe.b = y.drawn group by all"),
    ("fl", "select sp1, sp2, hog, perm, sum(cast(t >= t_obs as integer)) over (partition by sp1, sp2, hog order by perm) as cum from tp join obs using (sp1, sp2, hog) where t_obs > 0"),
    ("sq", f"select sp1, sp2, hog, coalesce(min(perm) filter (cum >= {H}), max(perm)) as n_perm, least(max(cum), {H}) as n_exceed from fl group by all"),
    ("info", "select sp1, sp2, hog, count(*) as n_pairs, count(distinct gene1) as n_sp1, count(distinct gene2) as n_sp2, avg(sqrt(e1 * e2)) as mean_eff from cmp group by all"),
]


def _hog_tests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, o = nets(spark, d), orthologs(spark, d)
    c = C.compare_neighborhoods(n, o)
    return c, P.permutation_hog_test(n, o, c, seed=7)


@query("hog_permutation", upto("cmp", """select i.sp1, i.sp2, i.hog, n_pairs, n_sp1, n_sp2, round(t_obs, 5) as t_obs, cast(coalesce(n_perm, 0) as integer) as n_perm, cast(coalesce(n_exceed, 0) as integer) as n_exceed, round(mean_eff, 5) as mean_eff,
  round(p, 6) as p_value, round(q, 6) as q_value from hp i join hq_t using (sp1, sp2, p)""", extra=[*_HOG, ("hp", "select i.*, t_obs, n_perm, n_exceed, case when n_perm is null then 1.0 else (n_exceed + 1) / (n_perm + 1) end as p from info i join obs using (sp1, sp2, hog) left join sq using (sp1, sp2, hog)"), *discrete_q_sql("hp", "sp1, sp2", "p", "hq", H, N_PERM)]))
def _hog(spark: SparkSession, d: str) -> DataFrame:
    t = _hog_tests(spark, d)[1]
    return t.select(*[F.round(c, 6 if c[1:] == "_value" else 5).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


@query("permutation_edges", upto("cmp", """select c.gene1, c.gene2, c.sp1 as species1, c.sp2 as species2, c.hog, round(q, 6) as q_value, round(sqrt(e1 * e2), 6) as effect_size, round(sqrt(j1 * j2), 6) as jaccard, case when q < 0.05 then 'conserved' else 'ns' end as type
  from cmp c left join (select sp1, sp2, hog, q from hp join hq_t using (sp1, sp2, p)) t using (sp1, sp2, hog)""", extra=[*_HOG, ("hp", "select i.*, t_obs, n_perm, n_exceed, case when n_perm is null then 1.0 else (n_exceed + 1) / (n_perm + 1) end as p from info i join obs using (sp1, sp2, hog) left join sq using (sp1, sp2, hog)"), *discrete_q_sql("hp", "sp1, sp2", "p", "hq", H, N_PERM)]))
def _perm_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.permutation_edges(*_hog_tests(spark, d)))


@query("coclassification", upto("nbr", """select species, i, j, round(o, 6) as observed, round(x, 6) as expected, round(greatest(o - x, 0), 6) as excess from (
  select e.species, e.i, e.j, avg(cast(a.module = b.module as integer)) as o, avg(case when a.module = b.module then power(sz.s / nn.n, 2) else 0.0 end) as x
  from e1 e join scans a on a.species = e.species and a.gene = e.i join scans b on b.species = e.species and b.gene = e.j and b.resolution = a.resolution
  join sz on sz.species = a.species and sz.resolution = a.resolution and sz.module = a.module join nn on nn.species = a.species group by all)""",
  extra=[_SCANS, _INNER, ("sz", "select species, resolution, module, count(*) as s from scans group by all"), ("nn", "select species, count(*) as n from expr group by all")]))
def _co(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.coclassification(scans(spark, d), M.thresholded(nets(spark, d))))


_C2 = "({0} * ({0} - 1) / 2)"


@query("adjusted_rand", upto("expr", f"""select species, resolution, n_modules, round(case when n < 2 or (sa + sb) / 2 = sa * sb / {_C2.format('n')} then 1.0 else (sij - sa * sb / {_C2.format('n')}) / ((sa + sb) / 2 - sa * sb / {_C2.format('n')}) end, 6) as ari_next
  from nm left join (select c.species, c.resolution, sij, n, sa, sb from
  (select species, resolution, sum({_C2.format('n')}) as sij, cast(sum(n) as double) as n from cells group by all) c join (select species, resolution, sum({_C2.format('n')}) as sa from (select species, resolution, a, cast(sum(n) as double) as n from cells group by all) group by all) x using (species, resolution)
  join (select species, resolution, sum({_C2.format('n')}) as sb from (select species, resolution, b, cast(sum(n) as double) as n from cells group by all) group by all) y using (species, resolution)) using (species, resolution)""",
  extra=[_SCANS, ("cells", "select x.species, x.resolution, x.module as a, y.module as b, cast(count(*) as double) as n from scans x join scans y on x.species = y.species and x.gene = y.gene and y.resolution = x.resolution + 1 group by all"), ("nm", "select species, resolution, count(distinct module) as n_modules from scans group by all")]))
def _ari(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.resolution_scan(scans(spark, d)))


@query("modularity", upto("nbr", """select c.species, c.resolution, round(sum(l / m - power(d / (2 * m), 2)), 6) as modularity from (
    select species, resolution, c, sum(l) as l, count(*) as d from (select species, resolution, a as c, case when a = b then 1 else 0 end as l from em union all select species, resolution, b, 0 from em) group by all) c
  join (select species, resolution, cast(count(*) as double) as m from em group by all) using (species, resolution) group by all""",
  extra=[_SCANS, _INNER, ("em", "select e.species, a.resolution, a.module as a, b.module as b from e1 e join scans a on a.species = e.species and a.gene = e.i join scans b on b.species = e.species and b.gene = e.j and b.resolution = a.resolution")]))
def _modularity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.modularity(scans(spark, d), M.thresholded(nets(spark, d))))


_MP = [
    _MEM,
    ("mr", "select distinct o.sp1, o.sp2, gene1, gene2, a.module as module1, b.module as module2 from ortho o join mem a on a.species = sp1 and a.gene = gene1 join mem b on b.species = sp2 and b.gene = gene2"),
    ("un", "select sp1, sp2, count(distinct gene2) as n from mr group by all"),
    ("m1", "select distinct sp1, sp2, module1, gene2 from mr"),
    ("m2", "select distinct sp1, sp2, gene2, module2 from mr"),
    ("mp0", """select u.sp1, u.sp2, a.module as module1, b.module as module2, u.n, coalesce(k, 0) as k, coalesce(m, 0) as m, coalesce(x, 0) as x
      from un u join (select distinct species, module from mem) a on a.species = u.sp1 join (select distinct species, module from mem) b on b.species = u.sp2
      left join (select sp1, sp2, module1 as module, count(*) as k from m1 group by all) s1 on s1.sp1 = u.sp1 and s1.sp2 = u.sp2 and s1.module = a.module
      left join (select sp1, sp2, module2 as module, count(*) as m from m2 group by all) s2 on s2.sp1 = u.sp1 and s2.sp2 = u.sp2 and s2.module = b.module
      left join (select m1.sp1, m1.sp2, module1, module2, count(*) as x from m1 join m2 using (sp1, sp2, gene2) group by all) o on o.sp1 = u.sp1 and o.sp2 = u.sp2 and o.module1 = a.module and o.module2 = b.module"""),
    ("mp", f"select *, case when k + m - x > 0 then x / (k + m - x) else 0.0 end as jac, case when x > 0 and m > 0 and k > 0 then {upper()} else 1.0 end as p from mp0"),
    *q_sql("mp", "sp1, sp2", "p", "qm"),
    ("mq", "select * from mp join qm_t using (sp1, sp2, p)"),
    ("bm0", """select *, row_number() over (partition by sp1, sp2, direction, module order by p, best_match) as rn, count(*) filter (qm < 0.05) over (partition by sp1, sp2, direction, module) as n_significant from (
      select sp1, sp2, 'sp1' as direction, module1 as module, module2 as best_match, p, qm, jac from mq union all select sp1, sp2, 'sp2', module2, module1, p, qm, jac from mq)"""),
    ("cl", "select sp1, sp2, direction as species, module, best_match, case when qm >= 0.05 then 'species_specific' when jac >= 0.1 then 'conserved' else 'partially_conserved' end as classification from bm0 where rn = 1"),
]


@query("module_overlap_hyper", upto("ortho", "select sp1, sp2, module1, module2, k as size1, m as size2, x as overlap, n as universe, round(jac, 6) as jaccard, round(p, 8) as p_value, round(qm, 6) as q_value from mq", extra=_MP))
def _hyper(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.compare_modules(members(spark, d), orthologs(spark, d)), 6).withColumn("p_value", F.col("p_value"))


ORACLES["module_overlap_hyper"] = ORACLES["module_overlap_hyper"].replace("round(p, 8)", "round(p, 6)")


@query("best_matches", upto("ortho", "select sp1, sp2, direction, module, best_match, round(p, 6) as p_value, round(qm, 6) as q_value, round(jac, 6) as jaccard, n_significant from bm0 where rn = 1", extra=_MP))
def _best(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.best_matches(M.compare_modules(members(spark, d), orthologs(spark, d))))


@query("classify_modules", upto("ortho", "select * from cl", extra=_MP))
def _classify(spark: SparkSession, d: str) -> DataFrame:
    return M.classify_modules(M.compare_modules(members(spark, d), orthologs(spark, d)))


@query("module_jaccard_perm", upto("ortho", f"""select sp1, sp2, module1, module2, x as overlap, round(jac, 6) as jaccard, cast(coalesce(n_perm, 0) as integer) as n_perm, cast(coalesce(n_exceed, 0) as integer) as n_exceed,
    round(pj, 6) as p_value, round(q, 6) as q_value from jp join jq_t using (sp1, sp2, pj)""", extra=[*_MP,
    ("ev", f"select * from mr cross join (select unnest(range(1, {N_PERM} + 1)) as perm)"),
    ("lf", "select perm, sp1, sp2, module1, row_number() over (partition by perm, sp1, sp2 order by gene1, gene2) as slot from ev"),
    ("rt", "select perm, sp1, sp2, gene2, module2, row_number() over (partition by perm, sp1, sp2 order by md5(concat_ws('|', '3', perm, gene1 || ':' || gene2)), gene1, gene2) as slot from ev"),
    ("dw", "select distinct perm, sp1, sp2, module1, gene2, module2 from lf join rt using (perm, sp1, sp2, slot)"),
    ("dk", "select perm, sp1, sp2, module1, count(*) as k from dw group by all"),
    ("dx", "select perm, sp1, sp2, module1, module2, count(*) as x from dw group by all"),
    ("gr", f"select sp1, sp2, module1, module2, jac, m, perm from mp cross join (select unnest(range(1, {N_PERM} + 1)) as perm) where jac > 0"),
    ("fl", "select g.*, sum(cast(coalesce(round(dx.x / (dk.k + g.m - dx.x), 9) >= round(g.jac, 9), false) as integer)) over (partition by g.sp1, g.sp2, g.module1, g.module2 order by g.perm) as cum from gr g left join dx on dx.perm = g.perm and dx.sp1 = g.sp1 and dx.sp2 = g.sp2 and dx.module1 = g.module1 and dx.module2 = g.module2 left join dk on dk.perm = g.perm and dk.sp1 = g.sp1 and dk.sp2 = g.sp2 and dk.module1 = g.module1"),
    ("sq", f"select sp1, sp2, module1, module2, coalesce(min(perm) filter (cum >= {H}), max(perm)) as n_perm, least(max(cum), {H}) as n_exceed from fl group by all"),
    ("jp", "select mp.*, n_perm, n_exceed, case when n_perm is null then 1.0 else (n_exceed + 1) / (n_perm + 1) end as pj from mp left join sq using (sp1, sp2, module1, module2)"),
    *discrete_q_sql("jp", "sp1, sp2", "pj", "jq", H, N_PERM),
]))
def _jac_perm(spark: SparkSession, d: str) -> DataFrame:
    t = M.compare_modules(members(spark, d), orthologs(spark, d), "jaccard", seed=3)
    return rounded(t.select("sp1", "sp2", "module1", "module2", "overlap", "jaccard", "n_perm", "n_exceed", "p_value", "q_value"))


_DENS = [_MEM, _INNER,
    ("dn", "select e.species, least(a.module, b.module) as mi, greatest(a.module, b.module) as mj, count(*) as n_edges from e1 e join mem a on a.species = e.species and a.gene = e.i join mem b on b.species = e.species and b.gene = e.j where a.module <> b.module group by all"),
    ("ms", "select species, module, count(*) as s from mem group by all")]


@query("module_density", upto("nbr", "select d.species, mi, mj, n_edges, round(n_edges / (a.s * b.s), 6) as density from dn d join ms a on a.species = d.species and a.module = mi join ms b on b.species = d.species and b.module = mj", extra=_DENS))
def _density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.module_density(members(spark, d), M.thresholded(nets(spark, d))))


@query("coarsen_modules")
def _coarsen(spark: SparkSession, d: str) -> DataFrame:
    return M.coarsen_modules(members(spark, d), M.thresholded(nets(spark, d)), 5)


def _contrasts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("AB", "SP_A", "SP_B"), ("CD", "SP_C", "SP_D")], "pair_name string, sp1 string, sp2 string")


@query("compare_modules_paired", upto("ortho", """select pair_name, scale, grp, count(*) as n_modules from (
    select pair_name, 'natural' as scale, case when classification = 'conserved' then 'conserved' when (species = 'sp1') = (sp1 in ('SP_A', 'SP_C')) then 'annual' else 'perennial' end as grp
    from cl join (values ('AB', 'SP_A', 'SP_B'), ('CD', 'SP_C', 'SP_D')) as c(pair_name, sp1, sp2) using (sp1, sp2)) group by all""", extra=_MP))
def _paired(spark: SparkSession, d: str) -> DataFrame:
    o = orthologs(spark, d, SPECIES)
    got = M.compare_modules_paired(members(spark, d, SPECIES), o, _contrasts(spark), traits(spark), M.thresholded(nets(spark, d, SPECIES)), "hypergeometric")
    return M.paired_summary(got.classification)


@query("compare_modules_matched")
def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Ten modules against four: the finer side is coarsened and compared again."""
    m = members(spark, d, SPECIES).withColumn("module", F.when(F.col("species").isin("SP_B", "SP_D"), F.col("module") % 4 + 1).otherwise(F.col("module")).cast("int"))
    got = M.compare_modules_paired(m, orthologs(spark, d, SPECIES), _contrasts(spark), traits(spark), M.thresholded(nets(spark, d, SPECIES)), "hypergeometric")
    return M.paired_summary(got.classification)


_SPEC = ("cs", "select case sp1 || sp2 when 'SP_ASP_B' then 'AB' else 'CD' end as pair_name, species, module, classification from cl where (sp1, sp2) in (('SP_A', 'SP_B'), ('SP_C', 'SP_D'))")


def _tag_recurring(labels: str, by: str) -> str:
    return f"""select {by} p.hog, count(*) as n_contrasts from (select {by} s.pair_name, max(s.side) filter (l.trait = 'annual') as side from sd s join {labels} l on l.species = s.species group by {by} s.pair_name having count(*) filter (l.trait = 'annual') = 1) o
      join pool p on p.pair_name = o.pair_name and p.side = o.side group by {by} p.hog having count(*) >= 2"""


@query("tag_permutation", upto("ortho", f"""select cast(n_observed as integer) as n_observed, 1000 as n_perm, cast(case when n_observed = 0 then 1000 else e end as integer) as n_exceed, round((case when n_observed = 0 then 1000 else e end + 1) / 1001, 6) as p_value
  from (select (select count(*) from rec) as n_observed, (select count(*) from (select perm, count(*) as n from nul group by perm) where n >= (select count(*) from rec)) as e)""", extra=[*_MP, _SPEC,
    ("sd", "select * from (values ('AB', 'sp1', 'SP_A'), ('AB', 'sp2', 'SP_B'), ('CD', 'sp1', 'SP_C'), ('CD', 'sp2', 'SP_D')) as t(pair_name, side, species)"),
    ("pool", "select distinct c.pair_name, c.species as side, x.hog from cs c join sd s on s.pair_name = c.pair_name and s.side = c.species join mem m on m.species = s.species and m.module = c.module join expr x on x.species = m.species and x.gene = m.gene where c.classification = 'species_specific' and x.gene in (select gene1 from ortho union select gene2 from ortho)"),
    ("tr", "select * from (values ('SP_A', 'annual'), ('SP_B', 'perennial'), ('SP_C', 'annual'), ('SP_D', 'perennial')) as t(species, trait)"),
    ("rec", _tag_recurring("tr", "")),
    ("ev", "select species, perm from tr cross join (select unnest(range(1, 1001)) as perm)"),
    ("lb", "select s.perm, s.species, tr.trait from (select *, row_number() over (partition by perm order by species) as slot from ev) s join (select perm, species as drawn, row_number() over (partition by perm order by md5(concat_ws('|', '5', perm, species)), species) as slot from ev) r on r.perm = s.perm and r.slot = s.slot join tr on tr.species = r.drawn"),
    ("nul", _tag_recurring("lb", "l.perm,").replace("p.hog, count(*)", "p.hog, count(*)").replace("select l.perm, p.hog", "select o.perm, p.hog").replace("group by l.perm, p.hog", "group by o.perm, p.hog")),
]))
def _tag(spark: SparkSession, d: str) -> DataFrame:
    o, m = orthologs(spark, d, SPECIES), members(spark, d, SPECIES)
    c = M.classify_modules(M.compare_modules(m, o)).join(_contrasts(spark), ["sp1", "sp2"]).select("pair_name", "species", "module", "classification")
    return rounded(P.tag_permutation(c, m, o, _contrasts(spark), traits(spark), "annual", seed=5)[0])


_HUBS = [_MEM, _INNER,
    ("em", "select e.*, a.module as ma, b.module as mb from e1 e join mem a on a.species = e.species and a.gene = e.i join mem b on b.species = e.species and b.gene = e.j"),
    ("en", "select species, i as gene, w, ma = mb as inn from em union all select species, j, w, ma = mb from em"),
    ("st", "select species, gene, sum(w) as gd, coalesce(sum(w) filter (inn), 0) as dg, count(*) filter (inn) as links from en group by all"),
    ("hb0", "select m.species, m.module, m.gene, x.hog, count(*) over (partition by m.species, m.module) as n, coalesce(dg, 0.0) as degree, coalesce(gd, 0.0) as global_degree, case when links > 0 then dg / links else 0.0 end as mean_edge_weight from mem m join expr x using (species, gene) left join st using (species, gene)"),
    ("hb", """select species, module, gene, hog, degree, global_degree, mean_edge_weight, rank() over (partition by species, module order by round(degree, 7) desc) as rank,
        row_number() over (partition by species, module order by round(degree, 7) desc, round(global_degree, 7) desc, round(mean_edge_weight, 7) desc, gene) <= greatest(1, ceil(0.1 * n)) as is_hub from hb0""")]  # fmt: skip


def _hubs(spark: SparkSession, d: str, species=SPECIES) -> DataFrame:
    x = expression(spark, d, species)
    edges = M.thresholded(nets(spark, d, species))
    return M.identify_module_hubs(members(spark, d, species), edges, x.select("species", "gene", "hog"))


@query("hub_cascade", upto("nbr", "select species, module, gene, hog, round(degree, 4) as degree, round(global_degree, 4) as global_degree, round(mean_edge_weight, 4) as mean_edge_weight, cast(rank as integer) as rank, is_hub from hb", extra=_HUBS))
def _cascade(spark: SparkSession, d: str) -> DataFrame:
    h = _hubs(spark, d).select("species", "module", "gene", "hog", "degree", "global_degree", "mean_edge_weight", "rank", "is_hub")
    return rounded(h, 4)


@query("module_hubs")
def _module_hubs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hubs(spark, d, SPECIES), 4)


@query("hub_conservation", upto("nbr", """select b.hog, case when b.n_species_hub = 0 then 'non_hub' when coalesce(n_traits, 0) >= 2 and n_known = 0 then 'multi_trait_hub' when coalesce(n_traits, 0) >= 2 and n_ok / n_known >= 0.5 then 'conserved_hub'
    when coalesce(n_traits, 0) >= 2 then 'rewired_hub' when n_traits = 1 then one || '_specific_hub' else 'sporadic_hub' end as classification, n_species, n_species_hub,
    case when n_traits >= 2 then n_cross_pairs end as n_cross_pairs, case when n_traits >= 2 and n_known > 0 then n_ok end as n_corresponding
  from b left join gr on gr.hog = b.hog left join cp on cp.hog = b.hog""", extra=[*_HUBS, ("ortho", "select a.species as sp1, b.species as sp2, a.gene as gene1, b.gene as gene2, a.hog from expr a join expr b on a.hog = b.hog and a.species < b.species"), *_MP[1:-2],
    ("sp", "select hog, species, bool_or(is_hub) as hub, max_by(module, (degree, gene)) filter (is_hub) as module, any_value(case when species in ('SP_A', 'SP_C') then 'annual' else 'perennial' end) as trait from hb group by hog, species"),
    ("b", "select hog, count(*) as n_species, count(*) filter (hub) as n_species_hub from sp group by hog"),
    ("bt", "select hog, trait from sp group by hog, trait having count(*) filter (hub) > 0 and count(*) filter (hub) / count(*) >= 0.5"),
    ("gr", "select hog, count(*) as n_traits, min(trait) as one from bt group by hog"),
    ("hs", "select sp.* from sp join bt using (hog, trait) where hub"),
    ("mt", "select sp1, sp2, module1, module2, qm < 0.05 and jac >= 0.1 as ok from mq union all select sp2, sp1, module2, module1, qm < 0.05 and jac >= 0.1 from mq"),
    ("cp", "select a.hog, count(*) as n_cross_pairs, count(*) as n_known, count(*) filter (mt.ok) as n_ok from hs a join hs b on a.hog = b.hog and a.trait < b.trait left join mt on mt.sp1 = a.species and mt.sp2 = b.species and mt.module1 = a.module and mt.module2 = b.module group by a.hog"),
]))
def _hub_cons(spark: SparkSession, d: str) -> DataFrame:
    pairs = M.compare_modules(members(spark, d, SPECIES), orthologs(spark, d, SPECIES))
    return M.classify_hub_conservation(_hubs(spark, d, SPECIES), traits(spark), pairs)


def _characterized(spark: SparkSession, d: str) -> DataFrame:
    x = expression(spark, d)
    notes = x.where("label < 5").select("gene", "label", F.col("hog").alias("hub_note"))
    c = M.characterize_hubs(_hubs(spark, d), x, notes)
    return c.select("species", "module", "gene", F.round("bridge_fraction", 5).alias("bridge_fraction"), F.round("bt_degree_ratio", 5).alias("bt_degree_ratio"), F.round("cv", 3).alias("cv"), "label", "hub_note")


@query("characterize_hubs")
def _character(spark: SparkSession, d: str) -> DataFrame:
    """All measures; those from shortest paths have no SQL."""
    return _characterized(spark, d)


@query("hub_bridges", upto("nbr", """select h.species, h.module, h.gene, round(case when global_degree > 0 then greatest(0, least(1, 1 - degree / global_degree)) end, 5) as bridge_fraction,
    round(list_stddev_samp(x.v) / abs(list_avg(x.v)), 3) as cv, an.label, hub_note from hb h join expr x using (species, gene) left join an on an.gene = h.gene""", extra=[*_HUBS, ("an", "select gene, min(label) as label, min(hog) as hub_note from expr where label < 5 group by gene")]))
def _bridges(spark: SparkSession, d: str) -> DataFrame:
    return _characterized(spark, d).drop("bt_degree_ratio")


@query("detect_modules")
def _detect(spark: SparkSession, d: str) -> DataFrame:
    return M.partitions(nets(spark, d, SPECIES), "leiden", [0.5, 1.0, 1.5], "modularity")


@query("infomap_modules")
def _infomap(spark: SparkSession, d: str) -> DataFrame:
    return M.partitions(nets(spark, d, SPECIES), "infomap")


@query("sbm_modules")
def _sbm(spark: SparkSession, d: str) -> DataFrame:
    return M.partitions(nets(spark, d, SPECIES), "sbm")


@query("consensus_modules")
def _consensus(spark: SparkSession, d: str) -> DataFrame:
    return M.detect_modules(nets(spark, d, SPECIES), resolutions=[0.5, 1.0, 1.5, 2.0]).modules


@query("structure_test")
def _structure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.structure_test(nets(spark, d, SPECIES), [0.5, 1.0]))


@query("reduce_orthogroups", upto("z", """select x.species, x.gene, case when r >= 0.3 then least(x.gene, o.gene) else x.gene end as representative from expr x left join (
    select a.species, a.gene as gene, b.gene as other, list_dot_product(a.z, b.z) as r from z a join z b on a.species = b.species join expr xa on xa.species = a.species and xa.gene = a.gene join expr xb on xb.species = b.species and xb.gene = b.gene and xa.hog = xb.hog and a.gene <> b.gene) c
  on c.species = x.species and c.gene = x.gene left join expr o on o.species = x.species and o.gene = c.other"""))
def _reduce(spark: SparkSession, d: str) -> DataFrame:
    return M.reduce_orthogroups(expression(spark, d), 0.3).select("species", "gene", "representative")
