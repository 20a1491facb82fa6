"""Queries of the clique operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import cliques as Q
from ..operators.comparison import find_coexpressologs
from ..sources.planted import SPECIES, TRAITS, traits
from .gene_queries import ABC, nets, orthologs, rounded
from .sql import upto

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def edges(spark: SparkSession, d: str, species=ABC) -> DataFrame:
    return find_coexpressologs(nets(spark, d, species), orthologs(spark, d, species))


#: Cliques over all three species: a chain of joins and the least mean q, then genes.
_TRIPLES = [
    ("ce", "select hog, gene1, gene2, species1, species2, q, eff, j from (select hog, gene1, gene2, species1, species2, q, eff, jac as j from edges where type = 'conserved')"),
    ("tr", """select ab.hog, ab.gene1 as a, ab.gene2 as b, ac.gene2 as c, (ab.q + ac.q + bc.q) / 3 as mq, greatest(ab.q, ac.q, bc.q) as xq, (ab.eff + ac.eff + bc.eff) / 3 as me, least(ab.eff, ac.eff, bc.eff) as ne,
        power(greatest(1 - ab.q, 2.220446049250313e-16) * greatest(1 - ac.q, 2.220446049250313e-16) * greatest(1 - bc.q, 2.220446049250313e-16), 1.0 / 3) as it, 1 - (ab.q + ac.q + bc.q) / 3 as mw
      from ce ab join ce ac on ab.hog = ac.hog and ab.gene1 = ac.gene1 and ab.species1 = 'SP_A' and ab.species2 = 'SP_B' and ac.species1 = 'SP_A' and ac.species2 = 'SP_C'
      join ce bc on bc.hog = ab.hog and bc.gene1 = ab.gene2 and bc.gene2 = ac.gene2 and bc.species1 = 'SP_B' and bc.species2 = 'SP_C'"""),
    ("ga", "select hog, species, count(distinct g) as n from (select hog, species1 as species, gene1 as g from ce union all select hog, species2, gene2 from ce) group by all"),
    ("od", "select hog, list(species order by n, species) as o from ga group by hog"),
    ("bt", """select * from (select tr.*, row_number() over (partition by tr.hog order by round(mq, 12),
        case o[1] when 'SP_A' then a when 'SP_B' then b else c end, case o[2] when 'SP_A' then a when 'SP_B' then b else c end, case o[3] when 'SP_A' then a when 'SP_B' then b else c end) as rn from tr join od using (hog)) where rn = 1"""),
]


@query("cliques_3sp", upto("edges", """select hog, 3 as n_species, round(mq, 5) as mean_q, round(xq, 5) as max_q, round(me, 5) as mean_effect_size, 3 as n_edges, 0 as n_missing, round(it, 5) as intensity, round(it / mw, 5) as coherence,
  round(ne, 5) as min_effect_size, a as "SP_A", b as "SP_B", c as "SP_C" from bt""", species="0, 1, 2", extra=_TRIPLES))
def _cliques(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.wide(Q.find_cliques(edges(spark, d), list(ABC)), ABC), 5)


@query("tolerant_cliques")
def _tolerant(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.wide(Q.find_cliques(edges(spark, d, SPECIES), list(SPECIES), 3, max_missing=1), SPECIES), 5)


@query("cliques_all")
def _all(spark: SparkSession, d: str) -> DataFrame:
    """Cliques of two species or more over all species."""
    return rounded(Q.wide(Q.find_cliques(edges(spark, d, SPECIES), list(SPECIES), 2), SPECIES), 5)


@query("clique_stability_all")
def _stability_all(spark: SparkSession, d: str) -> DataFrame:
    """Stability over every set of species that may be left out, with what traits the cliques stand for."""
    e = edges(spark, d, SPECIES)
    c = Q.find_cliques(e, list(SPECIES), 2)
    s = Q.stability_scores(Q.clique_stability(e, list(SPECIES), c)[0])
    return rounded(s.join(Q.annotate_traits(c, list(SPECIES), traits(spark)), ["hog", "clique"]))


@query("clique_traits", upto("edges", """select hog, cast(1 as integer) as clique, 'SP_A,SP_B,SP_C' as species_present, 'annual,perennial' as traits, false as sole_rep from bt""", species="0, 1, 2", extra=_TRIPLES))
def _traits(spark: SparkSession, d: str) -> DataFrame:
    return Q.annotate_traits(Q.find_cliques(edges(spark, d), list(ABC)), list(ABC), traits(spark))


@query("clique_persistence", upto("edges", """select hog, cast(1 as integer) as clique, round(min(r), 5) as persistence, round(avg(r), 5) as mean_persistence from (
    select b.hog, case when na.w / ta.threshold < nb.w / tb.threshold then na.w / ta.threshold else nb.w / tb.threshold end as r
    from cp b left join nbr na on na.species = b.sa and na.g = b.ga left join nbr nb on nb.species = b.sb and nb.g = b.gb left join thr ta on ta.species = b.sa left join thr tb on tb.species = b.sb
    where (b.sa, b.sb, na.nb, nb.nb) in (select (species1, species2, gene1, gene2) from edges)) group by hog
  union all select hog, 1, null, null from bt where hog not in (select b.hog from cp b join nbr na on na.species = b.sa and na.g = b.ga join nbr nb on nb.species = b.sb and nb.g = b.gb where (b.sa, b.sb, na.nb, nb.nb) in (select (species1, species2, gene1, gene2) from edges))""",
  species="0, 1, 2", extra=[*_TRIPLES, ("cp", "select hog, 'SP_A' as sa, a as ga, 'SP_B' as sb, b as gb from bt union all select hog, 'SP_A', a, 'SP_C', c from bt union all select hog, 'SP_B', b, 'SP_C', c from bt")]))
def _persistence(spark: SparkSession, d: str) -> DataFrame:
    n, o = nets(spark, d, ABC), orthologs(spark, d, ABC)
    e = find_coexpressologs(n, o)
    return rounded(Q.clique_persistence(Q.find_cliques(e, list(ABC)), list(ABC), n, e), 5)


_PAIRS_K1 = [
    *_TRIPLES,
    ("pb", """select * from (select hog, species1, species2, gene1, gene2, row_number() over (partition by hog, species1, species2 order by round(q, 12), case when n1 < n2 or (n1 = n2 and species1 < species2) then gene1 else gene2 end, case when n1 < n2 or (n1 = n2 and species1 < species2) then gene2 else gene1 end) as rn
      from (select ce.*, (select count(distinct gene1) from ce c2 where c2.hog = ce.hog and c2.species1 = ce.species1 and c2.species2 = ce.species2) as n1, (select count(distinct gene2) from ce c2 where c2.hog = ce.hog and c2.species1 = ce.species1 and c2.species2 = ce.species2) as n2 from ce)) where rn = 1"""),
    ("tt", """select b.hog, r.removed, case r.removed when 'SP_A' then (p.gene1 = b.b and p.gene2 = b.c) when 'SP_B' then (p.gene1 = b.a and p.gene2 = b.c) else (p.gene1 = b.a and p.gene2 = b.b) end as stable
      from bt b cross join (values ('SP_A', 'SP_B', 'SP_C'), ('SP_B', 'SP_A', 'SP_C'), ('SP_C', 'SP_A', 'SP_B')) as r(removed, s1, s2) left join pb p on p.hog = b.hog and p.species1 = r.s1 and p.species2 = r.s2"""),
]


@query("clique_stability_k1", upto("edges", """select hog, cast(1 as integer) as clique, count(*) as n_tested, count(*) filter (stable) as n_stable, round(count(*) filter (stable) / count(*), 6) as score,
  cast(case when count(*) filter (stable) = count(*) then 1 else 0 end as integer) as stability_class from tt group by hog""", species="0, 1, 2", extra=_PAIRS_K1))
def _stability(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return rounded(Q.stability_scores(Q.clique_stability(e, list(ABC), Q.find_cliques(e, list(ABC)), max_k=1)[0]))


@query("clique_disruption", upto("edges", "select removed as species, count(*) filter (not stable) as n_cliques_disrupted from tt group by removed", species="0, 1, 2", extra=_PAIRS_K1))
def _disruption(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return Q.species_disruption(Q.clique_stability(e, list(ABC), Q.find_cliques(e, list(ABC)), max_k=1)[0])


@query("slot_jaccard")
def _slot(spark: SparkSession, d: str) -> DataFrame:
    """Every clique of two species or more against its group's cliques at a raised threshold."""
    n, o, species = nets(spark, d, SPECIES), orthologs(spark, d, SPECIES), list(SPECIES)
    raised = n.thresholds.select("species", "threshold").withColumn("variant", F.lit(_STEPS[0]))
    kept = n.weights.join(F.broadcast(raised), "species").where(F.col("w") >= F.col("threshold") * F.col("variant")).select("variant", "species", "i", "j", "w")
    base = Q.find_cliques(find_coexpressologs(n, o), species, 2).select("hog", "clique", F.col("genes").alias("s1"))
    other = Q.find_cliques(Q.variant_edges(kept, n.genes, o, [_STEPS[0]], 0.05), species, 2, keys=["variant"]).select("hog", F.col("clique").alias("other"), F.col("genes").alias("s2"))
    return base.join(other, "hog").select("hog", "clique", "other", F.round(Q.slot_jaccard("s1", "s2"), 6).alias("jaccard"))


def _sets_sql() -> list[tuple[str, str]]:
    """Feasible maximal species sets of every group with their least mean q, for four species with at most ten genes each."""
    sp = list(SPECIES)
    edge = lambda x, y: f"(select hog, gene1 as {x}, gene2 as {y}, q as q_{x}{y} from ce where species1 = '{dict(zip('abcd', sp))[x]}' and species2 = '{dict(zip('abcd', sp))[y]}')"
    pairs = ["ab", "ac", "ad", "bc", "bd", "cd"]
    triples = ["abc", "abd", "acd", "bcd"]
    of = lambda s: [p for p in pairs if set(p) <= set(s)]

    def best(s: str) -> str:
        first, *rest = of(s)
        text, have = f"{edge(*first)} e0", set(first)
        for k, p in enumerate(rest, 1):
            text += f" join {edge(*p)} e{k} using ({', '.join(['hog', *sorted(set(p) & have)])})"
            have |= set(p)
        return f"select hog, '{s}' as s, min(({' + '.join(f'q_{p}' for p in of(s))}) / {len(of(s))}) as mq from {text} group by hog"

    return [
        ("ce", "select hog, gene1, gene2, species1, species2, q from edges where type = 'conserved'"),
        ("b2", " union all ".join(best(p) for p in pairs)),
        ("b3", " union all ".join(best(t) for t in triples)),
        ("b4", best("abcd")),
        ("k3", " union all ".join(f"select hog, '{t}' as s from b2 group by hog having count(*) filter (s in ({', '.join(repr(p) for p in of(t))})) = 3" for t in triples)),
        ("k4", "select hog from b2 group by hog having count(*) = 6"),
        ("fc", """select hog, s, mq from b4 union all select hog, s, mq from b3 where hog not in (select hog from k4)
          union all select b2.hog, b2.s, mq from b2 where not exists (select 1 from k3 where k3.hog = b2.hog and contains(k3.s, b2.s[1]) and contains(k3.s, b2.s[2]))"""),
        ("fg", """select hog, bool_or(len(s) = 4) as complete, bool_or((contains(s, 'a') or contains(s, 'c')) and (contains(s, 'b') or contains(s, 'd'))) as crossing,
            min((mq, len(s))) as bf, min((mq, len(s))) filter (len(s) = 4) as bc from fc group by hog"""),
        ("wi", "select hog, string_agg(case s when 'ac' then 'annual' else 'perennial' end, ',' order by s) as ts, count(*) as n, min(mq) as mq from b2 where s in ('ac', 'bd') group by hog"),
        ("cx", "select distinct hog from b2 where s not in ('ac', 'bd')"),
        ("cf", """select h.hog, case when complete then 'complete' when crossing then 'partial' when wi.n = 2 and h.hog not in (select hog from cx) then 'differentiated' when wi.n = 1 then 'trait_specific' else 'unclassified' end as classification,
            bf, bc, wi.mq, wi.ts from (select distinct hog from edges) h left join fg on fg.hog = h.hog left join wi on wi.hog = h.hog"""),
    ]


@query("classify_cliques", upto("edges", """select hog, classification, cast(case classification when 'complete' then 4 when 'partial' then bf[2] when 'unclassified' then null else 2 end as integer) as n_species,
  round(case classification when 'complete' then bc[1] when 'partial' then bf[1] when 'unclassified' then null else mq end, 6) as best_mean_q, case when classification in ('differentiated', 'trait_specific') then ts end as trait_groups from cf""", extra=_sets_sql()))
def _classify(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.classify_cliques(edges(spark, d, SPECIES), list(SPECIES), TRAITS))


_STEPS = (1.01, 1.02, 1.03)


def _sweep_sql() -> str:
    base = upto("edges", "select hog, a, b, c from bt", species="0, 1, 2", extra=_TRIPLES)
    found = " union all ".join(f"select {m} as m, * from ({upto('edges', 'select hog, a, b, c from bt', species='0, 1, 2', extra=_TRIPLES, mult=str(m))})" for m in _STEPS)
    return f"""with base as materialized ({base}), found as materialized ({found}),
      t as (select base.hog, m.m, (cast(base.a = f.a as integer) + cast(base.b = f.b as integer) + cast(base.c = f.c as integer)) / 3 as j from base cross join (values {', '.join(f'({m})' for m in _STEPS)}) as m(m) left join found f on f.hog = base.hog and f.m = m.m)
      select hog, cast(1 as integer) as clique, cast(1 as double) as birth, cast(min(m) filter (coalesce(j, 0) < 0.5) as double) as death, round(cast(min(m) filter (coalesce(j, 0) < 0.5) as double) - 1, 6) as persistence from t group by hog"""


@query("clique_threshold_sweep", _sweep_sql())
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    n, o = nets(spark, d, ABC), orthologs(spark, d, ABC)
    return rounded(Q.clique_threshold_sweep(Q.find_cliques(find_coexpressologs(n, o), list(ABC)), list(ABC), n, o, list(_STEPS))[1])


@query("clique_perturbation")
def _perturb(spark: SparkSession, d: str) -> DataFrame:
    n, o = nets(spark, d, SPECIES), orthologs(spark, d, SPECIES)
    return rounded(Q.clique_perturbation_test(Q.find_cliques(find_coexpressologs(n, o), list(SPECIES)), list(SPECIES), n, o))


def _intensity_sql() -> str:
    base = upto("edges", "select hog, it from bt", species="0, 1, 2", extra=_TRIPLES)
    shuffled = """select l.sp1, l.sp2, l.gene1, r.gene2, l.hog from (select *, row_number() over (partition by sp1, sp2 order by gene1, gene2, hog) as slot from ortho0) l
      join (select *, row_number() over (partition by sp1, sp2 order by md5(concat_ws('|', '1', '{p}', gene1 || ':' || gene2 || ':' || hog)), gene1, gene2, hog) as slot from ortho0) r on l.sp1 = r.sp1 and l.sp2 = r.sp2 and l.slot = r.slot"""
    null = " union all ".join("select * from (" + upto("edges", "select hog, it from bt", species="0, 1, 2", extra=_TRIPLES, before={"ortho": shuffled.replace("{p}", str(p))}) + ")" for p in (1, 2, 3))
    return f"""with base as materialized ({base}), nul as materialized ({null})
      select base.hog, cast(1 as integer) as clique, round(any_value(base.it), 6) as intensity, round(avg(nul.it), 6) as null_mean, round(stddev_samp(nul.it), 6) as null_sd,
        round(case when stddev_samp(nul.it) > 0 then (any_value(base.it) - avg(nul.it)) / stddev_samp(nul.it) end, 4) as z, count(nul.it) as n_matched,
        round(case when count(nul.it) > 0 then (count(*) filter (nul.it >= base.it) + 1) / (count(nul.it) + 1) end, 6) as p_value from base left join nul on nul.hog = base.hog group by base.hog"""


@query("clique_intensity_test", _intensity_sql())
def _intensity(spark: SparkSession, d: str) -> DataFrame:
    n, o = nets(spark, d, ABC), orthologs(spark, d, ABC)
    t = rounded(Q.clique_intensity_test(Q.find_cliques(find_coexpressologs(n, o), list(ABC)), list(ABC), n, o))
    return t.withColumn("z", F.round("z", 4))
