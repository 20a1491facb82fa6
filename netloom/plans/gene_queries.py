"""Queries of the sources, network and comparison operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import comparison as C, network as N, similarity as S
from ..sources import orthologs as O
from ..sources.planted import SPECIES, expression, traits
from ..sources.tables import table
from .sql import lower, q_sql, upper, upto

ABC = ("SP_A", "SP_B", "SP_C")
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


def nets(spark: SparkSession, d: str, species=SPECIES, **kw) -> N.Networks:
    return N.compute_network(expression(spark, d, species), **kw)


def orthologs(spark: SparkSession, d: str, species=SPECIES) -> DataFrame:
    return O.extract_orthologs(expression(spark, d, species).select("species", "gene", "hog"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("parse_orthologs", """with c as (select 'SP' || (o_custkey % 5) as species, 'g' || o_orderkey as gene_id,
    'SP1:' || 'a' || (o_orderkey % 97) || ',b' || (o_orderkey % 89) || ';SP2:c' || (o_orderkey % 83) || ';SP3:d' || (o_custkey % 11) as gene_content from orders),
  r as (select *, dense_rank() over (order by gene_content) as hog from c where species = 'SP1'),
  e as (select gene_id, hog, unnest(string_split(gene_content, ';')) as entry from r)
  select gene_id as "Species1", unnest(string_split(string_split(entry, ':')[2], ',')) as "Species2", cast(hog as varchar) as hog from e where contains(entry, 'SP2')""")
def _parse(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    content = F.format_string("SP1:a%d,b%d;SP2:c%d;SP3:d%d", k % 97, k % 89, k % 83, c % 11)
    g = table(spark, d, "orders").select(F.concat(F.lit("SP"), (c % 5).cast("string")).alias("species"), F.concat(F.lit("g"), k.cast("string")).alias("gene_id"), content.alias("gene_content"))
    return O.parse_orthologs(g, "SP1", "SP2")


@query("long_to_matrix", """with o as (select 'S' || (l_suppkey % 3) as species, 'G' || l_partkey as gene, 'T' || lpad(cast(month(l_shipdate) as varchar), 2, '0') as sample, max(l_quantity) as value from lineitem group by all)
  select species, gene, string_agg(sample, ',' order by sample) as samples, cast(count(*) as integer) as n_samples, round(sum(value), 4) as total from o group by species, gene""")
def _long(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("abbrev"), F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_id"),
        F.concat(F.lit("T"), F.lpad(F.month("l_shipdate").cast("string"), 2, "0")).alias("sample_id"), F.col("l_quantity").cast("double").alias("v"))
    p = O.long_to_profiles(x, "abbrev", "gene_id", "sample_id", "v")
    return p.select("species", "gene", F.array_join("samples", ",").alias("samples"), F.size("samples").alias("n_samples"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("extract_orthologs", upto("ortho", "select sp1, sp2, gene1, gene2, hog from ortho"))
def _extract(spark: SparkSession, d: str) -> DataFrame:
    return orthologs(spark, d)


@query("prepare_orthologs", upto("expr", """select distinct a.species as sp1, b.species as sp2, a.gene as gene1, b.gene as gene2, a.hog
  from mapped0 a join mapped0 b on a.hog = b.hog and a.species < b.species""", extra=[("mapped0", "select species, min(gene) over (partition by species, hog) as gene, hog from expr")]))
def _prepare(spark: SparkSession, d: str) -> DataFrame:
    rows = expression(spark, d).select("species", "gene", "hog")
    first = rows.groupBy("species", "hog").agg(F.min("gene").alias("representative"))
    return O.prepare_orthologs(rows, rows.join(first, ["species", "hog"]).select("species", F.col("gene").alias("original"), "representative"))


@query("var_filter", upto("expr", "select species, gene, round(list_var_samp(v), 6) as variance from expr where list_var_samp(v) > 0.03"))
def _var(spark: SparkSession, d: str) -> DataFrame:
    p = S.variance_filter(expression(spark, d), 0.03)
    return p.select("species", "gene", F.round(S.sample_variance("values"), 6).alias("variance"))


@query("pearson_pairs", upto("r", "select species, i, j, round(r + 3e-11, 8) + 0.0 as r from r"))
def _pearson(spark: SparkSession, d: str) -> DataFrame:
    return S.correlations(expression(spark, d)).withColumn("r", F.round(F.col("r") + 3e-11, 8) + F.lit(0.0))


_SPEARMAN = [
    ("u", "select species, gene, unnest(v) as x, generate_subscripts(v, 1) as p from expr"),
    ("ur", "select species, gene, p, rank() over (partition by species, gene order by x) + (count(*) over (partition by species, gene, x) - 1) / 2 as x from u"),
    ("uz", "select species, gene, list(x order by p) as v from ur group by all"),
    ("zs", "select species, gene, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))) as z from uz"),
]


@query("spearman_pairs", upto("expr", "select a.species, a.gene as i, b.gene as j, round(abs(list_dot_product(a.z, b.z)), 7) + 0.0 as r from zs a join zs b on a.species = b.species and a.gene < b.gene", extra=_SPEARMAN))
def _spearman(spark: SparkSession, d: str) -> DataFrame:
    return S.correlations(expression(spark, d), "spearman", absolute=True).withColumn("r", F.round("r", 7) + F.lit(0.0))


@query("mutual_rank_raw", upto("w", "select species, i, j, round(w, 6) as w from w"))
def _mr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.mutual_rank(S.correlations(expression(spark, d))))


@query("mutual_rank_log", upto("sym", "select a.species, a.g as i, a.nb as j, round(least(1.0, greatest(0.0, 1 - ln(sqrt(a.k * b.k)) / ln(nn.n))), 6) as w from rd a join rd b on a.species = b.species and a.g = b.nb and a.nb = b.g join nn on nn.species = a.species where a.g < a.nb",
  extra=[("rd", "select *, rank() over (partition by species, g order by r desc) + (count(*) over (partition by species, g, r) - 1) / 2 as k from sym"), ("nn", "select species, count(distinct g) as n from sym group by species")]))
def _mr_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.mutual_rank(S.correlations(expression(spark, d)), log_transform=True))


@query("clr", upto("sym", "select r.species, i, j, round(sqrt(power(greatest(0, (r - a.mu) / a.sd), 2) + power(greatest(0, (r - b.mu) / b.sd), 2)), 6) as w from r join ms a on a.species = r.species and a.g = i join ms b on b.species = r.species and b.g = j",
  extra=[("ms", "select species, g, avg(r) as mu, case when stddev_samp(r) < 1e-10 then 1 else stddev_samp(r) end as sd from sym group by all")]))
def _clr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(N.clr(S.correlations(expression(spark, d))))


@query("density_threshold", upto("thr", "select species, round(threshold, 6) as threshold, n_pairs from thr"))
def _threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nets(spark, d).thresholds)


@query("density_threshold_blocks", upto("thr", "select species, round(threshold, 6) as threshold, n_pairs from thr"))
def _threshold_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The way of species above LOCAL_GENES: correlations in blocks, ranks by windows."""
    return rounded(nets(spark, d, local_genes=0).thresholds)


@query("adjacency_degree", upto("nbr", "select species, g, count(*) as degree, round(sum(w), 4) as strength from nbr group by all"))
def _degree(spark: SparkSession, d: str) -> DataFrame:
    return nets(spark, d).neighbours().groupBy("species", "g").agg(F.count("*").alias("degree"), F.round(F.sum("w"), 4).alias("strength"))


_CMP = ", ".join(f"{a}{i} as sp{i}_{b}" if a in "mkx" else f"round({a}{i}, 6) as sp{i}_{b}" for i in (1, 2) for a, b in (("m", "neigh"), ("k", "ortho_neigh"), ("x", "overlap"), ("pc", "p_con"), ("pd", "p_div"), ("e", "effect"), ("j", "jaccard")))


@query("compare_neighborhoods", upto("cmp", f"select sp1, sp2, hog, gene1, gene2, {_CMP} from cmp"))
def _compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.compare_neighborhoods(nets(spark, d), orthologs(spark, d)))


@query("hypergeom_tail", upto("e", f"""select x, m, k, n, round({upper()}, 8) as upper, round({lower()}, 8) as lower
  from (select distinct l_linenumber as x, cast(l_quantity as integer) as m, cast(l_partkey % 40 + 1 as integer) as k, 120 + l_linenumber * 30 as n from lineitem)"""))
def _tails(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.stats import hypergeom_lower, hypergeom_upper

    t = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("x"), F.col("l_quantity").cast("int").alias("m"), (F.col("l_partkey") % 40 + 1).cast("int").alias("k"), (F.lit(120) + F.col("l_linenumber") * 30).cast("int").alias("n")).distinct()
    a = [F.col(c) for c in "xmkn"]
    return t.select("x", "m", "k", "n", F.round(hypergeom_upper(*a), 8).alias("upper"), F.round(hypergeom_lower(*a), 8).alias("lower"))


@query("storey_qvalues", upto("q2_t", "select sp1, sp2, hog, gene1, gene2, round(q1, 6) as q1, round(q2, 6) as q2 from kept join q1_t using (sp1, sp2, pc1) join q2_t using (sp1, sp2, pc2)"))
def _storey(spark: SparkSession, d: str) -> DataFrame:
    r = C.summarize_comparison(C.compare_neighborhoods(nets(spark, d), orthologs(spark, d)))
    return rounded(r.select(*C.ROW, "q1", "q2"))


def _level(name: str, key: str | None) -> str:
    src = "s" if key is None else f"(select sp1, sp2, {key}, min(q1) as q1, min(q2) as q2, min(qr) as qr from s group by all)"
    return f"select sp1, sp2, '{name}' as level, count(*) filter (q1 < 0.05) as n_sp1, count(*) filter (q2 < 0.05) as n_sp2, count(*) filter (qr < 0.05) as n_reciprocal, count(*) as n_total from {src} group by sp1, sp2"


@query("summarize_pairs", upto("edges", " union all ".join([_level("pairs", None), *[_level(k, k) for k in ("gene1", "gene2", "hog")]]), extra=[("s", "select species1 as sp1, species2 as sp2, hog, gene1, gene2, q1, q2, greatest(q1, q2) as qr from edges")]))
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary_counts(C.summarize_comparison(C.compare_neighborhoods(nets(spark, d), orthologs(spark, d))))


_EDGE = "select gene1, gene2, species1, species2, hog, round(q, 6) as q_value, round(eff, 6) as effect_size, round(jac, 6) as jaccard, type from edges"


@query("coexpressologs", upto("edges", _EDGE))
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.find_coexpressologs(nets(spark, d), orthologs(spark, d)))


@query("diverged_pairs", upto("cmp", "select gene1, gene2, sp1 as species1, sp2 as species2, hog, round(least(q1, q2), 6) as q_value, case when least(q1, q2) < 0.05 then 'diverged' else 'ns' end as type from cmp join q1_t using (sp1, sp2, pd1) join q2_t using (sp1, sp2, pd2)",
  extra=[*q_sql("cmp", "sp1, sp2", "pd1", "q1"), *q_sql("cmp", "sp1, sp2", "pd2", "q2")]))
def _diverged(spark: SparkSession, d: str) -> DataFrame:
    e = C.find_coexpressologs(nets(spark, d), orthologs(spark, d), alternative="less")
    return rounded(e.select("gene1", "gene2", "species1", "species2", "hog", "q_value", "type"))


_SWEEP = tuple(round(0.95 + 0.01 * k, 2) for k in range(11))


def _sweep_sql() -> str:
    parts = [f"select * from ({upto('edges', f'select cast({m} as double) as multiplier, (select round(avg(d), 6) from (select count(nbr.g) / 2 / any_value(n_pairs) as d from thr left join nbr using (species) group by species)) as density, count(*) as n_edges, count(*) filter (type <> {chr(39)}ns{chr(39)}) as n_significant from edges', mult=str(m))})" for m in _SWEEP]
    return " union all ".join(parts)


@query("density_sweep", _sweep_sql())
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return C.sweep_summary(*C.density_sweep(nets(spark, d), orthologs(spark, d), list(_SWEEP), "analytical"))


@query("coexpressed_hogs", upto("edges", """select a.hog, n_species, species, traits, round(mean_weight, 4) as mean_weight, conserved, round(mean_effect, 4) as mean_effect, round(min_q, 6) as min_q
  from agg a left join (select hog, bool_or(type = 'conserved') as conserved, avg(eff) as mean_effect, min(q) as min_q from edges group by hog) x on a.hog = x.hog""", extra=[
    ("cand", "select species, gene as g from expr where hog = 'H10'"),
    ("part", "select distinct n.species, n.nb from nbr n join cand using (species, g) where (n.species, n.nb) not in (select (species, g) from cand)"),
    ("every", "select species, i as g, j as nb, w from w union all select species, j, i, w from w"),
    ("pw", "select species, hog, max(w) as w from (select v.species, x.hog, v.g, avg(v.w) as w from every v join cand c on v.species = c.species and v.g = c.g join part p on p.species = v.species and p.nb = v.nb join expr x on x.species = v.species and x.gene = v.nb group by all) group by all"),
    ("agg", "select hog, count(*) as n_species, string_agg(distinct species, ',' order by species) as species, string_agg(distinct trait, ',' order by trait) as traits, avg(w) as mean_weight from (select *, case when species in ('SP_A', 'SP_C') then 'annual' else 'perennial' end as trait from pw) group by hog having count(*) >= 2"),
]))
def _partners(spark: SparkSession, d: str) -> DataFrame:
    n, o = nets(spark, d), orthologs(spark, d)
    hogs = expression(spark, d).select("species", "gene", "hog")
    c = C.coexpressed_hogs("H10", n, hogs, traits(spark), edges=C.find_coexpressologs(n, o))
    return c.withColumns({**{x: F.round(x, 4) for x in ("mean_weight", "mean_effect")}, "min_q": F.round("min_q", 6)})
