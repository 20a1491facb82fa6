"""SQL text of the oracles: one chain of common table expressions, cut off where a query needs it."""

from __future__ import annotations

#: name, text; each uses only those before it. {sp}: species numbers, {mult}: threshold multiplier.
CHAIN: list[tuple[str, str]] = [
    ("e", "select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e, label from embeddings"),
    ("g0", """select s, vec_id, cast(case when (vec_id // 2) % 8 = 3 then (label + 5 * (s % 2)) % 10
        when (vec_id // 2) % 8 = 6 and s % 2 = 1 then (label + 2 * s + 1) % 10 else label end as bigint) as c,
        (7 * vec_id + 13 * (s + 1)) % (select count(*) from e) as o, label, e.e as v
      from e cross join (select unnest([{sp}]) as s) where vec_id % 7 <> s"""),
    ("expr", """select 'SP_' || substr('ABCD', s + 1, 1) as species, substr('ABCD', s + 1, 1) || g0.vec_id as gene, 'H' || (g0.vec_id // 2) as hog, g0.label,
        list_transform(g0.v, lambda x, i: x + 0.8 * ec.e[i] + 0.6 * eo.e[i]) as v
      from g0 join e ec on ec.vec_id = g0.c join e eo on eo.vec_id = g0.o"""),
    ("z", "select species, gene, list_transform(v, lambda x: (x - list_avg(v)) / sqrt(list_sum(list_transform(v, lambda y: (y - list_avg(v)) * (y - list_avg(v)))))) as z from expr"),
    ("r", "select a.species, a.gene as i, b.gene as j, round(greatest(-1, least(1, list_dot_product(a.z, b.z))), 10) + 0.0 as r from z a join z b on a.species = b.species and a.gene < b.gene"),
    ("sym", """select species, i as g, j as nb, r from r union all select species, j, i, r from r
      union all select species, g, g, 1.0 from (select distinct species, g from (select species, i as g from r union all select species, j from r))"""),
    ("rk", "select *, rank() over (partition by species, g order by r) + (count(*) over (partition by species, g, r) - 1) / 2 as k from sym"),
    ("w", "select a.species, a.g as i, a.nb as j, sqrt(a.k * b.k) as w from rk a join rk b on a.species = b.species and a.g = b.nb and a.nb = b.g where a.g < a.nb"),
    ("thr", """select species, {mult} * min(w) as threshold, any_value(n) as n_pairs from (
        select species, w, row_number() over (partition by species order by w desc) as rn, count(*) over (partition by species) as n from w)
      where rn <= greatest(1, least(round(0.03 * n), n - 1)) group by species"""),
    ("nbr", """select species, g, nb, w.w from (select species, i as g, j as nb, w from w union all select species, j, i, w from w) w join thr using (species)
      where w.w >= threshold"""),
    ("ng", "select species, count(*) as n from expr group by species"),
    ("ortho", "select a.species as sp1, b.species as sp2, a.gene as gene1, b.gene as gene2, a.hog from expr a join expr b on a.hog = b.hog and a.species < b.species"),
    ("dir", """select 1 as d, sp1, sp2, hog, gene1, gene2, sp1 as sa, sp2 as so, gene1 as a, gene2 as o from ortho
      union all select 2, sp1, sp2, hog, gene1, gene2, sp2, sp1, gene2, gene1 from ortho"""),
    ("mapped", """select distinct d.d, d.sp1, d.sp2, n.g as o, d.a as m from nbr n join (select distinct d, sp1, sp2, so, a, o from dir) d on n.species = d.so and n.nb = d.o"""),
    ("mk", "select d, sp1, sp2, o, count(*) as k from mapped group by all"),
    ("md", "select species, g, count(*) as m from nbr group by all"),
    ("mx", """select d.d, d.sp1, d.sp2, d.hog, d.gene1, d.gene2, count(*) as x from dir d join mapped mp on mp.d = d.d and mp.sp1 = d.sp1 and mp.sp2 = d.sp2 and mp.o = d.o
      join nbr n on n.species = d.sa and n.g = d.a and n.nb = mp.m group by all"""),
    ("side", """select d.*, coalesce(md.m, 0) as m, coalesce(mk.k, 0) as k, coalesce(mx.x, 0) as x, ng.n from (select distinct * from dir) d
      left join md on md.species = d.sa and md.g = d.a left join mk on mk.d = d.d and mk.sp1 = d.sp1 and mk.sp2 = d.sp2 and mk.o = d.o
      left join mx on mx.d = d.d and mx.sp1 = d.sp1 and mx.sp2 = d.sp2 and mx.hog = d.hog and mx.gene1 = d.gene1 and mx.gene2 = d.gene2 join ng on ng.species = d.sa"""),
    ("ps", """select *, case when x > 1 then {up} else 1.0 end as p_con, case when k > 0 and m > 0 then {down} else 1.0 end as p_div,
        case when k > 0 and m > 0 then (x / k) / (m / n) else 1.0 end as effect, case when m + k - x > 0 then x / (m + k - x) else 0.0 end as jac from side"""),
    ("cmp", """select a.sp1, a.sp2, a.hog, a.gene1, a.gene2, a.m as m1, a.k as k1, a.x as x1, a.p_con as pc1, a.p_div as pd1, a.effect as e1, a.jac as j1,
        b.m as m2, b.k as k2, b.x as x2, b.p_con as pc2, b.p_div as pd2, b.effect as e2, b.jac as j2
      from ps a join ps b on a.d = 1 and b.d = 2 and a.sp1 = b.sp1 and a.sp2 = b.sp2 and a.hog = b.hog and a.gene1 = b.gene1 and a.gene2 = b.gene2"""),
    ("kept", "select * from cmp where x1 > 0 and x2 > 0"),
]


def pmf(i: str) -> str:
    """Hypergeometric probability of i in terms of m, k, n."""
    f = lambda a: f"lgamma(({a}) + 1.0)"
    return f"exp({f('m')} - {f(i)} - {f(f'm - {i}')} + {f('n - m')} - {f(f'k - {i}')} - {f(f'n - m - k + {i}')} - {f('n')} + {f('k')} + {f('n - k')})"


def upper(x: str = "x") -> str:
    """P(X >= x)."""
    return f"case when {x} <= greatest(0, k + m - n) then 1.0 when {x} > least(m, k) then 0.0 else least(1.0, list_sum(list_transform(range(cast({x} as bigint), cast(least(m, k) as bigint) + 1), lambda i: {pmf('i')}))) end"


def lower(x: str = "x") -> str:
    """P(X <= x)."""
    return f"case when {x} >= least(m, k) then 1.0 when {x} < greatest(0, k + m - n) then 0.0 else least(1.0, list_sum(list_transform(range(cast(greatest(0, k + m - n) as bigint), cast({x} as bigint) + 1), lambda i: {pmf('i')}))) end"


def q_sql(source: str, keys: str, p: str, q: str) -> list[tuple[str, str]]:
    """Tables ``<q>_t`` with (keys, p, q) of distinct p-values of ``source``."""
    from ..functions.stats import LAMBDAS, SPLINE_WEIGHTS

    est = " + ".join(f"({w}) * count(*) filter ({p} >= {lam}) / (count({p}) * (1 - {lam}))" for w, lam in zip(SPLINE_WEIGHTS, LAMBDAS))
    return [
        (f"{q}_s", f"select {keys}, count({p}) as m, case when {est} <= 0 or max({p}) < 0.95 then 1.0 else least(1.0, {est}) end as pi0 from {source} group by {keys}"),
        (f"{q}_c", f"select {keys}, {p}, sum(count(*)) over (partition by {keys} order by {p}) as rk from {source} where {p} is not null group by {keys}, {p}"),
        (f"{q}_t", f"""select {keys}, {p}, case when m < 2 then {p} else pi0 * least(1.0, min({p} * m / rk) over (partition by {keys} order by {p} desc)) end as {q}
           from {q}_c join {q}_s using ({keys})"""),
    ]


def discrete_q_sql(source: str, keys: str, p: str, q: str, h: int, most: int) -> list[tuple[str, str]]:
    """Tables up to ``<q>_t`` with (keys, p, q) of distinct sequential p-values of ``source`` (h exceedances, at most ``most`` draws)."""
    return [
        (f"{q}_u", f"select distinct s from (select ({h} + 1) / (t + 1) as s from (select unnest(range({h}, {most} + 1)) as t) union all select j / ({most} + 1) from (select unnest(range(1, {h} + 1)) as j)) where s <= 0.5"),
        (f"{q}_c", f"select {keys}, {p}, count(*) as c from {source} group by all"),
        (f"{q}_m", f"select {keys}, sum(c) as m from {q}_c group by all"),
        (f"{q}_e", f"select {keys}, s, coalesce(sum(c) filter ({p} > s + 1e-12), 0) / ((1 - s) * any_value(m)) as now from {q}_m join {q}_c using ({keys}) cross join {q}_u group by {keys}, s"),
        (f"{q}_l", f"select *, lag(now) over (partition by {keys} order by s) as before from {q}_e"),
        (f"{q}_0", f"select {keys}, least(1.0, coalesce(min_by(now, s) filter (now >= before), max_by(now, s))) as pi0 from {q}_l group by {keys}"),
        (f"{q}_t", f"""select {keys}, {p}, case when m < 2 then {p} else least(1.0, min(pi0 * {p} * m / rk) over (partition by {keys} order by {p} desc)) end as q
           from (select *, sum(c) over (partition by {keys} order by {p}) as rk from {q}_c) join {q}_0 using ({keys}) join {q}_m using ({keys})"""),
    ]


EDGES: list[tuple[str, str]] = [
    *q_sql("kept", "sp1, sp2", "pc1", "q1"),
    *q_sql("kept", "sp1, sp2", "pc2", "q2"),
    ("edges", """select gene1, gene2, sp1 as species1, sp2 as species2, hog, least(q1, q2) as q, q1, q2, sqrt(e1 * e2) as eff, sqrt(j1 * j2) as jac,
        case when least(q1, q2) < 0.05 then 'conserved' else 'ns' end as type
      from kept join q1_t using (sp1, sp2, pc1) join q2_t using (sp1, sp2, pc2)"""),
]


def upto(last: str, body: str, species: str = "0, 1, 2, 3", extra: list[tuple[str, str]] = (), mult: str = "1.0", before: dict[str, str] | None = None) -> str:
    """``with`` the chain (and EDGES behind it) up to ``last``, then ``extra`` tables, then ``body``; ``before`` replaces a table by a text over ``<name>0``, the table as it was."""
    tables = []
    for name, text in [*CHAIN, *EDGES]:
        if name in (before or {}):
            tables += [(f"{name}0", text), (name, before[name])]
        else:
            tables.append((name, text))
        if name == last:
            break
    tables += list(extra)
    fill = lambda t: t.replace("{sp}", species).replace("{mult}", mult).replace("{up}", upper()).replace("{down}", lower())
    return "with " + ",\n".join(f"{n} as materialized ({fill(t)})" for n, t in tables) + "\n" + body
