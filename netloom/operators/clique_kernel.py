"""Cliques of one group: species sets joined by edges, one gene per species. Plain Python, unit-testable."""

from __future__ import annotations

import math
from itertools import combinations

#: Above this many species, tolerant enumeration of subsets gives way to maximal cliques.
TOLERANT_SPECIES = 25


def maximal_cliques(adjacent: dict[str, set[str]], least: int) -> list[tuple[str, ...]]:
    """Maximal cliques of at least ``least`` nodes, by pivoting; sorted."""
    out: list[tuple[str, ...]] = []
    stack = [(set(), set(adjacent), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            if len(r) >= least:
                out.append(tuple(sorted(r)))
            continue
        if len(r) + len(p) < least:
            continue
        pivot = max(sorted(p | x), key=lambda u: len(p & adjacent[u]))
        for v in sorted(p - adjacent[pivot]):
            stack.append((r | {v}, p & adjacent[v], x & adjacent[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out)


def species_sets(adjacent: dict[str, set[str]], least: int, missing: int) -> list[tuple[str, ...]]:
    """Maximal cliques, or with ``missing`` > 0 all subsets (large first) lacking at most that many pairs."""
    if not missing or len(adjacent) > TOLERANT_SPECIES:
        return maximal_cliques(adjacent, least)
    names = sorted(adjacent)
    return [s for size in range(len(names), least - 1, -1) for s in combinations(names, size) if sum(b not in adjacent[a] for a, b in combinations(s, 2)) <= missing]


def assign(species: tuple[str, ...], genes: dict[str, list[str]], edges: dict[tuple[str, str], tuple[float, float]], missing: int, weights: tuple[float, float]):
    """One gene per species with the fewest missing edges, then the least w_q mean q - w_eff mean effect; None if impossible.

    An assignment without any present edge is none, however many may be missing.
    Species with fewer genes are tried first and genes by name; of equal assignments the first found stays.
    """
    if any(not genes.get(s) for s in species):
        return None
    order = sorted(species, key=lambda s: (len(genes[s]), s))
    wq, we = weights
    best: list = [missing + 1, math.inf, None]

    def extend(k: int, chosen: list[str], absent: int, q: float, eff: float, n: int) -> None:
        if k == len(order):
            if not n:  # no edge at all joins the chosen genes
                return
            cost = (wq * q - we * eff) / n
            if absent < best[0] or (absent == best[0] and cost < best[1] - 1e-15):
                best[:] = [absent, cost, list(chosen)]
            return
        for g in genes[order[k]]:
            a, dq, de, dn = absent, 0.0, 0.0, 0
            for other in chosen:
                e = edges.get((g, other) if g < other else (other, g))
                if e is None:
                    a += 1
                    if a > min(missing, best[0]):
                        break
                else:
                    dq, de, dn = dq + e[0], de + e[1], dn + 1
            else:
                extend(k + 1, [*chosen, g], a, q + dq, eff + de, n + dn)

    extend(0, [], 0, 0.0, 0.0, 0)
    return None if best[2] is None else dict(zip(order, best[2]))


def statistics(genes: dict[str, str], edges: dict[tuple[str, str], tuple[float, float]]) -> dict:
    """Counts, means, intensity (geometric mean of 1 - q), coherence (intensity over the mean) and least effect of a clique."""
    es = [e for a, b in combinations(genes.values(), 2) if (e := edges.get((a, b) if a < b else (b, a)))]
    n, k = len(es), len(genes)
    if not n:
        return {"n_species": k, "mean_q": None, "max_q": None, "mean_effect_size": None, "n_edges": 0, "n_missing": k * (k - 1) // 2, "intensity": None, "coherence": None, "min_effect_size": None}
    w = [max(1 - q, 2.220446049250313e-16) for q, _ in es]
    intensity = math.exp(sum(map(math.log, w)) / n)
    return {"n_species": k, "mean_q": sum(q for q, _ in es) / n, "max_q": max(q for q, _ in es), "mean_effect_size": sum(e for _, e in es) / n, "n_edges": n, "n_missing": k * (k - 1) // 2 - n,
            "intensity": intensity, "coherence": intensity / (sum(w) / n), "min_effect_size": min(e for _, e in es)}


def group_cliques(rows: list[tuple], least: int, missing: int, weights: tuple[float, float], active: set[str] | None = None) -> list[tuple[dict[str, str], dict]]:
    """(genes by species, statistics) of a group's cliques.

    rows: (gene1, species1, gene2, species2, q, effect, within_cap), one per gene pair. Species are adjacent if any
    row joins them; genes beyond the cap take no part in assignments. ``active`` restricts the species.
    """
    adjacent: dict[str, set[str]] = {}
    edges: dict[tuple[str, str], tuple[float, float]] = {}
    genes: dict[str, set[str]] = {}
    for g1, s1, g2, s2, q, eff, capped in rows:
        if active is not None and not (s1 in active and s2 in active):
            continue
        adjacent.setdefault(s1, set()).add(s2)
        adjacent.setdefault(s2, set()).add(s1)
        if capped:
            edges[(g1, g2) if g1 < g2 else (g2, g1)] = (q, eff)
            genes.setdefault(s1, set()).add(g1)
            genes.setdefault(s2, set()).add(g2)
    listed = {s: sorted(g) for s, g in genes.items()}
    out = []
    for s in species_sets(adjacent, least, missing):
        found = assign(s, listed, edges, missing, weights)
        if found is not None:
            out.append((found, statistics(found, edges)))
    return out


def slot_jaccard(a: list[str | None], b: list[str | None]) -> float:
    """Share of occupied slots that hold the same gene in both."""
    used = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 0.0
