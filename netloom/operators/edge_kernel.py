"""Edges of one species pair from adjacency matrices held in one task: the numbers of ``comparison`` in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from ..functions.stats import LAMBDAS, SPLINE_WEIGHTS

#: Ortholog rows whose neighbour rows are held at once.
CHUNK = 8192


def shuffle(seed: int, draw: int, items: list[bytes]) -> np.ndarray:
    """Places of ``items`` in the order of md5(seed | draw | item), equal ones as they stand."""
    head = f"{seed}|{draw}|".encode()
    md5 = hashlib.md5
    d = np.frombuffer(b"".join([md5(head + x).digest() for x in items]), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.argsort(d[:, 0], kind="stable")
    first = d[order, 0]
    return order if (first[1:] != first[:-1]).all() else np.lexsort((d[:, 1], d[:, 0]))


def bits(columns: np.ndarray) -> np.ndarray:
    """Row g: the set bits of column g, in 64-bit words."""
    rows = -len(columns) % 64
    full = np.pad(columns, ((0, rows), (0, 0))) if rows else columns
    return np.ascontiguousarray(np.packbits(full, axis=0).T).view(np.uint64)


class Side:
    """A species: n genes tested (the universe), and the adjacency of its genes by number."""

    def __init__(self, size: int, n: int, a: np.ndarray, b: np.ndarray) -> None:
        self.n, self.adjacent = n, np.zeros((size, size), np.uint8)
        self.adjacent[a, b] = self.adjacent[b, a] = 1
        self.degree = np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
        self.bits = bits(self.adjacent)


def mapped(members: np.ndarray, others: np.ndarray, size: int, other: Side) -> np.ndarray:
    """(size, genes of the other species): is the member an ortholog of a neighbour of that gene?"""
    order = np.argsort(members, kind="stable")
    members, others = members[order], others[order]
    hit = np.zeros((size, len(other.adjacent)), np.uint8)
    for at in range(0, len(members), CHUNK):
        m, o = members[at : at + CHUNK], others[at : at + CHUNK]
        first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        hit[m[first]] |= np.bitwise_or.reduceat(other.adjacent[o], first, axis=0)
    return hit


def overlaps(one: Side, two: Side, g1: np.ndarray, g2: np.ndarray, bridge: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """(m, k, x) of the rows (g1, g2) in both directions."""
    out = []
    for a, b, ga, gb, (ma, mb) in ((one, two, g1, g2, bridge), (two, one, g2, g1, bridge[::-1])):
        reach = bits(mapped(ma, mb, len(a.adjacent), b))
        k = np.bitwise_count(reach).sum(axis=1, dtype=np.int64)
        x = [np.bitwise_count(a.bits[ga[i : i + CHUNK]] & reach[gb[i : i + CHUNK]]).sum(axis=1, dtype=np.int64) for i in range(0, len(ga), CHUNK)]
        out.append((a.degree[ga], k[gb], np.concatenate(x) if x else np.zeros(0, np.int64)))
    return out[0], out[1]


def log_factorials(n: int) -> np.ndarray:
    """ln i! for i = 0..n."""
    return np.array([math.lgamma(i + 1) for i in range(n + 1)])


def upper_tail(x: np.ndarray, m: np.ndarray, k: np.ndarray, n: int, lf: np.ndarray) -> np.ndarray:
    """P(X >= x), X hypergeometric: as ``hypergeom_upper``, summed away from the mean."""
    lo, hi = np.maximum(0, k + m - n), np.minimum(m, k)
    within = (x > lo) & (x <= hi)
    above = x > m * k / max(n, 1)
    out = np.where(x <= lo, 1.0, 0.0)

    def total(pick: np.ndarray, up: bool) -> np.ndarray:
        mm, kk, j = m[pick], k[pick], x[pick] - (not up)
        t = np.exp(lf[mm] - lf[j] - lf[mm - j] + lf[n - mm] - lf[kk - j] - lf[n - mm - kk + j] - lf[n] + lf[kk] + lf[n - kk])
        s = np.zeros(len(j))
        for _ in range(int((hi[pick] - j if up else j - lo[pick]).max(initial=-1)) + 1):  # a term past the end is 0
            s += t
            t = t * (mm - j) * (kk - j) / ((j + 1) * (n - mm - kk + j + 1)) if up else t * j * (n - mm - kk + j) / ((mm - j + 1) * (kk - j + 1))
            np.maximum(t, 0, out=t)
            j = np.minimum(j + 1, hi[pick]) if up else np.maximum(j - 1, lo[pick])
        return s

    up, down = within & above, within & ~above
    out[up] = np.minimum(1.0, total(up, True))
    out[down] = np.maximum(0.0, 1.0 - total(down, False))
    return out


def q_values(p: np.ndarray) -> np.ndarray:
    """Storey-Tibshirani q-values as ``stats.q_values``; a single p is its own q."""
    m = len(p)
    if m < 2:
        return p
    est = sum(w * np.count_nonzero(p >= lam) / (m * (1 - lam)) for w, lam in zip(SPLINE_WEIGHTS, LAMBDAS))
    pi0 = 1.0 if est <= 0 or p.max() < 0.95 else min(est, 1.0)
    values, place, counts = np.unique(p, return_inverse=True, return_counts=True)
    step = np.minimum.accumulate((values * m / np.cumsum(counts))[::-1])[::-1]
    return (np.minimum(1.0, step) * pi0)[place]


def conserved(one: Side, two: Side, g1: np.ndarray, g2: np.ndarray, bridge: tuple[np.ndarray, np.ndarray], alpha: float, lf: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, q, effect, jaccard) of the rows (g1, g2) that are conserved edges; rows without overlap in either direction take no part in q-values."""
    both = overlaps(one, two, g1, g2, bridge)
    row = np.flatnonzero((both[0][2] > 0) & (both[1][2] > 0))
    qs, effects, jaccards = [], [], []
    for side, (m, k, x) in zip((one, two), both):
        m, k, x = m[row], k[row], x[row]  # x > 0, so m and k are
        qs.append(q_values(np.where(x > 1, upper_tail(x, m, k, side.n, lf[side.n]), 1.0)))
        effects.append((x / k) / (m / side.n))
        jaccards.append(x / (m + k - x))
    q = np.minimum(*qs)
    hit = q < alpha
    return row[hit], q[hit], np.sqrt(effects[0] * effects[1])[hit], np.sqrt(jaccards[0] * jaccards[1])[hit]


def fold_enrichment(one: Side, two: Side, bridge: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Matrix of x/E of both directions added, E = m k / n; 0 where nothing overlaps."""
    out = None
    for a, b, (ma, mb) in ((one, two, bridge), (two, one, bridge[::-1])):
        reach = mapped(ma, mb, len(a.adjacent), b)
        x = (a.adjacent.astype(np.float32) @ reach.astype(np.float32)).astype(np.float64)  # counts: exact
        k = reach.sum(axis=0, dtype=np.int64)
        for i in range(0, len(x), 256):
            e = a.degree[i : i + 256, None] * k[None] / a.n
            x[i : i + 256] = np.divide(x[i : i + 256], e, out=np.zeros_like(e), where=x[i : i + 256] > 0)
        if out is None:
            out = x
        else:
            out += x.T
    return out
