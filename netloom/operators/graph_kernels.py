"""Algorithms on one small graph (a species' thresholded network, or one module): plain numpy, no Spark.

A graph is (n, i, j, w): n nodes, edges i < j with positive weights.
"""

from __future__ import annotations

import heapq

import numpy as np


def _lists(n, i, j, w):
    nb = [[] for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist()):
        if a != b:
            nb[a].append((b, x))
            nb[b].append((a, x))
    return nb


def _move(nb, size, strength, start, gamma, cpm, total, rng, within=None):
    """Local moving from ``start``: a node joins the neighbouring community of greatest gain until none gains.

    ``within``: nodes may only join communities of their own value (refinement), and only from being alone.
    """
    com = list(start)
    mass, count = {}, {}
    for v, c in enumerate(com):
        mass[c] = mass.get(c, 0.0) + (size[v] if cpm else strength[v])
        count[c] = count.get(c, 0) + 1
    scale = gamma if cpm else gamma / (2 * total)
    queue = rng.permutation(len(com)).tolist()
    waiting = [True] * len(com)
    while queue:
        v = queue.pop()
        waiting[v] = False
        old, own = com[v], size[v] if cpm else strength[v]
        if within is not None and count[old] > 1:
            continue
        links = {}
        for u, x in nb[v]:
            if within is None or within[u] == within[v]:
                links[com[u]] = links.get(com[u], 0.0) + x
        mass[old] -= own
        best, gain = old, links.get(old, 0.0) - scale * own * mass[old]
        for c, x in sorted(links.items()):
            g = x - scale * own * mass[c]
            if g > gain + 1e-12:
                best, gain = c, g
        mass[best] += own
        if best != old:
            count[old] -= 1
            count[best] += 1
            com[v] = best
            for u, _ in nb[v]:
                if com[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.insert(0, u)
    return com


def _relabel(com):
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in com]


def leiden(n, i, j, w, resolution=1.0, objective="CPM", n_iterations=2, seed=0):
    """Membership by local moving, refinement and aggregation, repeated n_iterations times."""
    rng = np.random.default_rng(seed)
    cpm = objective.lower() == "cpm"
    total = float(w.sum()) or 1.0
    final = list(range(n))
    for _ in range(max(1, n_iterations)):
        nodes = list(range(n))  # node of the current graph that holds each original node
        ci, cj, cw = i, j, w
        size = [1.0] * n
        loops = np.zeros(n)
        start = list(final)
        while True:
            m = len(size)
            nb = _lists(m, ci, cj, cw)
            strength = [sum(x for _, x in nb[v]) + 2 * loops[v] for v in range(m)]
            com = _relabel(_move(nb, size, strength, start, resolution, cpm, total, rng))
            if len(set(com)) == m:
                final = [com[v] for v in nodes]
                break
            fine = _relabel(_move(nb, size, strength, list(range(m)), resolution, cpm, total, rng, within=com))
            k = max(fine) + 1
            if k == m:  # nothing was refined together: aggregate the communities themselves
                fine, k = com, max(com) + 1
            start = [0] * k
            new_size, new_loops = [0.0] * k, np.zeros(k)
            for v in range(m):
                start[fine[v]] = com[v]
                new_size[fine[v]] += size[v]
                new_loops[fine[v]] += loops[v]
            start = _relabel(start)
            f = np.asarray(fine)
            a, b = np.minimum(f[ci], f[cj]), np.maximum(f[ci], f[cj])
            inner = a == b
            np.add.at(new_loops, a[inner], cw[inner])
            code = a[~inner].astype(np.int64) * k + b[~inner]
            u, inv = np.unique(code, return_inverse=True)
            ci, cj, cw = u // k, u % k, np.bincount(inv, weights=cw[~inner], minlength=len(u))
            nodes = [fine[v] for v in nodes]
            size, loops = new_size, new_loops
    return np.asarray(_relabel(final))


def modularity(n, i, j, com):
    """Unweighted modularity of a membership."""
    m = len(i)
    if not m:
        return 0.0
    com = np.asarray(com)
    deg = np.bincount(np.r_[i, j], minlength=n)
    k = com.max() + 1
    inner = np.bincount(com[i][com[i] == com[j]], minlength=k)
    d = np.bincount(com, weights=deg, minlength=k)
    return float((inner / m - (d / (2 * m)) ** 2).sum())


def infomap(n, i, j, w, trials=10, seed=0):
    """Two-level map equation: nodes join the neighbouring module that shortens the code most; best of several orders."""
    nb = _lists(n, i, j, w)
    s = np.array([sum(x for _, x in nb[v]) for v in range(n)])
    total = s.sum() or 1.0
    p = s / total
    h = lambda x: x * np.log2(x) if x > 1e-15 else 0.0
    best, shortest = np.arange(n), np.inf
    for t in range(trials):
        rng = np.random.default_rng(seed + t)
        com = list(range(n))
        q, mass = list(p), list(p)  # exit rate and visit rate of each module; alone, a node exits always
        q_all = float(sum(q))
        moved = True
        while moved:
            moved = False
            for v in rng.permutation(n).tolist():
                old = com[v]
                links = {}
                for u, x in nb[v]:
                    links[com[u]] = links.get(com[u], 0.0) + x / total
                q_old, m_old = q[old] - p[v] + 2 * links.get(old, 0.0), mass[old] - p[v]
                pick, least = None, -1e-12
                for c in sorted(links):
                    if c == old:
                        continue
                    q_new, m_new = q[c] + p[v] - 2 * links[c], mass[c] + p[v]
                    total_q = q_all - q[old] - q[c] + q_old + q_new
                    d = h(total_q) - h(q_all) - 2 * (h(q_old) + h(q_new) - h(q[old]) - h(q[c])) + h(q_old + m_old) + h(q_new + m_new) - h(q[old] + mass[old]) - h(q[c] + mass[c])
                    if d < least:
                        pick, least, new = c, d, (q_new, m_new, total_q)
                if pick is not None:
                    q[old], mass[old] = q_old, m_old
                    q[pick], mass[pick], q_all = new
                    com[v] = pick
                    moved = True
        code = h(q_all) - 2 * sum(map(h, q)) - sum(map(h, p)) + sum(h(a + b) for a, b in zip(q, mass))
        if code < shortest - 1e-12:
            best, shortest = np.asarray(_relabel(com)), code
    return best


def _blocks(x, x2, lead, k, steps, rng):
    """(labels, ICL) of a Gaussian block model with k blocks by variational EM; diagonal entries take no part."""
    n = len(x)
    # start: k-means on the leading eigenvectors
    v = lead[:, :k]
    centre = v[rng.choice(n, k, replace=False)]
    for _ in range(20):
        z = ((centre**2).sum(1) - 2 * v @ centre.T).argmin(1)
        size = np.bincount(z, minlength=k)
        new = np.zeros((k, v.shape[1]))
        np.add.at(new, z, v)
        new = np.where(size[:, None] > 0, new / np.maximum(size, 1)[:, None], v[rng.integers(n, size=k)])
        if np.allclose(new, centre, atol=1e-12):
            break
        centre = new
    tau = np.full((n, k), 0.1 / k) + 0.9 * np.eye(k)[z]
    tau /= tau.sum(1, keepdims=True)
    pairs = n * (n - 1)
    for _ in range(steps):
        s = tau.sum(0)
        pi = np.maximum(s / n, 1e-10)
        den = np.maximum(np.outer(s, s) - tau.T @ tau, 1e-10)
        xt = x @ tau
        mu = tau.T @ xt / den
        var = max((x2 - (den * mu**2).sum()) / pairs, 1e-10)
        g = np.log(pi) + (xt @ mu.T - 0.5 * (s - tau) @ (mu**2).T) / var
        new = np.exp(g - g.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - tau).max() < 1e-4
        tau = new
        if done:
            break
    z = tau.argmax(1)
    r = (x - mu[z][:, z])[np.triu_indices(n, 1)]
    ll = -0.5 * len(r) * np.log(2 * np.pi * var) - 0.5 * (r**2).sum() / var + np.log(pi[z]).sum()
    return z, ll - 0.5 * (k * (k + 1) / 2 + 1) * np.log(max(len(r), 2)) - 0.5 * (k - 1) * np.log(n)


def gaussian_sbm(n, i, j, w, patience=3, steps=60, seed=0):
    """Gaussian block model of the weighted adjacency matrix by variational EM, number of blocks by ICL.

    Numbers of blocks grow by a quarter (at least one) until ``patience`` in a row, and half as many blocks again as the best, haven't raised the
    best ICL; then the numbers beside the best are tried, halving the distance. There is no maximum but n.
    """
    x = np.zeros((n, n))
    x[i, j] = x[j, i] = w
    x2 = float((x**2).sum())
    rng = np.random.default_rng(seed)
    lead = np.linalg.eigh(x)[1][:, ::-1]
    tried = {}
    k, best, since = 1, 1, 0
    while k <= n:
        tried[k] = _blocks(x, x2, lead, k, steps, rng)
        if tried[k][1] > tried[best][1] or k == best:
            best, since = k, 0
        elif (since := since + 1) >= patience and 2 * k >= 3 * best:
            break
        k += max(1, k // 4)
    gap = max(1, best // 4) // 2
    while gap:
        for k in (best - gap, best + gap):
            if 1 <= k <= n and k not in tried:
                tried[k] = _blocks(x, x2, lead, k, steps, rng)
        best = max(tried, key=lambda t: (tried[t][1], -t))
        gap //= 2
    return np.asarray(_relabel(tried[best][0].tolist()))


def rewire(n, i, j, w, swaps, seed):
    """Degree-preserving double edge swaps, then shuffled weights."""
    rng = np.random.default_rng(seed)
    e = list(zip(i.tolist(), j.tolist()))
    have = set(e)
    for a, b, flip in zip(rng.integers(len(e), size=swaps), rng.integers(len(e), size=swaps), rng.random(swaps) < 0.5):
        (u, v), (x, y) = e[a], e[b]
        if flip:
            x, y = y, x
        p, q = (min(u, y), max(u, y)), (min(x, v), max(x, v))
        if p[0] == p[1] or q[0] == q[1] or p in have or q in have or p == q:
            continue
        have -= {e[a], e[b]}
        have |= {p, q}
        e[a], e[b] = p, q
    a = np.array(e)
    return a[:, 0], a[:, 1], rng.permutation(w)


def coclassification(n, i, j, members):
    """(excess per edge, observed share, expected share): members is (K, n)."""
    m = np.asarray(members)
    same = m[:, i] == m[:, j]
    frac = np.stack([(np.bincount(r, minlength=r.max() + 1)[r] / n) ** 2 for r in m])
    c, e = same.mean(0), (same * frac[:, i]).mean(0)
    return np.maximum(c - e, 0), c, e


def spectral_norm(n, i, j, x, steps=500):
    """Largest eigenvalue of the symmetric sparse matrix with entries x by power iteration (shifted); 0 if empty."""
    if not len(i):
        return 0.0
    v, shift = np.full(n, 1 / np.sqrt(n)), float(np.bincount(np.r_[i, j], weights=np.r_[x, x], minlength=n).max())
    last = 0.0
    for _ in range(steps):
        u = np.bincount(np.r_[i, j], weights=np.r_[x * v[j], x * v[i]], minlength=n)
        lam = float(v @ u)
        u += shift * v
        v = u / (np.linalg.norm(u) or 1.0)
        if abs(lam - last) < 1e-12 * max(1.0, abs(lam)):
            break
        last = lam
    return lam


def adjusted_rand(a, b):
    """Adjusted Rand index of two memberships."""
    a, b = np.asarray(a), np.asarray(b)
    c2 = lambda x: (x * (x - 1.0) / 2).sum()
    t = np.unique(np.stack([a, b]), axis=1, return_counts=True)[1]
    sa, sb, n = c2(np.bincount(a)), c2(np.bincount(b)), len(a)
    e = sa * sb / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (sa + sb) / 2 - e
    return 1.0 if n < 2 or top == 0 else float((c2(t) - e) / top)


def betweenness(n, i, j, w):
    """Shortest-path betweenness with edge lengths 1/w (undirected, each pair once)."""
    nb = _lists(n, i, j, w)
    out = np.zeros(n)
    for s in range(n):
        dist, paths, order, pred = {}, {s: 1.0}, [], {s: []}
        heap, seen = [(0.0, s)], {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, x in nb[v]:
                t = d + 1 / x
                old = seen.get(u)
                if u not in dist and (old is None or t < old - 1e-12):
                    seen[u], paths[u], pred[u] = t, paths[v], [v]
                    heapq.heappush(heap, (t, u))
                elif u not in dist and abs(t - old) <= 1e-12:
                    paths[u] += paths[v]
                    pred[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in pred[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                out[v] += share[v]
    return out / 2


def eigenvector(n, i, j, w):
    """Leading eigenvector of the weighted adjacency matrix, scaled to a maximum of 1; zeros for no edges."""
    if not len(i):
        return np.zeros(n)
    x = np.zeros((n, n))
    x[i, j] = x[j, i] = w
    v = np.abs(np.linalg.eigh(x)[1][:, -1])
    return v / (v.max() or 1.0)


def complete_linkage(d, k):
    """Labels 0..k-1 of a complete-linkage clustering of the distance matrix cut at k clusters; ties by least indices."""
    n = len(d)
    groups = {c: [c] for c in range(n)}
    d = np.array(d, dtype=float)
    np.fill_diagonal(d, np.inf)
    while len(groups) > max(1, k):
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        a, b = live[min(a, b)], live[max(a, b)]
        d[a, :] = np.maximum(d[a, :], d[b, :])
        d[:, a] = d[a, :]
        d[a, a] = np.inf
        groups[a] += groups.pop(b)
    label = np.zeros(n, dtype=int)
    for c, g in enumerate(sorted(groups.values(), key=min)):
        label[g] = c
    return label


def ward_clusters(x, threshold):
    """Labels of Ward (D2) clustering of rows by d = 1 - Pearson r, merged while d^2 <= (1 - threshold)^2; first least pair wins."""
    n = len(x)
    z = x - x.mean(1, keepdims=True)
    z /= np.sqrt((z * z).sum(1, keepdims=True))
    d2 = np.clip(1 - z @ z.T, 0, 2) ** 2
    np.fill_diagonal(d2, np.inf)
    size, label, live = np.ones(n), np.arange(n), list(range(n))
    limit = (1 - threshold) ** 2 + 1e-12
    while len(live) > 1:
        sub = d2[np.ix_(live, live)]
        a, b = divmod(int(sub.argmin()), len(live))
        a, b = live[min(a, b)], live[max(a, b)]
        if d2[a, b] > limit:
            break
        t = size + size[a] + size[b]
        d2[a] = ((size + size[a]) * d2[a] + (size + size[b]) * d2[b] - size * d2[a, b]) / t
        d2[:, a] = d2[a]
        d2[a, a] = np.inf
        size[a] += size[b]
        live.remove(b)
        label[label == b] = a
    return label
