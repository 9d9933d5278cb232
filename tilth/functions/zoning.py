"""Sequential parts of zoning, on one field's arrays: segments of a profile, trees, rectangles, k-means."""

from __future__ import annotations

import math

import numpy as np


def segment_profile(mean: np.ndarray, n: np.ndarray, k_max: int, min_len: int) -> list[tuple[float, np.ndarray]]:
    """For k = 1, 2, ...: the least weighted squares of k segments of min_len positions or more, and their starts (exact, by dynamic programming)."""
    m = len(mean)
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, n * mean, n * mean * mean))

    def cost(i, j):  # positions i to j - 1
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    best = np.full((k_max + 1, m + 1), np.inf)
    back = np.zeros((k_max + 1, m + 1), int)
    best[0, 0] = 0
    out = []
    for k in range(1, k_max + 1):
        for j in range(k * min_len, m + 1):
            i = np.arange((k - 1) * min_len, j - min_len + 1)
            v = best[k - 1, i] + cost(i, j)
            at = int(np.argmin(v))
            best[k, j], back[k, j] = v[at], i[at]
        if not np.isfinite(best[k, m]):
            break
        starts, j = [], m
        for c in range(k, 0, -1):
            j = int(back[c, j])
            starts.append(j)
        out.append((float(max(best[k, m], 0.0)), np.array(starts[::-1])))
    return out


def segment_bic(found: list[tuple[float, np.ndarray]], m: int, n_obs: int) -> list[float]:
    """BIC by number of segments; squares are scaled to one observation a position, for the profile's means are what is cut."""
    return [m * math.log(max(sse / n_obs * m, np.finfo(float).eps) / m) + 2 * (k + 1) * math.log(m) for k, (sse, _) in enumerate(found)]


def profile_range(mean: np.ndarray, spacing: float, extent: float, steps: int = 150) -> float:
    """The practical range of a profile, half its extent at most; the spacing if it is short or flat.

    Semivariances of the first half of the lags, weighted by pairs; for each range of a log grid the
    exponential's nugget and sill follow in closed form, neither negative.
    """
    m = len(mean)
    lags = np.arange(1, max(3, m // 2) + 1)
    if m < 6:
        return spacing
    g = np.array([0.5 * np.mean((mean[k:] - mean[:-k]) ** 2) for k in lags])
    if not np.isfinite(g).all() or np.ptp(g) == 0:
        return spacing
    w = (m - lags) / (m - lags).sum()
    rise = 1 - np.exp(-lags[None] / np.geomspace(0.25, lags[-1], steps)[:, None])
    off = rise - (rise @ w)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        sill = (off * (g - g @ w) * w).sum(axis=1) / (off**2 * w).sum(axis=1)
        nugget = g @ w - sill * (rise @ w)
        alone = (rise * g * w).sum(axis=1) / (rise**2 * w).sum(axis=1)
    can = sill >= 0
    sill, nugget = np.where(nugget < 0, alone, sill), np.maximum(nugget, 0)
    sse = np.where(can, ((g - nugget[:, None] - sill[:, None] * rise) ** 2 * w).sum(axis=1), np.inf)
    if not np.isfinite(sse).any():
        return spacing
    a = np.geomspace(0.25, lags[-1], steps)[int(np.nanargmin(sse))]
    return float(min(3 * a * spacing, extent / 2))


class Sets:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j


def components(n: int, edges: np.ndarray) -> np.ndarray:
    sets = Sets(n)
    for i, j in edges:
        sets.join(int(i), int(j))
    return np.unique([sets.find(i) for i in range(n)], return_inverse=True)[1]


def connect(edges: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """edges with the shortest bridges that make one piece, the smallest piece first."""
    edges = [tuple(e) for e in edges]
    while True:
        part = components(len(xy), np.array(edges, int).reshape(-1, 2))
        sizes = np.bincount(part)
        if len(sizes) == 1:
            return np.array(edges, int).reshape(-1, 2)
        own, other = np.nonzero(part == sizes.argmin())[0], np.nonzero(part != sizes.argmin())[0]
        d = ((xy[own][:, None] - xy[other][None]) ** 2).sum(axis=2)
        i, j = np.unravel_index(d.argmin(), d.shape)
        edges.append((min(own[i], other[j]), max(own[i], other[j])))


def nearest_edges(xy: np.ndarray, k: int = 8, step: int = 256) -> np.ndarray:
    """Edges from each cell to its k nearest, each pair once; ties go to the earlier cell. Distances are held for `step` cells at a time."""
    n, pairs = len(xy), []
    for i in range(0, n, step):
        own = np.arange(i, min(i + step, n))
        far = ((xy[own][:, None] - xy[None]) ** 2).sum(axis=2)
        far[own - i, own] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(k, n - 1)]
        pairs.append(np.column_stack([np.repeat(own, near.shape[1]), near.ravel()]))
    both = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
    return np.unique(np.sort(both, axis=1), axis=0)


def principal(z: np.ndarray, n: int) -> np.ndarray:
    """Scores on the first n principal components; a component's largest loading is positive."""
    z = z - z.mean(axis=0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:n]
    axes = axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], 1))
    return z @ axes.T


def spanning_tree(n: int, edges: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Edges of the tree with the least differences in z."""
    cost = ((z[edges[:, 0]] - z[edges[:, 1]]) ** 2).sum(axis=1)
    sets = Sets(n)
    return np.array([edges[k] for k in np.argsort(cost, kind="stable") if sets.join(*map(int, edges[k]))], int).reshape(-1, 2)


def ssd(z: np.ndarray) -> float:
    return float(((z - z.mean(axis=0)) ** 2).sum()) if len(z) else 0.0


def tree_cuts(n: int, tree: np.ndarray, z: np.ndarray, k_max: int, min_cells: int) -> list[np.ndarray]:
    """Labels for 1, 2, ... k_max zones: the tree edge whose removal lowers the squares most goes first."""
    labels, live, out = np.zeros(n, int), [tuple(map(int, e)) for e in tree], [np.zeros(n, int)]
    while len(out) < k_max:
        best = (1e-12, None, None)
        for zone in range(len(out)):
            cells = np.nonzero(labels == zone)[0]
            if len(cells) < 2 * min_cells:
                continue
            near: dict[int, list[int]] = {int(c): [] for c in cells}
            for a, b in live:
                if a in near and b in near:
                    near[a].append(b)
                    near[b].append(a)
            root = int(cells[0])
            order, parent = [root], {root: -1}
            for v in order:
                for u in near[v]:
                    if u != parent[v]:
                        parent[u] = v
                        order.append(u)
            count, total = dict.fromkeys(order, 1), {v: z[v].copy() for v in order}
            for v in reversed(order[1:]):
                count[parent[v]] += count[v]
                total[parent[v]] += total[v]
            all_n, all_s = count[root], total[root]
            for v in order[1:]:
                n1 = count[v]
                if min(n1, all_n - n1) < min_cells:
                    continue
                gain = (total[v] ** 2).sum() / n1 + ((all_s - total[v]) ** 2).sum() / (all_n - n1) - (all_s**2).sum() / all_n
                if gain > best[0]:
                    under, stack = [], [v]
                    best = (gain, (v, parent[v]), (under, stack, near, parent))
        if best[1] is None:
            break
        v, p = best[1]
        under, stack, near, parent = best[2]
        while stack:
            u = stack.pop()
            under.append(u)
            stack += [c for c in near[u] if c != parent[u]]
        labels = labels.copy()
        labels[under] = len(out)
        live = [e for e in live if set(e) != {v, p}]
        out.append(labels)
    return out


def rectangle_cuts(row: np.ndarray, col: np.ndarray, z: np.ndarray, k_max: int, min_cells: int) -> list[np.ndarray]:
    """Labels for 1, 2, ... k_max rectangles: the cut with the largest fall in squares each time; rows before columns."""
    labels = np.zeros(len(row), int)
    out = [labels]
    while len(out) < k_max:
        best = (1e-12, None)
        for zone in range(len(out)):
            at = np.nonzero(labels == zone)[0]
            for axis in (row, col):
                order = at[np.argsort(axis[at], kind="stable")]
                v, c = axis[order], np.cumsum(z[order], axis=0)
                k = np.nonzero(v[1:] > v[:-1])[0] + 1
                k = k[(k >= min_cells) & (len(order) - k >= min_cells)]
                if not len(k):
                    continue
                gain = (c[k - 1] ** 2).sum(axis=1) / k + ((c[-1] - c[k - 1]) ** 2).sum(axis=1) / (len(order) - k) - (c[-1] ** 2).sum() / len(order)
                if gain.max() > best[0]:
                    best = (float(gain.max()), order[k[gain.argmax()] :])
        if best[1] is None:
            break
        labels = labels.copy()
        labels[best[1]] = len(out)
        out.append(labels)
    return out


def kmeans(z: np.ndarray, k: int, starts: int = 25, seed: int = 1) -> np.ndarray:
    best = (np.inf, np.zeros(len(z), int))
    for s in range(starts):
        rng = np.random.default_rng((seed, k, s))
        centre = z[rng.choice(len(z), k, replace=False)]
        for _ in range(100):
            label = ((z[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            fresh = np.array([z[label == j].mean(axis=0) if (label == j).any() else centre[j] for j in range(k)])
            if np.allclose(fresh, centre):
                break
            centre = fresh
        total = sum(ssd(z[label == j]) for j in range(k))
        if total < best[0]:
            best = (total, label)
    return best[1]


def partition(row, col, xy, z, edges, method: str = "rectangle", k: int | None = None, k_max: int = 8, criterion: str = "gain", min_gain: float = 0.05, min_cells: int | None = None, min_r2: float = 0.1) -> tuple[np.ndarray, list[tuple]]:
    """Zones from 1, numbered by the mean of z's first column, and the table (k, ssd, r2, gain, ch).

    'gain' takes the first k whose successor adds less than min_gain of the squares, 'ch' the largest
    Calinski-Harabasz index; a k with r2 under min_r2 gives one zone.
    """
    n = len(z)
    min_cells = min_cells or max(5, math.ceil(0.02 * n))
    if k and k > n // min_cells:
        raise ValueError(f"{k} zones of {min_cells} cells or more need more than {n} cells")
    top = k or max(1, min(k_max, n // min_cells))
    if method == "rectangle":
        found = rectangle_cuts(row, col, z, top, min_cells)
    elif method == "skater":
        found = tree_cuts(n, spanning_tree(n, connect(edges, xy), z), z, top, min_cells)
    elif method == "kmeans":
        found = [np.zeros(n, int), *(kmeans(z, j) for j in range(2, top + 1))]
    else:
        raise ValueError(f"unknown method: {method}")
    within = [sum(ssd(z[l == j]) for j in np.unique(l)) for l in found]
    total = within[0]
    table = []
    for i, w in enumerate(within):
        gain = (within[i - 1] - w) / total if i and total else math.nan
        ch = ((total - w) / i) / (w / (n - i - 1)) if i and w > 0 and n > i + 1 else math.nan
        table.append((i + 1, w, 1 - w / total if total else 0.0, gain, ch))
    if k:
        pick = min(k, len(found))
    elif criterion == "ch":
        pick = max(range(len(found)), key=lambda i: -1 if math.isnan(table[i][4]) else table[i][4]) + 1
    else:
        pick = next((i for i in range(1, len(found)) if table[i][3] < min_gain), len(found))
    if not k and table[pick - 1][2] < min_r2:
        pick = 1
    label = found[pick - 1]
    order = sorted(np.unique(label), key=lambda j: z[label == j, 0].mean())
    return np.array([order.index(j) + 1 for j in label]), table
