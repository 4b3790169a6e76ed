"""Agglomerative trees of a few hundred names at most."""

from __future__ import annotations

import math

import numpy as np


def linkage_tree(names: list[str], d: np.ndarray, method: str = "average", groups: int | None = None) -> list[tuple]:
    """Rows (node, parent, depth, child_pos, is_leaf, distance, coarse), parents first.

    The closest two clusters merge (ties: the earlier ones) by average, single or complete
    linkage; merged nodes are called merge_1, merge_2, ... Nearest clusters are kept, so that all merges
    together take about n^2 steps and not n^3.
    """
    n = len(names)
    last = 2 * n - 1
    size, kids, height = dict.fromkeys(range(n), 1), {}, dict.fromkeys(range(n), 0.0)
    # distances to later clusters, and each cluster's nearest later one: a merge changes what was nearest to few of them
    far = np.full((last, last), np.inf)
    far[:n, :n] = np.where(np.triu(np.ones((n, n), bool), 1), d, np.inf)
    near = far.argmin(1)
    gap = far[np.arange(last), near]
    alive = np.arange(last) < n
    for new in range(n, last):
        i = int(gap.argmin())
        j = int(near[i])
        kids[new], height[new], size[new] = (i, j), float(gap[i]), size[i] + size[j]
        alive[[i, j]] = False
        x = np.flatnonzero(alive)
        p, q = (far[np.minimum(k, x), np.maximum(k, x)] for k in (i, j))
        if method == "single":
            v = np.minimum(p, q)
        elif method == "complete":
            v = np.maximum(p, q)
        else:
            v = (size[i] * p + size[j] * q) / size[new]
        far[[i, j], :] = far[:, [i, j]] = np.inf
        gap[[i, j]] = np.inf
        far[x, new] = v
        alive[new] = True
        stale = x[np.isin(near[x], (i, j))]
        near[stale] = far[stale].argmin(1)
        gap[stale] = far[stale, near[stale]]
        closer = x[v < gap[x]]
        near[closer], gap[closer] = new, far[closer, new]
    alive = np.flatnonzero(alive).tolist()
    root = alive[0]
    want = groups or max(1, math.ceil(math.sqrt(n)))
    cut = [root]
    while len(cut) < want and any(x in kids for x in cut):
        top = max((x for x in cut if x in kids), key=lambda x: (height[x], x))
        cut = [y for x in cut for y in (kids[x] if x == top else (x,))]
    group: dict[int, int] = {}
    for g, x in enumerate(cut):
        stack = [x]
        while stack:
            y = stack.pop()
            group[y] = g
            stack += kids.get(y, ())
    name = lambda x: names[x] if x < n else f"merge_{x - n + 1}"
    rows, stack = [], [(root, None, 0, 0)]
    while stack:
        x, parent, depth, pos = stack.pop()
        rows.append((name(x), parent, depth, pos, x < n, height[x], group.get(x)))
        stack += [(y, name(x), depth + 1, k) for k, y in reversed(list(enumerate(kids.get(x, ()))))]
    return rows
