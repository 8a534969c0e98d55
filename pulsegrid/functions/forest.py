"""Numpy helpers for one-feature isolation forests (Liu, Ting, Zhou: Isolation Forest, ICDM 2008).

With one feature every tree is a step function of the value, so a fitted forest collapses to a
sorted array of edges and one score per interval. ``scores[i]`` holds for values above exactly
``i`` edges; a value equal to an edge lies below it (the split test is ``x <= edge``).
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

EULER = 0.5772156649


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big))


def grow_tree(
    rows: list[float], max_depth: int, draws: list[float], leaf_path: list[float]
) -> tuple[list[float], list[float]]:
    """Random splits of sorted rows: edges in ascending order and the path length of each leaf between them.

    ``draws`` holds at least ``len(rows)`` uniform numbers, one per split; ``leaf_path[n]`` is the
    mean path that a leaf of ``n`` rows adds.
    """
    edges: list[float] = []
    paths: list[float] = []
    used = 0
    # Depth-first with the left part on top, so that leaves come out in value order.
    pending: list[tuple[int, int, int, float | None]] = [(0, len(rows), 0, None)]
    while pending:
        lo, hi, depth, edge = pending.pop()
        if edge is not None:
            edges.append(edge)
        first, last = rows[lo], rows[hi - 1]
        if hi - lo <= 1 or depth >= max_depth or first == last:
            paths.append(depth + leaf_path[hi - lo])
            continue
        cut = first + (last - first) * draws[used]
        used += 1
        middle = min(bisect_right(rows, cut, lo, hi), hi - 1)
        pending.append((middle, hi, depth + 1, cut))
        pending.append((lo, middle, depth + 1, None))
    return edges, paths


def fit_surface(values: np.ndarray, n_trees: int, max_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges and raw scores (``-2 ** (-mean path / c)``) of a forest on ``values`` in any order."""
    values = np.sort(np.asarray(values, dtype=float))
    rng = np.random.default_rng(seed)
    size = min(max_rows, len(values))
    max_depth = int(np.ceil(np.log2(max(size, 2))))
    draws = np.stack([rng.choice(len(values), size, replace=False) for _ in range(n_trees)])
    leaf_path = average_path(np.arange(size + 1)).tolist()
    base = 0.0
    all_edges, all_steps = [], []
    for draw in draws:
        edges, paths = grow_tree(values[np.sort(draw)].tolist(), max_depth, rng.random(size).tolist(), leaf_path)
        base += paths[0]
        all_edges.append(edges)
        all_steps.append(np.diff(paths))
    edges, steps = np.concatenate(all_edges), np.concatenate(all_steps)
    order = np.argsort(edges, kind="stable")
    edges, depth = edges[order], base + np.concatenate([[0.0], np.cumsum(steps[order])])
    # Equal edges of several trees act together.
    last = np.append(edges[1:] != edges[:-1], True) if len(edges) else np.array([], dtype=bool)
    depth = np.concatenate([depth[:1], depth[1:][last]])
    norm = float(average_path(size)) or 1.0
    return edges[last], -np.power(2.0, -depth / n_trees / norm)


def lookup(edges: np.ndarray, scores: np.ndarray, values: np.ndarray) -> np.ndarray:
    return scores[np.searchsorted(edges, values, side="left")]


def normal_core(edges: np.ndarray, decisions: np.ndarray, threshold: float) -> tuple[float, float]:
    """Bounds of the longest run of steps at or above the threshold: values in (low, high] are normal for sure.

    Without such a step the range is empty.
    """
    fine = np.concatenate([[0], (decisions >= threshold).astype(int), [0]])
    begins, ends = np.flatnonzero(np.diff(fine) == 1), np.flatnonzero(np.diff(fine) == -1)
    if len(begins) == 0:
        return np.inf, -np.inf
    best = int(np.argmax(ends - begins))
    bounds = np.concatenate([[-np.inf], edges, [np.inf]])
    return float(bounds[begins[best]]), float(bounds[ends[best]])
