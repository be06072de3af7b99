"""A robust-pruned directed graph over the vectors of one shard, and beam search on it (numpy).

Searches of a batch run in step: each step opens the nearest unopened candidates of every query.
"""

from __future__ import annotations

import numpy as np

NONE = np.float32(np.inf)
OPENED = 4


def _distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids (-1: none)."""
    near = np.einsum("bcd,bd->bc", points[ids], queries, optimize=True)
    out = norms[ids] - 2 * near + np.einsum("bd,bd->b", queries, queries)[:, None]
    out[ids < 0] = NONE
    return out


def beam_search(
    points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the ``beam`` nearest found, nearest first."""
    b, n = len(queries), len(points)
    norms = np.einsum("nd,nd->n", points, points)
    seen = np.zeros((b, n + 1), bool)
    ids = np.full((b, beam), -1, np.int32)
    ids[:, 0] = start
    seen[:, start] = True
    dist = _distances(points, norms, queries, ids)
    closed = ids < 0
    every = np.arange(b)[:, None]
    while True:
        todo = np.where(closed, NONE, dist)
        opened = min(OPENED, beam)
        picks = np.argpartition(todo, opened - 1, axis=1)[:, :opened]
        valid = np.isfinite(todo[every, picks])
        active = np.flatnonzero(valid.any(1))
        if not len(active):
            return ids, dist
        picks, valid, rows = picks[active], valid[active], active[:, None]
        closed[rows, picks] |= valid
        fresh = np.where(valid[:, :, None], graph[ids[rows, picks]], -1).reshape(len(active), -1)
        fresh.sort(axis=1)
        again = np.zeros_like(fresh, bool)
        again[:, 1:] = fresh[:, 1:] == fresh[:, :-1]
        fresh[again | seen[rows, fresh]] = -1
        fresh[fresh < 0] = -1
        seen[rows, fresh] = True
        seen[:, n] = False
        new = _distances(points, norms, queries[active], fresh)
        all_ids = np.concatenate([ids[active], fresh], 1)
        all_dist = np.concatenate([dist[active], new], 1)
        all_closed = np.concatenate([closed[active], fresh < 0], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(active))[:, None]
        ids[active], dist[active], closed[active] = all_ids[at, order], all_dist[at, order], all_closed[at, order]


def robust_prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of ``own`` up to ``degree`` diverse ids from its row of candidates (-1: none):
    the nearest is kept, and candidates that it is ``alpha`` times nearer to than the point go."""
    ids = np.where(ids == own[:, None], -1, ids)
    rest = points[ids]
    norms = np.einsum("bcd,bcd->bc", rest, rest)
    me = points[own]
    dist = norms - 2 * np.einsum("bcd,bd->bc", rest, me) + np.einsum("bd,bd->b", me, me)[:, None]
    left = np.where(ids < 0, NONE, dist)
    out = np.full((len(own), degree), -1, np.int32)
    row = np.arange(len(own))
    for k in range(degree):
        best = left.argmin(1)
        ok = np.isfinite(left[row, best])
        if not ok.any():
            break
        out[:, k] = np.where(ok, ids[row, best], -1)
        near = rest[row, best]
        apart = norms - 2 * np.einsum("bcd,bd->bc", rest, near) + norms[row, best][:, None]
        left[(alpha * alpha * apart <= dist) & ok[:, None]] = NONE
        left[row, best] = NONE
    return out


def build(
    points: np.ndarray, degree: int = 40, beam: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 5
) -> tuple[np.ndarray, int]:
    """Neighbours of every point (-1: none), and the point that searches start from."""
    n = len(points)
    start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        first = min(degree // 2, n - 1)
        graph[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
    order = rng.permutation(n)
    for a in range(0, n, batch):
        own = order[a : a + batch].astype(np.int32)
        found, _ = beam_search(points, graph, start, points[own], min(beam, n))
        graph[own] = robust_prune(points, own, np.concatenate([found, graph[own]], 1), degree, alpha)
        source = np.repeat(own, degree)
        target = graph[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sort = np.argsort(target, kind="stable")
        source, target = source[sort], target[sort]
        at, first, counts = np.unique(target, return_index=True, return_counts=True)
        for c in np.unique(counts):
            some = at[counts == c]
            extra = source[first[counts == c][:, None] + np.arange(c)]
            extra[(graph[some][:, None, :] == extra[:, :, None]).any(2)] = -1
            both = np.concatenate([graph[some], extra], 1)
            fits = (both >= 0).sum(1) <= degree
            graph[some[fits]] = -np.sort(-both[fits], axis=1)[:, :degree]
            if not fits.all():
                graph[some[~fits]] = robust_prune(points, some[~fits].astype(np.int32), both[~fits], degree, alpha)
    return graph, start
