"""Variants beside the main path: smoothing, known-path flow, fragments, cycle splitting, walks, lookups."""

from __future__ import annotations

import numpy as np

from readloom.operators.flow import decompose_node


def smooth_copy_counts(edges: dict[tuple, float], norm: int = 2, lengths: dict[tuple, float] | None = None) -> dict[tuple, float]:
    """Edge weights of at least 0, changed as little as possible so that flow is conserved at inner nodes.

    ``norm`` 2: least sum of squares, weighted by ``lengths``; ``norm`` 1: least sum
    of changes, weighted by their roots. Both give the optimum.
    """
    keys = sorted(edges)
    size = np.array([(lengths or {}).get(e, 1.0) for e in keys], float)
    c = np.array([edges[e] for e in keys], float)
    inner = {v: i for i, v in enumerate(sorted({u for u, _ in keys} & {v for _, v in keys}))}
    x = _closest_flow(keys, c, size, inner) if norm == 2 else _cheapest_flow(keys, c, np.sqrt(size), inner)
    return dict(zip(keys, x.tolist()))


def _closest_flow(keys, c, size, inner, tol: float = 1e-11, rounds: int = 100_000) -> np.ndarray:
    """Dykstra's alternating projections onto conserved flows and onto weights of at least 0, in the scale of ``size``."""
    root = np.sqrt(size)
    a = np.zeros((len(inner), len(keys)))
    for j, (u, v) in enumerate(keys):
        if v in inner:
            a[inner[v], j] += 1
        if u in inner:
            a[inner[u], j] -= 1
    a = a / root
    onto = np.linalg.pinv(a) @ a if len(inner) else np.zeros((len(keys), len(keys)))
    y, more = c * root, np.zeros(len(keys))
    for _ in range(rounds):
        x = y - onto @ y
        z = np.maximum(x + more, 0)
        more = x + more - z
        if np.abs(z - y).max(initial=0) <= tol * max(1.0, np.abs(y).max(initial=0)) and np.abs(z - x).max(initial=0) <= tol * max(1.0, np.abs(x).max(initial=0)):
            return z / root
        y = z
    raise RuntimeError("smoothing did not settle")


def _cheapest_flow(keys, c, cost, inner) -> np.ndarray:
    """Surpluses of inner nodes sent to deficits along the cheapest changes: more on an edge, or less down to 0.

    Whatever is not an inner node takes and gives any amount.
    """
    x, outside = c.copy(), len(inner)
    at = lambda v: inner.get(v, outside)
    ends = [(at(u), at(v)) for u, v in keys]
    n = len(inner) + 1
    while True:
        spare = np.zeros(n)
        for (u, v), f in zip(ends, x):
            spare[v] += f
            spare[u] -= f
        spare[outside] = 0
        tiny = 1e-9 * max(1.0, np.abs(c).max(initial=0))
        if not (np.abs(spare) > tiny).any():
            return x
        # from a node with a surplus (or the outside) to one with a deficit (or the outside)
        over = spare > tiny
        start = over if over.any() else np.arange(n) == outside
        goal = (spare < -tiny) | (np.arange(n) == outside) if over.any() else spare < -tiny
        dist, via = np.where(start, 0.0, np.inf), [None] * n
        for _ in range(n):
            moved = False
            for j, (u, v) in enumerate(ends):
                up = -cost[j] if x[j] < c[j] - tiny else cost[j]
                down = -cost[j] if x[j] > c[j] + tiny else cost[j]
                room = c[j] - x[j] if x[j] < c[j] - tiny else np.inf
                back = x[j] - c[j] if x[j] > c[j] + tiny else x[j]
                if dist[u] + up < dist[v] - 1e-12:
                    dist[v], via[v], moved = dist[u] + up, (j, 1, u, room), True
                if back > tiny and dist[v] + down < dist[u] - 1e-12:
                    dist[u], via[u], moved = dist[v] + down, (j, -1, v, back), True
            if not moved:
                break
        end = int(np.argmin(np.where(goal & ~start, dist, np.inf)))
        path, v = [], end
        while via[v] is not None and len(path) <= n:
            path.append(via[v])
            v = via[v][2]
        amount = min(room for *_, room in path)
        if v != outside:
            amount = min(amount, spare[v])
        if end != outside:
            amount = min(amount, -spare[end])
        for j, sign, _, _ in path:
            x[j] = max(x[j] + sign * amount, 0.0)


def decompose_on_known_paths(a, b, supported: np.ndarray, seed: int = 0) -> np.ndarray:
    """Node decomposition in which pairs that no known path supports get no flow, where any pair is supported."""
    return decompose_node(a, b, supported, seed, known_only=True)


def fragments(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of overlapping intervals of two sorted lists; each interval is used once.

    Of two that do not overlap the left one is passed if it starts first, and the
    right one if it starts before the earlier end.
    """
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        (a, b), (c, d) = left[i], right[j]
        low, high = max(a, c), min(b, d)
        if low <= high:
            out.append((min(a, c), max(b, d)))
            i, j = i + 1, j + 1
        else:
            i, j = i + (a < low), j + (c < high)
    return out


def short_cycle(graph, start: int, most: int = 100) -> list[int] | None:
    """A cycle through a node of fewer than ``most`` nodes, depth first."""
    stack = [(start, (start,))]
    seen = set()
    while stack:
        v, path = stack.pop()
        for w in sorted(graph.out[v], reverse=True):
            if w == start:
                return list(path)
            if w not in seen and len(path) < most:
                seen.add(w)
                stack.append((w, (*path, w)))
    return None


def eulerian_walk(edges: list[tuple]) -> list | None:
    """A walk over every edge once, or None if there is none."""
    out: dict = {}
    need: dict = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
        need[u] = need.get(u, 0) + 1
        need[v] = need.get(v, 0) - 1
    starts = sorted(v for v, d in need.items() if d == 1)
    if any(abs(d) > 1 for d in need.values()) or len(starts) > 1:
        return None
    stack, walk = [starts[0] if starts else min(out)], []
    for v in out:
        out[v].sort(reverse=True)
    while stack:
        if out[stack[-1]]:
            stack.append(out[stack[-1]].pop())
        else:
            walk.append(stack.pop())
    return walk[::-1] if len(walk) == len(edges) + 1 else None


def all_sequences(graph, most_visits: int = 2) -> list[str]:
    """Sequences of all walks from sources to sinks that visit a node at most so often."""
    found = []
    for root in sorted(v for v in graph.seq if not graph.inn[v]):
        stack = [(root,)]
        while stack:
            path = stack.pop()
            nxt = [w for w in sorted(graph.out[path[-1]], reverse=True) if path.count(w) < most_visits]
            if not graph.out[path[-1]]:
                found.append(graph.spell(path))
            stack += [(*path, w) for w in nxt]
    return found
