"""Paths in a graph that fits one worker: compact arrays, Dijkstra and A*, loopless paths in order of
cost, and candidate sets with limited overlap. Nothing here knows of Spark."""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterator

import numpy as np

Path = list[int]
INF = float("inf")


class Graph:
    """Arcs by place of their start node. Of parallel arcs the one with the least weight stays (of
    equal ones the shortest). Nodes are places 0..n-1 inside, ids outside."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, length: np.ndarray | None = None):
        length = w if length is None else length
        self.ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = ends[: len(src)], ends[len(src) :]
        order = np.lexsort((length, w, b, a))
        a, b, w, length = a[order], b[order], w[order], length[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, w, length = a[first], b[first], w[first], length[first]
        self.n = len(self.ids)
        self.place = {x: i for i, x in enumerate(self.ids.tolist())}
        self.start = np.searchsorted(a, np.arange(self.n + 1)).tolist()
        self.src, self.dst, self.w, self.length = a.tolist(), b.tolist(), w.tolist(), length.tolist()
        self.arc = {(x, y): k for k, (x, y) in enumerate(zip(self.src, self.dst))}
        back = np.argsort(b, kind="stable")
        self.back_start = np.searchsorted(b[back], np.arange(self.n + 1)).tolist()
        self.back = back.tolist()
        #: Of each node the neighbours that its arcs lead to and come from, with the weights.
        self.out = [list(zip(self.dst[i:j], self.w[i:j])) for i, j in zip(self.start, self.start[1:])]
        self.into = [[(self.src[k], self.w[k]) for k in self.back[i:j]] for i, j in zip(self.back_start, self.back_start[1:])]

    def named(self, path: Path) -> list[int]:
        ids = self.ids
        return [int(ids[x]) for x in path]

    def arcs_of(self, path: Path) -> list[int]:
        return [self.arc[x, y] for x, y in zip(path, path[1:])]

    def cost(self, path: Path) -> float:
        return sum(self.w[k] for k in self.arcs_of(path))

    def roads(self, path: Path) -> dict[tuple[int, int], float]:
        """The undirected edges of a path with their lengths."""
        return {(min(x, y), max(x, y)): self.length[self.arc[x, y]] for x, y in zip(path, path[1:])}


def distances(g: Graph, s: int, backward: bool = False, until: Collection[int] = ()) -> list[float]:
    """The cost from s to every node, or from every node to s; of ``until`` given, right for these only,
    for the search ends with the last of them."""
    near, left = g.into if backward else g.out, set(until)
    ending = bool(left)
    dist = [INF] * g.n
    dist[s] = 0.0
    heap, pop, push = [(0.0, s)], heapq.heappop, heapq.heappush
    while heap:
        d, x = pop(heap)
        if d > dist[x]:
            continue
        if ending and x in left:
            left.remove(x)
            if not left:
                break
        for y, w in near[x]:
            e = d + w
            if e < dist[y]:
                dist[y] = e
                push(heap, (e, y))
    return dist


def shortest(
    g: Graph, s: int, t: int, ahead: list[float] | None = None, w: list[float] | None = None, no_nodes: Collection[int] = (), no_arcs: Collection[int] = ()
) -> tuple[float, Path] | None:
    """The cheapest path by A*; ahead: a lower bound of each node's cost to t (none: Dijkstra)."""
    w = w or g.w
    dist, came = {s: 0.0}, {}
    heap, pop, push = [(ahead[s] if ahead else 0.0, s)], heapq.heappop, heapq.heappush
    done = set(no_nodes)
    if ahead and ahead[s] == INF:
        return None
    while heap:
        _, x = pop(heap)
        if x == t:
            path = [t]
            while path[-1] != s:
                path.append(came[path[-1]])
            return dist[t], path[::-1]
        if x in done:
            continue
        done.add(x)
        d = dist[x]
        for k in range(g.start[x], g.start[x + 1]):
            y = g.dst[k]
            if y in done or k in no_arcs:
                continue
            e = d + w[k]
            if e < dist.get(y, INF):
                f = e + ahead[y] if ahead else e
                if f < INF:
                    dist[y], came[y] = e, x
                    push(heap, (f, y))
    return None


def loopless(g: Graph, s: int, t: int) -> Iterator[tuple[float, Path]]:
    """Loopless paths in order of cost. Costs to t, found once, guide every spur search, so that it
    hardly leaves the path. A candidate remembers where it left its parent; spurs before that were
    tried for the parent."""
    ahead = distances(g, t, backward=True)
    first = shortest(g, s, t, ahead)
    heap: list[tuple[float, Path, int]] = [(*first, 0)] if first else []
    known = {tuple(first[1])} if first else set()
    left_by: dict[tuple[int, ...], set[int]] = {}  # of each root: arcs by which found paths leave it
    while heap:
        cost, path, left = heapq.heappop(heap)
        yield cost, path
        arcs = g.arcs_of(path)
        for i, k in enumerate(arcs):
            left_by.setdefault(tuple(path[: i + 1]), set()).add(k)
        spent = sum(g.w[k] for k in arcs[:left])
        for i in range(left, len(path) - 1):
            root = path[: i + 1]
            spur = shortest(g, path[i], t, ahead, None, root[:-1], left_by[tuple(root)])
            if spur:
                full = root[:-1] + spur[1]
                if tuple(full) not in known:
                    known.add(tuple(full))
                    heapq.heappush(heap, (spent + spur[0], full, i))
            spent += g.w[arcs[i]]


class Overlap:
    """Keeps paths of which less than the share theta of their length is shared with any kept before."""

    def __init__(self, g: Graph, theta: float):
        self.g, self.theta = g, theta
        self.roads: list[dict[tuple[int, int], float]] = []

    def admit(self, path: Path) -> bool:
        own = self.g.roads(path)
        most = self.theta * sum(own.values())
        if all(sum(x for e, x in own.items() if e in other) < most for other in self.roads):
            self.roads.append(own)
            return True
        return False


def limited(g: Graph, s: int, t: int, k: int, theta: float = 0.7, stretch: float = 1.5, most: int = 400) -> list[tuple[float, Path]]:
    """Up to k paths of limited overlap among the first ``most`` loopless ones within stretch."""
    kept, overlap, best = [], Overlap(g, theta), None
    for i, (cost, path) in enumerate(loopless(g, s, t)):
        best = cost if best is None else best
        if i >= most or len(kept) >= k or cost > stretch * best:
            break
        if overlap.admit(path):
            kept.append((cost, path))
    return kept


def penalised(g: Graph, s: int, t: int, k: int, theta: float = 0.7, stretch: float = 1.5, factor: float = 1.2, most: int = 120) -> list[tuple[float, Path]]:
    """Up to k paths of limited overlap, of shortest paths on weights that grow by ``factor`` on the
    edges of each path found, in both directions where an edge has two. Paths beyond stretch are
    made dearer, too, but not kept."""
    dear, kept, overlap, best = list(g.w), [], Overlap(g, theta), None
    ahead = distances(g, t, backward=True)  # weights only grow, so this stays a lower bound
    for _ in range(most):
        found = shortest(g, s, t, ahead, dear)
        if not found:
            break
        path = found[1]
        cost = g.cost(path)
        best = cost if best is None else best
        for a, b in zip(path, path[1:]):
            for pair in ((a, b), (b, a)):
                if pair in g.arc:
                    dear[g.arc[pair]] *= factor
        if cost <= stretch * best and overlap.admit(path):
            kept.append((cost, path))
            if len(kept) >= k:
                break
    return kept


def ranked(g: Graph, s: int, t: int, k: int) -> list[tuple[float, Path]]:
    """The k cheapest loopless paths."""
    return [x for _, x in zip(range(k), loopless(g, s, t))]
