"""Maximum flow and minimum cut of one network."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from ..errors import GraphInputError, NotFoundError, NumericPolicyError

ALGORITHMS = ("dinic", "edmonds_karp", "ford_fulkerson")


class Residual:
    def __init__(self, vertices: list[str], edges, eps: float):
        self.names = sorted(vertices)
        self.at = {v: i for i, v in enumerate(self.names)}
        sums: dict[tuple[int, int], float] = {}
        for a, b, c, directed in edges:
            if c < -eps or c != c or c == float("inf"):
                raise NumericPolicyError("capacity")
            if a == b or c <= eps:
                continue
            i, j = self.at[a], self.at[b]
            sums[i, j] = sums.get((i, j), 0.0) + c
            if not directed:
                sums[j, i] = sums.get((j, i), 0.0) + c
        self.to: list[list[int]] = [[] for _ in self.names]
        self.head: list[int] = []
        self.cap: list[float] = []
        for i, j in sorted({tuple(sorted(p)) for p in sums}):
            self.to[i].append(len(self.head))
            self.to[j].append(len(self.head) + 1)
            self.head += [j, i]
            self.cap += [sums.get((i, j), 0.0), sums.get((j, i), 0.0)]

    def push(self, arc: int, f: float) -> None:
        self.cap[arc] -= f
        self.cap[arc ^ 1] += f


def _levels(r: Residual, s: int, eps: float) -> list[int]:
    level = [-1] * len(r.names)
    level[s] = 0
    todo = deque([s])
    while todo:
        v = todo.popleft()
        for a in r.to[v]:
            w = r.head[a]
            if r.cap[a] > eps and level[w] < 0:
                level[w] = level[v] + 1
                todo.append(w)
    return level


def _path(r: Residual, s: int, t: int, eps: float, deep: bool) -> list[int] | None:
    came: dict[int, int] = {s: -1}
    todo = deque([s])
    while todo:
        v = todo.pop() if deep else todo.popleft()
        if v == t:
            path = []
            while came[v] >= 0:
                path.append(came[v])
                v = r.head[came[v] ^ 1]
            return path[::-1]
        for a in reversed(r.to[v]) if deep else r.to[v]:
            w = r.head[a]
            if r.cap[a] > eps and w not in came:
                came[w] = a
                todo.append(w)
    return None


def max_flow(
    vertices: list[str],
    edges,
    source: str,
    sink: str,
    algorithm: str = "dinic",
    eps: float = 1e-9,
    level_rebuild: int = 0,
    max_augmentations: int = 0,
    observer: Callable[[int, list[str] | None, float], None] | None = None,
    cancelled: Callable[[], bool] | None = None,
) -> dict:
    """edges: (src, dst, capacity, directed).  Returns value, augmentations, source_side, sink_side, residual, capped.

    max_augmentations bounds Ford-Fulkerson only; ``capped`` says that it did,
    and then there is no cut.  observer gets every augmentation as (number,
    path or None under dinic, flow).  cancelled is asked before each and ends
    the search like a cap, with the flow so far.
    """
    if algorithm not in ALGORITHMS:
        raise GraphInputError(algorithm)
    r = Residual(vertices, edges, eps)
    for v in (source, sink):
        if v not in r.at:
            raise NotFoundError(v)
    if source == sink:
        raise GraphInputError("source is sink")
    s, t = r.at[source], r.at[sink]
    value, count, capped = 0.0, 0, False

    def told(path: list[int] | None, f: float) -> None:
        nonlocal value, count
        value += f
        count += 1
        if observer:
            observer(count, None if path is None else [r.names[s], *(r.names[r.head[a]] for a in path)], f)

    if algorithm == "dinic":
        while not capped:
            level = _levels(r, s, eps)
            if level[t] < 0:
                break
            nxt = [0] * len(r.names)
            since = 0
            while True:
                if cancelled and cancelled():
                    capped = True
                    break
                # One augmenting path by current arcs, without recursion.
                path: list[int] = []
                v = s
                while v != t:
                    while nxt[v] < len(r.to[v]):
                        a = r.to[v][nxt[v]]
                        if r.cap[a] > eps and level[r.head[a]] == level[v] + 1:
                            break
                        nxt[v] += 1
                    else:
                        if not path:
                            break
                        v = r.head[path.pop() ^ 1]
                        nxt[v] += 1
                        continue
                    path.append(a)
                    v = r.head[a]
                if v != t:
                    break
                f = min(r.cap[a] for a in path)
                for a in path:
                    r.push(a, f)
                told(None, f)
                since += 1
                if level_rebuild and since >= level_rebuild:
                    break
    else:
        deep = algorithm == "ford_fulkerson"
        while True:
            if cancelled and cancelled():
                capped = True
                break
            if deep and max_augmentations and count >= max_augmentations:
                capped = _path(r, s, t, eps, deep) is not None
                break
            path = _path(r, s, t, eps, deep)
            if path is None:
                break
            f = min(r.cap[a] for a in path)
            for a in path:
                r.push(a, f)
            told(path, f)
    level = _levels(r, s, eps)
    side = [n for n, d in zip(r.names, level, strict=True) if d >= 0]
    residual = sorted((r.names[r.head[a ^ 1]], r.names[r.head[a]], c) for a, c in enumerate(r.cap) if c > eps)
    return {
        "value": value,
        "augmentations": count,
        "capped": capped,
        "source_side": [] if capped else side,
        "sink_side": [] if capped else [n for n, d in zip(r.names, level, strict=True) if d < 0],
        "residual": [] if capped else residual,
    }
