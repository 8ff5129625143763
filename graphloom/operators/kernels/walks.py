"""Depth-first walks of one graph, without recursion."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import CycleError, NotFoundError, TraversalStopped

Arcs = dict[str, list[tuple[str, str]]]


def arcs_of(vertices: list[str], edges: list[tuple[str, str, str, bool]]) -> Arcs:
    """vertex -> [(edge ID, neighbour)] by edge ID; edges are (edge_id, src, dst, directed)."""
    out: Arcs = {v: [] for v in vertices}
    for eid, a, b, directed in edges:
        out[a].append((eid, b))
        if not directed and a != b:
            out[b].append((eid, a))
    for v in out.values():
        v.sort()
    return out


def dfs(
    arcs: Arcs,
    start: str | None,
    full: bool = False,
    max_depth: int = -1,
    keep: Callable[[str], bool] | None = None,
    on_visit: Callable[[str, int], None] | None = None,
    on_exit: Callable[[str, int], None] | None = None,
    cancelled: Callable[[], bool] | None = None,
):
    """(pre-order, finish order, depth, parent, skipped); start None or full: every vertex in ID order.

    on_visit and on_exit get (vertex, depth) as it is met and finished.  What
    they raise stops the walk, as does cancelled, asked at every vertex; the
    error's ``partial`` is what has been walked, without finish order if it
    was cancelled.
    """
    if not full and start not in arcs:
        raise NotFoundError(str(start))
    pre, post = [], []
    depth: dict[str, int] = {}
    parent: dict[str, str | None] = {}
    skipped = 0

    def told(hook, v: str) -> None:
        if cancelled and cancelled():
            raise TraversalStopped("cancelled", (pre, [], depth, parent, skipped))
        if hook:
            try:
                hook(v, depth[v])
            except Exception as e:
                raise TraversalStopped(str(e), (pre, post, depth, parent, skipped)) from e

    for root in sorted(arcs) if full else [start]:
        if root in depth:
            continue
        depth[root], parent[root] = 0, None
        pre.append(root)
        told(on_visit, root)
        stack = [(root, iter(arcs[root]))]
        while stack:
            v, it = stack[-1]
            for _, w in it:
                if keep is not None and not keep(w):
                    skipped += 1
                    continue
                if w in depth or 0 <= max_depth <= depth[v]:
                    continue
                depth[w], parent[w] = depth[v] + 1, v
                pre.append(w)
                told(on_visit, w)
                stack.append((w, iter(arcs[w])))
                break
            else:
                told(on_exit, v)
                post.append(v)
                stack.pop()
    return pre, post, depth, parent, skipped


def least_rotation(s: list[str]) -> list[str]:
    """The rotation that comes first, by the two-candidate scan."""
    n, i, j, k = len(s), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    at = min(i, j)
    return s[at:] + s[:at]


def canonical_cycle(ring: list[str], both_ways: bool) -> list[str]:
    """A ring (without its repeated end) as its least rotation, or that of its reverse; closed."""
    best = least_rotation(ring)
    if both_ways:
        best = min(best, least_rotation(ring[::-1]))
    return [*best, best[0]]


def cycles(vertices: list[str], edges: list[tuple[str, str, str, bool]], directed: bool, loops: bool) -> list[list[str]]:
    """Witnesses: the rings that back edges of one depth-first forest close, in order of their text.

    An undirected edge back to the parent vertex is none.
    """
    arcs: dict[str, list] = {v: [] for v in vertices}
    for eid, a, b, d in edges:
        arcs[a].append((eid, b, d))
        if not d and a != b:
            arcs[b].append((eid, a, d))
    for v in arcs.values():
        v.sort()
    state: dict[str, int] = {}
    found: dict[str, list[str]] = {}
    for root in sorted(arcs):
        if root in state:
            continue
        path, at = [root], {root: 0}
        state[root] = 1
        stack = [(root, iter(arcs[root]))]
        while stack:
            v, it = stack[-1]
            for _, w, d in it:
                if w == v:
                    if loops:
                        found[f"{v},{v}"] = [v, v]
                    continue
                if state.get(w) == 1:
                    if not d and len(path) > 1 and path[-2] == w:
                        continue
                    c = canonical_cycle(path[at[w] :], not directed)
                    found[",".join(c)] = c
                elif w not in state:
                    state[w] = 1
                    at[w] = len(path)
                    path.append(w)
                    stack.append((w, iter(arcs[w])))
                    break
            else:
                state[v] = 2
                stack.pop()
                del at[path.pop()]
    return [found[k] for k in sorted(found)]


def topological_order(vertices: list[str], edges: list[tuple[str, str, str, bool]], cancelled: Callable[[], bool] | None = None) -> list[str]:
    """Reverse finish order over directed edges, vertices and edges in ID order; undirected ones are passed over."""
    arcs = arcs_of(vertices, [e for e in edges if e[3]])
    state: dict[str, int] = {}
    post: list[str] = []
    for root in sorted(arcs):
        if root in state:
            continue
        if cancelled and cancelled():
            raise TraversalStopped("cancelled", None)
        state[root] = 1
        stack = [(root, iter(arcs[root]))]
        while stack:
            v, it = stack[-1]
            for _, w in it:
                s = state.get(w)
                if s == 1:
                    raise CycleError(w)
                if s is None:
                    state[w] = 1
                    stack.append((w, iter(arcs[w])))
                    break
            else:
                state[v] = 2
                post.append(v)
                stack.pop()
    return post[::-1]
