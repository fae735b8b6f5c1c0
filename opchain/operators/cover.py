"""Maximum matchings and minimum vertex covers of one bipartite component, in arrays."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

Adjacency = Sequence[Sequence[int]]  # of each left vertex its right vertices; repeats do no harm


def maximum_matching(adjacency: Adjacency, n_right: int) -> tuple[list[int], list[int]]:
    """Partners of the left and of the right vertices, -1 where there is none.

    Phases of a breadth-first layering from the free left vertices and a depth-first search along the
    layers with its own stack, each taking a maximal set of disjoint shortest augmenting paths.
    """
    left, right = [-1] * len(adjacency), [-1] * n_right
    while True:
        depth = [0 if p < 0 and adjacency[v] else -1 for v, p in enumerate(left)]
        queue, reached = deque(v for v, d in enumerate(depth) if d == 0), False
        while queue:
            v = queue.popleft()
            for r in adjacency[v]:
                w = right[r]
                if w < 0:
                    reached = True
                elif depth[w] < 0:
                    depth[w] = depth[v] + 1
                    queue.append(w)
        if not reached:
            return left, right
        tried = [0] * len(adjacency)
        for root in [v for v, d in enumerate(depth) if d == 0]:
            path, taken = [root], []  # left vertices, and the right vertex taken from each but the last
            while path:
                v = path[-1]
                if tried[v] == len(adjacency[v]):
                    path.pop()
                    if taken:
                        taken.pop()
                    continue
                r = adjacency[v][tried[v]]
                tried[v] += 1
                w = right[r]
                if w < 0:
                    for x, y in zip(path, [*taken, r], strict=True):
                        left[x], right[y] = y, x
                        tried[x], depth[x] = len(adjacency[x]), -1  # used once in this phase
                    break
                if depth[w] == depth[v] + 1:
                    path.append(w)
                    taken.append(r)
    return left, right


def minimum_vertex_cover(adjacency: Adjacency, n_right: int) -> tuple[list[int], list[int]]:
    """Left and right vertices of a least set that touches every edge, each in ascending order.

    Of vertices reached by alternating paths from the unmatched left ones, the right; of the others that have edges, the left.
    """
    left, right = maximum_matching(adjacency, n_right)
    seen_left, seen_right = [p < 0 for p in left], [False] * n_right
    todo = [v for v, free in enumerate(seen_left) if free]
    while todo:
        for r in adjacency[todo.pop()]:
            if not seen_right[r]:
                seen_right[r] = True
                if right[r] >= 0 and not seen_left[right[r]]:
                    seen_left[right[r]] = True
                    todo.append(right[r])
    return [v for v, s in enumerate(seen_left) if not s], [r for r, s in enumerate(seen_right) if s]
