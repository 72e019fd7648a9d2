"""Cover trees over unit vectors, and the traversal of two of them at once.

A tree has nested levels with halving radii: the root, then nets of radius 1,
1/2, 1/4 and 1/8, then the vectors themselves. Each centre of a level is a
centre of the next one too. Besides its level a node knows its *covering
radius*, the distance to the farthest vector below it, found exactly. Vectors lie
in the order of the tree, so those below a node are a run.

The traversal looks at pairs of nodes of the same level. With d the distance of
their centres, all vectors below them are farther apart than ``d - r1 - r2`` and
nearer than ``d + r1 + r2``: the pair is left, linked as a whole, or opened,
which gives the pairs of their children. Pairs of vectors that are still open in
the end are compared directly. Nodes are handled in strips, one matrix at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

RADII = (1.0, 0.5, 0.25, 0.125)
#: Nodes of one tree that are compared in one matrix with those of another.
STRIP = 512
#: Bounds this close to the threshold decide nothing, so rounding doesn't either.
SLACK = 1e-7
#: Cosines this close to the threshold are computed again from the raw vectors.
CLOSE = 1e-9


class Tree(NamedTuple):
    """Vectors in the order of the tree and its levels, the root's first and the vectors' last."""

    order: np.ndarray  # the place of each vector in the input
    starts: list[np.ndarray]  # per level: where the run of each node begins; the first of a run is its centre
    radii: list[np.ndarray]  # per level: covering radii
    parents: list[np.ndarray]  # per level: the node above


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; entries are scaled first, so that squares neither overflow nor vanish."""
    values = raw.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _far(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def _net(u: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """Split rows into runs within ``radius`` of their first row; a centre is no run's later member."""
    near = 1.0 - radius * radius / 2.0
    runs, left = [], rows
    while len(left):
        inside = u[left] @ u[left[0]] >= near
        inside[0] = True
        runs.append(left[inside])
        left = left[~inside]
    return runs


def _split(u: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """As ``_net``, with one product for many rows."""
    if len(rows) < 64:
        return _net(u, rows, radius)
    v = u[rows].astype(np.float32)
    near = np.float32(1.0 - radius * radius / 2.0)
    runs, left = [], np.arange(len(rows))
    while len(left) >= 64:
        # the next centres' neighbours, 128 centres at a time
        some = left[:128]
        inside = v[some] @ v[left].T >= near
        free = np.ones(len(left), dtype=bool)
        for k in range(len(some)):
            if free[k]:
                own = inside[k] & free
                own[k] = False
                members = left[own]
                runs.append(rows[np.concatenate([some[k : k + 1], members])])
                free[own] = False
                free[k] = False
        left = left[free]
    return runs + (_net(u, rows[left], radius) if len(left) else [])


def build(u: np.ndarray) -> Tree:
    """The tree of some unit vectors."""
    order = np.arange(len(u))
    runs = [order]
    starts, parents = [np.array([0])], [np.array([0])]
    for radius in RADII:
        below = [(parent, part) for parent, run in enumerate(runs) for part in _split(u, run, radius)]
        parents.append(np.array([p for p, _ in below]))
        runs = [part for _, part in below]
        order = np.concatenate(runs)
        sizes = np.array([len(run) for run in runs])
        starts.append(np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    last = np.repeat(np.arange(len(runs)), sizes)
    parents.append(last)
    starts.append(np.arange(len(u)))
    # runs are permuted only inside themselves by later levels, but for their first row, the centre
    placed = u[order]
    radii = []
    for begin in starts:
        owner = np.repeat(begin, np.diff(np.append(begin, len(u))))
        away = _far(np.einsum("ij,ij->i", placed, placed[owner]))
        away[owner == np.arange(len(u))] = 0.0
        radii.append(np.maximum.reduceat(away, begin))
    return Tree(order, starts, radii, parents)


class Links:
    """What a traversal finds: per vector the weight of those that it links with, and components as roots."""

    def __init__(self, n: int) -> None:
        self.weight = np.zeros(n + 1, dtype=np.int64)  # as differences along the order
        self.root = np.arange(n)

    def add(self, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> None:
        np.add.at(self.weight, begin, weight)
        np.subtract.at(self.weight, end, weight)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def weights(self) -> np.ndarray:
        return np.cumsum(self.weight)[:-1]


class Side(NamedTuple):
    """A tree with its vectors, raw and as units, and weights, all in its order."""

    tree: Tree
    raw: np.ndarray
    u: np.ndarray
    before: np.ndarray  # weights of all vectors before a place
    offset: int  # of its vectors among those of both trees

    @staticmethod
    def of(raw: np.ndarray, weights: np.ndarray, tree: Tree, offset: int) -> Side:
        """``raw`` and ``weights`` in the tree's order."""
        return Side(tree, raw, unit(raw), np.concatenate([[0], np.cumsum(weights)]), offset)

    def runs(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the nodes' vectors, and their weights."""
        begin = self.tree.starts[level]
        end = np.append(begin, len(self.u))[nodes + 1]
        begin = begin[nodes]
        return begin, end, self.before[end] - self.before[begin]

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of sorted nodes, and for each the place of its parent among ``nodes``."""
        parents = self.tree.parents[level + 1]
        first, last = np.searchsorted(parents, nodes), np.searchsorted(parents, nodes, side="right")
        count = last - first
        at = np.repeat(np.arange(len(nodes)), count)
        return np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + first[at], at


def traverse(p: Side, q: Side, least: float, links: Links, same: bool) -> None:
    """Record all links with a cosine of at least ``least`` between two trees, or within one."""
    tau = np.sqrt(2.0 - 2.0 * least)
    bottom = len(p.tree.starts) - 1
    root = np.array([0])
    todo = [(0, root, root, np.ones((1, 1), dtype=bool))]
    while todo:
        level, rows, cols, mask = todo.pop()
        a, b = p.tree.starts[level][rows], q.tree.starts[level][cols]
        cosines = p.u[a] @ q.u[b].T
        if level == bottom:
            linked = mask & (cosines >= least)
            _settle_close(p, q, a, b, cosines, mask, least, linked)
            still = None
        else:
            far = _far(cosines)
            reach = p.tree.radii[level][rows][:, None] + q.tree.radii[level][cols][None, :]
            linked = mask & (far + reach <= tau - SLACK)
            still = mask & ~linked & (far - reach <= tau + SLACK)
        _record(p, q, level, rows, cols, linked, links, same)
        if still is not None and still.any():
            todo += _opened(p, q, level, rows, cols, still)


def _settle_close(p: Side, q: Side, a, b, cosines, mask, least: float, linked: np.ndarray) -> None:
    """Decide pairs at the threshold by the cosine of the raw vectors."""
    for x, y in np.argwhere(mask & (np.abs(cosines - least) <= CLOSE)):
        v, w = p.raw[a[x]].astype(np.float64), q.raw[b[y]].astype(np.float64)
        size = np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))
        if np.isfinite(size) and size > 0:
            linked[x, y] = np.dot(v, w) / size >= least


def _record(p: Side, q: Side, level: int, rows, cols, linked: np.ndarray, links: Links, same: bool) -> None:
    if not linked.any():
        return
    x, y = np.nonzero(linked)
    begin_p, end_p, weight_p = p.runs(level, rows)
    begin_q, end_q, weight_q = q.runs(level, cols)
    # of each node as much weight as all its partners have
    links.add(p.offset + begin_p, p.offset + end_p, linked @ weight_q)
    if not same:
        links.add(q.offset + begin_q, q.offset + end_q, weight_p @ linked)
    links.unite(p.offset + begin_p[x], q.offset + begin_q[y])
    for side, begin, end, hit in ((p, begin_p, end_p, x), (q, begin_q, end_q, y)):
        # whatever lies below a linked node is in one component with it
        hit = np.unique(hit)
        size = end[hit] - begin[hit]
        if (size > 1).any():
            centre = np.repeat(begin[hit], size)
            member = centre + np.arange(len(centre)) - np.repeat(np.cumsum(size) - size, size)
            links.unite(side.offset + centre, side.offset + member)


def _opened(p: Side, q: Side, level: int, rows, cols, still: np.ndarray):
    """The children of open pairs, in strips of neighbouring rows with the columns that they need."""
    own = still.any(axis=1)
    rows, still = rows[own], still[own]
    sizes = np.searchsorted(p.tree.parents[level + 1], rows, side="right") - np.searchsorted(
        p.tree.parents[level + 1], rows
    )
    strip = (np.cumsum(sizes) - sizes) // STRIP
    for k in np.unique(strip):
        part = strip == k
        needed = still[part].any(axis=0)
        mine, at = p.below(level, rows[part])
        theirs, to = q.below(level, cols[needed])
        open_ = still[part][:, needed]
        # a node with very many children is cut as well
        for begin in range(0, len(mine), STRIP):
            here = slice(begin, begin + STRIP)
            yield level + 1, mine[here], theirs, open_[at[here]][:, to]
