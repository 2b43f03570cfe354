"""Anchors-hierarchy metric trees over points of whole numbers, and nearest entries found with them.

About sqrt(n) anchors are drawn, each new one the point farthest from its anchor; it takes the points
nearer to it, and the triangle inequality tells which need no look. Every anchor's points become a
tree of their own in the same way, and the anchors' trees are merged pairwise, the pair with the
smallest ball first. A ball keeps the sum and number of its points. A search hands each ball the
entries that its parent could not rule out; a ball with one entry left is owned as a whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LEAF = 48
#: Safety margin of distances in double precision, relative to the lengths compared.
SLACK = 1e-9


class Tree(NamedTuple):
    """Balls by number, the root last. `order` lists points so that a ball holds order[start:stop]."""

    order: np.ndarray
    left: np.ndarray
    right: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    sums: np.ndarray
    radius: np.ndarray


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """The points of each anchor, as positions; one group if all points are equal."""
    n = len(points)
    chosen = [0]
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    owner = np.zeros(n, np.int64)
    for _ in range(int(np.ceil(np.sqrt(n))) - 1):
        new = int(far.argmax())
        if far[new] <= 0:
            break
        apart = np.sqrt(((points[chosen] - points[new]) ** 2).sum(axis=1))
        look = np.flatnonzero(far > apart[owner] / 2)
        distance = np.sqrt(((points[look] - points[new]) ** 2).sum(axis=1))
        taken = distance < far[look]
        owner[look[taken]] = len(chosen)
        far[look[taken]] = distance[taken]
        chosen.append(new)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Tree over the rows of `points` (float64 holding whole numbers), of which there is at least one."""
    left, right, members = [], [], []

    def ball(a: int, b: int, rows: np.ndarray | None) -> int:
        left.append(a), right.append(b), members.append(rows)
        return len(left) - 1

    def merge(balls: list[int], centers: np.ndarray, sizes: np.ndarray, radii: np.ndarray) -> int:
        balls = np.array(balls)
        alive = len(balls)
        gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))

        def joint(i: int | np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
            share = sizes[j] / (sizes[i] + sizes[j])
            return np.maximum(apart * share + radii[i], apart * (1 - share) + radii[j])

        every = np.arange(alive)
        cost = joint(every[:, None], every[None, :], gap)
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(balls) - 1):
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            radii[i] = cost[i, j]
            centers[i] = (centers[i] * sizes[i] + centers[j] * sizes[j]) / (sizes[i] + sizes[j])
            sizes[i] += sizes[j]
            balls[i] = ball(int(balls[i]), int(balls[j]), None)
            cost[j], cost[:, j] = np.inf, np.inf
            others = np.flatnonzero(np.isfinite(cost).any(axis=1))
            others = others[others != i]
            if not len(others):
                return int(balls[i])
            apart = np.sqrt(((centers[others] - centers[i]) ** 2).sum(axis=1))
            cost[i, others] = cost[others, i] = joint(np.full(len(others), i), others, apart)
        return int(balls[0])

    def grow(rows: np.ndarray) -> int:
        """Groups shrink to about the square root from call to call, or in the worst case by one anchor's points."""
        groups = anchors(points[rows]) if len(rows) > leaf else []
        if len(groups) < 2:
            return ball(-1, -1, rows)
        most = max(len(g) for g in groups)
        balls = [ball(-1, -1, rows[g]) if len(g) == most and most > 0.9 * len(rows) else grow(rows[g]) for g in groups]
        centers = np.array([points[rows[g]].mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(((points[rows[g]] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centers)])
        return merge(balls, centers, np.array([float(len(g)) for g in groups]), radii)

    root = grow(np.arange(len(points)))
    count = len(left)
    start, stop, order = np.zeros(count, np.int32), np.zeros(count, np.int32), []
    at, open_balls = 0, [(root, False)]
    while open_balls:
        b, seen = open_balls.pop()
        if seen:
            stop[b] = at
            continue
        start[b] = at
        if left[b] < 0:
            order.append(members[b])
            at += len(members[b])
            stop[b] = at
        else:
            open_balls += [(b, True), (right[b], False), (left[b], False)]
    order = np.concatenate(order)
    placed = points[order]
    before = np.concatenate((np.zeros((1, points.shape[1])), np.cumsum(placed, axis=0)))
    sums = before[stop] - before[start]
    radius = np.empty(count)
    for b in range(count):
        part = placed[start[b] : stop[b]]
        radius[b] = np.sqrt(((part - sums[b] / len(part)) ** 2).sum(axis=1).max())
    return Tree(order.astype(np.int32), np.array(left, np.int32), np.array(right, np.int32), start, stop, sums, radius)


def nearest_exact(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each point, ties to the lower entry.

    Exact for whole numbers in float64 as long as squared lengths stay below 2^51, and for Python integers.
    """
    if points.dtype == object:
        best, least = np.zeros(len(points), np.int64), np.zeros(len(points), object)
        for i, p in enumerate(points):
            d = ((entries - p) ** 2).sum(axis=1)
            best[i] = min(range(len(d)), key=d.__getitem__)
            least[i] = d[best[i]]
        return best, least
    d = (points**2).sum(axis=1)[:, None] - 2 * (points @ entries.T) + (entries**2).sum(axis=1)[None, :]
    if allowed is not None:
        d[~allowed] = np.inf
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


class Owned(NamedTuple):
    """Balls owned by one entry each, and points looked at one by one (positions in `order`)."""

    balls: np.ndarray
    ball_entries: np.ndarray
    places: np.ndarray
    place_entries: np.ndarray


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Owned:
    """Give every point its nearest entry, ties to the lower number; `points` in the tree's order."""
    _, first = np.unique(entries, axis=0, return_index=True)
    possible = np.zeros(len(entries), bool)
    possible[first] = True  # of equal entries only the first can win
    apart = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(axis=2))
    balls = np.array([len(tree.left) - 1])
    lists = possible[None, :]
    done, done_entries, open_balls, open_lists = [], [], [], []
    while len(balls):
        centers = tree.sums[balls] / (tree.stop[balls] - tree.start[balls])[:, None]
        square = (centers**2).sum(axis=1)[:, None] - 2 * (centers @ entries.T) + (entries**2).sum(axis=1)[None, :]
        scale = np.abs(square).max(axis=1, initial=1.0) + (centers**2).sum(axis=1)
        square[~lists] = np.inf
        best = square.argmin(axis=1)
        least = square[np.arange(len(balls)), best]
        # an entry is out if the plane halfway to the best one leaves the whole ball on the best one's side
        width = 2 * apart[best] * tree.radius[balls][:, None]
        lists = lists & ((square - least[:, None] <= width * (1 + SLACK) + SLACK * scale[:, None]))
        alone = lists.sum(axis=1) == 1
        done.append(balls[alone]), done_entries.append(best[alone])
        balls, lists = balls[~alone], lists[~alone]
        leaf = tree.left[balls] < 0
        open_balls.append(balls[leaf]), open_lists.append(lists[leaf])
        balls, lists = balls[~leaf], lists[~leaf]
        balls = np.concatenate((tree.left[balls], tree.right[balls]))
        lists = np.concatenate((lists, lists))
    leaves, allowed = np.concatenate(open_balls), np.concatenate(open_lists)
    sizes = tree.stop[leaves] - tree.start[leaves]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.repeat(tree.start[leaves], sizes) + inside
    found = nearest_exact(points[places], entries, np.repeat(allowed, sizes, axis=0))[0] if len(places) else np.zeros(0, np.int64)
    return Owned(np.concatenate(done), np.concatenate(done_entries), places, found)


def totals(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to each entry."""
    owned = assign(tree, points, entries)
    sums, counts = np.zeros(entries.shape), np.zeros(len(entries))
    np.add.at(sums, owned.ball_entries, tree.sums[owned.balls])
    np.add.at(counts, owned.ball_entries, tree.stop[owned.balls] - tree.start[owned.balls])
    np.add.at(sums, owned.place_entries, points[owned.places])
    np.add.at(counts, owned.place_entries, 1)
    return sums, counts


def nearest(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of each point, in the order the tree was built from."""
    owned = assign(tree, points, entries)
    placed = np.zeros(len(points), np.int64)
    placed[owned.places] = owned.place_entries
    for a, b, entry in zip(tree.start[owned.balls], tree.stop[owned.balls], owned.ball_entries):
        placed[a:b] = entry
    out = np.empty(len(points), np.int64)
    out[tree.order] = placed
    return out
