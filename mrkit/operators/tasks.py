"""NumPy code that runs inside tasks, on Arrow batches and on groups of bounded size.

Squared differences are added in coordinate order, so distances equal those of ``mrkit.functions.euclidean`` to the
last bit and ties between centres come out the same.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Ship these functions with the query, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# By how much bounds are widened, relatively; distances are rounded by some 1e-14.
SLACK = 1 + 1e-9


def coordinates(v: pa.Array, dims: int) -> np.ndarray:
    """A list array as a ``(dims, n)`` matrix of doubles."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    if v.null_count or pc.any(pc.not_equal(pc.list_value_length(v), dims)).as_py():
        raise ValueError(f"every vector must have {dims} coordinates")
    values = v.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold NULL")
    x = np.ascontiguousarray(values.to_numpy().reshape(len(v), dims).T, dtype=np.float64)
    if np.isnan(x).any():
        raise ValueError("vectors must not hold NaN")
    return x


def distance(x: np.ndarray, center) -> np.ndarray:
    """Distances of the columns of ``x`` to one centre, or to one centre per column."""
    total = np.zeros(x.shape[1])
    for row, c in zip(x, center):
        difference = row - c
        total += difference * difference
    return np.sqrt(total)


def nearest(x: np.ndarray, centers) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest centre; the lowest index wins ties."""
    index, best = np.zeros(x.shape[1], dtype=np.int64), np.full(x.shape[1], np.inf)
    for i, center in enumerate(centers):
        d = distance(x, center)
        closer = d < best
        index[closer], best[closer] = i, d[closer]
    return index, best


class BallIndex:
    """Centres in balls, so that a point is only compared with those of balls that can hold its nearest centre.

    Some centres are pivots, and every centre is in the ball of its nearest pivot. A ball is out for a point if its
    surface is farther away than the best centre so far; rounding is far below the slack. What is found, and which of
    equals, is what ``nearest`` finds.
    """

    def __init__(self, centers: np.ndarray):
        n_balls = max(1, int(len(centers) ** 0.5))
        pivots = centers[np.linspace(0, len(centers) - 1, n_balls).astype(int)]
        ball, d = nearest(np.ascontiguousarray(centers.T), pivots)
        used, ball = np.unique(ball, return_inverse=True)
        self.members = np.argsort(ball, kind="stable")
        self.bounds = np.searchsorted(ball[self.members], np.arange(len(used) + 1))
        self.centers, self.pivots = centers[self.members], pivots[used]
        self.radii = np.maximum.reduceat(d[self.members], self.bounds[:-1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """As the function ``nearest``, and how many distances that took."""
        n = x.shape[1]
        to_pivots = np.array([distance(x, pivot) for pivot in self.pivots])
        index, best = np.full(n, np.iinfo(np.int64).max), np.full(n, np.inf)
        first, computed = to_pivots.argmin(axis=0), to_pivots.size
        for b in np.unique(first):
            computed += self._look_into(b, np.flatnonzero(first == b), x, index, best)
        for b, (away, radius) in enumerate(zip(to_pivots, self.radii)):
            near = away - radius * SLACK <= best * SLACK
            computed += self._look_into(b, np.flatnonzero(near & (first != b)), x, index, best)
        return index, best, computed

    def _look_into(self, ball: int, rows: np.ndarray, x: np.ndarray, index: np.ndarray, best: np.ndarray) -> int:
        if not len(rows):
            return 0
        inside, own, d = x[:, rows], index[rows], best[rows]
        for place in range(self.bounds[ball], self.bounds[ball + 1]):
            found, member = distance(inside, self.centers[place]), self.members[place]
            closer = (found < d) | (found == d) & (member < own)
            own[closer], d[closer] = member, found[closer]
        index[rows], best[rows] = own, d
        return len(rows) * int(self.bounds[ball + 1] - self.bounds[ball])


class AdaptiveSearch:
    """Nearest centres by an index while it saves enough distances, and by a scan once it does not.

    Both find the same. Balls save next to nothing where distances are much alike, as among many coordinates without
    clusters, and then cost more than they save.
    """

    SAVING = 0.4

    def __init__(self, centers: np.ndarray, balls: BallIndex | None):
        self.centers, self.balls = centers, balls

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.balls is None:
            return nearest(x, self.centers)
        index, best, computed = self.balls.nearest(x)
        if computed > self.SAVING * x.shape[1] * len(self.centers):
            self.balls = None
        return index, best


def nearest_of_own(x: np.ndarray, coords: np.ndarray, first: np.ndarray, count: np.ndarray):
    """As ``nearest``, where column ``i`` of ``x`` may only choose from ``count[i]`` columns of ``coords`` on from
    ``first[i]``. Columns without a choice get an infinite distance."""
    index, best = first.copy(), np.full(x.shape[1], np.inf)
    for rows, candidates, d in _each_own(x, coords, first, count):
        closer = d < best[rows]
        index[rows] = np.where(closer, candidates, index[rows])
        best[rows] = np.where(closer, d, best[rows])
    return index, best


def _each_own(x: np.ndarray, coords: np.ndarray, first: np.ndarray, count: np.ndarray):
    """One candidate after the other: the columns that have it, which it is, and the distances."""
    one_group = len(first) > 0 and first.min() == first.max() and count.min() == count.max()
    for i in range(count.max(initial=0)):
        if one_group:
            # A single centre is not copied for every point.
            yield slice(None), first + i, distance(x, coords[:, first[0] + i])
        else:
            rows = np.flatnonzero(count > i)
            yield rows, first[rows] + i, distance(x if len(rows) == x.shape[1] else x[:, rows], coords[:, first[rows] + i])


def two_nearest_of_own(x: np.ndarray, coords: np.ndarray, first: np.ndarray, count: np.ndarray):
    """As ``nearest_of_own``, and the distance to the second nearest as well."""
    index, best, second = first.copy(), np.full(x.shape[1], np.inf), np.full(x.shape[1], np.inf)
    for rows, candidates, d in _each_own(x, coords, first, count):
        closer = d < best[rows]
        second[rows] = np.where(closer, best[rows], np.minimum(second[rows], d))
        index[rows] = np.where(closer, candidates, index[rows])
        best[rows] = np.where(closer, d, best[rows])
    return index, best, second


def longest_of_others(way: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For every centre the longest way that another one of its group went."""
    longest = np.zeros(len(way))
    for begin, n in zip(first.tolist(), count.tolist()):
        if n > 1:
            own = way[begin : begin + n]
            top = np.argsort(own, kind="stable")[-2:]
            longest[begin : begin + n] = own[top[1]]
            longest[begin + top[1]] = own[top[0]]
    return longest


def tighten(x, own, upper, lower, coords, first, count, way, others) -> np.ndarray:
    """Brings centre and bounds of every point up to date after the centres went their ways; all are changed in place.

    Gives the number of distances that were computed for each point: none if the bounds stay apart, one if the exact
    distance to the own centre keeps them apart, and all otherwise. Slack makes up for rounding.
    """
    upper[:] = (upper + way[own]) * SLACK
    lower[:] = lower - others[own] * SLACK
    computed = np.zeros(len(own), dtype=np.int64)
    rows = np.flatnonzero(~(upper * SLACK < lower))
    upper[rows] = distance(x[:, rows], coords[:, own[rows]])
    computed[rows] = 1
    rows = rows[~(upper[rows] * SLACK < lower[rows])]
    own[rows], upper[rows], lower[rows] = two_nearest_of_own(x[:, rows], coords, first[rows], count[rows])
    computed[rows] += count[rows]
    return computed


def improve(x: np.ndarray, group: np.ndarray, own: np.ndarray, d: np.ndarray, coords: np.ndarray, rounds: list) -> int:
    """Takes new centres in: ``own`` and ``d``, index of and distance to the nearest centre, are changed in place.

    Each round has, per group, the column of ``coords`` that is new (-1 if there is none), and the distance of every
    centre to the new one of its group. A new centre that is at least twice as far from a point's own centre as the
    point is cannot be nearer; its distance is not computed. Rounding is far below the slack. Gives the number of
    distances that were.
    """
    computed = 0
    for new, gaps in rounds:
        near = (own < 0) | (gaps[own] < 2 * SLACK * d)
        rows = np.flatnonzero(near & (new[group] >= 0))
        computed += len(rows)
        candidates = new[group[rows]]
        same = len(rows) and len(new) == 1
        found = distance(x if len(rows) == len(d) else x[:, rows], coords[:, candidates[0]] if same else coords[:, candidates])
        closer = found < d[rows]
        own[rows[closer]], d[rows[closer]] = candidates[closer], found[closer]
    return computed


def add_to(sums: np.ndarray, weights: np.ndarray, x: np.ndarray, w: np.ndarray, index: np.ndarray) -> None:
    """Adds weights and weighted coordinates of the columns of ``x`` to the rows of ``sums`` that ``index`` names."""
    weights += np.bincount(index, w, len(sums))
    for d, row in enumerate(x):
        sums[:, d] += np.bincount(index, w * row, len(sums))


def pick(mass: np.ndarray, u: float) -> int | None:
    """First index with mass at which the running share of the total reaches ``u``; None without mass."""
    running, candidates = np.cumsum(mass), np.flatnonzero(mass > 0)
    if not len(candidates):
        return None
    reached = candidates[running[candidates] >= u * running[-1]]
    return int(reached[0] if len(reached) else candidates[-1])


def group_draws(seed: int, group: int, k: int) -> list[float]:
    """The ``k`` random numbers of a group; the same on the driver and in any task."""
    return np.random.default_rng([seed % 2**64, group % 2**64]).random(k).tolist()


def cluster_group(x: np.ndarray, w: np.ndarray, iters: int, draws) -> tuple[np.ndarray, np.ndarray]:
    """Centres and their weights for one group, with points in id order and one draw per centre."""
    centers, index, best = [], np.zeros(len(w), dtype=np.int64), None
    for u in draws:
        chosen = pick(np.ones(len(w)) if best is None else w * best, u)
        if chosen is None:
            break
        centers.append(x[:, chosen])
        d = distance(x, centers[-1])
        if best is None:
            best = d
        closer = d < best
        index[closer], best[closer] = len(centers) - 1, d[closer]
    for _ in range(iters):
        for i in range(len(centers)):
            members = index == i
            weight = w[members].sum()
            if weight > 0:
                centers[i] = (x[:, members] * w[members]).sum(axis=1) / weight
        index, _ = nearest(x, centers)
    return np.array(centers), np.bincount(index, weights=w, minlength=len(centers))
