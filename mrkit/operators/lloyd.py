"""Lloyd iterations by jobs over the whole cluster: one pass over the points per iteration.

Each point may carry its centre, an upper bound of the distance to it and a lower bound of the distance to any other one.
When centres move, the upper bound grows by the way of the own centre and the lower bound shrinks by the longest way of
another one. As long as they do not meet, the point keeps its centre and no distance is computed. Centres come out the same
to the last bit either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.operators import tasks
from mrkit.operators.centers import PARTIAL_SUMS, Centers, total_sums
from mrkit.operators.reduce import FAN_IN

BOUNDS = "struct<c: long, upper: double, lower: double, computed: long>"


class Clustered(NamedTuple):
    """The centres after the last step, the weight of the points nearest to each, and the distances that each pass took."""

    centers: Centers
    weights: dict[tuple[int, int], float]
    computed: list[int]


def lloyd_iterations(
    points: DataFrame, centers: Centers, iters: int, n_tasks: int, bounds: bool = False, fan_in: int = FAN_IN
) -> Clustered:
    """``iters`` steps from ``centers`` over ``points(g, v, w)``, which are read in ``n_tasks`` tasks.

    Every group of the points must be one of the centres'. With ``bounds`` the points are cached once more, with what is
    known of each. That pays where distances cost more than reading the points, so with very many centres, and where clusters
    are well apart.
    """
    run = _with_bounds if bounds else _plain
    return run(points, centers, iters, n_tasks, fan_in)


def _plain(points: DataFrame, centers: Centers, iters: int, n_tasks: int, fan_in: int) -> Clustered:
    for _ in range(iters):
        centers = centers.moved(centers.sums(points, fan_in, n_tasks).collect())
    weights = centers.sums(points, fan_in, n_tasks, coordinates=False).collect()
    return Clustered(centers, {(row.g, row.cid): row.w for row in weights}, [])


def _with_bounds(points: DataFrame, centers: Centers, iters: int, n_tasks: int, fan_in: int) -> Clustered:
    computed, before = [], None
    state = points.select("g", "v", "w", F.lit(None).cast(BOUNDS).alias("near"))
    cached: list[DataFrame] = []
    try:
        for i in range(iters + 1):
            state = state.withColumn("near", _bounded(centers, before)("g", "v", "near"))
            cached.append(state.persist(StorageLevel.MEMORY_AND_DISK))
            # The job that adds up also fills the cache, from the one before.
            partials = state.mapInArrow(_adder(centers, i < iters), f"{PARTIAL_SUMS}, computed long")
            rows = total_sums(partials, n_tasks, fan_in).collect()
            for old in cached[:-1]:
                old.unpersist()
            del cached[:-1]
            computed.append(sum(row.computed for row in rows))
            if i < iters:
                before, centers = centers, centers.moved(rows)
    finally:
        for left in cached:
            left.unpersist()
    return Clustered(centers, {(row.g, row.cid): row.w for row in rows}, computed)


def _bounded(centers: Centers, before: Centers | None):
    """A function of group, vector and ``BOUNDS`` so far that gives them for these centres, which ``before`` were others."""
    names, first, count, _, coords = centers
    dims, columns = coords.shape[1], coords.T.copy()
    way = None if before is None else tasks.distance(coords.T, before.coords.T)
    others = None if before is None else tasks.longest_of_others(way, first, count)

    @F.arrow_udf(BOUNDS)
    def bounded(group: pa.Array, v: pa.Array, near: pa.Array) -> pa.Array:
        x = tasks.coordinates(v, dims)
        g = np.searchsorted(names, group.to_numpy(zero_copy_only=False))
        if before is None:
            own, upper, lower = tasks.two_nearest_of_own(x, columns, first[g], count[g])
            computed = count[g]
        else:
            c, upper, lower = (near.field(name).to_numpy(zero_copy_only=False).copy() for name in ("c", "upper", "lower"))
            own = c + first[g]
            computed = tasks.tighten(x, own, upper, lower, columns, first[g], count[g], way, others)
        return pa.StructArray.from_arrays(
            [pa.array(own - first[g]), pa.array(upper), pa.array(lower), pa.array(computed)], ["c", "upper", "lower", "computed"]
        )

    return bounded


def _adder(centers: Centers, coordinates: bool):
    """Adds up what a task reads, per centre; the first row has the distances that were computed for these points."""
    names, first, _, _, coords = centers
    dims = coords.shape[1] if coordinates else 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights, computed = np.zeros((len(coords), dims)), np.zeros(len(coords)), 0
        for batch in batches:
            near = batch.column("near")
            w, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "g"))
            index = near.field("c").to_numpy(zero_copy_only=False) + first[np.searchsorted(names, group)]
            x = tasks.coordinates(batch.column("v"), coords.shape[1]) if coordinates else np.zeros((0, len(w)))
            tasks.add_to(sums, weights, x, w, index)
            computed += int(near.field("computed").to_numpy(zero_copy_only=False).sum())
        partial = centers.partial_sums(sums, weights)
        first_row = np.arange(partial.num_rows) == 0
        yield partial.append_column("computed", pa.array(np.where(first_row, computed, 0)))

    return add
