"""Weighted k-centre clustering of one or many groups of points.

Groups given by a column that are small enough for one task are clustered there, all of them in a single pass over the
data. Larger groups, and points without groups whatever their number, are clustered by Spark jobs over the whole
cluster, one pass per centre and iteration. Both ways check weights alike and give the same centres.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.operators import tasks
from mrkit.operators.centers import checked_weight
from mrkit.operators.lloyd import lloyd_iterations
from mrkit.operators.seeding import BROADCAST_ROWS, PICK_ROWS, group_extents, weighted_seeding
from mrkit.session import checkpoint

# Coordinates of a group that one task may hold, and values of centres that the driver may hold.
TASK_VALUES = 8 << 20
DRIVER_VALUES = 2 << 20

# Coordinates that one shuffle partition should hold when groups are brought together.
SHUFFLE_VALUES = 64 << 20


def check_parameters(k: int, iters: int, draws: Sequence[float] | None = None) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    if iters < 0:
        raise ValueError(f"the number of iterations must not be negative: {iters}")
    if draws is not None and (len(draws) != k or not all(0 <= u < 1 for u in draws)):
        raise ValueError("there must be k draws, each in [0, 1)")


def weighted_kcenters(
    points: DataFrame,
    k: int,
    iters: int,
    by: str | None = None,
    seed: int = 0,
    draws: Sequence[float] | None = None,
    task_values: int = TASK_VALUES,
    pick_rows: int = PICK_ROWS,
) -> DataFrame:
    """``(cid, c, w)``: ``k`` centres of ``points(id, v[, w])`` and the weight of the points nearest to each.

    Seeding as in ``weighted_seeding``, then exactly ``iters`` Lloyd steps: every centre moves to the weighted mean of
    its points, or stays if it has none. Ids must be unique. With ``by``, an integer column, every group is clustered
    by itself and the result carries that column. ``draws`` fixes the ``k`` random numbers of every group; without it
    they follow from ``seed`` and the group. Fewer distinct points than ``k`` give fewer centres. Weights that are
    NULL, NaN, infinite or negative fail.
    """
    check_parameters(k, iters, draws)
    weight = checked_weight("w") if "w" in points.columns else F.lit(1.0)
    group = (F.col(by) if by else F.lit(0)).cast("int")
    points = points.select(group.alias("g"), "id", "v", weight.alias("w"))
    dims = dimensions(points)
    if by is None:
        result = _cluster_in_jobs(points, group_extents(points), k, iters, seed, draws, dims, pick_rows)
        return result.drop("g")
    extents = points.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    limit = max(1, task_values // dims)
    groups, rows, largest = extents.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if largest <= limit:
        result = cluster_in_tasks(points, k, iters, seed, draws, groups, rows, dims)
    else:
        large = {row.g: (row.n, row.lo, row.hi) for row in extents.where(F.col("n") > limit).collect()}
        result = _cluster_in_jobs(points, large, k, iters, seed, draws, dims, pick_rows)
        if sum(n for n, *_ in large.values()) < rows:
            names = points.sparkSession.createDataFrame([(g,) for g in large], "g int")
            names = F.broadcast(names) if len(large) <= BROADCAST_ROWS else names
            small = points.join(names, "g", "left_anti")
            result = result.unionByName(cluster_in_tasks(small, k, iters, seed, draws, groups, rows, dims))
    return result.withColumnRenamed("g", by)


def dimensions(points: DataFrame) -> int:
    """Coordinates of the first vector; whoever reads the others checks that they have as many."""
    row = points.select(F.size("v").alias("dims")).first()
    if row is None:
        raise ValueError("there are no points")
    if not row.dims or row.dims < 1:
        raise ValueError("vectors must not be NULL or empty")
    return row.dims


def cluster_in_tasks(
    points: DataFrame,
    k: int,
    iters: int,
    seed: int,
    draws: Sequence[float] | None,
    groups: int,
    rows: int,
    dims: int,
) -> DataFrame:
    """``(g, cid, c, w)`` of ``points(g, id, v, w)``, whose groups each fit into one task.

    The number of groups and rows, or bounds of these, say how far to spread the groups.
    """

    def cluster(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = tasks.coordinates(table["v"], dims)
        g = key[0].as_py()
        centers, w = tasks.cluster_group(x, table["w"].to_numpy(), iters, draws or tasks.group_draws(seed, g, k))
        return pa.table(
            {
                "g": pa.array([g] * len(w), pa.int32()),
                "cid": pa.array(range(len(w)), pa.int32()),
                "c": pa.array(list(centers), pa.list_(pa.float64())),
                "w": pa.array(w),
            }
        )

    # A given number of partitions, as adaptive execution would merge them by size although each is a lot of work.
    cores = points.sparkSession.sparkContext.defaultParallelism
    points = points.repartition(min(groups, max(4 * cores, rows * dims // SHUFFLE_VALUES)), "g")
    return points.groupBy("g").applyInArrow(cluster, "g int, cid int, c array<double>, w double")


def _cluster_in_jobs(
    points: DataFrame,
    large: dict[int, tuple[int, int, int]],
    k: int,
    iters: int,
    seed: int,
    draws: Sequence[float] | None,
    dims: int,
    pick_rows: int,
) -> DataFrame:
    """``(g, cid, c, w)`` of the ``large`` groups, as many at once as the driver can hold centres of."""
    if k * dims > DRIVER_VALUES:
        raise ValueError(f"{k} centres of {dims} coordinates are more than the {DRIVER_VALUES} values that a driver may hold")
    names, at_once = sorted(large), DRIVER_VALUES // (k * dims)
    results = []
    for start in range(0, len(names), at_once):
        extents = {g: large[g] for g in names[start : start + at_once]}
        group_draws = {g: draws or tasks.group_draws(seed, g, k) for g in extents}
        chunk = points.where(F.col("g").isin(list(extents))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            seeds = weighted_seeding(chunk, group_draws, "g", extents, pick_rows)
            found = lloyd_iterations(chunk, seeds, iters, chunk._jdf.queryExecution().toRdd().getNumPartitions())
        finally:
            chunk.unpersist()
        result = found.centers.to_dataframe(points.sparkSession, found.weights)
        results.append(checkpoint(result) if len(names) > at_once else result)
    return reduce(DataFrame.unionByName, results)
