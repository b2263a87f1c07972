"""Three-round k-median: cluster the parts, cluster their weighted centres, measure the result."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mrkit.operators import tasks
from mrkit.operators.centers import checked_weight, kmedian_objective
from mrkit.operators.reduce import tasks_of
from mrkit.plans.clustering import (
    DRIVER_VALUES,
    TASK_VALUES,
    check_parameters,
    cluster_in_tasks,
    dimensions,
    weighted_kcenters,
)
from mrkit.session import Generations, checkpoint

# Parts whose centres are united to one part of the next level.
FAN_IN = 256


class KMedian(NamedTuple):
    """``centers`` is ``(cid, c, w)``, ``objective`` one row ``(n_points, objective)``."""

    centers: DataFrame
    objective: DataFrame


def with_part(points: DataFrame, parts: int) -> DataFrame:
    """Adds ``part`` in ``[0, parts)``. It follows from the id alone, however the points are partitioned."""
    if parts < 1:
        raise ValueError(f"the number of parts must be at least 1, not {parts}")
    return points.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def partition_coreset(
    points: DataFrame,
    k: int,
    iters: int,
    seed: int = 0,
    draws: Sequence[float] | None = None,
    task_values: int = TASK_VALUES,
) -> DataFrame:
    """``(part, cid, v, w)``: up to ``k`` centres of every part of ``points(part, id, v[, w])`` and their weights.

    The weights of a part sum up to the weight of its points, so a coreset can stand for the points and may be reduced
    again.
    """
    centers = weighted_kcenters(points, k, iters, "part", seed, draws, task_values)
    return centers.withColumnRenamed("c", "v")


def scan_coreset(
    points: DataFrame,
    k: int,
    iters: int,
    seed: int = 0,
    draws: Sequence[float] | None = None,
    block_values: int = TASK_VALUES,
) -> DataFrame:
    """``(part, cid, v, w)``: up to ``k`` weighted centres of what each task reads of ``points(id, v[, w])``.

    The points are not moved. A task clusters blocks of at most ``block_values`` coordinates as it reads them; two
    coresets of equally many blocks become one of the next level, so it holds one block and a few coresets, however much
    it reads. ``part`` is the number of the task. As for any coreset, the weights add up to those of the points. What
    comes out depends on how the points lie in the files, and is the same again for the same files and split size.
    """
    check_parameters(k, iters, draws)
    weight = checked_weight("w") if "w" in points.columns else F.lit(1.0)
    dims = dimensions(points)
    block = max(k, block_values // dims)

    def reduced(x: np.ndarray, w: np.ndarray, turn: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        centers, weights = tasks.cluster_group(x, w, iters, draws or tasks.group_draws(seed, (part << 32) + turn, k))
        return (centers.T if len(weights) else np.zeros((dims, 0))), weights

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held, size, levels = TaskContext.get().partitionId(), 0, [], 0, []

        def put(coreset: tuple[np.ndarray, np.ndarray], level: int) -> None:
            """Adds a coreset as in a binary number: equal levels are merged and go up."""
            nonlocal turn
            while levels and levels[-1][0] == level:
                _, other = levels.pop()
                turn += 1
                coreset = reduced(*(np.concatenate(both, axis=-1) for both in zip(other, coreset)), turn, part)
                level += 1
            levels.append((level, coreset))

        def close(rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
            nonlocal turn
            turn += 1
            put(reduced(*(np.concatenate(some, axis=-1) for some in zip(*rows)), turn, part), 0)

        for batch in batches:
            x, w = tasks.coordinates(batch.column("v"), dims), batch.column("w").to_numpy(zero_copy_only=False)
            while len(w):
                take = min(block - size, len(w))
                held.append((x[:, :take], w[:take]))
                x, w, size = x[:, take:], w[take:], size + take
                if size == block:
                    close(held)
                    held, size = [], 0
        if held:
            close(held)
        if levels:
            turn += 1
            x, w = (np.concatenate(some, axis=-1) for some in zip(*(coreset for _, coreset in levels)))
            x, w = reduced(x, w, turn, part) if len(levels) > 1 else (x, w)
            centers = pa.array(list(x.T), pa.list_(pa.float64()))
            columns = [pa.array(np.full(len(w), part, dtype=np.int32)), pa.array(np.arange(len(w), dtype=np.int32)), centers, pa.array(w)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "cid", "v", "w"])

    return points.select("v", weight.alias("w")).mapInArrow(read, "part int, cid int, v array<double>, w double")


def mr_kmedian(
    points: DataFrame,
    k: int,
    parts: int | None,
    iters: int,
    seed: int = 0,
    draws: Sequence[float] | None = None,
    part: Column | None = None,
    task_values: int = TASK_VALUES,
    fan_in: int = FAN_IN,
    shuffle: bool = True,
) -> KMedian:
    """``k`` centres of ``points(id, v)`` and the mean distance of the points to the nearest of them.

    Points fall into ``parts`` parts by a hash of the id, or as the expression ``part`` with values in ``[0, parts)``
    says. With ``parts=None`` there are as many as it takes to cluster each part in one task; fewer and larger parts
    cost more passes over the points, more parts a larger coreset. More than ``fan_in`` parts are reduced in a tree:
    the centres of ``fan_in`` parts, with their weights, become one part of the next level. That holds for any size.
    Without ``shuffle`` the points stay where they are and what a task reads is a part, see ``scan_coreset``.
    """
    check_parameters(k, iters, draws)
    if fan_in < 2:
        raise ValueError(f"fan_in must be at least 2, not {fan_in}")
    dims = dimensions(points)
    if not shuffle:
        if parts is not None or part is not None:
            raise ValueError("without a shuffle the tasks are the parts")
        coreset = scan_coreset(points.select("id", "v"), k, iters, seed, draws, task_values)
        return _solved(points, coreset, tasks_of(points), k, iters, seed, draws, dims, task_values, fan_in)
    if parts is None:
        # Hashing spreads ids evenly; half full on average leaves no part too large.
        parts = math.ceil(2 * points.count() * dims / task_values)
    if part is None:
        parted = with_part(points.select("id", "v"), parts)
    else:
        outside = F.raise_error(F.lit(f"a part is not in [0, {parts})")).cast("int")
        part = F.when(part.between(0, parts - 1), part.cast("int")).otherwise(outside)
        parted = points.select("id", "v", part.alias("part"))
    coreset = partition_coreset(parted, k, iters, seed, draws, task_values)
    return _solved(points, coreset, parts, k, iters, seed, draws, dims, task_values, fan_in)


def _solved(points, coreset, parts, k, iters, seed, draws, dims, task_values, fan_in) -> KMedian:
    """The centres of a coreset of at most so many parts, and the objective."""
    with Generations(points.sparkSession) as levels:
        coreset, parts = _reduced(coreset, parts, k, iters, seed, draws, task_values, fan_in, levels)
        reduced = _as_points(coreset, k).select(F.lit(0).alias("g"), "id", "v", "w")
        if parts * k * dims <= task_values:
            centers = cluster_in_tasks(reduced, k, iters, seed + 1, draws, 1, parts * k, dims).drop("g")
        else:
            centers = weighted_kcenters(levels.keep(reduced), k, iters, None, seed + 1, draws, task_values)
        held = k * dims <= DRIVER_VALUES
        centers = points.sparkSession.createDataFrame(centers.toArrow()) if held else checkpoint(centers)
    return KMedian(centers, kmedian_objective(points, centers))


def _as_points(coreset: DataFrame, k: int) -> DataFrame:
    return coreset.withColumn("id", F.col("part").cast("long") * k + F.col("cid")).select("part", "id", "v", "w")


def _reduced(coreset, parts, k, iters, seed, draws, task_values, fan_in, levels) -> tuple[DataFrame, int]:
    """The coreset of at most ``fan_in`` parts and their number; each level replaces the files of the one before."""
    level = 1
    while parts > fan_in:
        part = F.floor(F.col("part") / fan_in).cast("int")
        united = levels.keep(_as_points(coreset, k).withColumn("part", part))
        parts, level = -(-parts // fan_in), level + 1
        coreset = partition_coreset(united, k, iters, seed + level, draws, task_values)
    return coreset, parts
