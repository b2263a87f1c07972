"""Nearest-centre assignment and what follows from it.

Points are ``(id, v[, w])``, centres ``(cid, c)``. With ``by`` both carry that column too, and a point only meets the
centres of its own group. Distances are plain Euclidean, not squared; of equally near centres the lowest ``cid`` wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mrkit.operators import tasks
from mrkit.operators.reduce import FAN_IN, TASK, merge_partials, tasks_of, with_task
from mrkit.session import Generations, checkpoint

# Centres shipped to the executors at once. More are taken block by block.
CENTER_BYTES = 16 << 20
BLOCKS_AT_ONCE = 4

# Centres without groups from which on an index of them is shipped as well.
BALLS_FROM = 1024


class Centers(NamedTuple):
    """A bounded set of centres on its way to the executors.

    Group ``groups[g]`` owns the ``count[g]`` centres on from ``first[g]`` in ``cids`` and ``coords``, in order of cid.
    """

    groups: np.ndarray
    first: np.ndarray
    count: np.ndarray
    cids: np.ndarray
    coords: np.ndarray

    @classmethod
    def build(cls, groups: dict[int, dict[int, np.ndarray]]) -> Centers:
        """From ``{group: {cid: coordinates}}``."""
        rows = [(g, cid, groups[g][cid]) for g in sorted(groups) for cid in sorted(groups[g])]
        if not rows:
            raise ValueError("there are no centres")
        dims = {len(c) for _, _, c in rows}
        if len(dims) > 1:
            raise ValueError(f"centres have different dimensions: {sorted(dims)}")
        coords = np.array([c for _, _, c in rows], dtype=np.float64)
        if np.isnan(coords).any():
            raise ValueError("centres must not hold NaN")
        names, first, count = np.unique([g for g, _, _ in rows], return_index=True, return_counts=True)
        return cls(names, first, count, np.array([cid for _, cid, _ in rows], dtype=np.int64), coords)

    @staticmethod
    def fetch(df: DataFrame, by: str | None) -> dict[int, dict[int, np.ndarray]]:
        """``{group: {cid: coordinates}}`` of a centre table whose size the caller has checked."""
        group = F.col(by) if by else F.lit(0)
        groups: dict[int, dict[int, np.ndarray]] = {}
        for row in df.select(group.alias("g"), "cid", F.col("c").cast("array<double>").alias("c")).collect():
            groups.setdefault(row.g, {})[row.cid] = np.array(row.c)
        return groups

    def members(self) -> dict[int, dict[int, np.ndarray]]:
        """The inverse of ``build``."""
        owned = [(g, slice(i, i + n)) for g, i, n in zip(self.groups.tolist(), self.first, self.count)]
        return {g: dict(zip(self.cids[rows].tolist(), self.coords[rows])) for g, rows in owned}

    def to_dataframe(self, spark: SparkSession, weights: dict[tuple[int, int], float] | None = None) -> DataFrame:
        """``(g, cid, c)``, and ``w`` where weights are given by group and centre; those not listed are 0."""
        rows = [(g, cid, c) for g, members in self.members().items() for cid, c in members.items()]
        columns = {
            "g": pa.array([g for g, _, _ in rows], pa.int32()),
            "cid": pa.array([cid for _, cid, _ in rows], pa.int32()),
            "c": pa.array([c for _, _, c in rows], pa.list_(pa.float64())),
        }
        if weights is not None:
            columns["w"] = pa.array([weights.get((g, cid), 0.0) for g, cid, _ in rows], pa.float64())
        return spark.createDataFrame(pa.table(columns))

    def nearest(self, v: Column, group: Column | None = None) -> Column:
        """``struct<cid, d>`` of the nearest centre of the row's group; NULL for a group without centres."""
        names, first, count, cids, coords = self
        dims, columns = coords.shape[1], coords.T.copy()
        balls = tasks.BallIndex(coords) if group is None and len(coords) >= BALLS_FROM else None
        search = tasks.AdaptiveSearch(coords, balls)

        @F.arrow_udf("struct<cid:long,d:double>")
        def single(v: pa.Array) -> pa.Array:
            index, d = search.nearest(tasks.coordinates(v, dims))
            return pa.StructArray.from_arrays([pa.array(cids[index]), pa.array(d)], ["cid", "d"])

        @F.arrow_udf("struct<cid:long,d:double>")
        def grouped(group: pa.Array, v: pa.Array) -> pa.Array:
            group = group.to_numpy(zero_copy_only=False)
            g = np.searchsorted(names, group).clip(max=len(names) - 1)
            known = names[g] == group
            x = tasks.coordinates(v, dims)
            index, d = tasks.nearest_of_own(x, columns, first[g], np.where(known, count[g], 0))
            result = [pa.array(cids[index]), pa.array(d)]
            return pa.StructArray.from_arrays(result, ["cid", "d"], mask=pa.array(~known))

        return single(v) if group is None else grouped(group, v)

    def moved(self, sums: list) -> Centers:
        """Centres at the weighted means of their points, from rows ``(g, cid, sums, w)``; others stay where they are."""
        means = {(row.g, row.cid): np.array(row.sums) / row.w for row in sums if row.w > 0}
        owners = zip(np.repeat(self.groups, self.count).tolist(), self.cids.tolist(), self.coords)
        return self._replace(coords=np.array([means.get((g, cid), c) for g, cid, c in owners]))

    def sums(self, points: DataFrame, fan_in: int = FAN_IN, n_tasks: int | None = None, coordinates: bool = True) -> DataFrame:
        """``(g, cid, sums, w)``: weighted coordinate sums and weights of the ``points(g, v, w)`` nearest to each centre.

        One pass: a task adds up what it reads, so it yields at most a row per centre. Rows of one centre are added
        ``fan_in`` at a time, level by level. No coordinate becomes a row of its own, and without ``coordinates`` only
        weights are added up.
        """
        names, first, count, cids, coords = self
        dims, columns = coords.shape[1], coords.T.copy()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, weights = np.zeros((len(coords), dims if coordinates else 0)), np.zeros(len(coords))
            for batch in batches:
                x = tasks.coordinates(batch.column("v"), dims)
                w, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "g"))
                g = np.searchsorted(names, group).clip(max=len(names) - 1)
                known = names[g] == group
                index, _ = tasks.nearest_of_own(x, columns, first[g], np.where(known, count[g], 0))
                tasks.add_to(sums, weights, x[: sums.shape[1], known], w[known], index[known])
            yield self.partial_sums(sums, weights)

        rows = points.select(F.col("g").cast("long").alias("g"), "v", "w")
        return total_sums(rows.mapInArrow(add, PARTIAL_SUMS), n_tasks or tasks_of(rows), fan_in)

    def partial_sums(self, sums: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        """What a task has for the centres that got weight there, as ``PARTIAL_SUMS``."""
        used = np.flatnonzero(weights > 0)
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * sums.shape[1], pa.array(sums[used].ravel()))
        columns = [np.repeat(self.groups, self.count)[used], self.cids[used], lists, weights[used]]
        return with_task(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "cid", "sums", "w"]))


PARTIAL_SUMS = f"g long, cid long, sums array<double>, w double, {TASK} long"


def total_sums(partials: DataFrame, n_tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """``(g, cid, sums, w)`` from the ``PARTIAL_SUMS`` of tasks; further columns are added up too."""

    def total(table: pa.Table) -> pa.Table:
        sums = table["sums"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        others = {name: [table[name].to_numpy().sum()] for name in table.column_names if name != "sums"}
        return pa.table({"sums": pa.array([sums]), **others})

    return merge_partials(partials, ["g", "cid"], total, n_tasks, fan_in)


def checked_weight(w: str | Column, name: str = "weights") -> Column:
    """``w`` as a double; NULL, NaN, infinite and negative values fail."""
    w = (F.col(w) if isinstance(w, str) else w).cast("double")
    sound = (w >= 0) & (w < float("inf"))
    return F.when(F.coalesce(sound, F.lit(False)), w).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} must be finite and not negative, not "), F.coalesce(w.cast("string"), F.lit("NULL")))).cast("double")
    )


def nearest_center(
    points: DataFrame, centers: DataFrame, by: str | None = None, center_bytes: int = CENTER_BYTES
) -> DataFrame:
    """Adds ``cid`` and ``d``, the nearest centre and the distance to it. No shuffle of the points.

    Centres are shipped to the executors if they fit in ``center_bytes``. A larger set is cut into blocks that fit;
    the points pass ``BLOCKS_AT_ONCE`` of them at a time and keep the best centre so far, in one generation of files
    that replaces the one before. Points of a group without centres get NULLs.
    """
    return _assigned(points, centers, by, center_bytes)[0]


def _assigned(
    points: DataFrame, centers: DataFrame, by: str | None, center_bytes: int = CENTER_BYTES
) -> tuple[DataFrame, DataFrame]:
    """As ``nearest_center``, and the centres without what it takes to compute them."""
    for name in ("cid", "d"):
        if name in points.columns:
            raise ValueError(f"the points have a column {name} already")
    table, known, blocks = _fetched(centers, by, center_bytes)
    group, type_ = F.col(by) if by else None, centers.schema["cid"].dataType
    if table is not None:
        # A generator, as one UDF call then serves both columns and filters on other columns pass below it.
        near = F.inline(F.array(table.nearest(F.col("v"), group))).alias("cid", "d")
        return points.select("*", near).withColumn("cid", F.col("cid").cast(type_)), known
    best, state = _free(points, "best"), Generations(points.sparkSession)
    block = F.pmod(F.xxhash64(*[F.col(c) for c in [by, "cid"] if c]), F.lit(blocks))
    result, numbers = points.withColumn(best, F.lit(None).cast("struct<cid:long,d:double>")), _occupied(known, block)
    for start in range(0, len(numbers), BLOCKS_AT_ONCE):
        if start:
            result = state.keep(result)
        for b in numbers[start : start + BLOCKS_AT_ONCE]:
            near = _free(result, "near")
            found = Centers.build(Centers.fetch(known.where(block == b), by)).nearest(F.col("v"), group)
            result = result.withColumn(near, found).withColumn(best, _nearer(F.col(best), F.col(near))).drop(near)
    # The result still reads the last generation.
    state.release()
    chosen = [F.col(f"{best}.cid").cast(type_).alias("cid"), F.col(f"{best}.d").alias("d")]
    return result.select(*points.columns, *chosen), known


def _fetched(centers: DataFrame, by: str | None, center_bytes: int) -> tuple[Centers | None, DataFrame, int]:
    """The centres if they fit into ``center_bytes``, a table of them that is not computed again, and how often they fit."""
    owned = not (centers.storageLevel.useMemory or centers.storageLevel.useDisk)
    if owned:
        centers.persist()
    try:
        size = centers.agg(F.sum(F.size("c") * 8).alias("bytes")).first()["bytes"] or 0
        blocks = max(1, math.ceil(size / center_bytes))
        if blocks > 1:
            return None, checkpoint(centers.select(*[c for c in [by, "cid", "c"] if c])), blocks
        table = Centers.build(Centers.fetch(centers, by))
    finally:
        if owned:
            centers.unpersist()
    known = table.to_dataframe(centers.sparkSession)
    columns = [F.col("g").cast(centers.schema[by].dataType).alias(by)] if by else []
    return table, known.select(*columns, F.col("cid").cast(centers.schema["cid"].dataType).alias("cid"), "c"), 1


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _occupied(centers: DataFrame, block: Column) -> list[int]:
    return sorted(row.block for row in centers.select(block.alias("block")).distinct().collect())


def _nearer(a: Column, b: Column) -> Column:
    order = lambda near: F.struct(near["d"].alias("d"), near["cid"].alias("cid"))
    return F.when(b.isNotNull() & (a.isNull() | (order(b) < order(a))), b).otherwise(a)


def center_weights(points: DataFrame, centers: DataFrame, by: str | None = None) -> DataFrame:
    """``(cid, w)``, the total weight of the points nearest to each centre (their number without a column ``w``)."""
    keys = [by, "cid"] if by else ["cid"]
    weighted = "w" in points.columns
    assigned, known = _assigned(points, centers, by)
    weight = F.sum(checked_weight("w")) if weighted else F.count("*")
    counted = assigned.groupBy(*keys).agg(weight.alias("w"))
    return known.select(*keys).join(counted, keys, "left").fillna(0, ["w"])


def kmedian_objective(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``(n_points, objective)``, with the mean distance to the nearest centre."""
    return nearest_center(points, centers).agg(F.count("*").alias("n_points"), F.avg("d").alias("objective"))


class Measured(NamedTuple):
    """The number of points and the mean distance to the nearest centre (NULL without points)."""

    n_points: int
    objective: float | None


def write_assignment(points: DataFrame, centers: DataFrame, folder: str, by: str | None = None) -> Measured:
    """Writes ``nearest_center`` of the points as Parquet, and measures it on the way: one pass over the points for both.

    The figures are those of ``kmedian_objective``; they come with the write and not from reading what was written.
    """
    seen = Observation()
    figures = F.count(F.lit(1)).alias("n_points"), F.avg("d").alias("objective")
    nearest_center(points, centers, by).observe(seen, *figures).write.parquet(folder)
    # An empty plan is not run, so nothing is seen of it.
    if points.sparkSession.read.parquet(folder).isEmpty():
        return Measured(0, None)
    return Measured(**seen.get)


def lloyd_step(points: DataFrame, centers: DataFrame, by: str | None = None) -> DataFrame:
    """``(cid, c)`` with each centre moved to the weighted mean of the points nearest to it.

    A centre stays where it is if no weight is nearest to it. Points without a column ``w`` weigh 1.
    """
    keys = [by, "cid"] if by else ["cid"]
    weight = checked_weight("w") if "w" in points.columns else F.lit(1.0)
    group = F.col(by) if by else F.lit(0)
    heavy = points.withColumn("w", weight).where(F.col("w") > 0)
    table, known, _ = _fetched(centers, by, CENTER_BYTES)
    if table is None:
        moved = move_centers(_assigned(heavy, known, by)[0], keys)
    else:
        found = table.sums(heavy.select(group.alias("g"), "v", "w"))
        names = [F.col("g").cast(centers.schema[by].dataType).alias(by)] if by else []
        cid = F.col("cid").cast(centers.schema["cid"].dataType).alias("cid")
        moved = found.select(*names, cid, F.transform("sums", lambda x: x / F.col("w")).alias("c"))
    joined = known.alias("old").join(moved.alias("new"), keys, "left")
    return joined.select(*keys, F.coalesce("new.c", F.col("old.c").cast("array<double>")).alias("c"))


def move_centers(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means of assigned points per centre, summed coordinate by coordinate inside the tasks first."""
    weighted = assigned.where(F.col("w") > 0).select(*keys, "w", F.posexplode("v").alias("pos", "x"))
    means = weighted.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    coords = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(coords, lambda coord: coord["x"]).alias("c"))
