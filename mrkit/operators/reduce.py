"""Reductions with bounded fan-in: every task yields partial results, and few of them are merged at a time.

A partial result carries the number of the task that made it. Each level brings together what ``FAN_IN`` neighbouring
numbers have for one key, so no task holds more than that however many tasks read the data, and no level has more rows
than the one before by ``FAN_IN``. Merging follows the numbers, so a run again gives the same result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Ship these functions with the query, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_IN = 256

# Tasks of a plan with shuffles, whose number is known only when it runs.
MOST_TASKS = 1 << 24

TASK = "reduce_task"


def tasks_of(df: DataFrame) -> int:
    """An upper bound of the number of tasks that read ``df``, without running any of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"\b(Aggregate|Join|Sort|Window|Repartition|RebalancePartitions|Distinct|Limit)", plan):
        return MOST_TASKS
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def levels_of(tasks: int, fan_in: int) -> int:
    """How often partial results of so many tasks are merged until there is one per key."""
    if fan_in < 2:
        raise ValueError(f"fan_in must be at least 2, not {fan_in}")
    levels, left = 1, -(-tasks // fan_in)
    while left > 1:
        levels, left = levels + 1, -(-left // fan_in)
    return levels


def merge_partials(
    partials: DataFrame, keys: list[str], merge: Callable[[pa.Table], pa.Table], tasks: int, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per key from ``partials``, which have a row per key and task and the task's number in ``TASK``.

    ``merge`` takes at most ``fan_in`` rows of one key, in the order of their tasks, and gives a row of the same columns
    without ``TASK``; keys are put back by the caller of ``merge``.
    """
    schema = partials.schema
    values = [field.name for field in schema if field.name not in (*keys, TASK)]

    def level(group: tuple, table: pa.Table) -> pa.Table:
        merged = merge(table.sort_by(TASK).select(values))
        columns = {name: pa.array([value.as_py()], table.schema.field(name).type) for name, value in zip([*keys, TASK], group)}
        columns |= {name: merged[name] for name in values}
        return pa.table({field.name: columns[field.name] for field in schema})

    for _ in range(levels_of(tasks, fan_in)):
        partials = partials.withColumn(TASK, F.floor(F.col(TASK) / fan_in).cast("long"))
        partials = partials.groupBy(*keys, TASK).applyInArrow(level, schema)
    return partials.drop(TASK)


def with_task(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the number of this task."""
    return batch.append_column(TASK, pa.array(np.full(batch.num_rows, TaskContext.get().partitionId())))


def reduce_columns(
    df: DataFrame,
    reduce: Callable[[pa.Table], pa.Table],
    schema: StructType | str | None = None,
    prepare: Callable[[pa.Table], pa.Table] | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row: ``df`` reduced by a function of the caller. No rows give no row.

    ``reduce`` turns an Arrow table of any number of rows into one of a single row with the same columns, and it must not
    matter which rows it meets together: reducing parts and then their results must be the same as reducing all. It
    works on whole batches, so it is called for batches and never for a row. ``prepare``, if given, maps a batch of
    ``df`` to the rows that are reduced, whose columns are ``schema``. A task holds one batch and its result so far.
    """
    types = df.schema if schema is None else df.sparkSession.createDataFrame([], schema).schema
    if any(field.name.lower() == TASK for field in types):
        raise ValueError(f"there is a column {TASK} already")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if prepare is None else prepare(rows)
            if rows.num_rows:
                state = one_row(reduce(rows if state is None else pa.concat_tables([state, rows.cast(state.schema)])))
        if state is not None:
            yield with_task(state.combine_chunks().to_batches()[0])

    def one_row(table: pa.Table) -> pa.Table:
        if table.num_rows != 1:
            raise ValueError(f"a reduction must give one row, not {table.num_rows}")
        return table

    out = StructType([*types.fields]).add(TASK, "long")
    partials = df.mapInArrow(partial, out)
    return merge_partials(partials, [], lambda table: one_row(reduce(table)), tasks_of(df), fan_in)


def best_row(
    df: DataFrame, score: Callable[[pa.Table], pa.Array], ties: list[str], largest: bool = True, fan_in: int = FAN_IN
) -> DataFrame:
    """The row of ``df`` with the largest (or smallest) score; among equals the one that comes first by ``ties``.

    ``score`` compares rows on behalf of the caller: it gives a number, text or other ordered value for every row of an
    Arrow table, and NULL for rows that are out of the question. Whole rows travel only as the best of their task.
    """
    order = [("best_row_score", "descending" if largest else "ascending"), *((name, "ascending") for name in ties)]
    if any(field.name.lower() == "best_row_score" for field in df.schema):
        raise ValueError("there is a column best_row_score already")

    def reduce(table: pa.Table) -> pa.Table:
        scores = score(table)
        rows = table.append_column("best_row_score", scores).filter(pc.is_valid(scores))
        return rows.sort_by(order).slice(0, 1).drop_columns(["best_row_score"])

    def prepare(table: pa.Table) -> pa.Table:
        return table.filter(pc.is_valid(score(table)))

    return reduce_columns(df, reduce, prepare=prepare, fan_in=fan_in)
