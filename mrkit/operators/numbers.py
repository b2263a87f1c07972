"""Statistics of a numeric column.

The column maximum enters other expressions as a scalar subquery: Spark computes it in a job of its own and puts the
value into the generated code, so no join and no collect is involved. Spark orders NaN above all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_of_squares(df: DataFrame, x: str = "x") -> DataFrame:
    value = F.col(x).cast("double")
    return df.agg(F.sum(value * value).alias("sum_of_squares"))


def max_value(df: DataFrame, x: str = "x") -> DataFrame:
    return df.agg(F.max(x).alias("max_value"))


def max_by_key(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The row that is largest by the keys, compared in the given order."""
    keys = [F.col(key) if isinstance(key, str) else key for key in keys]
    return df.agg(F.max_by(F.struct("*"), F.struct(*keys)).alias("row")).select("row.*")


def normalize_by_max(df: DataFrame, x: str = "x", out: str = "z") -> DataFrame:
    """Adds ``x / max(x)``; NULL when the maximum is 0."""
    return df.withColumn(out, normalized(df, x))


def normalized(df: DataFrame, x: str) -> Column:
    """``x / max(x)`` over all rows of ``df``; NULL when the maximum is 0."""
    largest = df.agg(F.max(F.col(x).cast("double"))).scalar()
    return F.try_divide(F.col(x).cast("double"), largest)


def band_probability(df: DataFrame, x: str = "x", low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Share of the values whose quotient by the maximum lies in ``[low, high]``; NULL for no values."""
    values = df.select(x).where(F.col(x).isNotNull())
    return values.agg(band_share(normalized(values, x), low, high).alias("probability"))


def band_share(z: str | Column, low: float = 0.2, high: float = 0.8) -> Column:
    """Aggregate: share of the rows with ``z`` in ``[low, high]``; a NULL is outside."""
    z = F.col(z) if isinstance(z, str) else z
    return F.avg(F.when(z.between(low, high), 1.0).otherwise(0.0))
