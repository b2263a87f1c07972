from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mrkit.functions.text import split_words


def _double_array(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def euclidean(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two array columns, summed in coordinate order. Fails when the lengths differ."""
    a, b = _double_array(a), _double_array(b)
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    mismatch = F.raise_error(F.lit("vectors have different dimensions")).cast("double")
    return F.when(F.size(a) == F.size(b), distance).when(a.isNull() | b.isNull(), None).otherwise(mismatch)


def parse_vector(text: str | Column, mode: str = "failfast") -> Column:
    """Space-separated numbers as ``array<double>``. See ``read_vectors`` for the modes."""
    tokens = split_words(text)
    if mode == "failfast":
        return tokens.cast("array<double>")
    if mode == "permissive":
        values = tokens.try_cast("array<double>")
        return F.when(F.exists(values, lambda x: x.isNull()), None).otherwise(values)
    raise ValueError(f"unknown mode: {mode}")
