"""The figures of a whole number or document set in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.operators.numbers import band_share, normalized
from mrkit.operators.words import word_count


def number_report(df: DataFrame, x: str = "x") -> DataFrame:
    """``(n, max_value, probability)``: count, maximum and share of values within 20% to 80% of the maximum."""
    value = F.col(x)
    quotient = normalized(df, x)
    probability = band_share(quotient).alias("probability")
    return df.where(value.isNotNull()).agg(F.count("*").alias("n"), F.max(value).alias("max_value"), probability)


def word_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(n_words, n_occurrences, avg_length)``: distinct words, all words, mean length of the distinct words."""
    return word_count(docs, text).agg(
        F.count("*").alias("n_words"),
        F.sum("n").alias("n_occurrences"),
        F.avg(F.length("word")).alias("avg_length"),
    )
