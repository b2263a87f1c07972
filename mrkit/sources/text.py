"""Text file sources. Paths may be files, directories or globs on any file system Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mrkit.functions import parse_vector
from mrkit.sources.lines import read_lines

# Numbers are separated by runs of Java whitespace, as a default java.util.Scanner reads them.
NUMBER_SEPARATOR = r"\p{javaWhitespace}+"


# Bits of an id that hold the offset of a line; the others hold the number of its file.
OFFSET_BITS = 40


def read_documents(spark: SparkSession, path: str | list[str], ids: str = "place") -> DataFrame:
    """One line is one document: ``(doc_id long, text string)``; ``ids`` is as ``identified_lines`` says."""
    return identified_lines(spark, path, ids).withColumnsRenamed({"line_id": "doc_id", "value": "text"})


def read_vectors(spark: SparkSession, path: str | list[str], mode: str = "failfast", ids: str = "place") -> DataFrame:
    """One line is one vector with coordinates separated by single spaces: ``(id long, v array<double>)``.

    ``failfast`` fails on a token that is no number (two spaces in a row make an empty one); ``permissive`` gives a
    NULL vector for such a line. ``ids`` is as ``identified_lines`` says.
    """
    lines = identified_lines(spark, path, ids)
    return lines.select(F.col("line_id").alias("id"), parse_vector("value", mode).alias("v"))


def identified_lines(spark: SparkSession, path: str | list[str], ids: str = "place") -> DataFrame:
    """``(line_id long, value string)`` with ids in the order of the files' paths and of the lines in them.

    ``place``: the number of the file and the offset of the line in it, read in one scan. ``number``: lines counted from 0
    on through all files, which takes a second scan, but works on any file system that Spark itself can read. Neither
    depends on cores or split sizes, so several passes over a plan agree.
    """
    if ids == "number":
        return numbered_lines(spark, path)
    if ids != "place":
        raise ValueError(f"ids must be 'place' or 'number', not {ids!r}")
    lines, limit = read_lines(spark, path), F.lit(1 << OFFSET_BITS)
    beyond = F.raise_error(F.lit(f"a file has more than 2^{OFFSET_BITS} bytes, or there are more than 2^{63 - OFFSET_BITS} files"))
    fits = (F.col("offset") < limit) & (F.col("file") < F.lit(1 << 63 - OFFSET_BITS))
    line_id = F.when(fits, F.col("file").cast("long") * limit + F.col("offset")).otherwise(beyond.cast("long"))
    return lines.select(line_id.alias("line_id"), F.col("line").alias("value"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line_id long, value string)``: lines counted from 0 through all files, in the order of the files' paths.

    A line's place in its file split is known where it is read; how many lines come before the split takes a count of
    the files, so they are scanned twice. That table has a row per split and is broadcast if it is small, as any other.
    """
    place = F.monotonically_increasing_id().alias("place")
    split = ["file", "block"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place
    )
    counted = lines.groupBy(*split).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # Files first, then splits within them, so that no window has more rows than a file has splits or there are files.
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = counted.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    starts = counted.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(files, "file")
    starts = starts.select(*split, (F.col("ahead") + F.col("inside") - F.col("first")).alias("shift"))
    return lines.join(starts, split).select((F.col("place") + F.col("shift")).alias("line_id"), "value")


def read_numbers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All whitespace-separated numbers of the files, any number of them per line: ``(x double)``."""
    return numbers_from_lines(spark.read.text(path), "value")


def numbers_from_lines(lines: DataFrame, text: str) -> DataFrame:
    """The numbers in a string column: ``(x double)``."""
    tokens = lines.select(F.explode(F.split(F.col(text), NUMBER_SEPARATOR)).alias("token"))
    return tokens.where(F.col("token") != "").select(F.col("token").cast("double").alias("x"))
