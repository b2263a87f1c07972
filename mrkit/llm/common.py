"""Small helpers that the operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The bytes that separate words (U+0009 to U+000D and U+0020), as bytes.split() does by itself.
SPACES = bytes([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])

# The bytes of UTF-8 that do not begin a character.
CONTINUATION = bytes(range(0x80, 0xC0))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores if ``df`` has such a column already; Spark compares names without case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array | pa.ChunkedArray, at_once: int = 512) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, NULL as an empty text, few rows at a time as Python objects."""
    for start in range(0, len(column), at_once):
        for text in column.slice(start, at_once).cast(pa.binary()).to_pylist():
            yield text or b""


def kept_in_process(name: str) -> dict:
    """A dictionary that lasts as long as the Python worker, for what each task would otherwise load again."""
    return sys.__dict__.setdefault("_mrkit_llm", {}).setdefault(name, {})


def chunked(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    chunk: list = []
    for item in items:
        chunk.append(item)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
