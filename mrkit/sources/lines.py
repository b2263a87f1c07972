"""Lines of text files with their places, in one scan.

A split is a range of bytes of a file, and yields the lines that begin in it. So where the file is cut does not change
what is read: a line has the number of its file, files counted in the order of their paths, and its offset there. Lines
end in LF, CR or both. Files are opened by the tasks through Arrow's file systems (local and mounted folders, object
stores, HDFS); compressed files are read as one split, and offsets are those of their content.
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Ship the source with the query, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "mrkit_lines"

# Bytes that are read at once, and lines of a batch.
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20

# Opening a file counts as much as reading so many bytes, when small files are put together.
OPEN_BYTES = 1 << 20

SCHEMA = "file int, offset long, line string"
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")


class Piece(NamedTuple):
    """Bytes ``[start, end)`` of a file; all of it if ``end`` is None."""

    file: int
    path: str
    start: int
    end: int | None


class Split(InputPartition):
    """Pieces that one task reads."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def read_lines(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """``(file, offset, line)`` of all lines of files, folders or globs. Names that begin with ``_`` or ``.`` are hidden.

    ``split_bytes`` is what a task reads, by default as ``spark.sql.files.maxPartitionBytes`` says.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if split_bytes is None:
        split_bytes = int(re.match(r"\d+", spark.conf.get("spark.sql.files.maxPartitionBytes"))[0])
    spark.dataSource.register(Lines)
    return spark.read.format(FORMAT).options(paths=json.dumps(paths), split_bytes=split_bytes).load()


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(json.loads(self.options["paths"]), int(self.options["split_bytes"]))


class LinesReader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        if split_bytes < 1:
            raise ValueError(f"a split needs a byte at least, not {split_bytes}")
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[Split]:
        splits, held, size = [], [], 0
        for file, (path, length) in enumerate(listed(self.paths)):
            for piece, cost in pieces(file, path, length, self.split_bytes):
                if held and size + cost > self.split_bytes:
                    splits.append(Split(held))
                    held, size = [], 0
                held.append(piece)
                size += cost
        return splits + [Split(held)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from batches(piece)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and ``file:`` are local."""
    if match := re.match(r"file:(?://)?(/.*)", path):
        path = match[1]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """Files and their sizes, in the order of their paths; a file that is named twice is read once."""
    found: dict[str, int] = {}
    for path in paths:
        system, inside = opened(path)
        prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
        glob = re.search(r"[*?\[]", inside)
        base = inside[: glob.start()].rpartition("/")[0] or "/" if glob else inside.rstrip("/") or "/"
        info = system.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"there is no {path}")
        own = [info] if info.is_file else system.get_file_info(pafs.FileSelector(base, recursive=bool(glob)))
        # As in a shell, a star does not cross a slash; files in a folder that matches are read, folders in it are not.
        wanted = [re.compile(fnmatch.translate(part)) for part in inside.split("/")] if glob else []
        for each in own:
            parts = each.path.split("/")
            below = parts[len(base.split("/")) :] if each.path != base else []
            hidden = any(part.startswith(("_", ".")) for part in below)
            matches = not glob or len(parts) - len(wanted) in (0, 1) and all(w.match(part) for w, part in zip(wanted, parts))
            if each.is_file and not hidden and matches:
                found[prefix + each.path] = each.size
    if not found and any(re.search(r"[*?\[]", path) for path in paths):
        raise FileNotFoundError(f"no files match {paths}")
    return sorted(found.items())


def pieces(file: int, path: str, length: int, split_bytes: int) -> Iterator[tuple[Piece, int]]:
    """The pieces of a file and what each costs to read."""
    if path.endswith(COMPRESSED):
        yield Piece(file, path, 0, None), length + OPEN_BYTES
        return
    for start in range(0, length, split_bytes):
        end = min(start + split_bytes, length)
        yield Piece(file, path, start, end), end - start + OPEN_BYTES


def places(stream, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in ``[start, end)`` of a seekable or fresh stream."""
    at = max(start - 1, 0)
    if at:
        stream.seek(at)
    carry, step = b"", CHUNK
    while True:
        data = stream.read(step)
        lines = (carry + data).splitlines(keepends=True)
        # The last line may go on, or be followed by the second half of its end.
        carry = lines.pop() if data and lines else b""
        step = CHUNK if lines else 2 * step
        for line in lines:
            # What begins in front of the piece is the rest of a line of the piece before.
            if at >= start:
                if end is not None and at >= end:
                    return
                yield at, line.rstrip(b"\n").removesuffix(b"\r") if line.endswith(b"\n") else line.removesuffix(b"\r")
            at += len(line)
        if not data:
            return


def batches(piece: Piece) -> Iterator[pa.RecordBatch]:
    system, path = opened(piece.path)
    with system.open_input_file(path) as file:
        codec = {".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4", ".gz": "gzip"}.get(path[path.rfind(".") :])
        stream = file if piece.end is not None else pa.CompressedInputStream(file, codec)
        offsets, lines, held = [], [], 0
        for offset, line in places(stream, piece.start, piece.end):
            offsets.append(offset)
            lines.append(line)
            held += len(line) + 32
            if held >= BATCH_BYTES:
                yield _batch(piece.file, offsets, lines)
                offsets, lines, held = [], [], 0
        if offsets:
            yield _batch(piece.file, offsets, lines)


def _batch(file: int, offsets: list[int], lines: list[bytes]) -> pa.RecordBatch:
    # Bytes that are no UTF-8 stay as they are, as in other text sources.
    as_text = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
    columns = [np.full(len(offsets), file, dtype=np.int32), np.array(offsets, dtype=np.int64), pc.cast(pa.array(lines, pa.binary()), options=as_text)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "offset", "line"])
