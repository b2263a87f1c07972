"""Lines and their places, however files are cut."""

import gzip
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mrkit.sources import lines, read_documents, read_lines, read_vectors


def brute_force(data):
    """``(offset, line)`` of a file's bytes."""
    found = [(m.start(), m[1]) for m in re.finditer(rb"([^\r\n]*)(\r\n|\r|\n|\Z)", data)]
    return found[:-1] if not found or found[-1][0] == len(data) else found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\r", b"\r\n", b"\xff", "é".encode(), b"x" * 9]), max_size=30), st.integers(1, 12), st.integers(1, 5))
def test_any_cut_gives_the_same_lines(tmp_path_factory, parts, split, chunk):
    data = b"".join(parts)
    path = tmp_path_factory.mktemp("cut") / "f"
    path.write_bytes(data)
    size, lines.CHUNK = lines.CHUNK, chunk
    try:
        found = []
        for piece, _ in lines.pieces(0, str(path), len(data), split):
            with open(path, "rb") as stream:
                found += list(lines.places(stream, piece.start, piece.end))
    finally:
        lines.CHUNK = size
    assert found == brute_force(data)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "more.log").write_bytes(b"deep\n")
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n\nfive")
    (tmp_path / "b.txt").write_bytes("é\n".encode() * 300)
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "z z.txt.gz").write_bytes(gzip.compress(b"packed\nlines\n"))
    (tmp_path / "_hidden.txt").write_bytes(b"not read\n")
    (tmp_path / ".hidden").write_bytes(b"not read\n")
    return tmp_path


def test_one_scan(spark, folder):
    found = read_lines(spark, str(folder), split_bytes=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert found.rdd.getNumPartitions() > 5
    rows = sorted(map(tuple, found.collect()))
    assert rows[:5] == [(0, 0, "one"), (0, 5, "two"), (0, 9, "three"), (0, 15, ""), (0, 16, "five")]
    assert rows[5:305] == [(1, 3 * i, "é") for i in range(300)]
    # The empty file has a number too.
    assert rows[305:] == [(3, 0, "packed"), (3, 7, "lines")]


def test_ids_do_not_depend_on_cores_or_splits(spark, folder):
    expected = None
    for size, cores in ((7, "2"), (64, "7"), (1 << 20, "3")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        try:
            found = sorted(map(tuple, read_documents(spark, str(folder)).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        expected = expected or found
        assert found == expected and len({i for i, _ in found}) == 307
    assert found[1] == (5, "two") and found[5] == (1 << 40, "é")
    numbered = sorted(map(tuple, read_documents(spark, str(folder), "number").collect()))
    assert [text for _, text in numbered] == [text for _, text in found]
    assert [i for i, _ in numbered] == list(range(307))


def test_paths(spark, folder):
    count = lambda path: read_lines(spark, path).count()
    assert count(f"file://{folder}/a.txt") == count(f"file:{folder}/a.txt") == count(str(folder / "a.txt")) == 5
    assert count(str(folder / "[ab]*")) == 305 == count(str(folder / "*.txt")) and count(str(folder / "s*")) == 1
    assert count(str(folder / "*" / "*.log")) == 1 == count(str(folder / "sub"))
    assert count([str(folder / "a.txt"), str(folder / "z z.txt.gz"), str(folder / "a.txt")]) == 7
    assert count(str(folder / "empty.txt")) == 0
    for missing in ("none.txt", "none*.txt"):
        with pytest.raises(Exception, match="there is no|no files match"):
            count(str(folder / missing))
    with pytest.raises(ValueError, match="place"):
        read_documents(spark, str(folder), "other")


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"\xff\xfe\nok\n")
    assert [r.line for r in read_lines(spark, str(tmp_path)).selectExpr("hex(line) AS line").collect()] == ["FFFE", "6F6B"]


def test_long_lines_and_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(" ".join(str(i + j) for j in range(20_000)) for i in range(30)))
    points = read_vectors(spark, str(tmp_path))
    assert sorted((r.v[0], len(r.v)) for r in points.collect()) == [(float(i), 20_000) for i in range(30)]
