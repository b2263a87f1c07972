import pytest

from mrkit.functions import euclidean, parse_vector
from mrkit.sources import read_vectors


def _parse(spark, text, mode="failfast"):
    return spark.createDataFrame([(text,)], "line string").select(parse_vector("line", mode)).first()[0]


def test_parse_vector(spark):
    assert _parse(spark, "1.0 -2 3e1") == [1.0, -2.0, 30.0]
    assert _parse(spark, "1.0 2.0  ") == [1.0, 2.0]


@pytest.mark.parametrize("text", ["1.0  2.0", "", " 1.0", "1.0 x"])
def test_malformed_vectors(spark, text):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        _parse(spark, text)
    assert _parse(spark, text, "permissive") is None


def test_permissive_keeps_good_lines(spark):
    assert _parse(spark, "1.0 2.0", "permissive") == [1.0, 2.0]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        _parse(spark, "1.0", "loose")


def test_read_vectors(spark, tmp_path):
    (tmp_path / "points.txt").write_text("0.0 1.0\n2.0 3.0\n")
    points = read_vectors(spark, str(tmp_path / "points.txt"))
    assert points.schema.simpleString() == "struct<id:bigint,v:array<double>>"
    assert [row.v for row in points.orderBy("id").collect()] == [[0.0, 1.0], [2.0, 3.0]]


def test_euclidean(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<float>")
    assert df.select(euclidean("a", "b")).first()[0] == 5.0


def test_euclidean_of_null_and_of_other_dimension(spark):
    df = spark.createDataFrame([([0.0], None)], "a array<double>, b array<double>")
    assert df.select(euclidean("a", "b")).first()[0] is None
    df = spark.createDataFrame([([0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different dimensions"):
        df.select(euclidean("a", "b")).collect()
