import pytest
from pyspark.sql import functions as F

from mrkit.operators import numbers
from mrkit.plans.reports import number_report
from mrkit.sources import read_numbers


@pytest.fixture
def one_to_ten(spark, tmp_path):
    path = tmp_path / "numbers.txt"
    path.write_text("1.0\n2.0\n3.0 4.0\n\n  5.0\t6.0 \n7.0\n8.0\n9.0\n10.0\n")
    return read_numbers(spark, str(path))


def _value(df):
    (row,) = df.collect()
    return row[0]


def test_one_to_ten(one_to_ten):
    assert _value(numbers.sum_of_squares(one_to_ten)) == 385.0
    assert _value(numbers.max_value(one_to_ten)) == 10.0
    assert _value(numbers.band_probability(one_to_ten)) == 0.7
    assert number_report(one_to_ten).first() == (10, 10.0, 0.7)


def test_max_by_key_agrees_with_max(one_to_ten):
    assert _value(numbers.max_by_key(one_to_ten, "x")) == 10.0
    assert _value(numbers.max_by_key(one_to_ten, -F.col("x"))) == 1.0


def test_max_by_key_keeps_the_row_and_compares_keys_in_order(spark):
    df = spark.createDataFrame([("a", 2, 1), ("b", 2, 3), ("c", 1, 9)], "name string, x int, y int")
    assert numbers.max_by_key(df, "x", "y").collect() == [("b", 2, 3)]


def test_normalize_keeps_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 4.0)], "name string, x double")
    assert numbers.normalize_by_max(df).orderBy("name").collect() == [("a", 1.0, 0.25), ("b", 4.0, 1.0)]


def test_band_is_inclusive(spark):
    df = spark.createDataFrame([(2.0,), (8.0,), (10.0,), (1.999,)], "x double")
    assert _value(numbers.band_probability(df)) == 0.5


def test_zero_maximum_is_outside_of_the_band(spark):
    zeros = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    assert _value(numbers.band_probability(zeros)) == 0.0
    assert [row.z for row in numbers.normalize_by_max(zeros).collect()] == [None, None]


def test_integers_are_taken_as_doubles(spark):
    df = spark.createDataFrame([(2_000_000_000,), (500_000_000,)], "x int")
    assert _value(numbers.sum_of_squares(df)) == 4.25e18
    assert _value(numbers.band_probability(df)) == 0.5


def test_no_values(spark):
    empty = spark.createDataFrame([], "x double")
    for operator in (numbers.sum_of_squares, numbers.max_value, numbers.band_probability):
        assert _value(operator(empty)) is None


def test_bad_number_fails(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("1.0 two\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_numbers(spark, str(path)).collect()
