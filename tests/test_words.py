from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mrkit.functions import split_words
from mrkit.operators import words
from mrkit.plans.reports import word_report
from mrkit.sources import read_documents, spread_scan

SPLITS = {
    "a  b  ": ["a", "", "b"],
    "": [""],
    "   ": [],
    "  a": ["", "", "a"],
    "a\tb c\n": ["a\tb", "c\n"],
    "Ab ab,": ["Ab", "ab,"],
}


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _split(text):
    """What split_words must give, by hand."""
    found = text.split(" ")
    while len(found) > 1 and not found[-1]:
        found.pop()
    return [] if found == [""] and text else found


def _counts(df):
    rows = [(row.word, row.n) for row in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("text", SPLITS)
def test_split_words(spark, text):
    assert _docs(spark, [text]).select(split_words("text")).first()[0] == SPLITS[text] == _split(text)


def test_null_text_has_no_words(spark):
    docs = _docs(spark, [None, "a"])
    assert _counts(words.word_count(docs)) == {"a": 1}
    assert [tuple(row) for row in words.doc_term_freq(docs).collect()] == [(1, "a", 1)]


def test_small_documents(spark):
    docs = _docs(spark, ["a b a", "b c"])
    assert _counts(words.word_count(docs)) == {"a": 2, "b": 2, "c": 1}
    assert words.distinct_word_count(docs).first().n_words == 3
    assert words.avg_distinct_word_length(docs).first().avg_length == 1.0
    assert word_report(docs).first() == (3, 5, 1.0)
    frequencies = {(row.doc_id, row.word): row.n for row in words.doc_term_freq(docs).collect()}
    assert frequencies == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1, (1, "c"): 1}
    assert [tuple(row) for row in words.tokenize(docs).orderBy("doc_id", "pos").collect()] == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "b"), (1, 1, "c"),
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet="ab \té", max_size=12), min_size=1, max_size=6),
    k=st.integers(1, 5),
    seed=st.integers(-3, 3),
)
def test_all_counts_agree(spark, texts, k, seed):
    docs = _docs(spark, texts)
    expected = Counter(word for text in texts for word in _split(text))
    assert _counts(words.word_count(docs)) == expected
    assert _counts(words.word_count_salted(docs, k, seed)) == expected
    assert _counts(words.word_count_by_partition(docs, k)) == expected
    per_document = {(row.doc_id, row.word): row.n for row in words.doc_term_freq(docs).collect()}
    assert per_document == Counter((i, word) for i, text in enumerate(texts) for word in _split(text))


def test_one_word_holds_a_third_of_all(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot hot hot")).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text"),
    )
    for counted in (words.word_count(docs), words.word_count_salted(docs, 7), words.word_count_by_partition(docs, 7)):
        assert counted.count() == 2001
        assert counted.where("word = 'hot'").first().n == 3000


@pytest.mark.parametrize("operator", [words.word_count_salted, words.word_count_by_partition])
def test_number_of_parts_is_checked(spark, operator):
    with pytest.raises(ValueError):
        operator(_docs(spark, ["a"]), 0)


def test_doc_term_freq_does_not_shuffle(spark):
    docs = _docs(spark, ["a b a"])
    assert "Exchange" not in words.doc_term_freq(docs)._jdf.queryExecution().executedPlan().toString()


def test_word_count_shuffles_once(spark):
    plan = words.word_count(_docs(spark, ["a b a"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a b a\n\n")
    (tmp_path / "b.txt").write_text("b c\n")
    docs = read_documents(spark, str(tmp_path))
    assert docs.select("doc_id").distinct().count() == 3
    assert _counts(words.word_count(docs)) == {"a": 2, "b": 2, "c": 1, "": 1}


def test_spread_scan(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spread = spread_scan(spark.read.parquet(str(tmp_path / "one")))
    assert spread.rdd.getNumPartitions() == 8 and spread.count() == 100
    spark.range(100).repartition(16).write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # one partition per file
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert spread_scan(many) is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
