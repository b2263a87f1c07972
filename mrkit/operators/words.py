"""Word counts over documents ``(doc_id, text)``. A word is what ``split_words`` says it is.

A frequent word needs no special care in these aggregations: every task first counts its own words, so that a word
reaches the shuffle at most once per task (and salt), however many rows hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mrkit.functions import split_words


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, word)``, one row per word of each document."""
    _check_names(doc_id, "pos", "word")
    return docs.select(doc_id, F.posexplode(split_words(text)).alias("pos", "word"))


def doc_term_freq(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, word, n)``, the count of each distinct word in its document. No shuffle.

    All words of a document sit in one row, so they are counted there: the sorted words are cut where a new word
    starts, and a count is the distance to the next start.
    """
    _check_names(doc_id, "word", "n")
    words, starts, key = "the words", "the starts", "the document"
    sorted_words = docs.select(F.col(doc_id).alias(key), F.sort_array(split_words(text)).alias(words))
    begins = F.filter(
        F.transform(F.col(words), lambda word, i: i), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
    )
    runs = sorted_words.select(key, words, begins.alias(starts))
    ends = lambda i: F.coalesce(F.get(starts, i + 1), F.size(words))
    counts = F.transform(
        F.col(starts),
        lambda start, i: F.struct(F.get(words, start).alias("word"), (ends(i) - start).cast("long").alias("n")),
    )
    return runs.select(F.col(key).alias(doc_id), F.inline(counts))


def word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents, with one shuffle of per-task counts."""
    return docs.select(F.explode(split_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_count_salted(
    docs: DataFrame, k: int, seed: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Word count in two rounds: by random key in ``[0, k)`` and word, then by word.

    The key is a seeded hash of the word's place, so a task that is run again draws the same keys.
    """
    _check_parts(k)
    salt = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("pos")), F.lit(k))
    placed = docs.select(F.col(doc_id).alias("id"), F.posexplode(split_words(text)).alias("pos", "word"))
    return _count_in_two_rounds(placed.select(salt.alias("key"), "word"))


def word_count_by_partition(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word count in two rounds: within each of ``k`` parts of the documents, then over the parts.

    A part is a key derived from the document id. The texts stay where they are; only counts are shuffled.
    """
    _check_parts(k)
    part = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(k))
    return _count_in_two_rounds(docs.select(part.alias("key"), F.explode(split_words(text)).alias("word")))


def distinct_word_count(docs: DataFrame, text: str = "text") -> DataFrame:
    words = docs.select(F.explode(split_words(text)).alias("word"))
    return words.agg(F.count_distinct("word").alias("n_words"))


def avg_distinct_word_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """Mean length, in code points, of the distinct words; how often a word occurs does not matter."""
    words = docs.select(F.explode(split_words(text)).alias("word")).distinct()
    return words.agg(F.avg(F.length("word")).alias("avg_length"))


def _count_in_two_rounds(words: DataFrame) -> DataFrame:
    partial = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _check_names(doc_id: str, *made: str) -> None:
    if doc_id.lower() in made:
        raise ValueError(f"the id of a document cannot be called {doc_id}, as the result has a column of that name")


def _check_parts(k: int) -> None:
    if k < 1:
        raise ValueError(f"the number of parts must be at least 1, not {k}")
