"""Columns of the tables that have the names of results or helpers change nothing."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from mrkit.llm import byte_bpe, conversation_trie, lexical_search, lm_scoring, minhash, packing, quality_rules, suffix_dedup, vector_graph, warc

NAMES = ["score", "start", "length", "offset", "n_words", "kept", "s", "rank", "n", "hash", "doc", "spans", "marks", "name", "item", "held_out", "stratum", "cutoffs", "key", "first"]


@pytest.fixture(scope="module")
def clashing():
    return lambda df: df.withColumns({name: F.lit("x") for name in NAMES if name not in df.columns})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "run",
    [
        lambda docs, labels: minhash.near_duplicates(docs),
        lambda docs, labels: suffix_dedup.repeated_bytes(docs),
        quality_rules.quality_rules,
        lambda docs, labels: byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        lambda docs, labels: packing.pack_documents(docs, P.path("word_bpe_49k.json")),
        lambda docs, labels: lm_scoring.lm_scores(docs),
        lambda docs, labels: lexical_search.search(docs, docs.select(F.col("doc_id").alias("item_id"), "text")),
    ],
)
def test_documents(table, clashing, run):
    docs, labels = table("documents").where("doc_id < 60").coalesce(1), table("labels")
    assert rows(run(clashing(docs), clashing(labels))) == rows(run(docs, labels)) != []


def test_other_tables(table, clashing):
    pages = table("pages").where("page_id < 20")
    assert rows(warc.round_trip(clashing(pages).withColumn("refers_to", F.lit(1)))) == rows(warc.round_trip(pages)) != []
    turns = table("conversations").where("conv_id < 30")
    trie = conversation_trie.conversation_trie
    assert rows(trie(clashing(turns).withColumn("conv", F.lit(1)).withColumn("pos", F.lit(1)))) == rows(trie(turns)) != []
    vectors = table("embeddings").where("vec_id < 60")
    found = lambda v: rows(vector_graph.nearest_neighbours(v, v.where("vec_id % 20 = 0"), 5))
    assert found(clashing(vectors).withColumn("v", F.lit(1))) == found(vectors) != []
