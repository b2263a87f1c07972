"""The stages over a small corpus, and what the entry registers."""

import random

import __spark_entry__ as spark_entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from mrkit.llm import queries
from mrkit.session import written


def test_queries_are_registered():
    names = spark_entry.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    text = lambda seed, n: " ".join(f"w{x}" for x in random.Random(seed).choices(range(10**6), k=n))
    passage = text(99, 90)
    rows = [
        (1, text(1, 120) + " mail der.34@mail7.example.com now"),
        (2, text(1, 120) + " mail der.34@mail7.example.com then"),
        (3, text(3, 70) + " " + passage),
        (4, passage + " " + text(4, 70)),
        (5, "too short"),
        (6, "again and again " * 40),
        (7, None),
        (8, text(8, 6000)),
    ]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: t for i, t in rows}, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: (r.text, r.n_chars) for r in docs.collect()})
    assert set(kept[0]) == {1, 2, 3, 4, 8} and set(kept[1]) == {1, 3, 4, 8} == set(kept[2]) == set(kept[3])
    assert all(t == texts[i] for i, (t, _) in kept[1].items())
    assert passage not in kept[2][3][0] and passage[40:-40] not in kept[2][4][0] and kept[2][8][0] == texts[8]
    assert "der.34@mail7.example.com" not in kept[3][1][0] and kept[3][1][0].startswith(texts[1][:100])
    assert all(n == len(t) for t, n in kept[3].values())
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {1, 3, 4, 8}
    assert all(sum(r.length for r in packed if r.doc_id == i) == next(r.doc_tokens for r in packed if r.doc_id == i) for i in (1, 3, 4, 8))


def test_passages_of_51_short_words_go(spark):
    rng = random.Random(5)
    text = lambda n, size: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))
    # 400 bytes go however few words they are, also if they begin inside a word.
    passages = [text(51, 5), text(51, 1), text(36, 10) + " and on", text(45, 5)]
    assert len(passages[0]) < 400 <= len(passages[2])
    rows = [(i, f"{text(60, 6)} {'xyz'[i // 4:]}{passages[i % 4]} {text(60, 6)}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    for i, whole in rows:
        words = left[i].split()
        assert words[:60] == whole.split()[:60] and words[-59:] == whole.split()[-59:]
        assert left[i] == whole if i % 4 == 3 else len(words) <= 122
