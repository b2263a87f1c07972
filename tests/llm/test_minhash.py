"""Near duplicates against all pairs."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mrkit.llm import components, minhash
from mrkit.llm.components import connected_components
from mrkit.session import checkpoint


def _sets(rows, words):
    def shingles(text):
        tokens = [w.lower() for w in (text or "").encode().split()]
        return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()

    return [(i, shingles(t)) for i, t in rows]


def _expected(rows, words=4):
    sets = [(i, s) for i, s in _sets(rows, words)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        counts = Counter(other for x in s for other in holders[x])
        for other, n in counts.items():
            if i is not None and sets[other][0] is not None and 100 * n >= 80 * (len(s) + len(sets[other][1]) - n):
                a, b = sorted((find(k), find(other)))
                parent[b] = a
        for x in s:
            holders[x].append(k)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((i, len(s), name[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def _found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_awkward_texts(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = minhash.near_duplicates(docs)
    assert _found(found) == _expected(rows)
    assert {r.doc_id for r in found.collect() if not r.kept} == {9, 11, 12}


def test_no_documents(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert minhash.keep_one_of_each(no_docs).columns == no_docs.columns


def test_whole_table(table):
    documents = table("documents")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert _found(minhash.near_duplicates(documents)) == _expected(rows)


@pytest.mark.parametrize("small", [3, 1000])
def test_chains_of_near_copies(spark, monkeypatch, small):
    """Each is near the next one, the ends are not; with large buckets through tiles and with small ones through pairs."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE_CLASSES", 5)
    rng, rows = np.random.default_rng(1), []
    base = [f"word{i}" for i in range(120)]
    for i in range(60):
        words = list(base)
        for k in rng.choice(len(base), rng.integers(0, 8), replace=False):
            words[k] = f"edit{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            base[i] = f"drift{i}"
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = _expected(rows)
    assert _found(found) == expected and 1 < len({c for *_, c in expected}) < 60


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2000], np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))])
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(2).permutation(70).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**dict.fromkeys(range(70), 0), 100: 100, 101: 100}


def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch):
    written = []

    def counted(df):
        written.append(df)
        assert len(written) <= 14
        return checkpoint(df)

    monkeypatch.setattr(components, "checkpoint", counted)
    order = np.random.default_rng(3).permutation(200).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r.node, r.component) for r in connected_components(links).collect()} == {(i, 0) for i in range(200)}


def test_estimates_of_components_do_not_grow_with_the_rounds(spark):
    """The optimizer's size of the result, which joins multiply, has as many digits after many rounds as after one."""
    estimate = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    found = spark.createDataFrame([(0, 1)], "a long, b long")
    for length in (2, 70, 70):
        path = spark.createDataFrame([(i, i + 1) for i in range(length)], "node long, other long")
        links = path.join(found.toDF("node", "component"), "node", "left").select(F.col("node").alias("a"), F.col("other").alias("b"))
        found = connected_components(links)
        assert estimate(found) < 2**64
        assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(length + 1)}


def test_stage_keeps_one_of_each_group_and_all_columns(docs):
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*range(1, 9), 10, None], key=repr)
