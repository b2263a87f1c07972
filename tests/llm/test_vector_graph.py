import numpy as np
import pytest

from mrkit.llm import vector_graph


def _brute(rows, queries, k):
    found = {}
    for i, q in queries:
        scores = [(-float(np.dot(np.array(v, np.float64), np.array(q, np.float64))), j) for j, v in rows if j != i]
        found[i] = sorted(scores)[:k]
    return found


def test_recall_in_several_shards(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.7 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_graph.nearest_neighbours(df, df.where("vec_id % 20 = 0"), shard=400).collect()
    expected = _brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    hits = sum((r.vec_id in {j for _, j in expected[r.query_id]}) for r in found)
    assert len(found) == 20 * 75 and hits >= 0.95 * 20 * 75
    for r in found:
        assert r.score == pytest.approx(float(np.dot(np.float64(rows[r.query_id][1]), np.float64(rows[r.vec_id][1]))), rel=1e-12)


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, 1.0 + i]) for i in range(5)]
    bad = [(200, None), (220, []), (240, [0.0, 0.0]), (260, [1.0, None]), (280, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows + bad + [(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = vector_graph.nearest_neighbours(df, df.where("vec_id % 20 = 0 or vec_id is null")).collect()
    usable = [(i, v) for i, v in rows]
    expected = _brute(usable, [r for r in usable if r[0] % 20 == 0], 20)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == expected and {r.rank for r in found} == set(range(1, 21))


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_graph.nearest_neighbours(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 4.0)]
    none = df.where("vec_id < 0")
    assert vector_graph.nearest_neighbours(none, none).collect() == []


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(40, [9.0]), (41, [9.0, 9.0, 9.0]), (42, [])]
    vectors = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    found = vector_graph.nearest_neighbours(vectors, vectors.where("vec_id in (0, 20, 40, 41)"), 3)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [
        (0, 1, 29), (0, 2, 28), (0, 3, 27), (20, 1, 29), (20, 2, 28), (20, 3, 27)
    ]
    assert vector_graph.nearest_neighbours(vectors.where("vec_id > 99"), vectors).collect() == []
