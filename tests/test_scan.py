"""What one pass over the points gives: an index of many centres, coresets of whole tasks, figures of a write."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mrkit.operators import centers, tasks
from mrkit.plans.kmedian import mr_kmedian, scan_coreset


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_balls_find_what_the_scan_finds(data):
    """Also among ties, repeated centres and distances that differ by rounding only."""
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 32)))
    dims, n, k = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 30)), data.draw(st.integers(1, 60))
    grid = data.draw(st.sampled_from([1.0, 0.5, 1e-12]))
    at = np.round(rng.normal(size=(k, dims)) / grid) * grid
    x = np.round(rng.normal(size=(dims, n)) / grid) * grid
    index, best = tasks.nearest(x, at)
    found, d, _ = tasks.BallIndex(at).nearest(x)
    assert (found == index).all() and (d == best).all()


def test_balls_save_distances():
    rng = np.random.default_rng(2)
    means = rng.normal(size=(100, 8)) * 20
    at = means[rng.integers(0, 100, 10_000)] + rng.normal(size=(10_000, 8))
    x = (means[rng.integers(0, 100, 500)] + rng.normal(size=(500, 8))).T.copy()
    index, best = tasks.nearest(x, at)
    found, d, computed = tasks.BallIndex(at).nearest(x)
    assert (found == index).all() and (d == best).all() and computed < 500 * 10_000 / 5


def test_balls_are_given_up_where_they_do_not_save():
    rng = np.random.default_rng(3)
    at, x = rng.normal(size=(2000, 64)), rng.normal(size=(64, 50))
    search = tasks.AdaptiveSearch(at, tasks.BallIndex(at))
    for _ in range(2):
        index, best = search.nearest(x)
        assert (index == tasks.nearest(x, at)[0]).all() and (best == tasks.nearest(x, at)[1]).all()
    assert search.balls is None


def test_many_centres_on_spark(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)).round(1))], "cid int, c array<double>")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)).round(1))], "id long, v array<double>")
    plain = sorted((r.id, r.cid, r.d) for r in centers.nearest_center(points, at).collect())
    monkeypatch.setattr(centers, "BALLS_FROM", 100)
    assert sorted((r.id, r.cid, r.d) for r in centers.nearest_center(points, at).collect()) == plain
    # In blocks of centres, each block has its own index.
    monkeypatch.setattr(centers, "BALLS_FROM", 10)
    assert sorted((r.id, r.cid, r.d) for r in centers.nearest_center(points, at, center_bytes=1000).collect()) == plain


def _merge_and_reduce(x, w, k, iters, draws, block):
    """The same blocks one after the other, merged in pairs like digits of a binary number."""
    levels = []
    for start in range(0, len(w), block):
        coreset, level = (x[:, start : start + block], w[start : start + block]), 0
        coreset = tasks.cluster_group(*coreset, iters, draws)
        while levels and levels[-1][0] == level:
            other = levels.pop()[1]
            both = [np.concatenate([a, b]) for a, b in zip(other, coreset)]
            coreset, level = tasks.cluster_group(both[0].T.copy(), both[1], iters, draws), level + 1
        levels.append((level, coreset))
    both = [np.concatenate(parts) for parts in zip(*(coreset for _, coreset in levels))]
    return both if len(levels) == 1 else tasks.cluster_group(both[0].T.copy(), both[1], iters, draws)


@pytest.mark.parametrize("n", [5, 40, 41, 175])
def test_coreset_of_a_task(spark, n):
    rng = np.random.default_rng(n)
    x, w, draws = rng.normal(size=(n, 2)), rng.integers(0, 3, n).astype(float), [0.3, 0.7, 0.1]
    points = spark.createDataFrame([(i, x[i].tolist(), float(w[i])) for i in range(n)], "id long, v array<double>, w double")
    coreset = scan_coreset(points.coalesce(1), 3, 2, draws=draws, block_values=40)
    found = sorted((r.cid, r.v, r.w) for r in coreset.collect())
    expected, weights = _merge_and_reduce(x.T.copy(), w, 3, 2, draws, 20)
    assert [cid for cid, _, _ in found] == list(range(len(weights)))
    assert np.allclose([v for _, v, _ in found], expected) and np.allclose([w for _, _, w in found], weights)


def test_points_stay_where_they_are(spark, tmp_path):
    rng = np.random.default_rng(1)
    means = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0]])
    rows = [(i, (means[i % 3] + rng.normal(size=2)).tolist()) for i in range(3000)]
    spark.createDataFrame(rows, "id long, v array<double>").repartition(12).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    coreset = scan_coreset(points, 6, 2, seed=3, block_values=200)
    assert "Exchange" not in _plan(coreset)
    rows = coreset.collect()
    assert sum(r.w for r in rows) == 3000 and rows == scan_coreset(points, 6, 2, seed=3, block_values=200).collect()
    result = mr_kmedian(points, 3, None, 3, seed=1, fan_in=2, task_values=200, shuffle=False)
    assert result.objective.first().n_points == 3000 and result.objective.first().objective < 3
    assert sum(r.w for r in result.centers.collect()) == 3000
    with pytest.raises(ValueError, match="tasks are the parts"):
        mr_kmedian(points, 3, 4, 3, shuffle=False)
    empty = scan_coreset(points.where("id < 5"), 6, 1).collect()
    assert sum(r.w for r in empty) == 5


def test_a_write_measures_itself(spark, tmp_path):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 3)))], "id long, v array<double>")
    points.write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    at = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1.0, 1.0, 1.0])], "cid int, c array<double>")
    measured, objective = centers.write_assignment(points, at, str(tmp_path / "out")), centers.kmedian_objective(points, at).first()
    assert measured.n_points == objective.n_points == 200 and np.isclose(measured.objective, objective.objective)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, centers.nearest_center(points, at).collect()))
    # Every point passes through the caller's function once.
    passed = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        passed.add(1)
        return i

    centers.write_assignment(points.withColumn("id", counted("id")), at, str(tmp_path / "again"))
    assert passed.value == 200
    nothing = centers.write_assignment(points.where("id < 0"), at, str(tmp_path / "none"))
    assert tuple(nothing) == (0, None) and spark.read.parquet(str(tmp_path / "none")).count() == 0
