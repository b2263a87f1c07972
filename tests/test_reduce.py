"""Reductions with bounded fan-in, and what Lloyd steps and seeding save without changing results."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mrkit.operators import lloyd, seeding, tasks
from mrkit.operators.centers import Centers, lloyd_step
from mrkit.operators.reduce import MOST_TASKS, TASK, best_row, levels_of, merge_partials, reduce_columns, tasks_of


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "fan_in", "levels"), [(1, 4, 1), (4, 4, 1), (5, 4, 2), (16, 4, 2), (17, 4, 3), (1 << 24, 256, 3)])
def test_levels(n, fan_in, levels):
    assert levels_of(n, fan_in) == levels


def test_no_merge_meets_more_than_the_fan_in(spark):
    """Fifty tasks and three at a time: four levels, in which every key has the partial results in order."""
    rows = [(i % 3, i, [float(i), 1.0]) for i in range(150)]
    partials = spark.createDataFrame(rows, f"key int, {TASK} long, seen array<double>")
    partials = partials.withColumn(TASK, F.floor(F.col(TASK) / 3).cast("long"))

    def merge(table):
        if table.num_rows > 3:
            raise ValueError("too many partial results in one task")
        return pa.table({"seen": [[x for row in table["seen"].to_pylist() for x in row]]})

    merged = merge_partials(partials, ["key"], merge, 50, 3)
    assert _plan(merged).count("FlatMapGroupsInArrow") == 4
    found = {row.key: row.seen[::2] for row in merged.collect()}
    assert found == {key: [float(i) for i in range(key, 150, 3)] for key in range(3)}


def test_sums_of_more_tasks_than_the_fan_in(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=(400, 3)), rng.integers(0, 4, 400).astype(float)
    points = spark.createDataFrame([(0, v[i].tolist(), float(w[i])) for i in range(400)], "g int, v array<double>, w double")
    points = points.repartition(40)
    centers = Centers.build({0: {7: v[0], 9: v[1], 11: v[2], 12: np.full(3, 1e6)}})
    index, _ = tasks.nearest(v.T.copy(), centers.coords)
    for fan_in in (2, 256):
        sums = centers.sums(points, fan_in, 40)
        assert _plan(sums).count("FlatMapGroupsInArrow") == levels_of(40, fan_in)
        found = {row.cid: row for row in sums.collect()}
        assert sorted(found) == [7, 9, 11]
        for i, cid in enumerate((7, 9, 11)):
            assert np.allclose(found[cid].sums, (v * w[:, None])[index == i].sum(axis=0))
            assert np.isclose(found[cid].w, w[index == i].sum())
    only = {row.cid: (row.sums, row.w) for row in centers.sums(points, 2, 40, coordinates=False).collect()}
    assert only == {cid: ([], row.w) for cid, row in found.items()}


def test_tasks_are_counted_without_running(spark, tmp_path):
    spark.range(100).repartition(7).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert tasks_of(scan.where("id > 3")) == scan.rdd.getNumPartitions()
    assert tasks_of(scan.groupBy("id").count()) == MOST_TASKS
    # A step over points that come from a shuffle merges in as many levels as any number of tasks may need.
    points = spark.range(30).selectExpr("id", "array(double(id)) AS v").repartition(5)
    at = spark.createDataFrame([(0, [3.0]), (1, [20.0])], "cid int, c array<double>")
    step = lloyd_step(points, at)
    assert _plan(step).count("FlatMapGroupsInArrow") == 3
    assert sorted((r.cid, r.c) for r in step.collect()) == [(0, [5.5]), (1, [20.5])]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_reduction_by_a_function(spark, parts):
    df = spark.range(1, 500).select((F.col("id") * 84).alias("x")).repartition(parts)
    gcd = lambda table: pa.table({"x": [np.gcd.reduce(table["x"].to_numpy())]})
    assert [tuple(r) for r in reduce_columns(df, gcd, fan_in=2).collect()] == [(84,)]
    longest = reduce_columns(
        df,
        lambda t: pa.table({"n": [pc.sum(t["n"]).as_py()], "most": [pc.max(t["most"]).as_py()]}),
        "n long, most long",
        lambda t: pa.table({"n": np.ones(t.num_rows, dtype=np.int64), "most": t["x"]}),
        fan_in=2,
    )
    assert [tuple(r) for r in longest.collect()] == [(499, 499 * 84)]
    assert reduce_columns(df.where("x < 0"), gcd).collect() == []


def test_a_reduction_must_give_one_row(spark):
    with pytest.raises(Exception, match="must give one row"):
        reduce_columns(spark.range(5).withColumnRenamed("id", "x"), lambda t: t).collect()
    with pytest.raises(ValueError, match=TASK):
        reduce_columns(spark.range(5).withColumnRenamed("id", TASK), lambda t: t)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_best_row_by_a_comparator(spark, parts):
    rows = [(i, None if i % 5 == 0 else i * 7 % 20, f"name {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x long, name string").repartition(parts)
    score = lambda table: pc.multiply(table["x"], table["x"])
    known = [row for row in rows if row[1] is not None]
    assert [tuple(r) for r in best_row(df, score, ["id"], fan_in=2).collect()] == [max(known, key=lambda r: (r[1] ** 2, -r[0]))]
    assert [tuple(r) for r in best_row(df, score, ["id"], False, 2).collect()] == [min(known, key=lambda r: (r[1] ** 2, r[0]))]
    assert best_row(df.where("x IS NULL"), score, ["id"]).collect() == []


COORDINATE = st.sampled_from([0.0, 0.5, 1.0, 1.0 + 1e-12, 2.0, 3.5, 100.0])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_pruned_seeding_finds_the_same(data):
    """Two groups, ties and repeated points; what is skipped is never nearer."""
    dims, n = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 12))
    x = np.array(data.draw(st.lists(st.lists(COORDINATE, min_size=n, max_size=n), min_size=dims, max_size=dims)))
    k = data.draw(st.integers(1, 6))
    coords = np.array(data.draw(st.lists(st.lists(COORDINATE, min_size=2 * k, max_size=2 * k), min_size=dims, max_size=dims)))
    group = np.array(data.draw(st.lists(st.integers(0, 1), min_size=n, max_size=n)))
    first, owner = np.array([0, k]), np.repeat([0, 1], k)
    own, d = np.full(n, -1), np.full(n, np.inf)
    for i in range(k):
        new = first + i
        rounds = [(new, tasks.distance(coords, coords[:, new[owner]]))]
        tasks.improve(x, group, own, d, coords, rounds)
        index, best = tasks.nearest_of_own(x, coords, first[group], np.full(n, i + 1))
        assert (own == index).all() and (d == best).all()


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_bounds_keep_the_nearest_centre(data):
    dims, n, k = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 12)), data.draw(st.integers(1, 5))
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 32)))
    grid = data.draw(st.sampled_from([1.0, 0.25, 1e-9]))
    x = np.round(rng.normal(size=(dims, n)) / grid) * grid
    group = rng.integers(0, 2, n)
    first, count = np.array([0, k]), np.array([k, data.draw(st.integers(1, 3))])
    coords = np.round(rng.normal(size=(dims, count.sum())) / grid) * grid
    own, upper, lower = tasks.two_nearest_of_own(x, coords, first[group], count[group])
    for step in (0.0, 1.0, 0.1, 0.01, 0.001, 0.0):
        before, coords = coords, coords + np.round(step * rng.normal(size=coords.shape) / grid) * grid
        way = tasks.distance(coords, before)
        others = tasks.longest_of_others(way, first, count)
        computed = tasks.tighten(x, own, upper, lower, coords, first[group], count[group], way, others)
        index, best = tasks.nearest_of_own(x, coords, first[group], count[group])
        assert (own == index).all() and (upper >= best * (1 - 1e-12)).all() and (computed <= count[group] + 1).all()


def test_iterations_with_bounds_give_the_same_centres(spark):
    rng = np.random.default_rng(5)
    means = rng.normal(size=(6, 4)) * 8
    rows = [(int(g), (means[rng.integers(0, 6)] + rng.normal(size=4)).tolist(), float(rng.integers(0, 3))) for g in rng.integers(0, 2, 3000)]
    points = spark.createDataFrame(rows, "g int, v array<double>, w double").repartition(6).persist()
    vectors = [[np.array(v) for group, v, _ in rows if group == g] for g in (0, 1)]
    centers = Centers.build({g: dict(enumerate(vectors[g][: 5 + g])) for g in (0, 1)})
    plain = lloyd.lloyd_iterations(points, centers, 6, 6, bounds=False)
    carried = lloyd.lloyd_iterations(points, centers, 6, 6, bounds=True)
    assert (plain.centers.coords == carried.centers.coords).all() and plain.weights == carried.weights
    all_distances = sum(5 + g for g, *_ in rows)
    assert carried.computed[0] == all_distances and carried.computed[-1] < all_distances / 2
    points.unpersist()


def test_seeding_leaves_far_points_alone(spark, monkeypatch):
    """Far clusters: once distances are written down, a new centre only goes to the points of its own cluster."""
    rng = np.random.default_rng(9)
    means = np.array([[0.0, 0.0], [1000.0, 0.0], [0.0, 1000.0], [1000.0, 1000.0]])
    rows = [(i, (means[i % 4] + rng.normal(size=2)).tolist(), 1.0) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, v array<double>, w double").repartition(4).persist()
    draws = rng.random(9).tolist()
    whole = seeding.weighted_seeding(points, draws)
    conditions, may_be_nearer = [], seeding._may_be_nearer
    monkeypatch.setattr(seeding, "_may_be_nearer", lambda *a: conditions.append(may_be_nearer(*a)) or conditions[-1])
    blocks = seeding.weighted_seeding(points, draws, block=3)
    points.unpersist()
    assert (whole.coords == blocks.coords).all() and len(conditions) == 4
    x = np.array([v for _, v, _ in rows]).T
    chosen = dict(enumerate(whole.coords))
    index, d = tasks.nearest(x, whole.coords[:6])
    known = spark.createDataFrame([(int(c), float(b)) for c, b in zip(index, d)], "c long, d double").select(F.struct("c", "d").alias("known"))
    touched = known.where(may_be_nearer(chosen, 6, 7)).count()
    _, after = tasks.nearest(x, whole.coords[:7])
    assert (after < d).sum() <= touched <= 200
