import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mrkit.operators import centers, seeding, tasks
from mrkit.plans import kmedian
from mrkit.plans.clustering import weighted_kcenters

# Sizes that force the clustering by Spark jobs, and picks over several levels of id ranges.
JOBS = {"task_values": 1, "pick_rows": 2}


def _points(spark, values, weights=None, ids=None):
    rows = [
        (i, [float(x) for x in np.atleast_1d(v)], float(w))
        for i, v, w in zip(ids or range(len(values)), values, weights or [1] * len(values))
    ]
    return spark.createDataFrame(rows, "id long, v array<double>, w double")


def _centers(spark, *values):
    rows = [(i, [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cid int, c array<double>")


def _table(df, *columns):
    return [tuple(row) for row in df.orderBy(*columns[:-1]).select(*columns).collect()]


@pytest.fixture
def line(spark):
    return _points(spark, [0, 1, 10, 11])


def test_line(spark, line):
    at = _centers(spark, 0, 10)
    assert _table(centers.nearest_center(line, at).drop("v"), "id", "cid", "d") == [
        (0, 0, 0.0), (1, 0, 1.0), (2, 1, 0.0), (3, 1, 1.0),
    ]
    assert _table(centers.center_weights(line, at), "cid", "w") == [(0, 2.0), (1, 2.0)]
    assert centers.kmedian_objective(line, at).first() == (4, 0.5)
    moved = centers.lloyd_step(line, at)
    assert _table(moved, "cid", "c") == [(0, [0.5]), (1, [10.5])]
    assert _table(centers.lloyd_step(line, moved), "cid", "c") == [(0, [0.5]), (1, [10.5])]


def test_lowest_centre_wins_ties(spark):
    assert centers.nearest_center(_points(spark, [5]), _centers(spark, 0, 10)).first().cid == 0
    reordered = _centers(spark, 10, 0).orderBy(F.desc("cid"))
    assert centers.nearest_center(_points(spark, [5]), reordered).first().cid == 0


def test_lloyd_uses_weights_and_keeps_empty_centres(spark):
    assert _table(centers.lloyd_step(_points(spark, [0, 4], [3, 1]), _centers(spark, 2)), "cid", "c") == [(0, [1.0])]
    moved = centers.lloyd_step(_points(spark, [0, 1]), _centers(spark, 0, 100))
    assert _table(moved, "cid", "c") == [(0, [0.5]), (1, [100.0])]
    assert _table(centers.center_weights(_points(spark, [0, 1]), _centers(spark, 0, 100)), "cid", "w")[1] == (1, 0.0)
    weightless = centers.lloyd_step(_points(spark, [3, 5], [0, 0]), _centers(spark, 4))
    assert _table(weightless, "cid", "c") == [(0, [4.0])]


def test_centres_in_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    points = _points(spark, rng.integers(0, 4, (60, 2)))
    many = _centers(spark, *rng.integers(0, 4, (40, 2)))
    whole = _table(centers.nearest_center(points, many), "id", "cid", "d")
    blocks = _table(centers.nearest_center(points, many, center_bytes=100), "id", "cid", "d")
    assert whole == blocks


@pytest.mark.parametrize("center_bytes", [centers.CENTER_BYTES, 8])
def test_groups_only_meet_their_own_centres(spark, center_bytes):
    points = _points(spark, [0, 10, 0, 10]).withColumn("part", F.col("id").cast("int") % 3)
    at = spark.createDataFrame([(0, 0, [9.0]), (1, 0, [0.0]), (1, 1, [10.0])], "part int, cid int, c array<double>")
    found = centers.nearest_center(points, at, "part", center_bytes)
    assert _table(found, "id", "cid", "d") == [(0, 0, 9.0), (1, 1, 0.0), (2, None, None), (3, 0, 1.0)]


def test_groups_of_different_sizes(spark):
    rng = np.random.default_rng(10)
    points = _points(spark, rng.normal(size=(90, 2))).withColumn("part", F.col("id").cast("int") % 3)
    at = [(part, cid, rng.normal(size=2).tolist()) for part in range(3) for cid in range(1 + 6 * part)]
    found = centers.nearest_center(points, spark.createDataFrame(at, "part int, cid int, c array<double>"), "part")
    for row in found.collect():
        d, cid = min((math.dist(row.v, c), cid) for part, cid, c in at if part == row.part)
        assert row.cid == cid and row.d == pytest.approx(d, rel=1e-12)


def test_distances_equal_the_column_function(spark):
    from mrkit.functions import euclidean

    rng = np.random.default_rng(2)
    points = _points(spark, rng.normal(size=(50, 7)))
    at = _centers(spark, rng.normal(size=7))
    both = centers.nearest_center(points, at).join(at, "cid").select("d", euclidean("v", "c").alias("e"))
    assert all(row.d == row.e for row in both.collect())


@pytest.mark.parametrize(
    "bad", [[[1.0, 2.0]], [[float("nan")]], [None], [[None]]], ids=["dimension", "nan", "null", "null inside"]
)
def test_bad_vectors_fail(spark, bad):
    points = spark.createDataFrame([(0, v) for v in bad], "id long, v array<double>")
    with pytest.raises(Exception, match="every vector must have|vectors must not hold"):
        centers.nearest_center(points, _centers(spark, 0)).collect()


@pytest.mark.parametrize("pick_rows", [1, 2, 100])
@pytest.mark.parametrize("ids", [[0, 1, 2, 3], [-(2**62), -5, 7, 2**62 - 1]])
@pytest.mark.parametrize("u, expected", [(0.0, 1), (0.25, 1), (0.26, 2), (0.5, 2), (0.51, 3), (0.999, 3)])
def test_weighted_pick(spark, pick_rows, ids, u, expected):
    points = _points(spark, range(4), [0, 1, 1, 2], ids)
    picked = seeding.weighted_pick(points, u, "w", pick_rows=pick_rows).collect()
    assert [row.id for row in picked] == [ids[expected]]


@pytest.mark.parametrize("pick_rows", [50, 7, 1000])
def test_weighted_pick_follows_the_running_sum(spark, pick_rows):
    rng = np.random.default_rng(3)
    mass = rng.integers(0, 5, 400)
    ids = rng.permutation(10**6)[:400].tolist()
    points = _points(spark, range(400), mass.tolist(), ids).repartition(5)
    order = np.argsort(ids)
    for u in (0.0, 0.1, 0.73, 0.9999):
        expected = ids[order[tasks.pick(mass[order].astype(float), u)]]
        assert seeding.weighted_pick(points, u, "w", pick_rows=pick_rows).first().id == expected


@pytest.mark.parametrize("pick_rows", [2, 100])
def test_weighted_pick_by_group(spark, pick_rows):
    points = _points(spark, range(8), [0, 0, 1, 0, 1, 0, 2, 0]).withColumn("part", F.col("id") % 2)
    picked = seeding.weighted_pick(points, {0: 0.3, 1: 0.3}, "w", "part", pick_rows=pick_rows).collect()
    assert [(row.part, row.id) for row in picked] == [(0, 4)]


@pytest.mark.parametrize("pick_rows", [2, 100])
def test_pick_keeps_all_columns(spark, pick_rows):
    names = ["id", "mass", "u", "before", "total", "key", "n", "row", "near"]
    points = spark.createDataFrame([tuple(range(i, i + 9)) for i in range(5)], names)
    picked = seeding.weighted_pick(points, 0.9, F.col("u") - F.col("id"), pick_rows=pick_rows)
    assert picked.columns == names and tuple(picked.first()) == tuple(range(4, 13))


def test_no_mass_no_pick(spark):
    assert seeding.weighted_pick(_points(spark, [1, 2], [0, 0]), 0.5, "w").count() == 0


def test_repeated_ids_fail(spark):
    with pytest.raises(ValueError, match="unique"):
        seeding.weighted_pick(_points(spark, range(5), ids=[7] * 5), 0.5, "w", pick_rows=2)


def _brute_force(values, weights, draws, iters):
    """Plain brute force, point by point."""
    values, chosen = [np.atleast_1d(np.array(v, float)) for v in values], []
    distance = lambda v: min(math.dist(v, c) for c in chosen)
    for u in draws:
        mass = [w * distance(v) for v, w in zip(values, weights)] if chosen else [1.0] * len(values)
        total, running = sum(mass), 0.0
        for v, m in zip(values, mass):
            running += m
            if m > 0 and running / total >= u:
                chosen.append(v)
                break
    label = lambda v: min(range(len(chosen)), key=lambda i: (math.dist(v, chosen[i]), i))
    for _ in range(iters):
        members = [label(v) for v in values]
        for i in range(len(chosen)):
            weight = sum(w for w, m in zip(weights, members) if m == i)
            if weight:
                chosen[i] = sum(w * v for v, w, m in zip(values, weights, members) if m == i) / weight
    members = [label(v) for v in values]
    return [(i, c, sum(w for w, m in zip(weights, members) if m == i)) for i, c in enumerate(chosen)]


@pytest.mark.parametrize("sizes", [{}, JOBS], ids=["tasks", "jobs"])
@pytest.mark.parametrize("iters", [0, 2])
def test_clustering_equals_brute_force(spark, sizes, iters):
    rng = np.random.default_rng(4)
    values, weights = rng.normal(size=(30, 3)), rng.integers(0, 4, 30).tolist()
    draws = [0.4, 0.95, 0.01]
    found = weighted_kcenters(_points(spark, values, weights), 3, iters, draws=draws, **sizes).orderBy("cid").collect()
    expected = _brute_force(values, weights, draws, iters)
    assert [(row.cid, row.w) for row in found] == [(i, w) for i, _, w in expected]
    np.testing.assert_allclose([row.c for row in found], [c for _, c, _ in expected], rtol=1e-12)


@pytest.mark.parametrize("sizes", [{}, JOBS], ids=["tasks", "jobs"])
def test_second_iteration_starts_from_zero(spark, sizes):
    """Centres 0 and 1 move to 0.5, 26/3 and then to 1, 11.5: old centres do not add to new ones."""
    points = _points(spark, [0, 1, 2, 11, 12])
    found = weighted_kcenters(points, 2, 2, draws=[0.0, 0.0], **sizes)
    assert _table(found, "cid", "c") == [(0, [1.0]), (1, [11.5])]


@pytest.mark.parametrize("sizes", [{}, JOBS], ids=["tasks", "jobs"])
def test_fewer_distinct_points_than_centres(spark, sizes):
    found = weighted_kcenters(_points(spark, [7, 7, 7]), 2, 1, draws=[0.5, 0.5], **sizes)
    assert _table(found, "cid", "c") == [(0, [7.0])]
    assert found.first().w == 3.0


@pytest.mark.parametrize("sizes", [{}, {"task_values": 1}, {"task_values": 30}], ids=["tasks", "jobs", "both"])
def test_groups_with_a_hot_one(spark, sizes):
    """Part 0 holds half of the points; with room for 30 values it goes to jobs and the others to tasks."""
    rng = np.random.default_rng(5)
    points = _points(spark, rng.normal(size=(120, 1))).withColumn(
        "part", F.when(F.col("id") % 2 == 0, 0).otherwise((F.col("id") % 5 + 1).cast("int"))
    )
    found = weighted_kcenters(points, 3, 1, "part", seed=9, **sizes).orderBy("part", "cid").collect()
    by_part = {}
    for row in points.orderBy("id").collect():
        by_part.setdefault(row.part, []).append(row.v)
    expected = [
        (part, cid, c, w)
        for part, values in sorted(by_part.items())
        for cid, c, w in _brute_force(values, [1.0] * len(values), tasks.group_draws(9, part, 3), 1)
    ]
    assert [(row.part, row.cid, row.w) for row in found] == [(part, cid, w) for part, cid, _, w in expected]
    np.testing.assert_allclose([row.c for row in found], [c for _, _, c, _ in expected], rtol=1e-12)


def test_seeding_in_blocks_gives_the_same(spark):
    rng = np.random.default_rng(6)
    points, draws = _points(spark, rng.normal(size=(40, 2))), rng.random(7).tolist()
    whole = seeding.weighted_seeding(points, draws)
    blocks = seeding.weighted_seeding(points, draws, block=2)
    assert np.array_equal(whole.coords, blocks.coords) and np.array_equal(whole.cids, blocks.cids)


def test_lloyd_never_raises_the_weighted_squared_cost(spark):
    rng = np.random.default_rng(7)
    points = _points(spark, rng.normal(size=(80, 3)), rng.integers(1, 5, 80).tolist())
    at = _centers(spark, *rng.normal(size=(3, 3)))
    cost = lambda c: centers.nearest_center(points, c).agg(F.sum(F.col("w") * F.col("d") ** 2)).first()[0]
    assert cost(centers.lloyd_step(points, at)) <= cost(at)


@pytest.fixture(scope="module")
def cloud(spark):
    return _points(spark, np.random.default_rng(8).normal(size=(300, 4))).drop("w").persist()


@pytest.mark.parametrize("sizes", [{}, {"task_values": 1}], ids=["tasks", "jobs"])
def test_coreset_stands_for_the_points(spark, cloud, sizes):
    parted = kmedian.with_part(cloud, 4)
    coreset = kmedian.partition_coreset(parted, 3, 1, **sizes)
    assert coreset.columns == ["part", "cid", "v", "w"]
    weights = coreset.groupBy("part").agg(F.sum("w").alias("n"), F.count("*").alias("rows"))
    sizes_of_parts = parted.groupBy("part").agg(F.count("*").cast("double").alias("n"))
    assert _table(weights, "part", "n") == _table(sizes_of_parts, "part", "n")
    assert {row.rows for row in weights.collect()} == {3}


def test_centres_without_steps_are_points(spark, cloud):
    found = weighted_kcenters(cloud, 4, 0, seed=2)
    assert found.join(cloud, F.col("c") == F.col("v"), "left_semi").count() == 4


def test_kmedian_does_not_depend_on_the_partitioning(spark, cloud):
    expected = kmedian.mr_kmedian(cloud, 3, 5, 1, seed=1)
    shuffled = kmedian.mr_kmedian(cloud.repartition(3, "v"), 3, 5, 1, seed=1, task_values=20)
    assert [r.cid for r in expected.centers.collect()] == [0, 1, 2]
    assert shuffled.objective.first().objective == pytest.approx(expected.objective.first().objective, rel=1e-12)
    other = kmedian.mr_kmedian(cloud, 3, 5, 1, seed=2)
    assert other.objective.first() != expected.objective.first()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = kmedian.mr_kmedian(cloud, 3, 5, 1, seed=1)
        assert again.objective.first().objective == pytest.approx(expected.objective.first().objective, rel=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_number_of_parts_follows_from_the_room_of_a_task(spark, cloud):
    chosen = kmedian.mr_kmedian(cloud, 3, None, 1, seed=1, task_values=400)
    given_six = kmedian.mr_kmedian(cloud, 3, 6, 1, seed=1)
    assert chosen.objective.first().objective == pytest.approx(given_six.objective.first().objective, rel=1e-12)


def test_caller_keeps_cached_centres(spark, line):
    at = _centers(spark, 0, 10).persist()
    centers.nearest_center(line, at).collect()
    assert at.storageLevel.useMemory
    at.unpersist()
    centers.nearest_center(line, at).collect()
    assert not at.storageLevel.useMemory


def test_more_parts_than_points(spark):
    result = kmedian.mr_kmedian(_points(spark, [0, 1, 10, 11]), 2, 50, 3)
    assert result.objective.first().n_points == 4


@pytest.mark.parametrize("k, parts, iters", [(0, 2, 1), (2, 0, 1), (2, 2, -1)])
def test_parameters_are_checked(spark, cloud, k, parts, iters):
    with pytest.raises(ValueError):
        kmedian.mr_kmedian(cloud, k, parts, iters)


@pytest.mark.parametrize("draws", [[0.5], [0.5, 1.0], [0.5, -0.1]])
def test_draws_are_checked(cloud, draws):
    with pytest.raises(ValueError):
        weighted_kcenters(cloud, 2, 1, draws=draws)


def test_parts_outside_of_the_range_fail(spark, cloud):
    with pytest.raises(Exception, match="a part is not in"):
        kmedian.mr_kmedian(cloud, 2, 3, 1, part=F.pmod("id", F.lit(4)))


@pytest.mark.parametrize("bad", [None, []])
def test_first_vector_must_have_coordinates(spark, bad):
    points = spark.createDataFrame([(0, bad)], "id long, v array<double>")
    with pytest.raises(ValueError, match="NULL or empty"):
        weighted_kcenters(points, 1, 0)


def test_groups_must_have_the_same_dimension(spark):
    points = spark.createDataFrame([(0, [1.0], 0), (1, [1.0, 2.0], 1)], "id long, v array<double>, part int")
    with pytest.raises(Exception, match="every vector must have"):
        weighted_kcenters(points, 1, 0, "part").collect()


def test_no_points(spark, cloud):
    with pytest.raises(ValueError, match="no points"):
        weighted_kcenters(cloud.where("id < 0"), 2, 1)
    with pytest.raises(ValueError, match="no centres"):
        centers.nearest_center(cloud, _centers(spark, 0).where("cid < 0"))


def test_assignment_runs_once_per_pass(spark, line):
    at = _centers(spark, 0, 10)
    found = centers.nearest_center(line, at)
    for df in (found.where("d < 1"), centers.center_weights(line, at), centers.lloyd_step(line, at)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # A Lloyd step assigns and adds up in one function over the rows.
        assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
