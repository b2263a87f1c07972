"""What must hold at any size: checked weights, one behaviour for both ways, plans and files that do not pile up."""

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mrkit.operators import centers, numbers, seeding, words
from mrkit.plans import kmedian
from mrkit.plans.clustering import weighted_kcenters
from mrkit.plans.reports import number_report
from mrkit.sources import read_documents, read_vectors, spread_scan


def _points(spark, rows, schema="id long, v array<double>, w double"):
    return spark.createDataFrame(rows, schema)


def _rows(df):
    return sorted((r.cid, [round(x, 9) for x in r.c], round(r.w, 9)) for r in df.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 2)), min_size=3, max_size=12),
    st.lists(st.floats(0, 0.999), min_size=2, max_size=2),
)
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_both_ways_agree(spark, points, draws):
    """Ties, zero weights and repeated points; the way through tasks needs a column of groups."""
    df = _points(spark, [(i, [float(x), float(y)], float(w)) for i, (x, y, w) in enumerate(points)])
    grouped = df.withColumn("part", F.lit(0))
    in_jobs = weighted_kcenters(df, 2, 1, draws=draws, pick_rows=4)
    in_task = weighted_kcenters(grouped, 2, 1, "part", draws=draws)
    assert _rows(in_jobs) == _rows(in_task)


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), -1.0])
def test_bad_weights_fail_everywhere(spark, bad):
    df = _points(spark, [(0, [0.0], 1.0), (1, [1.0], bad), (2, [5.0], 1.0)])
    at = spark.createDataFrame([(0, [0.0])], "cid int, c array<double>")
    grouped = df.withColumn("part", F.lit(0))
    for run in (
        lambda: weighted_kcenters(df, 2, 1, draws=[0.1, 0.5]).collect(),
        lambda: weighted_kcenters(grouped, 2, 1, "part", draws=[0.1, 0.5]).collect(),
        lambda: centers.lloyd_step(df, at).collect(),
        lambda: centers.center_weights(df, at).collect(),
        lambda: seeding.weighted_pick(df, 0.5, "w").collect(),
    ):
        with pytest.raises(Exception, match="must be finite and not negative"):
            run()


def test_filters_pass_below_the_assignment(spark, tmp_path):
    rows = [(i, [float(i)], i % 4, "kept") for i in range(8)]
    _points(spark, rows, "id long, v array<double>, label int, nearest_center string").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    at = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "cid int, c array<double>")
    found = centers.nearest_center(points, at).where("label = 3")
    assert "EqualTo(label,3)" in _plan(found)
    assert {r.nearest_center for r in found.collect()} == {"kept"}
    for name in ("cid", "d"):
        with pytest.raises(ValueError, match=name):
            centers.nearest_center(points.withColumn(name, F.lit(1)), at)


def test_centres_are_computed_once(spark, tmp_path):
    _points(spark, [(i, [float(i)], 1.0) for i in range(8)]).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    means = centers.move_centers(points.select((F.col("id") % 2).cast("int").alias("cid"), "v", F.lit(1.0).alias("w")), ["cid"])
    for df in (centers.center_weights(points, means), centers.lloyd_step(points, means)):
        plan = _plan(df)
        assert plan.count("FileScan parquet") == 1 and "Generate" not in plan.replace("Generate inline", "")


def _left(spark):
    folder = spark.sparkContext.getCheckpointDir().split(":")[-1]
    return {name for name in os.listdir(folder) if not name.startswith((".", "rdd-"))}


def test_generations_do_not_pile_up(spark):
    rng = np.random.default_rng(6)
    points = _points(spark, [(i, rng.normal(size=2).tolist(), 1.0) for i in range(40)])
    spark.range(1).checkpoint()
    before = _left(spark)
    seeding.weighted_seeding(points, rng.random(9).tolist(), block=2)
    assert _left(spark) == before
    at = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(40)], "cid int, c array<double>")
    found = centers.nearest_center(points, at, center_bytes=64)
    assert found.count() == 40 and len(_left(spark) - before) <= 1


def test_only_ids_and_masses_are_sorted(spark, monkeypatch):
    points = _points(spark, [(i, [float(i)], 1.0) for i in range(6)])
    plans, first_reaching = [], seeding._first_reaching
    monkeypatch.setattr(seeding, "_first_reaching", lambda *a: plans.append(first_reaching(*a)) or plans[-1])
    assert seeding.weighted_pick(points, 0.5, "w").first().v == [2.0]
    assert "Window" in _plan(plans[0]) and "array" not in plans[0]._jdf.queryExecution().analyzed().schema().simpleString()
    window = next(line for line in _plan(plans[0]).splitlines() if " Sort [" in line or "Window [" in line)
    assert "v#" not in window


@pytest.mark.parametrize("pick_rows", [2, 100])
def test_draws_of_many_groups_as_a_table(spark, pick_rows):
    rng = np.random.default_rng(1)
    rows = [(i, int(g), float(m)) for i, (g, m) in enumerate(zip(rng.integers(0, 50, 400), rng.integers(0, 4, 400)))]
    points = _points(spark, rows, "id long, part int, w double")
    draws = {g: float(u) for g, u in enumerate(rng.random(50))}
    table = spark.createDataFrame(list(draws.items()), "part int, u double")
    given_ = seeding.weighted_pick(points, draws, "w", "part", pick_rows=pick_rows)
    found = seeding.weighted_pick(points, table, "w", "part", pick_rows=pick_rows)
    assert sorted(found.collect()) == sorted(given_.collect()) and found.count() > 40


def test_report_of_columns_with_helper_names(spark):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(1, 11)], "z double, x double")
    assert tuple(number_report(df, "z").first()) == (10, 10.0, 0.7)
    assert number_report(df, "x").first().max_value == -1.0
    assert numbers.band_probability(df, "z").first()[0] == 0.7


@pytest.mark.parametrize("name", ["words", "starts", "key", "id"])
def test_ids_with_helper_names(spark, name):
    docs = spark.createDataFrame([(7, "a b a")], f"{name} long, text string")
    assert sorted(map(tuple, words.doc_term_freq(docs, name).collect())) == [(7, "a", 2), (7, "b", 1)]
    assert words.word_count_salted(docs, 2, doc_id=name).count() == 2
    with pytest.raises(ValueError, match="word"):
        words.tokenize(docs.withColumnRenamed(name, "word"), "word")


def test_line_numbers_do_not_depend_on_the_cores(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{i} {ord(name)}\n" for i in range(2000)))
    found = []
    for cores, size in (("2", "4096"), ("7", "1000")):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            points = read_vectors(spark, str(tmp_path), ids="number")
            found.append([(r.id, *r.v) for r in points.orderBy("id").collect()])
            assert read_documents(spark, str(tmp_path), "number").agg(F.max("doc_id")).first()[0] == 3999
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == [(i + 2000 * (n == 98), float(i), float(n)) for n in (97, 98) for i in range(2000)]


def test_only_scans_are_spread(spark):
    with pytest.raises(ValueError, match="scan"):
        spread_scan(spark.range(10).groupBy("id").count())


def test_coreset_tree(spark):
    rng = np.random.default_rng(3)
    points = _points(spark, [(i, rng.normal(size=2).tolist()) for i in range(200)], "id long, v array<double>")
    result = kmedian.mr_kmedian(points, 2, 9, 1, seed=1, fan_in=2)
    assert result.centers.agg(F.sum("w")).first()[0] == 200 and result.objective.first().n_points == 200
    # Brute force of the levels: 9 parts become 5, 3 and 2.
    level, parts, step = kmedian.partition_coreset(kmedian.with_part(points, 9), 2, 1, 1), 9, 1
    while parts > 2:
        united = [(r.part // 2, r.part * 2 + r.cid, r.v, r.w) for r in level.collect()]
        parts, step = -(-parts // 2), step + 1
        united = spark.createDataFrame(united, "part int, id long, v array<double>, w double")
        level = kmedian.partition_coreset(united, 2, 1, 1 + step)
    last = spark.createDataFrame([(0, r.part * 2 + r.cid, r.v, r.w) for r in level.collect()], "part int, id long, v array<double>, w double")
    assert _rows(weighted_kcenters(last, 2, 1, "part", 2)) == _rows(result.centers)


def test_too_many_centres_are_refused(spark):
    points = _points(spark, [(0, [0.0] * 100, 1.0)])
    with pytest.raises(ValueError, match="driver"):
        weighted_kcenters(points, 30_000, 0)


@pytest.mark.parametrize("name", ["pairwise_distance", "weighted_pick", "weighted_pick_by_group"])
def test_points_stay_where_they_are(spark, name):
    import __spark_entry__ as spark_entry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark_entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "SortMergeJoin" not in plan and "hashpartitioning(label" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
