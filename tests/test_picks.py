"""Many draws at once against one at a time."""

import numpy as np
import pytest

from mrkit.operators import seeding


@pytest.mark.parametrize("pick_rows", [1, 7, 1000])
@pytest.mark.parametrize("spread", [1, 10**12])
def test_equal_to_single_picks(spark, pick_rows, spread, monkeypatch):
    monkeypatch.setattr(seeding, "PICK_RANGES", 16)
    rng = np.random.default_rng(pick_rows)
    ids = np.sort(rng.choice(3000, 300, replace=False)) * spread - 5 * spread
    mass = rng.integers(0, 4, 300).astype(float)
    points = spark.createDataFrame([(int(i), float(m), "x") for i, m in zip(ids, mass)], "id long, mass double, draw2 string")
    us = [0.0, 0.999999, *rng.random(30).tolist(), 0.5, 0.5]
    running, massive = np.cumsum(mass), mass > 0
    expected = [(d, int(ids[np.flatnonzero(massive & (running >= u * running[-1]))[0]])) for d, u in enumerate(us)]
    found = seeding.weighted_picks(points, us, pick_rows=pick_rows)
    assert found.columns == ["draw", "id", "mass", "draw2"]
    assert sorted((r.draw, r.id) for r in found.collect()) == expected
    for draw in (0, 1, 7):
        assert seeding.weighted_pick(points, us[draw], pick_rows=pick_rows).first().id == expected[draw][1]


def test_passes_do_not_grow_with_the_draws(spark, monkeypatch):
    points = spark.range(2000).selectExpr("id * 1000003 AS id", "double(id % 5) AS mass").persist()
    monkeypatch.setattr(seeding, "PICK_RANGES", 16)
    passes = []
    for n in (1, 200):
        spark.sparkContext.setJobGroup(f"draws {n}", "draws")
        seeding.weighted_picks(points, [i / n for i in range(n)], pick_rows=10)
        stages = [s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(f"draws {n}") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
        passes.append(len(stages))
    spark.sparkContext.setJobGroup("other", "other")
    points.unpersist()
    assert passes[1] <= passes[0] * 1.5


def test_awkward_draws(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, mass double")
    assert seeding.weighted_picks(points, [0.1, 0.9]).collect() == []
    assert seeding.weighted_picks(points.where("id > 5"), [0.1]).collect() == []
    assert seeding.weighted_picks(points, []).collect() == []
    with pytest.raises(ValueError, match="draws"):
        seeding.weighted_picks(points, [1.0])
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "id long, mass double")
    with pytest.raises(ValueError, match="not unique"):
        seeding.weighted_picks(twice, [0.5], pick_rows=1)
    with pytest.raises(Exception, match="must be finite"):
        seeding.weighted_picks(spark.createDataFrame([(1, -1.0)], "id long, mass double"), [0.5]).collect()
