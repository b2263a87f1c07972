from types import SimpleNamespace

import pyarrow as pa
import pytest

from mrkit import session


def _spark(master, conf):
    """Stands for a session without a checkpoint folder."""
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=context, conf=conf, seen=seen)


def test_cluster_needs_a_shared_checkpoint_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._ensure_checkpoint_dir(_spark("spark://host:7077", {}))


def test_folder_of_the_session_is_used():
    spark = _spark("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared"})
    session._ensure_checkpoint_dir(spark)
    assert spark.seen == ["hdfs:///shared"]


def test_checkpoint_lands_in_the_folder_and_cuts_the_lineage(spark):
    df = session.checkpoint(spark.range(5).selectExpr("id * 2 AS id"))
    assert [row.id for row in df.orderBy("id").collect()] == [0, 2, 4, 6, 8]
    assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sparkContext.getCheckpointDir().split(":")[-1].startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shared_folder_is_deleted_with_its_files(spark):
    with session.shared_folder(spark) as folder:
        spark.range(3).write.parquet(folder)
        assert spark.read.parquet(folder).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder)
    # A folder that was never written to is no error.
    with session.shared_folder(spark):
        pass


def test_batches_are_bounded_while_tables_are_written(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [batch.num_rows]}) for batch in batches)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    assert max(row.n for row in session.checkpoint(rows.mapInArrow(sizes, "n long")).collect()) < 1500
    assert spark.conf.get(name) == before
