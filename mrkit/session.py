from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Bytes of a batch on its way to a Python worker; a worker and its task hold several copies of it at once.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> Iterator[None]:
    """Bounds the batches of what is planned and run meanwhile, whatever the rows hold; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(batch_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder of the session and cuts its lineage there.

    On a cluster the folder is the shared one named by ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def without_estimate(df: DataFrame) -> DataFrame:
    """``df``, a checkpoint, as rows of which Spark's optimizer knows no size.

    A checkpoint carries the estimate of the plan it cuts, and a join multiplies those of its sides. A loop that joins its
    own state so gets numbers with more than twice the digits in every round, which every node of a plan holds on the
    driver. Adaptive execution still sees the true sizes after a shuffle, and broadcasts by those only.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in a new subfolder of the checkpoint folder, read again. The files stay until ``Generations``
    or the user deletes them."""
    folder = f"{_ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    with small_batches(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Generations:
    """State of a loop that is written anew from time to time: the next generation replaces the one before.

    ``keep`` writes a DataFrame to a subfolder of the shared folder, deletes the generation before it and returns what
    was written. Used as a context, it deletes the last one in the end too; ``release`` leaves that one to a result
    that still reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, None

    def keep(self, df: DataFrame) -> DataFrame:
        old, new = self.folder, f"{_ensure_checkpoint_dir(self.spark)}/{uuid.uuid4()}"
        try:
            with small_batches(self.spark):
                df.write.parquet(new)
        except BaseException:
            _delete(self.spark, new)
            raise
        self.folder = new
        if old:
            _delete(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(new)

    def release(self) -> None:
        self.folder = None

    def __enter__(self) -> Generations:
        return self

    def __exit__(self, *error) -> None:
        if self.folder:
            _delete(self.spark, self.folder)
            self.folder = None


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """The name of a new subfolder of the checkpoint folder; it is deleted in the end with all that was written to it."""
    folder = f"{_ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"
    try:
        yield folder
    finally:
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    # One process, so its folders are shared; local-cluster has executors of its own.
    local = re.fullmatch(r"local(\[[^\]]*\])?", context.master) is not None
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mrkit-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder
