"""Shared scratch space and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session, whose executors are this very process, may fall back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="deedscope-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries planned and run inside leave no shuffle files behind.

    Else these stay until the driver happens to collect its garbage, so that the disk holds those
    of all steps of a job at once. Only for a DataFrame that is run once: a further run would
    make them again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy.

    The copy also fixes values that a recomputation could place differently, such as the
    partition a row sits in.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with dropped_shuffles(spark):
        # A plan of its own: a caller may have run, or go on with, the one of ``df``.
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh ``path`` and continue from the files."""
    with dropped_shuffles(df.sparkSession):
        df.select("*").write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh path of the shared folder and continue from the files.

    For rounds that join a table with itself: a checkpoint keeps the estimated size of its plan, a
    product over the joins, whose digits double at each and fill the driver after a few rounds.
    """
    return written(df, scratch_path(df.sparkSession, label))


def discard(copy: DataFrame) -> None:
    """Delete the files of a copy that :func:`written` made, once nothing is read from it any more."""
    spark = copy.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in copy.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
