"""Session helpers: the shared checkpoint folder and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where that is unset
    on one machine (a local master) a temporary folder is made. Elsewhere it's an error to have none.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder within the checkpoint folder for files that tasks read themselves; it's deleted at the end."""
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    try:
        yield str(store.getFileStatus(path).getPath().toUri())
    finally:
        store.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan that has fewer partitions than there are cores, dealt out to all of them.

    For work that is dear per row. A larger scan stays as it is, so that nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
