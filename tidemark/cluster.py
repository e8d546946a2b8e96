"""What the corpus operators need from the cluster: a shared folder, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where a session on one machine (``local[n]``, as in tests) names none, a temporary
    folder is made and set, once a session; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; removed when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_remove, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where)
    return path


def _remove(files, where) -> None:
    # the session may have been stopped, the JVM's file system still answers; a JVM that is gone can't be asked
    with contextlib.suppress(Py4JError, OSError):
        files.delete(where, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends
    there, so a lost executor costs no more than the tasks it ran."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, the one setting that follows the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
