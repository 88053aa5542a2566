"""What survives a lost executor: the shared folder and checkpoints in it. And names that no column of a table has."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on one machine (tests) a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="keyweave-")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df computed once, its lineage cut through the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to clash with none of the taken ones (without case)."""
    known = {t.lower() for t in taken}
    mark = ""
    while any((mark + n).lower() in known for n in names):
        mark += "_"
    return [mark + n for n in names]
