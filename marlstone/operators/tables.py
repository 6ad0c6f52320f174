"""Tables that cut lineage, in the folder that all machines see, and scopes that own them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Where that is unset, a temporary one is set on a single machine; a cluster's
    executors would each write to a disk of their own, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables of each open scope, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes a table in the shared folder and reads it: lineage is cut, and lost executors cost no work that was done. A table belongs to the
    innermost open scope (`owned`), or if it outlives that to the one around it, and is deleted when its scope ends; without one it stays until the
    folder's owner clears it, as the result may still read from it. `free` deletes it earlier."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    if len(_scopes) > outlives:
        _scopes[-1 - outlives].append(path)
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables from `materialize` that nothing will read again, and lets Spark drop the shuffle files of plans that are done with."""
    if tables:
        _delete(tables[0].sparkSession, [t._marlstone_path for t in tables])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()  # Spark removes a plan's shuffle files when the driver's JVM collects the plan, by itself every half hour


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """A scope that deletes the tables written in it when it ends, but for those that outlive it."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())
