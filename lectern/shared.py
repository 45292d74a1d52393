"""Tables in the folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made.
_ours: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one (spark.checkpoint.dir); it goes when the driver ends. On one
    machine (local mode, tests) an unset folder is a temporary one; on a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", where)
    own = f"{where.rstrip('/')}/lectern-{spark.sparkContext.applicationId}"
    if own not in _ours:
        _ours.add(own)
        path, fs = hadoop(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def hadoop(spark: SparkSession, where: str):
    """(path, file system) of Hadoop for an address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, name: str) -> str:
    """A new address in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path, fs = hadoop(df.sparkSession, df._written_to)
        fs.delete(path, True)
