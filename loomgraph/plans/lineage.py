"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a
    cluster that is an error, since executors would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        _file_system(spark, root)[0].deleteOnExit(_file_system(spark, root)[1])
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def _file_system(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared root; what is there goes when the session ends."""
    folder = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, path = _file_system(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder: lineage ends here, and a lost executor costs nothing that came before."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tasks per core that write a table made by a shuffle.
WAVES = 4


def keep(df: DataFrame, shuffled: bool = False) -> DataFrame:
    """``cut`` by a Parquet table, which is smaller than a checkpoint, is read by columns and goes by ``forget``.

    ``shuffled``: rows that come from a shuffle, whose partitions may be many and small.  They are
    written in at most ``WAVES`` files a core; a task takes its partitions one after another.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    if shuffled:
        df = df.coalesce(WAVES * spark.sparkContext.defaultParallelism)
    df.write.mode("overwrite").parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._kept_in = folder
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``keep`` that no frame reads any more."""
    for table in tables:
        system, path = _file_system(table.sparkSession, table._kept_in)
        system.delete(path, True)
