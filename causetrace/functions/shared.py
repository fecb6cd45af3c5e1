"""Rows that are used more than once are written once, where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may lack it, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="causetrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{shared_folder(spark)}/causetrace-{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def settled(df: DataFrame, tag: str = "rows") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and not again when an executor is lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._settled_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``settled`` table that nothing reads any more; other tables are left alone."""
    path = getattr(df, "_settled_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
