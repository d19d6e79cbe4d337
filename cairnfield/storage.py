"""Tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where no shared folder is named and everything runs on one machine, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/cairnfield"
#: Spark's setting by which a query's shuffle files go when it ends; else they stay until the driver's objects are collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on one machine a local one.
    A cluster without that setting is an error, as its machines don't see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{new_name(name)}"


def new_name(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than a read of the files. What the write
    shuffled is freed when it has ended, as nothing reads it again.
    """
    path = new_path(df.sparkSession, name)
    before = df.sparkSession.conf.get(FREED)
    df.sparkSession.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark sees them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    files, target = hadoop_path(spark, path)
    files.delete(target, True)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            removed(table.sparkSession, file.rsplit("/", 1)[0])
