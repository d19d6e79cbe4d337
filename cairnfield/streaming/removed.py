"""Removed points as a stream: each compaction publishes those it purged, readers get each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.storage import hadoop_path, new_name, removed

#: A compaction's folder; Spark reads the number as a column.
NUMBER = "compaction"
#: Spark's file stream passes over files that are older than this, seen from the newest one.
NEVER = "36500d"


def publish(points: DataFrame, folder: str, number: int) -> bool:
    """Add the points that compaction ``number`` removed to the feed in ``folder``.

    They are written beside the feed and then take their place by one rename, so readers see
    all of a compaction or nothing, and a compaction that runs again after a failure changes
    nothing: the result is False if ``number`` was published before. One writer at a time.

    Defined cases: a compaction without removed points is published too; repeated points
    are points of their own; a column with the name of the number is an error.
    """
    if number < 0 or NUMBER in points.columns:
        raise ValueError(f"compactions are numbered from 0, and points have no column {NUMBER}")
    spark = points.sparkSession
    files, place = hadoop_path(spark, f"{folder}/{NUMBER}={number}")
    if files.exists(place):
        return False
    draft = f"{folder}/_{new_name('draft')}"
    points.write.parquet(draft)
    if not files.rename(hadoop_path(spark, draft)[1], place):
        removed(spark, draft)
        raise OSError(f"{draft} couldn't become {place}")
    return True


def feed(spark: SparkSession, folder: str, points: T.StructType) -> DataFrame:
    """The feed as a stream of ``points``' columns and ``compaction int``. A query's checkpoint
    remembers which files it has taken, so a query that is started again goes on after them."""
    schema = T.StructType([*points, T.StructField(NUMBER, T.IntegerType())])
    return spark.readStream.schema(schema).option("maxFileAge", NEVER).parquet(folder)


def deliver(spark: SparkSession, folder: str, points: T.StructType, into: str) -> None:
    """Append what the feed holds and ``into`` doesn't have yet to the table in ``into``, whose
    log of batches keeps a batch that runs again from being stored twice."""
    out = feed(spark, folder, points).writeStream.format("parquet").outputMode("append")
    out.option("path", f"{into}/points").option("checkpointLocation", f"{into}/progress").trigger(availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, into: str, points: T.StructType) -> DataFrame:
    """All points that were delivered, with the number of the compaction that removed them."""
    schema = T.StructType([*points, T.StructField(NUMBER, T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{into}/points").select(*(F.col(c) for c in schema.names))
